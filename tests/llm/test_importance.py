"""Importance resampling and radix ranks against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

import heartwood.llm.radix as radix
from heartwood.llm.importance import importance_sample
from heartwood.llm.queries import queries
from heartwood.llm.radix import radix_ranks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text):
    words = WORD.findall((text or "").translate(CAPITALS))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute(rows, target, percent=25, least=20, size=10_000, seed=7):
    buckets = lambda text: [zlib.crc32(g.encode()) % size for g in grams(text)[1]]
    source = Counter(b for _, text in rows for b in buckets(text))
    wanted = Counter(b for text in target for b in buckets(text))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + size) / ((source[b] + 1) * (t_all + size))))
    out, long_enough = [], []
    for doc_id, text in rows:
        found = buckets(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
        if grams(text)[0] >= least:
            long_enough.append(out[-1])
    long_enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(long_enough[: percent * len(long_enough) // 100], 1):
        row[4] = rank
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in df.collect())


def test_the_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert rows_of(queries()["op13_importance_resampling"](spark, sf_dir)) == brute(docs, target)


def test_awkward_rows(awkward, nothing, spark):
    target = awkward.where("doc_id in (12, 106, 116) or doc_id is null")
    docs = awkward.withColumnRenamed("bucket", "rank").withColumnRenamed("fp", "score")
    want = brute([(r.doc_id, r.text) for r in awkward.collect()], [r.text for r in target.collect()], percent=60)
    # equal rows are told apart by nothing, so their ranks are compared as sets
    assert rows_of(importance_sample(docs.repartition(5), target, percent=60)) == want
    assert importance_sample(nothing, target).collect() == []
    empty = importance_sample(awkward, nothing)
    assert rows_of(empty) == brute([(r.doc_id, r.text) for r in awkward.collect()], [])


@pytest.mark.parametrize("bits", [2, 17])
def test_ranks_follow_all_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(radix, "BLOCK_BITS", bits)
    numbers = [5, -7, 0, None, 2**63 - 1, -(2**63), 4096, -4096, 5, 5, None, 1]
    rows = [(a, b, k) for k, (a, b) in enumerate((a, b) for a in numbers for b in numbers[:7])]
    df = spark.createDataFrame(rows, "a long, b long, k int").repartition(5)
    found = sorted(radix_ranks(df, [("a", True), ("b", False)]).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in found] == list(range(1, len(rows) + 1))
    order = lambda a, b: (a is None, -(a or 0), b is None, b or 0)
    assert [order(r.a, r.b) for r in found] == sorted(order(a, b) for a, b, _ in rows)
    assert sorted(r.k for r in found) == list(range(len(rows)))


def test_equal_keys_and_no_rows(spark):
    same = spark.range(50).selectExpr("7 AS a", "id").repartition(3)
    assert sorted(r["rank"] for r in radix_ranks(same, [("a", False)]).collect()) == list(range(1, 51))
    assert radix_ranks(same.limit(0), [("a", False)]).collect() == []
