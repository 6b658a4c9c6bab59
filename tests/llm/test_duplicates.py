"""Near-duplicate and substring operators against brute force."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from heartwood.llm.components import components
from heartwood.llm.neardup import embedding_groups
from heartwood.llm.simhash import one_per_group, simhash_groups
from heartwood.llm.substrings import drop_shared_windows, without_shared_windows
from heartwood.llm.suffixes import drop_repeated_substrings
from heartwood.llm.tiles import tiled

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_reachable(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (7, None), (301, 301)], "a long, b long")
    found = {r.id: r.component for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1200), 1000)}
    assert components(links.limit(0)).count() == 0


def test_tiles_meet_every_pair_once(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).cast("long").alias("bucket"), "id")
    met = Counter()
    for (_, _, cross), group in tiled(rows, "id", chunk=50).toPandas().groupby(["bucket", "tile", "cross"]):
        ids, side = group.id.to_numpy(), group.side.to_numpy()
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                if not cross or side[i] != side[j]:
                    met[tuple(sorted((ids[i], ids[j])))] += 1
    assert set(met.values()) == {1}
    assert len(met) == 400 * 399 // 2


def fingerprint(text, words):
    tokens = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(awkward, spark):
    rows = awkward.select("doc_id", "text").collect()
    prints = [fingerprint(r.text, 3) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    label = smallest_reachable(len(rows), pairs)
    least = {k: min((rows[i].doc_id for i in range(len(rows)) if label[i] == k and rows[i].doc_id is not None), default=None) for k in label}
    expected = Counter((r.doc_id, p, least[k]) for r, p, k in zip(rows, prints, label, strict=True))
    found = simhash_groups(awkward).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == expected


def test_spark_hash_is_the_same_xxh64(spark):
    row = spark.sql("SELECT xxhash64('the same three') AS h").first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"the same three", 42)


def test_one_row_of_each_group_stays(awkward):
    left = one_per_group(awkward).collect()
    copies = [r.doc_id for r in left if r.doc_id in (110, 111, 112, 113)]
    assert copies == [110]
    assert sorted(r.doc_id for r in left if r.doc_id is not None and r.doc_id < 40) == list(range(30))
    assert sum(r.doc_id is None for r in left) == 1
    assert left[0].asDict().keys() == set(awkward.columns)


def brute_words(rows, window):
    tokens = [WORD.findall(r.text or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in tokens for i in range(len(w) - window + 1))
    out = Counter()
    for row, w in zip(rows, tokens, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[row.doc_id, len(w), int(gone.sum()), kept] += 1
    return out


def test_shared_windows_equal_brute_force(awkward):
    expected = brute_words(awkward.select("doc_id", "text").collect(), 35)
    found = drop_shared_windows(awkward, 35).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in found) == expected
    assert sum(n * k[2] for k, n in expected.items()) > 300


def test_whole_rows_keep_their_columns_and_untouched_texts(awkward):
    before = {r.fp: r for r in awkward.collect()}
    after = {r.fp: r for r in without_shared_windows(awkward, 35).collect()}
    assert {k: (r.doc_id, r.source, r.bucket, r["copy"]) for k, r in after.items()} == {
        k: (before[k].doc_id, before[k].source, before[k].bucket, before[k]["copy"]) for k in after
    }
    assert all(after[k].text == before[k].text for k in after if before[k].doc_id in (102, 103, 104, 116))
    gone = {before[k].doc_id for k in before if k not in after}
    assert {110, 111, 112} <= gone
    assert not gone & {100, 101, 102, 103, 104, 116}


def test_repeated_bytes_equal_brute_force(awkward):
    docs = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    seen, expected = {}, {}
    for row in sorted(docs.select("doc_id", "text").collect()):
        body = (row.text or "").encode()
        strings = [body[i : i + 50] for i in range(len(body) - 49)]
        gone = np.zeros(len(body), bool)
        for i, s in enumerate(strings):
            if s in seen:
                gone[i : i + 50] = True
        seen |= dict.fromkeys(strings)
        spans = int(np.count_nonzero(np.diff(gone, prepend=False)[gone]))
        expected[row.doc_id] = (len(body), np.frombuffer(body, np.uint8)[~gone].tobytes(), spans)
    found = {r.doc_id: (r.n_bytes, bytes(r.kept), len(r.spans)) for r in drop_repeated_substrings(docs).collect()}
    assert found == expected


def test_repeated_rows_leave_one_text(awkward):
    kept = [bytes(r.kept) for r in drop_repeated_substrings(awkward).collect() if r.doc_id == 112 or r.doc_id is None]
    assert sorted(len(k) > 0 for k in kept) == [False, False, False, True, True]


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(1)
    base = draw.standard_normal((60, 16))
    near = [base[k % 5] + draw.standard_normal(16) * 0.12 for k in range(700)]
    rows = [(k, v.tolist()) for k, v in enumerate([*base, *near, *[base[0]] * 40, base[1] * 3])]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows += [(2000 + k, v) for k, v in enumerate(odd)] + [(None, base[0].tolist())]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, node int, mult string")


def test_embedding_groups_equal_brute_force(vectors):
    rows = [r for r in vectors.collect() if r.vec_id is not None]
    usable = [bool(r.embedding) and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding) for r in rows]
    pairs = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if usable[i] and usable[j] and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding), np.array(b.embedding)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    pairs.append((i, j))
    degree = Counter(k for p in pairs for k in p)
    label = smallest_reachable(len(rows), pairs)
    expected = {r.vec_id: (degree[k], rows[label[k]].vec_id) for k, r in enumerate(rows)}
    found = embedding_groups(vectors).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, False)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id is not None}
    assert got.keys() == expected.keys()
    assert sum(n for n, _ in got.values()) >= 0.99 * 2 * len(pairs)
    assert all(got[k][0] <= expected[k][0] and got[k][1] == expected[k][1] for k in got)


def test_empty_tables_give_no_rows(nothing, vectors):
    assert embedding_groups(vectors.limit(0)).count() == 0
    for operator in (simhash_groups, one_per_group, drop_shared_windows, without_shared_windows, drop_repeated_substrings):
        assert operator(nothing).count() == 0
