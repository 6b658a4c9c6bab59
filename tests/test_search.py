from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heartwood.operators.search import search_bm25, search_knn, search_knn_every
from heartwood.sources.tables import load_table


def brute_bm25(documents: dict[str, str], query: str) -> dict[str, float]:
    words = {key: re.findall("[a-z]+", text.lower()) for key, text in documents.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    scores = {}
    for key, found in words.items():
        counts, total = Counter(found), 0.0
        for term in set(re.findall("[a-z]+", query.lower())):
            df = sum(term in w for w in words.values())
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            total += idf * counts[term] * 2.2 / (counts[term] + 1.2 * (0.25 + 0.75 * len(found) / mean))
        if total > 0:
            scores[key] = round(total, 6)
    return scores


def corpus_rows(rows, documents):
    values = ", ".join(
        f"('{i}', '{text}', '{'call_transcript' if i % 2 else 'interaction_note'}', 'Phone', TIMESTAMP_NTZ '2024-01-01 00:00:00', '{key}')"
        for i, (key, text) in enumerate(documents.items())
    )
    return rows("customer_id, search_text, source_type, channel, event_date, document_key", values)


DOCUMENTS = {
    "a": "late claim, the claim is late",
    "b": "the weather " * 50,
    "c": "claim " + "filler " * 300 + "premium",
    "d": "",
    "e": "The PREMIUM of the claim",
}


def test_bm25_equals_brute_force(rows):
    queries = {"q1": "claim premium", "q2": "the the late", "q3": "unseen"}
    found = search_bm25(corpus_rows(rows, DOCUMENTS), queries, 10).collect()
    for name, text in queries.items():
        got = {r.document_key: r.score for r in found if r.query_id == name}
        assert got == pytest.approx(brute_bm25(DOCUMENTS, text), abs=1e-6)


def test_filter_limits_hits_not_statistics(rows):
    corpus = corpus_rows(rows, DOCUMENTS)
    found = search_bm25(corpus, {"q": "claim"}, 10, F.col("source_type") == "interaction_note").collect()
    expected = {k: v for k, v in brute_bm25(DOCUMENTS, "claim").items() if k in "ace"}
    assert {r.document_key: r.score for r in found} == pytest.approx(expected, abs=1e-6)


def test_ranks_and_ties(rows):
    found = search_bm25(corpus_rows(rows, {"b": "x y", "a": "x y", "c": "z"}), {"q": "x"}, 1).collect()
    assert [(r.document_key, r.rank) for r in found] == [("a", 1)]


def test_knn_equals_brute_force(spark, sf_dir):
    embeddings = load_table(spark, sf_dir, "embeddings")
    local = {r.vec_id: np.array(r.embedding, dtype=float) for r in embeddings.collect()}
    found = search_knn(embeddings, [3, 5], 4).collect()
    for query in (3, 5):
        q = local[query]
        cosine = {k: round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 6) for k, v in local.items() if k != query}
        best = sorted(cosine, key=lambda k: (-cosine[k], k))[:4]
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == query] == best


def test_knn_asks_each_id_once(rows):
    df = rows("vec_id, embedding, label", "(1L, array(1f, 0f), 0), (1L, array(1f, 0f), 0), (2L, array(1f, 1f), 0)")
    found = search_knn(df, [1], 5).collect()
    assert [(r.vec_id, r.similarity) for r in found] == [(2, 0.707107)]


def test_knn_in_passes_equals_one_pass(spark, sf_dir):
    embeddings = load_table(spark, sf_dir, "embeddings")
    ids = list(range(7))
    assert sorted(search_knn(embeddings, ids, 3, at_once=2).collect()) == sorted(search_knn(embeddings, ids, 3).collect())


def test_every_hundredth_vector_is_asked(spark, sf_dir):
    embeddings = load_table(spark, sf_dir, "embeddings")
    ids = [r.vec_id for r in embeddings.where("vec_id % 100 = 0").collect()]
    found = search_knn_every(embeddings, 100, 3, block=64).collect()
    assert {r.query_id for r in found} == set(ids) and len(ids) > 3
    assert sorted(found) == sorted(search_knn(embeddings, ids, 3).collect())


def test_every_with_nulls_zeros_and_other_lengths(rows):
    values = "(0L, array(1f, 0f), 0), (1L, array(0f, 0f), 1), (2L, NULL, 2), (3L, array(1f, 1f, 1f), 3), (4L, array(1f, 1f), NULL), (100L, array(0f, 1f), 5)"
    df = rows("vec_id, embedding, label", values)
    key = lambda r: (r.query_id, r["rank"])
    assert sorted(search_knn_every(df, 100, 9).collect(), key=key) == sorted(search_knn(df, [0, 100], 9).collect(), key=key)
