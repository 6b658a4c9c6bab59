"""Search over calls and notes: the corpus, BM25 ranking, nearest vectors."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartwood.functions.columns import is_blank
from heartwood.functions.frames import top_per_key
from heartwood.operators.enrich import WORD, words_of

K1 = 1.2
B = 0.75


def search_corpus(transcripts: DataFrame, interactions: DataFrame) -> DataFrame:
    calls = transcripts.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("transcript_text").alias("search_text"),
        F.lit("call_transcript").alias("source_type"),
        F.lit("Phone").alias("channel"),
        F.col("call_date").alias("event_date"),
        F.concat(F.lit("call_"), "transcript_id").alias("document_key"),
    )
    notes = interactions.filter(~is_blank(F.col("notes"))).select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.concat(F.coalesce("subject", F.lit("")), F.lit(". "), F.coalesce("notes", F.lit(""))).alias("search_text"),
        F.lit("interaction_note").alias("source_type"),
        "channel",
        F.col("interaction_date").alias("event_date"),
        F.concat(F.lit("interaction_"), "interaction_id").alias("document_key"),
    )
    return calls.unionByName(notes)


def _occurrences(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def search_bm25(
    corpus: DataFrame, queries: Mapping[str, str], k: int = 10, where: Column | None = None
) -> DataFrame:
    """Best ``k`` documents per query by BM25 over the whole texts.

    The asked terms are part of the plan, so each document counts only those
    words, in its own row: no index of all words is shuffled, and a stop word
    costs nothing unless it is asked for. Collection statistics come from one
    aggregate with a count per asked term, so the corpus is read twice: for many
    searches, hand in a written one. ``where`` restricts the hits, not the
    statistics.
    """
    asked = {name: sorted(set(re.findall(WORD, text.lower()))) for name, text in queries.items()}
    terms = sorted({term for words in asked.values() for term in words})
    counted = (
        corpus.withColumn("_words", words_of(F.col("search_text")))
        .withColumn("_length", F.size("_words"))
        .withColumn("_asked", F.filter("_words", lambda w: w.isin(*terms)))
        .drop("_words", "search_text")
    )
    counted = counted.withColumns({f"_tf_{term}": _occurrences("_asked", term) for term in terms}).drop("_asked")
    stats = counted.agg(
        F.count("*").alias("n"),
        F.sum("_length").alias("length"),
        *[F.count(F.when(F.col(f"_tf_{t}") > 0, 1)).alias(f"df_{t}") for t in terms],
    )
    collection = stats.select(F.struct("*").alias("_stats")).scalar()
    hits = counted.filter(where) if where is not None else counted
    # The subquery stays a column until the weights are computed, so it runs once.
    hits = hits.withColumn("_s", collection)
    norm = 1 - F.lit(B) + F.lit(B) * F.col("_length") / (F.col("_s.length").cast("double") / F.col("_s.n"))

    def weight(term: str) -> Column:
        n, df = F.col("_s.n").cast("double"), F.col(f"_s.df_{term}").cast("double")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        count = F.col(f"_tf_{term}").cast("double")
        return F.when(count > 0, idf * count * (K1 + 1) / (count + F.lit(K1) * norm)).otherwise(0.0)

    per_query = F.array(
        *[
            F.struct(F.lit(name).alias("query_id"), F.round(sum((weight(t) for t in words), F.lit(0.0)), 6).alias("score"))
            for name, words in asked.items()
        ]
    )
    scored = (
        hits.withColumn("_hit", F.explode(F.filter(per_query, lambda h: h["score"] > 0)))
        .select("_hit.query_id", "document_key", "customer_id", "source_type", "channel", "event_date", "_hit.score")
    )
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("document_key").asc()], k, rank="rank")


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def search_knn(embeddings: DataFrame, query_ids: Sequence[int], k: int = 10, at_once: int = 1000) -> DataFrame:
    """Exact cosine neighbours of the named vectors, the query itself left out.

    One array holds the query vectors: its size is the number of ids asked for,
    never that of the table. Each row is compared with that array in place. More
    ids than ``at_once`` are answered in several passes.
    """
    if len(query_ids) > at_once:
        first, rest = query_ids[:at_once], query_ids[at_once:]
        return search_knn(embeddings, first, k, at_once).unionByName(search_knn(embeddings, rest, k, at_once))
    wanted = embeddings.filter(F.col("vec_id").isin(*query_ids)).groupBy(F.col("vec_id").alias("query_id"))
    # One vector per id, so copies of an id cannot lengthen the list.
    asked = wanted.agg(F.min("embedding").alias("q")).withColumn("norm", _norm(F.col("q")))
    compared = (
        embeddings.withColumn("_norm", _norm(F.col("embedding")))
        .withColumn("_query", F.explode(asked.agg(F.collect_list(F.struct("query_id", "q", "norm"))).scalar()))
        .filter(F.col("vec_id") != F.col("_query.query_id"))
        .select(
            F.col("_query.query_id").alias("query_id"),
            "vec_id",
            "label",
            F.round(
                F.try_divide(_dot(F.col("embedding"), F.col("_query.q")), F.col("_norm") * F.col("_query.norm")), 6
            ).alias("similarity"),
        )
    )
    return top_per_key(compared, ["query_id"], [F.col("similarity").desc_nulls_last(), F.col("vec_id").asc()], k, rank="rank")


def _packed(rows: DataFrame, name: str, block: int) -> DataFrame:
    """Blocks of at most ``block`` rows, each one pickle of ids, labels and vectors (None where a component is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block).sort_by("vec_id")
                vectors = [None if v is None or None in v else np.array(v, float) for v in part["v"].to_pylist()]
                yield pa.record_batch({name: pa.array([pickle.dumps((part["vec_id"].to_pylist(), part["label"].to_pylist(), vectors))], pa.binary())})

    return rows.where("vec_id is not null").mapInArrow(run, f"{name} binary")


def _nearest(rows: bytes, asked: bytes, k: int) -> Iterator[tuple]:
    ids, labels, vectors = pickle.loads(rows)
    query_ids, _, queries = pickle.loads(asked)
    similarity, known = np.full((len(queries), len(ids)), -np.inf), np.zeros((len(queries), len(ids)), bool)
    for dim in {len(v) for v in vectors if v is not None} & {len(q) for q in queries if q is not None}:
        i, j = ([n for n, v in enumerate(side) if v is not None and len(v) == dim] for side in (queries, vectors))
        q, v = (np.array([side[n] for n in at]) for side, at in ((queries, i), (vectors, j)))
        with np.errstate(all="ignore"):
            norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
            similarity[np.ix_(i, j)] = np.where(norms == 0, -np.inf, np.round(q @ v.T / norms, 6))
        known[np.ix_(i, j)] = norms != 0
    order = np.argsort(-np.where(np.isnan(similarity), np.inf, similarity), axis=1, kind="stable")  # rows come by id
    for n, query in enumerate(query_ids):
        best = [j for j in order[n].tolist() if ids[j] != query][:k]
        yield from ((query, ids[j], labels[j], float(similarity[n, j]) if known[n, j] else None) for j in best)


def search_knn_every(embeddings: DataFrame, step: int = 100, k: int = 10, block: int = 1000) -> DataFrame:
    """Exact cosine neighbours of every vector whose id is divisible by ``step``, the query itself left out.

    Results are as in ``search_knn``. Queries and rows stand in blocks of ``block``; each block of queries meets
    each block of rows, and only the best ``k`` per query of such a pair are handed on.
    """
    vectors = F.col("embedding").cast("array<double>").alias("v")
    chunks = _packed(embeddings.select("vec_id", "label", vectors), "rows", block)
    wanted = embeddings.filter(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = _packed(wanted.select("vec_id", F.lit(None).cast("int").alias("label"), vectors), "asked", block)
    schema = "query_id long, vec_id long, label int, similarity double"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("query_id", "vec_id", "label", "similarity")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
        for batch in batches:
            for rows, queries in zip(batch["rows"].to_pylist(), batch["asked"].to_pylist(), strict=True):
                found = list(zip(*_nearest(rows, queries, k), strict=True)) or [()] * 4
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(found, kinds, strict=True)], names)

    compared = chunks.crossJoin(asked).mapInArrow(compare, schema)
    return top_per_key(compared, ["query_id"], [F.col("similarity").desc_nulls_last(), F.col("vec_id").asc()], k, rank="rank")
