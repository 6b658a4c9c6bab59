"""Resampling documents towards the distribution of a target set, by importance weights over hashed n-grams."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.llm.common import map_arrow, utf8
from heartwood.llm.radix import radix_ranks

#: Bytes that words are made of, with capitals folded; all others become spaces. Characters beyond ASCII count.
_FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_HALF, _RANGE = 0.5, 4294967296


def features(body: bytes, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each single word and each pair of neighbours."""
    words = body.translate(_FOLDED).split()
    single = [crc32(word) for word in words]
    pairs = [crc32(word, crc32(b" ", before)) for word, before in zip(words[1:], single, strict=False)]
    return len(words), np.array(single + pairs, np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends its counts, whatever it read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for body in utf8(batch["text"]):
                counts += np.bincount(features(body, buckets)[1], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.record_batch({"bucket": some.astype(np.int32), "n": counts[some]})

    bodies = texts.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("text <> ''")
    rows = map_arrow(bodies, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    counts[[r.bucket for r in rows]] = [r.n for r in rows]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature in each bucket adds: a thousand times the logarithm of the smoothed ratio, rounded down."""
    size, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    ratios = [
        (float(t) + 1.0) * (all_source + size) / ((float(s) + 1.0) * (all_target + size))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ]
    return np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A draw from the Gumbel distribution that depends on nothing but the seed and the id."""
    name = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + _HALF) / _RANGE)))


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    buckets: int = 10_000,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `n_features`, `weight`, `score`, `rank` (null if not drawn).

    Features are single words and pairs of neighbours, each in a bucket of its hash. A bucket's gain is the log
    ratio of its share of the target to its share of `docs`, counted over all texts of both; the gains are an array
    of `buckets` numbers whatever the input, and go to every task. A document's weight is the mean of its gains;
    with hashed Gumbel noise added, the highest scores are a sample without replacement in proportion to the
    weights. Of the documents with `least_words` words or more, `percent` in a hundred are drawn. Ranks come from a
    distributed radix sort (`radix.py`) over score and id.

    Null and empty texts have no features, weight 0, and are not drawn. A null id draws its noise from an empty name
    and comes after all other ids of the same score. Rows that share an id are scored each by itself with the same
    noise; equal rows take neighbouring ranks. An empty target or table counts as no features. Other columns are not read. A
    very long text is handled whole, in one task.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    gain = gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, target_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            out = np.zeros((4, len(ids)), np.int64)
            for at, (doc_id, body) in enumerate(zip(ids, utf8(batch["text"]), strict=True)):
                n_words, found = features(body, buckets)
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                out[:, at] = n_words, len(found), weight, weight + noise(doc_id, seed)
            names = ("n_words", "n_features", "weight", "score")
            yield pa.record_batch({"doc_id": batch["doc_id"], **dict(zip(names, out, strict=True))})

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    scored = map_arrow(rows, run, "doc_id long, n_words long, n_features long, weight long, score long")
    ranked = radix_ranks(scored.withColumn("short", (F.col("n_words") < least_words).cast("int")), [("short", False), ("score", True), ("doc_id", False)])
    long_enough = ranked.agg(F.count(F.when(F.col("short") == 0, 1)).alias("n")).first().n
    drawn = (F.col("short") == 0) & (F.col("rank") <= percent * long_enough // 100)
    return ranked.withColumn("rank", F.when(drawn, F.col("rank"))).drop("short")
