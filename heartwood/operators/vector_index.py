"""A stored index of vectors around pivots: exact nearest neighbours by cosine without comparing all pairs.

On unit vectors the cosine falls as the distance grows, and distances obey the triangle inequality. Each vector
belongs to its nearest pivot and to a ring around it; a cell (pivot and ring) with distances from `low` to `high` can
hold nothing nearer to a query than `low - d` or `d - high`, where `d` is the query's distance from the pivot.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.functions.frames import top_per_key
from heartwood.sources.files import SharedFiles

#: Pivots and rings around each: the cells that every task knows are at most their product, whatever the table.
PIVOTS, RINGS = 256, 8
#: Vectors that are packed together, about, and rows of queries that are taken together.
CHUNK, TOGETHER = 1000, 1000
#: Similarities are rounded to so many digits, and rows just below a rounded value may tie with it.
DIGITS, TIE, SLACK = 6, 1e-6, 1e-9

ASSIGNED = "vec_id long, label int, pivot int, distance double, vector binary"
CELLS = "cell int, pivot int, low double, high double, n long, chunks long"
CHUNKS = "cell int, chunk int, ids array<long>, labels array<int>, vectors binary"
RESULT = "query_id long, vec_id long, label int, similarity double"


def _sound(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be compared, and these as rows. All must be of one length."""
    usable = [v is not None and len(v) > 0 and None not in v for v in vectors]
    lengths = {len(v) for v, ok in zip(vectors, usable, strict=True) if ok}
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(lengths)}")
    rows = np.array([v for v, ok in zip(vectors, usable, strict=True) if ok], float).reshape(sum(usable), max(lengths, default=0))
    fine = np.isfinite(rows).all(axis=1) & (np.abs(rows).max(axis=1, initial=0) > 0)
    at = np.flatnonzero(usable)[fine]
    return at, rows[fine]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T)))


def _as_bytes(rows: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in rows]


@dataclass(frozen=True)
class Cells:
    """What every task knows: the pivots, and the bounds and sizes of the cells."""

    pivots: np.ndarray
    number: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """The least distance that each vector can have from the rows of each cell."""
        d = _distances(units, self.pivots)[:, self.pivot]
        return np.maximum(0.0, np.maximum(d - self.high, self.low - d) - SLACK)


@dataclass(frozen=True)
class VectorIndex:
    path: str

    @staticmethod
    def build(embeddings: DataFrame, path: str, pivots: int = PIVOTS, rings: int = RINGS) -> VectorIndex:
        """Index `vec_id`, `label`, `embedding`.

        The pivots are the vectors with the smallest hashes of their ids, `pivots` at most: a bounded sample that
        decides how much is skipped, never what is found. Vectors that are null, zero, or hold null or non-finite
        components are not indexed; ids that are null neither. Cells are packed in chunks of about 1000 vectors, so
        a cell that holds a third of all rows is spread over many tasks.
        """
        spark = embeddings.sparkSession
        index = VectorIndex(path.rstrip("/"))
        rows = embeddings.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v")
        )
        first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()
        _, chosen = _sound([r.v for r in first])
        chosen = _unit(chosen) if len(chosen) else chosen

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, found = _sound(batch["v"].to_pylist())
                if not len(at):
                    continue
                near = _distances(_unit(found), chosen) if len(chosen) else np.zeros((len(at), 1))
                pivot = near.argmin(axis=1)
                picked = batch.take(pa.array(at))
                columns = [picked["vec_id"], picked["label"], pa.array(pivot, pa.int32()), pa.array(near[np.arange(len(at)), pivot]), pa.array(_as_bytes(found), pa.binary())]
                yield pa.record_batch(columns, ["vec_id", "label", "pivot", "distance", "vector"])

        rows.mapInArrow(assign, ASSIGNED).write.mode("overwrite").parquet(f"{index.path}/assigned")
        assigned = spark.read.schema(ASSIGNED).parquet(f"{index.path}/assigned")
        cuts = [i / rings for i in range(1, rings)]
        edges = assigned.groupBy("pivot").agg(F.percentile_approx("distance", cuts, 1000).alias("edges") if cuts else F.array().alias("edges"))
        ring = F.size(F.filter("edges", lambda edge: edge < F.col("distance")))
        placed = assigned.join(F.broadcast(edges), "pivot").withColumn("cell", (F.col("pivot") * rings + ring).cast("int")).drop("edges")
        cells = placed.groupBy("cell", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"))
        cells = cells.withColumn("chunks", F.ceil(F.col("n") / CHUNK))
        cells.select("cell", "pivot", "low", "high", "n", "chunks").write.mode("overwrite").parquet(f"{index.path}/cells")
        sizes = spark.read.schema(CELLS).parquet(f"{index.path}/cells").select("cell", "chunks")
        chunk = F.pmod(F.xxhash64("vec_id"), "chunks").cast("int")
        dealt = placed.join(F.broadcast(sizes), "cell").withColumn("chunk", chunk).select("cell", "chunk", "vec_id", "label", "vector")

        def pack(group: pa.Table) -> pa.Table:
            group = group.sort_by("vec_id")
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            values = group["cell"][0].as_py(), group["chunk"][0].as_py(), group["vec_id"].to_pylist(), group["label"].to_pylist(), b"".join(group["vector"].to_pylist())
            return pa.table([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], ["cell", "chunk", "ids", "labels", "vectors"])

        dealt.groupBy("cell", "chunk").applyInArrow(pack, CHUNKS).write.mode("overwrite").parquet(f"{index.path}/chunks")
        spark.createDataFrame([(_as_bytes(chosen),)], "pivots array<binary>").write.mode("overwrite").parquet(f"{index.path}/pivots")
        SharedFiles(spark, index.path).remove("assigned")
        return index

    def cells(self, spark: SparkSession) -> Cells:
        raw = spark.read.schema("pivots array<binary>").parquet(f"{self.path}/pivots").first().pivots
        pivots = np.array([np.frombuffer(p) for p in raw]) if raw else np.zeros((0, 0))
        rows = spark.read.schema(CELLS).parquet(f"{self.path}/cells").orderBy("cell").collect()
        column = lambda name, kind: np.array([r[name] for r in rows], kind)
        return Cells(pivots, column("cell", int), column("pivot", int), column("low", float), column("high", float), column("n", int))

    def search(self, queries: DataFrame, k: int = 10, name: str = "search") -> tuple[DataFrame, DataFrame]:
        """The ``k`` nearest vectors of each query, itself left out, and the pairs it took to find them.

        `queries` has `query_id` and `embedding`. Each query first meets the cells that can be nearest, until they
        hold ``k`` vectors besides itself; their ``k``-th similarity bounds what the others must offer, and it then
        meets those that can. A pair of query and cell that the bound rules out is never made. Queries that cannot
        be compared (see `build`) have no neighbours. The second frame has `round`, `cell`, `compared`.
        """
        spark = queries.sparkSession
        known = self.cells(spark)
        asked = queries.filter("query_id IS NOT NULL").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("v"))
        asked.write.mode("overwrite").parquet(f"{self.path}/{name}/queries")
        asked = spark.read.schema("query_id long, v array<double>").parquet(f"{self.path}/{name}/queries")
        first = self._round(asked.withColumn("least", F.lit(None).cast("double")), known, k, f"{name}/first")
        least = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("least")).select(
            "query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("least")
        )
        second = self._round(asked.join(least, "query_id", "left").fillna(-2.0, ["least"]), known, k, f"{name}/second")
        order = [F.col("similarity").desc(), F.col("vec_id").asc()]
        found = top_per_key(first.unionByName(second), ["query_id"], order, k, rank="rank")
        made = [spark.read.schema("cell int, compared long").parquet(f"{self.path}/{name}/{turn}-pairs").select(F.lit(turn).alias("round"), "cell", "compared") for turn in ("first", "second")]
        return found, made[0].unionByName(made[1])

    def _round(self, asked: DataFrame, known: Cells, k: int, name: str) -> DataFrame:
        """Queries meet cells: without `least` the first ones, with it all others that can hold a neighbour."""
        spark = asked.sparkSession

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low in range(0, whole.num_rows, TOGETHER):
                    batch = whole.slice(low, TOGETHER)
                    at, found = _sound(batch["v"].to_pylist())
                    if not len(at) or not len(known.number):
                        continue
                    bounds = known.bounds(_unit(found))
                    order = np.argsort(bounds, axis=1, kind="stable")
                    before = np.cumsum(known.n[order], axis=1) - known.n[order]
                    early = np.zeros(bounds.shape, bool)
                    np.put_along_axis(early, order, before < k + 1, axis=1)
                    if batch["least"].null_count:
                        meets = early
                    else:
                        least = batch["least"].to_numpy()[at]
                        reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (least - TIE))) + SLACK
                        meets = ~early & (bounds <= reach[:, None])
                    ids = batch["query_id"].to_numpy()[at]
                    for column in np.flatnonzero(meets.any(axis=0)):
                        some = np.flatnonzero(meets[:, column])
                        values = [int(known.number[column])], [ids[some].tolist()], [found[some].tobytes()], [len(some) * int(known.n[column])]
                        kinds = pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64()
                        yield pa.record_batch([pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)], ["cell", "queries", "asked", "compared"])

        pairs = "cell int, queries array<long>, asked binary, compared long"
        asked.mapInArrow(blocks, pairs).write.mode("overwrite").parquet(f"{self.path}/{name}-pairs")
        made = spark.read.schema(pairs).parquet(f"{self.path}/{name}-pairs").drop("compared")
        chunks = spark.read.schema(CHUNKS).parquet(f"{self.path}/chunks")
        chunks.join(made, "cell").mapInArrow(lambda batches: _compare(batches, k), RESULT).write.mode("overwrite").parquet(f"{self.path}/{name}")
        every = spark.read.schema(RESULT).parquet(f"{self.path}/{name}")
        return top_per_key(every, ["query_id"], [F.col("similarity").desc(), F.col("vec_id").asc()], k)


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of each chunk for each query that met its cell."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
    for batch in batches:
        for n in range(batch.num_rows):
            ids, labels, queries = (batch[name][n].as_py() for name in ("ids", "labels", "queries"))
            rows = np.frombuffer(batch["vectors"][n].as_py()).reshape(len(ids), -1)
            asked = np.frombuffer(batch["asked"][n].as_py()).reshape(len(queries), -1)
            norms = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
            similarity = np.round(asked @ rows.T / norms, DIGITS) + 0.0  # no negative zero
            similarity[np.array(queries)[:, None] == np.array(ids)[None, :]] = -np.inf
            best = np.argsort(-similarity, axis=1, kind="stable")[:, :k]  # rows come by id
            at = np.repeat(np.arange(len(queries)), best.shape[1])
            picked = best.ravel()
            fine = np.isfinite(similarity[at, picked])
            yield _result(queries, ids, labels, similarity, at[fine], picked[fine], kinds)


def _result(queries: Sequence, ids: Sequence, labels: Sequence, similarity: np.ndarray, at: np.ndarray, picked: np.ndarray, kinds: tuple) -> pa.RecordBatch:
    values = [queries[i] for i in at], [ids[j] for j in picked], [labels[j] for j in picked], similarity[at, picked].tolist()
    return pa.record_batch([pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)], ["query_id", "vec_id", "label", "similarity"])
