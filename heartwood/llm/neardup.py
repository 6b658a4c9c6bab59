"""Near-duplicate embeddings: random-hyperplane tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.llm.common import binaries, group_starts, keep, map_arrow, whole_groups
from heartwood.llm.components import components
from heartwood.llm.tiles import comparable, spanning, tiled

#: Rows a bucket should hold, and the share of pairs just at the threshold that no table may bring together.
BUCKET, MISS = 32, 0.003


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """The random hyperplanes, the same in every task."""
    return np.random.default_rng([dim, bits, tables]).standard_normal((dim, tables * bits))


def shape(rows: int, threshold: float) -> tuple[int, int]:
    """Bits and tables for so many vectors: buckets stay as full and the recall at the threshold stays the same."""
    bits = min(24, max(6, math.ceil(math.log2(max(rows, 1) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-meet))


def signatures(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """One row per node and table: `bucket`, `slot` (the table), `node`, `mult`, `vec`, `sigs` (of all tables)."""
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
                x = binaries(part["vec"], "<f8")
                sides = (x @ planes(dim, bits, tables) > 0).reshape(len(x), tables, bits)
                sigs = (sides @ weights).astype("<i4")
                rows = [row.tobytes() for row in sigs]
                for table in range(tables):
                    bucket = (sigs[:, table].astype(np.int64) * 256 + table) * 2**31 + dim  # 24, 8 and 31 bits
                    yield pa.record_batch(
                        {
                            "bucket": bucket,
                            "slot": np.full(len(x), table, np.int32),
                            "node": part["node"].combine_chunks(),
                            "mult": part["mult"].combine_chunks(),
                            "vec": part["vec"].combine_chunks(),
                            "sigs": pa.array(rows, pa.binary()),
                        }
                    )

    return map_arrow(nodes, run, "bucket long, slot int, node long, mult long, vec binary, sigs binary")


def tile_links(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node of each tile that has links no earlier table shows: node, linked vectors, a node that spans."""
    node, mult, side, cross, slot = (table[name].to_numpy() for name in ("node", "mult", "side", "cross", "slot"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    starts = group_starts(table, ["bucket", "tile"])
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
        if end - start < 2:
            continue
        rows = table.slice(start, end - start)
        x = binaries(rows["vec"], "<f8")
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        near = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
        near &= comparable(side[start:end], cross[start])
        if not near.any():
            continue
        sigs = binaries(rows["sigs"], "<i4")
        i, j = np.nonzero(near)
        fresh = ~(sigs[i, : slot[start]] == sigs[j, : slot[start]]).any(axis=1)
        near[i[~fresh], j[~fresh]] = False
        mine, weight = node[start:end], mult[start:end]
        count = near @ weight
        has = np.flatnonzero(count)
        out.append((mine[has], count[has], mine[spanning(near)][has]))
    if not out:
        return node[:0], mult[:0], node[:0]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def embedding_groups(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept`: links of cosine >= `threshold` (double precision).

    Links are those found by the tables: bits and tables follow the number of distinct vectors so that a pair
    just at the threshold is missed with probability 0.003 at every size (closer pairs far less); none below
    the threshold is reported. Equal vectors are one node with a multiplicity; buckets that many distinct
    vectors share are cut into tiles, and a pair counts in the first table that shows it.

    Null, zero, empty vectors and those with null or non-finite components link with nothing, and so do rows
    with a null id (component_id null, kept false). Vectors link only with those of as many components. Rows
    that share an id are vectors of their own; the id is one node, so they report the same component, and what is
    reachable from one is reachable from all. An empty table gives no rows;
    other columns are not read.
    """
    values = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v"))
    sound = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.array_max(F.transform("v", F.abs))
    sound = F.coalesce(F.col("vec_id").isNotNull() & sound & (top > 0), F.lit(False))
    usable = keep(rows.select("vec_id", F.when(sound, F.col("v")).alias("v"), top.alias("top")), "vectors")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths = batch["v"].flatten().to_numpy(), batch["v"].value_lengths().to_numpy()
            ends = np.cumsum(lengths)
            blobs = [(flat[e - n : e] / t).astype("<f8").tobytes() for e, n, t in zip(ends, lengths, batch["top"].to_numpy())]
            yield pa.record_batch({"vec_id": batch["vec_id"], "dim": lengths.astype(np.int32), "vec": pa.array(blobs, pa.binary())})

    packed = keep(usable.where("v is not null").mapInArrow(pack, "vec_id long, dim int, vec binary"), "packed")
    distinct = packed.groupBy("vec", "dim").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"))
    nodes = keep(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bits, tables = shape(nodes.count(), threshold)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "tile"]):
            a, n, b = tile_links(table, threshold)
            yield pa.record_batch({"a": a, "links": n, "b": b})

    hashed = keep(signatures(nodes.select("node", "dim", "mult", "vec"), bits, tables), "signatures")
    found = keep(map_arrow(tiled(hashed, "node"), verify, "a long, links long, b long"), "found")
    drop_columns = nodes.select("node", "vec", "first", "mult")
    degree = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    shared = usable.groupBy("vec_id").agg(F.count("*").alias("n")).where("vec_id is not null and n > 1").select("vec_id")
    repeats = not shared.isEmpty()
    links = found.select("a", "b")
    if repeats:  # rows of one id belong together, whatever their vectors
        own = packed.join(shared, "vec_id", "left_semi").join(nodes.select("vec", "node"), "vec").select("vec_id", "node")
        one = own.groupBy("vec_id").agg(F.min("node").alias("b"))
        links = links.unionByName(own.join(one, "vec_id").select(F.col("node").alias("a"), "b").where("a <> b"))
    groups = components(links).withColumnsRenamed({"id": "node", "component": "root"})
    rooted = drop_columns.join(degree, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")
    result = rooted.join(least, "root").select("vec", n_links, "component_id")
    linked = packed.join(result, "vec").select("vec_id", "n_links", "component_id")
    alone = usable.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if repeats:
        known = linked.join(shared, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("component_id").alias("known"))
        alone = alone.join(known, "vec_id", "left").select("vec_id", "n_links", F.coalesce("known", "component_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)
