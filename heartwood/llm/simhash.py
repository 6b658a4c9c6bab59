"""SimHash near-duplicates by a grid join over segment popcounts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from heartwood.llm.common import group_starts, keep, map_arrow, texts, utf8, whole_groups
from heartwood.llm.components import components
from heartwood.llm.tiles import comparable, spanning, tiled

BITS, SEED = 64, 42
#: Groups of up to this many rows emit their links as found, larger ones a spanning set.
SMALL = 16
#: Shingles whose bits are counted at a time.
SLICE = 65_536


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of a text: majority bits of the hashes of its word shingles, repeats included."""
    tokens = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(words, len(tokens)) - 1
    spans = zip(starts[: len(tokens) - last].tolist(), ends[last:].tolist(), strict=True)
    hashes = np.array([xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `fp` (the 64 bits as a long), one row per row of `docs`. Null text: no words, fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(text, words) for text in utf8(batch["text"])]
            yield pa.record_batch({"doc_id": batch["doc_id"], "fp": pa.array(fps, pa.int64())})

    return map_arrow(texts(docs, id_col, text_col), run, "doc_id long, fp long")


def grid_rows(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid cells of fingerprints: cell, index into `fps`, whether it is the fingerprint's own cell.

    A fingerprint becomes 32 counts of ones, one per segment of two bits. The Manhattan distance of two such
    points is at most the Hamming distance of the fingerprints. The 32 dimensions are dealt into
    distance // 2 + 1 groups; two points within `distance` are within 1 in at least one group. So each point
    stands in its own cell of each group, and looks into the cells one step up in one dimension: of two points
    one step apart, one looks up to the other.
    """
    groups = distance // 2 + 1
    counts = ((fps[:, None] >> np.arange(0, BITS, 2, dtype=np.uint64)) & np.uint64(3)).astype(np.int64)
    counts -= counts >> 1  # 0 1 2 3 -> 0 1 1 2 ones
    every = np.arange(len(fps))
    cells, index, own = [], [], []
    for number, dims in enumerate(np.array_split(np.arange(BITS // 2), groups)):
        weights = 3 ** np.arange(len(dims), dtype=np.int64)
        cell = counts[:, dims] @ weights * groups + number
        cells.append(cell), index.append(every), own.append(np.ones(len(fps), bool))
        for dim, weight in zip(dims, weights, strict=True):
            up = np.flatnonzero(counts[:, dim] < 2)
            cells.append(cell[up] + weight * groups), index.append(up), own.append(np.zeros(len(up), bool))
    return np.concatenate(cells), np.concatenate(index), np.concatenate(own)


def cell_links(table: pa.Table, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within the tiles of a table: all of a small tile, a spanning set of a large one."""
    fp = table["fp"].to_numpy().view(np.uint64)
    own, side, cross = (table[name].to_numpy() for name in ("own", "side", "cross"))
    starts = group_starts(table, ["bucket", "tile"])
    size = np.diff(np.append(starts, len(fp)))
    a, b = [], []
    left = np.repeat(starts + size, size) - np.arange(len(fp))  # rows from here to the end of the tile
    few = (size <= SMALL) & ~cross[starts]
    small = np.repeat(few, size)
    for step in range(1, min(SMALL, int(size.max()))):
        i = np.flatnonzero(small & (left > step))
        near = (own[i] | own[i + step]) & (np.bitwise_count(fp[i] ^ fp[i + step]) <= distance)
        a.append(fp[i[near]]), b.append(fp[i[near] + step])
    for start, n in zip(starts[~few].tolist(), size[~few].tolist(), strict=True):
        x, mine = fp[start : start + n], own[start : start + n]
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= distance
        near &= comparable(side[start : start + n], cross[start]) & (mine[:, None] | mine[None, :])
        label = spanning(near)
        moved = np.flatnonzero(label != np.arange(n))
        a.append(x[moved]), b.append(x[label[moved]])
    return np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """`a`, `b`: links of at most `distance` bits between the distinct values of `fp`, enough to span every
    component. Grid cells that hold many fingerprints are shared by many tasks and emit no quadratic output."""
    own_schema = "bucket long, fp long, own boolean"

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            cell, index, own = grid_rows(fp, distance)
            yield pa.record_batch({"bucket": cell, "fp": fp[index].view(np.int64), "own": own})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "tile"]):
            a, b = cell_links(table, distance)
            yield pa.record_batch({"a": a.view(np.int64), "b": b.view(np.int64)})

    grid = keep(map_arrow(fps.select("fp").distinct(), cells, own_schema), "grid")
    tiles = tiled(grid, "fp").select("bucket", "tile", "side", "cross", "fp", "own")
    return map_arrow(tiles, verify, "a long, b long")


def rooted(prints: DataFrame, distance: int) -> DataFrame:
    """Kept `fp`, `first` (smallest doc_id that has it), `root` (the same for linked fingerprints)."""
    nodes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    groups = components(links(nodes, distance)).withColumnsRenamed({"id": "fp", "component": "root"})
    return keep(nodes.join(groups, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")


def simhash_groups(
    docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id`, `fp`, `component_id` (smallest doc_id reachable by links of at most `distance` bits).

    One row per row of `docs`. Equal fingerprints are one node however many documents carry them, so a group of
    copies is never expanded. Texts without words (null, empty, white space) have fingerprint zero and link as
    any other. Rows with a null doc_id take part; a component without any other id has a null component_id.
    Repeated rows stay, each with its result. An empty table gives no rows. Other columns are not read.
    """
    prints = keep(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = rooted(prints, distance)
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    found = keep(nodes.join(least, "root").select("fp", "component_id"), "groups")
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def one_each(printed: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each `root` of `groups` (`fp`, `first`, `root`) the `doc` of `printed` (`doc`, `doc_id`, `fp`) that stays."""
    best = F.min(F.struct(F.col("first").isNull().alias("no_id"), "first", "fp")).alias("best")
    chosen = groups.groupBy("root").agg(best).select("best.first", "best.fp")
    counts = printed.groupBy("fp", "doc_id").count().withColumnsRenamed({"doc_id": "first"})
    same = chosen["fp"].eqNullSafe(counts["fp"]) & chosen["first"].eqNullSafe(counts["first"])
    chosen = keep(chosen.join(counts, same).select(chosen["fp"], chosen["first"], "count"), "chosen")
    staying = printed.join(chosen, "fp").where(F.col("doc_id").eqNullSafe(F.col("first")))
    single = staying.where(F.col("count") == 1).select("doc")
    several = staying.where(F.col("count") > 1).groupBy("fp").agg(F.first("doc").alias("doc")).select("doc")
    return single.unionByName(several).select("doc.*")


def one_per_group(
    docs: DataFrame, words: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of `docs` without near duplicates: of each group the row with the smallest id stays, unchanged.

    Of rows with the same id and fingerprint one stays. A null id stays only where its group has no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(text, words) for text in utf8(batch["text"])]
            yield pa.record_batch({"doc": batch["doc"], "doc_id": batch["doc_id"], "fp": pa.array(fps, pa.int64())})

    rows = texts(docs, id_col, text_col, docs.columns)
    schema = StructType([rows.schema["doc"], StructField("doc_id", LongType()), StructField("fp", LongType())])
    printed = keep(map_arrow(rows, run, schema), "printed")
    return one_each(printed, rooted(printed, distance))
