"""Near-duplicate documents by the Jaccard similarity of word shingles: SimHash, grid over segment popcounts, exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heartwood.llm.common import binaries, group_starts, keep, map_arrow, texts, utf8, whole_groups
from heartwood.llm.components import components
from heartwood.llm.exchange import decode, encode
from heartwood.llm.simhash import SEED
from heartwood.llm.tiles import tiled

#: The share of pairs just at the least similarity that no group of the grid may bring together.
MISS = 0.0004
#: Rows that a cell of the grid should hold, those of a tile, and the rows of a tile that are compared at a time.
CELL, CHUNK, TOGETHER = 2000, 2048, 256
#: Groups of the grid whose rows are on disk at a time: groups grow with the input, what a round writes does not.
ROUND = 20
#: Sets of fewer shingles have ties more often, so their bits differ more: at most this share of them.
SHORT, SHORT_SHARE = 32, 0.1875
#: The share of random pairs of segments of two bits that hold as many ones.
MEET = 0.375
#: Words of 64 bits on which the fingerprints of a cell are compared.
CHECKED = 3
#: Bits of a shingle's hash by which whole sets are compared.
KEY_BITS = 48
#: Shingles that are hashed at a time.
SLICE = 4096
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; of a shorter text, of all its words."""
    tokens = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    size = min(words, len(tokens))
    single = np.array([xxhash.xxh64_intdigest(t, SEED) for t in tokens], np.uint64)
    keys = np.full(len(tokens) - size + 1 if tokens else 0, size, np.uint64)
    for k in range(size):
        keys = keys * FACTOR + single[k : k + len(keys)]
        keys ^= keys >> np.uint64(29)
    return np.unique(keys)


def bit_share(least: float) -> float:
    """The share of fingerprint bits in which sets of Jaccard similarity `least` differ: their angle."""
    return math.acos(2 * least / (1 + least)) / math.pi


def shape(nodes: int, least: float) -> tuple[int, int, int]:
    """Segments in a group, groups, and groups of short sets: cells stay as full and the recall stays the same."""
    dims = max(2, math.ceil(math.log(max(nodes, 1) / CELL) / -math.log(MEET)))

    def groups(differ: float) -> int:
        same = ((1 - differ) ** 2 + differ**2 / 2) ** dims
        return math.ceil(math.log(MISS) / math.log1p(-same))

    differ = bit_share(least)
    return dims, groups(differ), groups(max(differ, SHORT_SHARE))


def width(dims: int, groups: int) -> int:
    """Words of 64 bits for so many groups of segments of two bits."""
    return max(CHECKED, math.ceil(2 * dims * groups / 64))


def fingerprint(keys: np.ndarray, words: int) -> np.ndarray:
    """SimHash over so many words: per bit whether it is set in over half of the hashes, drawn anew per word."""
    draw = np.random.default_rng(SEED)
    seeds, factors = draw.integers(0, 2**64, (2, 1, words), np.uint64)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(keys), SLICE):
        mixed = (keys[at : at + SLICE, None] ^ seeds) * (factors | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        mixed *= FACTOR
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(keys), bitorder="little").view("<u8")


def grid_cells(prints: np.ndarray, dims: int, groups: int) -> np.ndarray:
    """Per fingerprint and group the cell that it stands in: the counts of ones of the group's segments of two bits."""
    counts = (prints[:, :, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    counts = (counts - (counts >> np.uint64(1))).astype(np.int64).reshape(len(prints), -1)  # 0 1 2 3 -> 0 1 1 2 ones
    points = counts[:, : dims * groups].reshape(len(prints), groups, dims)
    return (points @ 3 ** np.arange(dims, dtype=np.int64)) * groups + np.arange(groups)


def distance(least: float, words: int, short: bool = True) -> int:
    """Bits of so many words in which fingerprints of similar sets differ at most: four standard deviations more."""
    differ, bits = max(bit_share(least), SHORT_SHARE if short else 0), 64 * words
    return math.ceil(bits * differ + 4 * math.sqrt(bits * differ * (1 - differ)))


def near_rows(prints: np.ndarray, size: np.ndarray, side: np.ndarray, cross: bool, least: float) -> np.ndarray:
    """Per row of a tile the smallest row that it reaches by fingerprints within `distance`, in the first word and in
    all, of sets whose sizes allow the similarity."""
    label = np.arange(len(prints))
    short = size < SHORT
    first = distance(least, 1, bool(short.any()))
    all_words = np.array([distance(least, prints.shape[1], few) for few in (False, True)])
    ends = []
    for low in range(0, len(prints), TOGETHER):
        near = np.bitwise_count(prints[low : low + TOGETHER, None, 0] ^ prints[None, low:, 0]) <= first
        if cross:
            near &= side[low : low + TOGETHER, None] != side[None, low:]
        i, j = np.nonzero(near)
        i, j = i[i < j] + low, j[i < j] + low
        kept = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1) <= all_words[(short[i] | short[j]).astype(int)]
        kept &= alike(np.minimum(size[i], size[j]), size[i], size[j], least)
        ends.append(np.stack([i[kept], j[kept]]))
    i, j = np.concatenate(ends, axis=1)
    while True:
        lowest = label.copy()
        np.minimum.at(lowest, j, label[i])
        np.minimum.at(lowest, i, label[j])
        lowest = lowest[lowest]
        if (lowest == label).all():
            return label
        label = lowest


def candidates(nodes: DataFrame, least: float, dims: int, groups: int, short: int) -> DataFrame:
    """`bucket`, `node`, `hub`, `n`: nodes that fingerprints within a cell of the grid bring together, two of a bucket at
    least; their count is `n`, `hub` is one of them, where possible the same in many buckets.

    `nodes` has the columns `node`, `size` (its shingles) and `print`. A cell's rows are compared in tiles; what a
    tile links is one bucket, so that nothing is emitted per pair; the same nodes are one bucket in every cell.
    The grid is gone through `ROUND` groups at a time, so that disk follows the nodes however many groups there are.
    """
    checked = [f"p{k}" for k in range(CHECKED)]
    columns = ", ".join(["bucket long", "node long", "size int", *(f"{name} long" for name in checked)])

    def met(low: int) -> DataFrame:
        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                prints, size = binaries(batch["print"], "<u8"), batch["size"].to_numpy()
                wanted = np.arange(low, min(low + ROUND, short)) < np.where(size < SHORT, short, groups)[:, None]
                row, _ = np.nonzero(wanted)
                found = {"bucket": grid_cells(prints, dims, short)[:, low : low + ROUND][wanted], "node": batch["node"].to_numpy()[row]}
                found["size"] = np.minimum(size, 2**31 - 1).astype(np.int32)[row]
                found |= {f"p{k}": prints[row, k].view(np.int64) for k in range(CHECKED)}
                yield pa.record_batch(found)

        rows = map_arrow(nodes.select("node", "size", "print"), cells, columns)
        tiles = tiled(rows, "node", CHUNK).select("bucket", "tile", "side", "cross", "node", "size", *checked)
        return keep(map_arrow(tiles, meet, "bucket long, node long, hub long, n long").distinct(), "met")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "tile"]):
            node, size, side, cross = (table[name].to_numpy() for name in ("node", "size", "side", "cross"))
            prints = np.stack([table[name].to_numpy() for name in checked], axis=1).view(np.uint64)
            starts = group_starts(table, ["bucket", "tile"]).tolist()
            found = [np.zeros((4, 0), np.int64)]
            for start, end in zip(starts, [*starts[1:], len(node)], strict=True):
                if end - start < 2:
                    continue
                label = near_rows(prints[start:end], size[start:end], side[start:end], bool(cross[start]), least)
                count = np.bincount(label, minlength=len(label))
                kept = np.flatnonzero(count[label] > 1)
                mine, label = node[start:end][kept], label[kept]
                mixed = (mine.view(np.uint64) ^ (mine.view(np.uint64) >> np.uint64(31))) * FACTOR
                name, hub = np.zeros(len(count), np.uint64), np.zeros(len(count), np.int64)
                np.add.at(name, label, mixed)
                last = np.argsort(mixed)[::-1]
                hub[label[last]] = mine[last]  # of repeated places the last is kept: the smallest
                found.append(np.stack([name[label].view(np.int64), mine, hub[label], count[label]]))
            yield pa.record_batch(dict(zip(("bucket", "node", "hub", "n"), np.concatenate(found, axis=1), strict=True)))

    parts = [met(low) for low in range(0, short, ROUND)]
    return reduce(DataFrame.unionByName, parts).distinct()


def alike(common: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of sizes `a` and `b` with so many common members have a Jaccard similarity of `least`."""
    return common >= least * (a + b - common) - 1e-9


def tile_links(sets: list[np.ndarray], label: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of a tile between rows of different `label`, enough to span its components: those within one are known."""
    if len(sets) < 2:
        return []
    size = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    marked, label, out = np.zeros(int(member.max()) + 1, bool), label.copy(), []
    kinds, counts = np.unique(label, return_counts=True)
    for i in np.flatnonzero(label != kinds[counts.argmax()]).tolist():  # of two rows apart, one at least is not of the largest
        mine = member[starts[i] : starts[i] + size[i]]
        marked[mine] = True
        near = alike(np.add.reduceat(marked[member].astype(np.int64), starts), size[i], size, least) & (label != label[i])
        marked[mine] = False
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def links(near: DataFrame, named: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """`a`, `b`: links between the values of `node`, enough to span every component.

    `near` has the columns of `candidates`; `named` has `node` and `key`, the hash of one text of that set; `rows`
    has `key` and `text`, one per document. Sets are made again for the candidates only:
    these are first compared with one node of their bucket, so
    that a group of copies costs one comparison each; a bucket of several components after that is compared
    whole in tiles, but for pairs that are in one component by now.
    """
    near = keep(near, "near")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [encode(np.unique(shingles(text, words) >> np.uint64(64 - KEY_BITS))) for text in utf8(batch["text"])]
            yield pa.record_batch({"node": batch["node"], "keys": pa.array(blobs, pa.binary())})

    wanted = named.join(near.select("node").distinct(), "node", "left_semi")
    asked = rows.join(wanted, "key").groupBy("key").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    sets = keep(map_arrow(asked.select("node", "text"), whole, "node long, keys binary"), "sets")
    pairs = near.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    left = sets.withColumnsRenamed({"node": "a", "keys": "x"})
    right = sets.withColumnsRenamed({"node": "b", "keys": "y"})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([decode(blob) for blob in batch[name].to_pylist()] for name in ("x", "y"))
            common = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            size = [np.array([len(p) for p in side], np.int64) for side in (x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(alike(common, *size, least), pa.bool_()))

    by_hub = keep(map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), compare, "a long, b long"), "by_hub")
    so_far = components(by_hub).withColumnsRenamed({"id": "node"})
    labelled = near.where("n > 2").join(so_far, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    own = Window.partitionBy("bucket")
    apart = labelled.select("*", F.min("label").over(own).alias("low"), F.max("label").over(own).alias("high")).where("low < high")
    rest = keep(apart.select("bucket", "node", "label"), "rest")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "tile"]):
            node, label = table["node"].to_numpy(), table["label"].to_numpy()
            starts = group_starts(table, ["bucket", "tile"]).tolist()
            found = []
            for start, end in zip(starts, [*starts[1:], len(node)], strict=True):
                part = [decode(blob) for blob in table["keys"].slice(start, end - start).to_pylist()]
                found += [(node[start + i], node[start + j]) for i, j in tile_links(part, label[start:end], least)]
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.record_batch({"a": np.ascontiguousarray(a), "b": np.ascontiguousarray(b)})

    tiles = tiled(rest.join(sets, "node"), "node").select("bucket", "tile", "node", "label", "keys")
    return by_hub.unionByName(map_arrow(tiles, verify, "a long, b long"))


def one_per_similar(
    docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of `docs` without near duplicates: of each group the row with the smallest id stays, unchanged.

    Two texts link where the Jaccard similarity of their sets of `words`-word shingles is `least` or more; a
    group is what links reach. Candidates come from SimHash fingerprints of the sets: segments of two bits become
    counts of ones, groups of these span a grid, and those of one cell (Manhattan distance zero in a group) are
    compared by their bits. Dimensions, groups and bits follow the number of rows. Every link is checked
    on the whole sets (48-bit hashes of the shingles). A pair
    just at `least` is not found with probability 0.0004 or little more, a closer one far more rarely. Case (of A to Z) and white
    space do not count. A text of fewer words is one shingle; texts without words are copies of one another.

    Texts of equal sets are one node however many rows carry them. Of rows with the same id and set one stays. A
    null id stays only where its group has no other. An empty table gives no rows.

    No stage writes the texts down: `docs` is read several times and has to give the same rows each time.
    """
    rows = texts(docs, id_col, text_col, docs.columns).withColumn("key", F.xxhash64("text"))
    dims, groups, short = shape(rows.count(), least)
    words_wide = width(dims, short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, words) for text in utf8(batch["text"])]
            fp = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            prints = [fingerprint(x, words_wide).tobytes() for x in sets]
            found = {"doc_id": batch["doc_id"], "key": batch["key"], "fp": fp, "size": np.array([len(x) for x in sets], np.int64)}
            yield pa.record_batch(found | {"print": pa.array(prints, pa.binary())})

    printed = keep(map_arrow(rows.select("doc_id", "key", "text"), run, "doc_id long, key long, fp long, size long, print binary"), "printed")
    one = [F.min("doc_id").alias("first"), F.min("key").alias("key"), F.first("size").alias("size"), F.first("print").alias("print")]
    nodes = keep(printed.groupBy("fp").agg(*one), "nodes")
    near = candidates(nodes.withColumnRenamed("fp", "node"), least, dims, groups, short)
    found = links(near, nodes.select(F.col("fp").alias("node"), "key"), rows.select("key", "text"), words, least)
    joined = components(found).withColumnsRenamed({"id": "fp", "component": "root"})
    rooted = nodes.join(joined, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return one_each(rows, printed, rooted)


def one_each(rows: DataFrame, printed: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of each `root` of `rooted` (`fp`, `first`, `root`) the `doc` of `rows` (`doc`, `doc_id`, `key`) that stays; `printed`
    has `doc_id`, `key` and `fp` of each. Texts of one key have one root, so a row of `rows` meets one choice at most."""
    best = F.min(F.struct(F.col("first").isNull().alias("no_id"), "first", "fp")).alias("best")
    chosen = rooted.groupBy("root").agg(best).select("best.first", "best.fp")
    counts = printed.groupBy("fp", "doc_id", "key").count()
    own = counts.groupBy("fp", "doc_id").agg(F.min(F.struct("key", "count")).alias("own"))
    same = (chosen["fp"] == own["fp"]) & chosen["first"].eqNullSafe(own["doc_id"])
    chosen = keep(chosen.join(own, same).select("first", F.col("own.key").alias("key"), F.col("own.count").alias("count")), "chosen")
    staying = rows.join(chosen, (rows["key"] == chosen["key"]) & rows["doc_id"].eqNullSafe(chosen["first"]))
    staying = staying.select("doc", "count", chosen["key"])
    single = staying.where(F.col("count") == 1).select("doc")
    several = staying.where(F.col("count") > 1).groupBy("key").agg(F.first("doc").alias("doc")).select("doc")
    return single.unionByName(several).select("doc.*")
