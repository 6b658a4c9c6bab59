"""Blocks of documents, window fingerprints in numpy, and an exchange that tells blocks which keys others have.

Positions of text outnumber bytes on disk that a job may use, so they never travel as rows. A block of
documents sends the sorted distinct keys of its windows, one binary per key range; the task of a range sees
which keys several blocks hold and returns one bit per key. Keys of one range are bounded by the count of
ranges, which follows the input; a key that a third of all windows share counts once per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heartwood.llm.common import free_shuffles, keep, map_arrow, texts, utf8

BLOCK_BYTES = 2 << 20
#: Keys of a range that a task should hold.
RANGE_KEYS = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1

#: A difference cover: every residue modulo PERIOD is a difference of two members.
PERIOD, COVER = 21, (0, 1, 6, 8, 18)


@dataclass
class Block:
    """Texts one after the other, a newline between them; text k is body[starts[k]:ends[k]]."""

    number: int
    ids: pa.Array
    body: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rest: bytes | None = None


def write_blocks(docs: DataFrame, id_col: str, text_col: str, in_order: bool, carry: bool = False) -> DataFrame:
    """Documents as kept blocks of about 2 MB, texts compressed. `in_order`: ascending by doc_id, then by a hash
    of the text, also across blocks. `carry`: with the whole rows but for the text, as an Arrow stream. Memory: a
    block, or the longest text if that is longer."""
    rows = texts(docs, id_col, text_col, [name for name in docs.columns if name != text_col] if carry else None)
    if in_order:
        order = ["doc_id", F.xxhash64("text")]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3)
        ids: list[int | None] = []
        held: list[bytes] = []
        rest: list[pa.RecordBatch] = []
        size = count = 0

        def block() -> pa.RecordBatch:
            lengths = pa.array([[len(t) for t in held]], pa.list_(pa.int64()))
            columns = {"block": pa.array([first + count], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": lengths}
            columns["body"] = pa.array([pack.compress(b"\n".join(held))], pa.binary())
            columns["rest"] = pa.array([stream(rest) if carry else None], pa.binary())
            return pa.record_batch(columns)

        for batch in batches:
            low = 0
            for at, (doc, text) in enumerate(zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True)):
                if held and size + len(text) > BLOCK_BYTES:
                    rest += [batch.select(["doc"]).slice(low, at - low)] if carry else []
                    yield block()
                    ids, held, rest, size, count, low = [], [], [], 0, count + 1, at
                ids.append(doc)
                held.append(text)
                size += len(text) + 1
            rest += [batch.select(["doc"]).slice(low)] if carry else []
        if held:
            yield block()

    schema = "block long, ids array<long>, lengths array<long>, body binary, rest binary"
    return keep(map_arrow(rows, run, schema), "blocks")


def stream(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def carried(block: Block) -> pa.StructArray:
    """The whole rows that a block carries, as structs."""
    return pa.ipc.open_stream(block.rest).read_all().combine_chunks()["doc"].combine_chunks()


def text_bytes(blocks: DataFrame) -> int:
    """Bytes of text in all blocks."""
    return blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0


def read_blocks(table: pa.Table | pa.RecordBatch) -> Iterator[Block]:
    unpack = zstandard.ZstdDecompressor()
    for row in range(table.num_rows):
        lengths = np.array(table["lengths"][row].as_py(), np.int64)
        body = np.frombuffer(unpack.decompress(table["body"][row].as_py()), np.uint8)
        ends = np.cumsum(lengths + 1) - 1
        yield Block(table["block"][row].as_py(), table["ids"][row].values, body, ends - lengths, ends, table["rest"][row].as_py())


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n-1, modulo 2^64."""
    if len(_powers[0]) < n:
        for which, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[which] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[k] * BASE**k, before each position."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values))[0], out=sums[1:])
    return sums


def window_keys(sums: np.ndarray, at: np.ndarray, to: np.ndarray | int) -> np.ndarray:
    """Well mixed 64-bit fingerprints of the values from `at` up to `to`, equal for equal sequences."""
    x = (sums[to] - sums[at]) * _power(len(sums))[1][at]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


#: A random number per byte value, so that no two bytes differ by a small multiple.
BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def starts_mask(n: int, firsts: np.ndarray, ends: np.ndarray, window: int, cover: bool) -> np.ndarray:
    """Which of n positions start a window inside their document, and with `cover` stand on the cover too."""
    mask = np.zeros(n, bool)
    longest = int((ends - firsts).max(initial=0))
    pattern = np.zeros(PERIOD, bool)
    pattern[list(COVER) if cover else slice(None)] = True
    tiled = np.resize(pattern, longest)
    for first, last in zip(firsts.tolist(), (ends - window + 1).tolist(), strict=True):
        if last > first:
            mask[first:last] = tiled[: last - first]
    return mask


def reach(n: int, anchors: np.ndarray) -> np.ndarray:
    """Positions from which a window's cover offset can meet one of the anchors."""
    mask = np.zeros(n, bool)
    for back in range(PERIOD):
        mask[np.maximum(anchors - back, 0)] = True
    return mask


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Positions inside a window at one of the starts."""
    step = np.zeros(n + 1, np.int32)
    step[starts] += 1
    np.subtract.at(step, starts + window, 1)
    return np.cumsum(step[:-1]) > 0


def encode(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed byte planes of their differences."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def decode(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def hash_ranges(distinct: np.ndarray, bits: int, ranges: int) -> list[np.ndarray]:
    """Sorted distinct keys of `bits` bits, cut into `ranges` (a power of two)."""
    cuts = np.arange(1, ranges, dtype=np.uint64) << np.uint64(bits - ranges.bit_length() + 1)
    return np.split(distinct, np.searchsorted(distinct, cuts))


def distinct_and_repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and those that occur more than once, both sorted."""
    ordered = np.sort(keys)
    if not len(ordered):
        return ordered, ordered
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    heads = np.flatnonzero(new)
    return ordered[heads], ordered[heads[np.diff(np.append(heads, len(ordered))) > 1]]


def member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def range_count(keys: int) -> int:
    """Ranges for so many keys: a power of two."""
    return max(64, 1 << max(0, (keys - 1) // RANGE_KEYS).bit_length())


Emit = Callable[[Block, list[np.ndarray]], list[np.ndarray]]


def exchange(blocks: DataFrame, marks: list[DataFrame], emit: Emit, earlier: bool) -> DataFrame:
    """`block`, `part`, `bits`: for each key that `emit` gives, in order, whether another (`earlier`: a smaller)
    block gives it too. `emit` gets the marks of earlier exchanges and returns sorted keys per range."""

    def send(block: Block, got: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ranges = [(part, encode(keys)) for part, keys in enumerate(emit(block, got)) if len(keys)]
        parts, blobs = zip(*ranges, strict=True) if ranges else ((), ())
        yield pa.record_batch(
            {"block": np.full(len(parts), block.number, np.int64), "part": pa.array(parts, pa.int32()), "keys": pa.array(blobs, pa.binary())}
        )

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        lists = [decode(blob) for blob in table["keys"].to_pylist()]
        shared = distinct_and_repeated(np.concatenate(lists))[1]
        if earlier:
            unseen = np.ones(len(shared), bool)
        packed = []
        for keys in lists:
            at = np.searchsorted(shared, keys)
            hit = np.zeros(len(keys), bool)
            inside = at < len(shared)
            hit[inside] = shared[at[inside]] == keys[inside]
            if earlier:
                found = at[hit]
                hit[hit] = ~unseen[found]
                unseen[found] = False
            packed.append(np.packbits(hit).tobytes())
        return pa.table({"block": table["block"], "part": table["part"], "bits": pa.array(packed, pa.binary())})

    sent = per_block(blocks, marks, send, "block long, part int, keys binary")
    return keep(sent.groupBy("part").applyInArrow(meet, "block long, part int, bits binary"), "marks")


def marked(ranges: list[np.ndarray], bits: dict[int, bytes]) -> np.ndarray:
    """Of the keys a block sent, those whose bit came back set; sorted within each range."""
    out = [np.zeros(0, np.uint64)]
    for part, keys in enumerate(ranges):
        if part in bits:
            out.append(keys[np.unpackbits(np.frombuffer(bits[part], np.uint8), count=len(keys)).astype(bool)])
    return np.concatenate(out)


def per_block(
    blocks: DataFrame, marks: list[DataFrame], run: Callable[[Block, list[dict[int, bytes]]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """`run` over every block with the bits that each exchange returned to it, by range."""
    if not marks:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in read_blocks(batch):
                    yield from run(block, [])

        return map_arrow(blocks, alone, schema)
    free_shuffles(blocks.sparkSession, pause=1.5)
    got = marks[0].withColumn("round", F.lit(0))
    for number, more in enumerate(marks[1:], 1):
        got = got.unionByName(more.withColumn("round", F.lit(number)))
    rounds = len(marks)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        bits: list[dict[int, bytes]] = [{} for _ in range(rounds)]
        for number, part, value in zip(*(right[name].to_pylist() for name in ("round", "part", "bits")), strict=True):
            bits[number][part] = value
        return pa.Table.from_batches([batch for block in read_blocks(left) for batch in run(block, bits)])

    return blocks.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(joined, schema)
