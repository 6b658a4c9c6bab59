"""Substring dedup on bytes: suffix buckets, ties settled by the ranks of a difference-cover sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.llm.common import map_arrow
from heartwood.llm.exchange import (
    BYTE_VALUES,
    PERIOD,
    Block,
    covered,
    distinct_and_repeated,
    exchange,
    hash_ranges,
    marked,
    member,
    per_block,
    prefix_sums,
    range_count,
    reach,
    read_blocks,
    starts_mask,
    text_bytes,
    window_keys,
    write_blocks,
)

#: Suffix buckets by leading bytes, and positions of a block from which their borders are drawn.
BUCKET_BITS, DRAWN = 6, 64
#: Positions that are hashed at a time.
SLICE = 1 << 20


def byte_keys(body: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Fingerprints of the `window` bytes at ascending positions, slice by slice."""
    out = []
    for low in range(0, len(body), SLICE):
        part = at[np.searchsorted(at, low) : np.searchsorted(at, low + SLICE)] - low
        if len(part):
            sums = prefix_sums(BYTE_VALUES[body[low : low + SLICE + window]])
            out.append(window_keys(sums, part, part + window))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def leading(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first seven bytes at each position as a number: its order is that of the suffixes."""
    value = np.zeros(len(at), np.int64)
    for k in range(7):
        value = (value << 8) | body[np.minimum(at + k, len(body) - 1)]
    return value


class Suffixes:
    """The suffixes of a block: the cover sample, and those that the sample's ranks leave to be sorted.

    `back` holds what the exchanges returned so far; texts that the first one found to be copies of an earlier
    document are left out, as the earlier one has all their strings.
    """

    def __init__(self, block: Block, window: int, ranges: int, back: list[dict[int, bytes]]):
        self.block, self.window, self.sample, self.ranges, self.back = block, window, window - PERIOD + 1, ranges, back
        self.n = len(block.body)
        self.texts = window_keys(prefix_sums(BYTE_VALUES[block.body]), block.starts, block.ends)
        self.copy = np.zeros(len(self.texts), bool)
        if back:
            first = np.zeros(len(self.texts), bool)
            first[np.unique(self.texts, return_index=True)[1]] = True
            self.copy = ~first | member(self.texts, marked(hash_ranges(np.unique(self.texts), 64, ranges), back[0]))

    def starts(self, window: int, cover: bool) -> np.ndarray:
        return starts_mask(self.n, self.block.starts[~self.copy], self.block.ends[~self.copy], window, cover)

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.starts(self.sample, True))
        return at, byte_keys(self.block.body, at, self.sample) >> np.uint64(64 - bits)

    def tied(self, bits: int, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that can agree with another for a whole window, and their keys: bucket, then fingerprint."""
        at, names = self.samples(bits)
        distinct, repeated = distinct_and_repeated(names)
        shared = np.union1d(marked(hash_ranges(distinct, bits, self.ranges), self.back[1]), repeated)
        reached = reach(self.n, at[member(names, shared)])
        start = np.flatnonzero(reached & self.starts(self.window, False))
        bucket = np.searchsorted(borders, leading(self.block.body, start), side="right").astype(np.uint64)
        keys = byte_keys(self.block.body, start, self.window) >> np.uint64(BUCKET_BITS)
        return start, (bucket << np.uint64(64 - BUCKET_BITS)) | keys


def borders_of(blocks: DataFrame) -> np.ndarray:
    """Borders of the suffix buckets, from the leading bytes of a few positions of every block."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in read_blocks(batch):
                at = np.random.default_rng(block.number).integers(0, max(1, len(block.body)), DRAWN)
                yield pa.record_batch({"lead": leading(block.body, np.sort(at)) if len(block.body) else np.zeros(0, np.int64)})

    shares = [k / 2**BUCKET_BITS for k in range(1, 2**BUCKET_BITS)]
    found = map_arrow(blocks, draw, "lead long").agg(F.percentile_approx("lead", shares, 1000)).first()[0]
    return np.unique(np.array(found or [], np.int64))


def drop_repeated_substrings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `n_bytes`, `spans` (removed runs, start and end in bytes), `kept` (the other bytes, binary).

    A byte goes if it lies in a string of `window` (at least 22) bytes that also starts in a document with a
    smaller doc_id; overlaps count, and texts are judged as given.

    Texts that are wholly equal to an earlier one are found first and take no further part. Cover sample: at the
    byte positions of a difference cover modulo 21, strings of window - 20 bytes are named, and an exchange finds
    the names that occur twice. Two suffixes that agree for `window` bytes share a named pair at one of their first
    21 positions, so a suffix that reaches no such pair ties with nothing and is never sorted. The rest go to
    buckets by leading bytes, cut again by name where a start is frequent; one bucket at a time is sorted by the
    names of whole windows (58 bits beside the bucket), and a name's first block and document are its smallest.
    Names stand for ranks: only equality is asked for, so any order in which equal strings are equal will do.

    Null text: no bytes. Rows that share a doc_id are documents in order of a hash of their text, null ids come
    first; of wholly equal rows one counts as the first. An empty table gives no rows; other columns are not read.
    """
    blocks = write_blocks(docs, id_col, text_col, in_order=True)
    size = text_bytes(blocks)
    # A short name only filters: eight bits more than there are samples let one in 256 through.
    bits, ranges = min(64, max(16, int(size // 4).bit_length() + 8)), range_count(size // 4)
    borders = borders_of(blocks)

    def whole_texts(block: Block, back: list[dict[int, bytes]]) -> list[np.ndarray]:
        return hash_ranges(np.unique(Suffixes(block, window, ranges, back).texts), 64, ranges)

    def sample(block: Block, back: list[dict[int, bytes]]) -> list[np.ndarray]:
        return hash_ranges(np.unique(Suffixes(block, window, ranges, back).samples(bits)[1]), bits, ranges)

    def suffixes(block: Block, back: list[dict[int, bytes]]) -> list[np.ndarray]:
        return hash_ranges(np.unique(Suffixes(block, window, ranges, back).tied(bits, borders)[1]), 64, ranges)

    def cut(block: Block, back: list[dict[int, bytes]]) -> Iterator[pa.RecordBatch]:
        found = Suffixes(block, window, ranges, back)
        start, keys = found.tied(bits, borders)
        distinct, repeated = distinct_and_repeated(keys)
        hit = member(keys, marked(hash_ranges(distinct, 64, ranges), back[2]))
        # Strings that occur more than once in the block: all but those of the first document to have them.
        again = np.flatnonzero(member(keys, repeated))
        doc = np.searchsorted(block.ends, start[again], side="right")
        _, first, group = np.unique(keys[again], return_index=True, return_inverse=True)
        hit[again] |= doc > doc[first][group]
        gone = covered(found.n, start[hit], window)
        body, spans, kept = block.body, [], []
        for low, high, copy in zip(block.starts.tolist(), block.ends.tolist(), found.copy.tolist(), strict=True):
            mine = gone[low:high]
            if copy and high - low >= window:
                mine[:] = True
            kept.append(body[low:high][~mine].tobytes())
            edge = np.flatnonzero(np.diff(mine, prepend=False, append=False)).tolist() if mine.any() else []
            spans.append([{"start": i, "end": j} for i, j in zip(edge[::2], edge[1::2], strict=True)])
        kind = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))
        yield pa.record_batch(
            {"doc_id": block.ids, "n_bytes": block.ends - block.starts, "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())}
        )

    marks: list[DataFrame] = []
    for emit, earlier in ((whole_texts, True), (sample, False), (suffixes, True)):
        marks.append(exchange(blocks, marks, emit, earlier))
    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return per_block(blocks, marks, cut, schema)
