"""Substring dedup on words: difference-cover anchors, extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heartwood.llm.exchange import (
    BYTE_VALUES,
    PERIOD,
    Block,
    carried,
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
    starts_mask,
    text_bytes,
    window_keys,
    write_blocks,
)

SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a block; first and one past the last word of each document."""
    blank = np.ones(len(block.body) + 2, bool)
    blank[1:-1] = SPACE[block.body]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    return starts, ends, np.searchsorted(starts, block.starts), np.searchsorted(starts, block.ends)


class Windows:
    """The word windows of a block: anchors on the cover, and the windows that can reach a shared anchor."""

    def __init__(self, block: Block, window: int):
        self.window, self.anchor = window, window - PERIOD + 1
        self.starts, self.ends, self.firsts, self.lasts = words(block)
        self.n = len(self.starts)
        self.sums = prefix_sums(window_keys(prefix_sums(BYTE_VALUES[block.body]), self.starts, self.ends))

    def anchors(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(starts_mask(self.n, self.firsts, self.lasts, self.anchor, True))
        return at, window_keys(self.sums, at, at + self.anchor) >> np.uint64(64 - bits)

    def candidates(self, bits: int, ranges: int, back: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        at, keys = self.anchors(bits)
        distinct, repeated = distinct_and_repeated(keys)
        shared = np.union1d(marked(hash_ranges(distinct, bits, ranges), back), repeated)
        reached = reach(self.n, at[member(keys, shared)])
        start = np.flatnonzero(reached & starts_mask(self.n, self.firsts, self.lasts, self.window, False))
        return start, window_keys(self.sums, start, start + self.window)


def drop_shared_windows(
    docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False
) -> DataFrame:
    """`doc_id`, `n_words`, `n_removed`, `text`, with `whole_rows` also `doc` (the other columns): texts without the words of windows that start elsewhere too.

    Words are runs of characters other than ASCII white space; a window is `window` (at least 22) consecutive
    words of one document. A word goes if any window over it has the word sequence of a window that starts
    anywhere else, also in the same document; all occurrences go. Kept words are joined by one space.

    Anchors (window - 20 words) are hashed only at word positions of the difference cover. Two equal windows
    share an anchor at one of their first 21 positions; keys that no other position has end there. Around the
    shared anchors, whole windows are fingerprinted (64 bits) and exchanged the same way, without pairs.

    With `whole_rows`, texts that lose nothing keep their white space.

    Null and empty texts have no words and stay as empty texts. Repeated rows and ids are documents of their
    own. Shorter documents than a window lose nothing. An empty table gives no rows; other columns are not read.
    """
    blocks = write_blocks(docs, id_col, text_col, in_order=False, carry=whole_rows)
    size = text_bytes(blocks)
    # A short key only filters: eight bits more than there are anchors let one in 256 through.
    bits, ranges = min(64, max(16, int(size // 16).bit_length() + 8)), range_count(size // 16)

    def anchors(block: Block, back: list[dict[int, bytes]]) -> list[np.ndarray]:
        return hash_ranges(np.unique(Windows(block, window).anchors(bits)[1]), bits, ranges)

    def whole(block: Block, back: list[dict[int, bytes]]) -> list[np.ndarray]:
        return hash_ranges(np.unique(Windows(block, window).candidates(bits, ranges, back[0])[1]), 64, ranges)

    def cut(block: Block, back: list[dict[int, bytes]]) -> Iterator[pa.RecordBatch]:
        found = Windows(block, window)
        start, keys = found.candidates(bits, ranges, back[0])
        distinct, repeated = distinct_and_repeated(keys)
        shared = np.union1d(marked(hash_ranges(distinct, 64, ranges), back[1]), repeated)
        gone = covered(found.n, start[member(keys, shared)], window)
        body, removed, kept = block.body.tobytes(), [], []
        edges = zip(found.firsts.tolist(), found.lasts.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True)
        for first, last, low, high in edges:
            stay = first + np.flatnonzero(~gone[first:last])
            removed.append(last - first - len(stay))
            if whole_rows and not removed[-1]:
                kept.append(body[low:high])
                continue
            kept.append(b" ".join([body[i:j] for i, j in zip(found.starts[stay].tolist(), found.ends[stay].tolist(), strict=True)]))
        columns = {"doc_id": block.ids, "n_words": found.lasts - found.firsts, "n_removed": pa.array(removed, pa.int64())}
        columns["text"] = pa.array(kept, pa.binary()).cast(pa.string())
        yield pa.record_batch(columns | ({"doc": carried(block)} if whole_rows else {}))

    near = exchange(blocks, [], anchors, earlier=False)
    same = exchange(blocks, [near], whole, earlier=False)
    schema = StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("text", "string")
    if whole_rows:
        schema = schema.add("doc", StructType([field for field in docs.schema if field.name != text_col]))
    return per_block(blocks, [near, same], cut, schema)


def without_shared_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with their texts cut by `drop_shared_windows`, without those of which nothing is left.

    Texts that lose nothing stay as they are, white space included; a null text comes back as an empty one.
    """
    found = drop_shared_windows(docs, window, id_col, text_col, whole_rows=True)
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    cut = F.col("text").alias(text_col)
    return left.select(*[cut if name == text_col else F.col("doc")[name].alias(name) for name in docs.columns])
