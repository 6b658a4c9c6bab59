"""Language-model scores by stupid backoff, from n-gram counts of the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.llm.common import keep, map_arrow
from heartwood.llm.exchange import BYTE_VALUES, Block, decode, encode, per_block, prefix_sums, range_count, read_blocks, text_bytes, window_keys, write_blocks
from heartwood.llm.substrings import words

#: Factor per step of backing off.
BACKOFF = 0.4


class Grams:
    """The n-grams of a block, per order: where they end, and their keys."""

    def __init__(self, block: Block, order: int):
        starts, ends, self.firsts, self.lasts = words(block)
        self.n = len(starts)
        self.doc = np.repeat(np.arange(len(block.starts)), self.lasts - self.firsts)
        sums = prefix_sums(window_keys(prefix_sums(BYTE_VALUES[block.body]), starts, ends))
        left = self.lasts[self.doc] - np.arange(self.n) if self.n else np.zeros(0, np.int64)
        #: Per order, the positions of the last words of its n-grams, and the keys; the length is part of a key.
        self.at, self.keys = [], []
        for size in range(1, order + 1):
            first = np.flatnonzero(left >= size)
            self.at.append(first + size - 1)
            self.keys.append(window_keys(sums, first, first + size) + np.uint64(size))

    def spread(self, size: int, values: np.ndarray) -> np.ndarray:
        """Values of the n-grams of a size by the position of their last word, zero where none ends."""
        out = np.zeros(self.n, values.dtype)
        out[self.at[size - 1]] = values
        return out

    def sent(self, level: int, seen: list[np.ndarray]) -> np.ndarray:
        """The keys that an exchange asks for: words and pairs first, then one order more each time.

        An n-gram can occur in another document only if both n-grams one word shorter inside it do. So only those
        go; `seen` says for the orders below how often each n-gram occurs elsewhere. All its occurrences in a
        document go or none, and all documents that share it send it, so the counts that matter are whole.
        """
        if level == 0:
            return np.concatenate(self.keys[:2])
        return self.keys[level + 1][self.open(level + 2, seen)]

    def open(self, size: int, seen: list[np.ndarray]) -> np.ndarray:
        """Which n-grams of a size can occur in another document."""
        shorter, at = self.spread(size - 1, seen[size - 2]), self.at[size - 1]
        return (shorter[at] > 0) & (shorter[at - 1] > 0)

    def elsewhere(self, back: list[dict[int, bytes]], ranges: int) -> list[np.ndarray]:
        """Per order, how often each n-gram occurs in other documents, as far as the exchanges have told."""
        seen: list[np.ndarray] = []
        empty = np.zeros(0, np.int64)
        for level, told in enumerate(back):
            distinct = np.unique(self.sent(level, seen))
            counts = np.concatenate([unpack(told[p]) if p in told else empty for p in range(ranges)])
            for size in range(1, min(2, len(self.keys)) + 1) if level == 0 else (level + 2,):
                keys, doc = self.keys[size - 1], self.doc[self.at[size - 1]]
                asked = np.ones(len(keys), bool) if level == 0 else self.open(size, seen)
                found = np.zeros(len(keys), np.int64)
                own = own_counts(keys[asked], doc[asked], len(self.firsts))
                found[asked] = counts[np.searchsorted(distinct, keys[asked])] - own
                seen.append(found)
        return seen


def cut(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` (a power of two) ends in sorted keys."""
    return np.searchsorted(keys, np.arange(1, ranges, dtype=np.uint64) << np.uint64(65 - ranges.bit_length()))


def pack(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def ngram_counts(blocks: DataFrame, known: list[DataFrame], order: int, ranges: int) -> DataFrame:
    """`block`, `part`, `bits`: for each distinct n-gram that a block sends, in key order, its count in the corpus.

    `known` holds the counts of the orders below. A block sends its distinct n-grams with their counts, already
    summed, to the task of their hash range; that task holds the range of the count table and joins the blocks'
    n-grams to it.
    """

    def send(block: Block, back: list[dict[int, bytes]]) -> Iterator[pa.RecordBatch]:
        grams = Grams(block, order)
        keys, counts = np.unique(grams.sent(len(back), grams.elsewhere(back, ranges)), return_counts=True)
        at = cut(keys, ranges)
        rows = [(p, encode(k), pack(c)) for p, (k, c) in enumerate(zip(np.split(keys, at), np.split(counts, at), strict=True)) if len(k)]
        parts, blobs, sizes = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch(
            {
                "block": np.full(len(parts), block.number, np.int64),
                "part": pa.array(parts, pa.int32()),
                "keys": pa.array(blobs, pa.binary()),
                "counts": pa.array(sizes, pa.binary()),
            }
        )

    def join(table: pa.Table) -> pa.Table:
        lists = [decode(blob) for blob in table["keys"].to_pylist()]
        every, counts = np.concatenate(lists), np.concatenate([unpack(blob) for blob in table["counts"].to_pylist()])
        order_of = np.argsort(every, kind="stable")
        ordered = every[order_of]
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        distinct, totals = ordered[heads], np.add.reduceat(counts[order_of], heads)
        back = [pack(totals[np.searchsorted(distinct, keys)]) for keys in lists]
        return pa.table({"block": table["block"], "part": table["part"], "bits": pa.array(back, pa.binary())})

    sent = per_block(blocks, known, send, "block long, part int, keys binary, counts binary")
    return keep(sent.groupBy("part").applyInArrow(join, "block long, part int, bits binary"), "counts")


def own_counts(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """How often each key occurs in its own document."""
    salt = window_keys(np.arange(n_docs + 1, dtype=np.uint64), np.zeros(n_docs, np.int64), np.arange(1, n_docs + 1))
    _, which, counts = np.unique(keys ^ salt[doc], return_inverse=True, return_counts=True)
    return counts[which]


def lm_scores(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `n_words`, `log_score` (natural, summed over the words), `mean_log_score` (null without words).

    A word's score is the share of its n-gram among those with the same context, in the corpus without the
    document itself; where the n-gram occurs nowhere else, 0.4 times the score with a context one word shorter,
    down to the share of the word among all words, where a word seen nowhere else counts as half a time. Contexts
    do not cross documents, so a text's first words have shorter ones.

    Counts are those of all documents, up to `order` words, exact but for 64-bit fingerprints; of longer n-grams
    than pairs only those are exchanged whose shorter parts occur elsewhere, as all others back off. A copy of a
    document elsewhere counts, as in any corpus. Null and empty texts have no words and a score of zero. Repeated
    rows are documents of their own. An empty table gives no rows; other columns are not read.
    """
    blocks = write_blocks(docs, id_col, text_col, in_order=False)
    size = text_bytes(blocks)
    ranges = range_count(size * order // 10)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"n": pa.array([sum(len(words(b)[0]) for b in read_blocks(batch))], pa.int64())})

    all_words = map_arrow(blocks, total, "n long").agg(F.sum("n")).first()[0] or 0

    def score(block: Block, back: list[dict[int, bytes]]) -> Iterator[pa.RecordBatch]:
        grams = Grams(block, order)
        n_words = grams.lasts - grams.firsts
        others = (all_words - n_words)[grams.doc].astype(np.float64)
        score = below = np.zeros(grams.n)  # below: how often the n-gram one shorter that ends at a word was seen
        for size, (at, found) in enumerate(zip(grams.at, grams.elsewhere(back, ranges), strict=True), 1):
            seen = found.astype(np.float64)
            if size == 1:
                score = np.log(np.maximum(seen, 0.5) / np.maximum(others, 1.0))
                score = np.minimum(score, 0.0)
                below = seen
                continue
            context = below[at - 1]
            hit = seen > 0
            lower = score[at] + np.log(BACKOFF)
            score[at] = np.where(hit, np.log(np.where(hit, seen, 1.0) / np.where(hit, context, 1.0)), lower)
            below = grams.spread(size, seen)
        summed = np.bincount(grams.doc, weights=score, minlength=len(n_words)).astype(np.float64)
        mean = pa.array(summed / np.maximum(n_words, 1), mask=n_words == 0)
        yield pa.record_batch({"doc_id": block.ids, "n_words": n_words, "log_score": summed, "mean_log_score": mean})

    counted: list[DataFrame] = []
    for _ in range(max(1, order - 1)):  # words and pairs together, then one order at a time
        counted.append(ngram_counts(blocks, counted, order, ranges))
    return per_block(blocks, counted, score, "doc_id long, n_words long, log_score double, mean_log_score double")
