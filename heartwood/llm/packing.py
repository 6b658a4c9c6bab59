"""Best-two-fit packing of documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.llm.common import keep, map_arrow, texts
from heartwood.llm.tokens import encoded, id_type

#: Pieces that are packed with one another.
GROUP = 65_536


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each piece.

    A bin is filled greedily with the longest piece that fits. If a gap is left, its smallest piece gives way to
    the two unpacked pieces that together fit the widened gap most tightly, provided they fill more of it.
    """
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    top = np.cumsum(count)  # one past the next piece of each length in `order`
    mask = sum(1 << int(n) for n in np.flatnonzero(count))
    every = np.arange(capacity + 1)
    bins, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal mask
        top[n] -= 1
        count[n] -= 1
        if not count[n]:
            mask &= ~(1 << n)
        return int(order[top[n]])

    def two(room: int, least: int) -> tuple[int, int] | None:
        below = np.maximum.accumulate(np.where(count[: room + 1] > 0, every[: room + 1], 0))
        a = np.flatnonzero(count[: room + 1])
        if not len(a):
            return None
        b = below[np.minimum(room - a, a)]
        once = (a == b) & (count[a] < 2)
        b = np.where(once, below[np.maximum(b - 1, 0)], b)
        total = np.where(b > 0, a + b, 0)
        best = int(total.argmax())
        return (int(a[best]), int(b[best])) if total[best] > least else None

    number = 0
    while mask:
        held: list[tuple[int, int]] = []
        gap = capacity
        while gap and (fits := mask & ((2 << gap) - 1)):
            n = fits.bit_length() - 1
            held.append((n, take(n)))
            gap -= n
        if gap and mask:
            n = held[-1][0]  # the smallest: lengths only fall
            if pair := two(gap + n, n):
                held.pop()
                top[n] += 1  # the last piece taken of its length is the next to be given
                count[n] += 1
                mask |= 1 << n
                held += [(m, take(m)) for m in pair]
        offset = 0
        for n, piece in held:
            bins[piece], place[piece] = number, offset
            offset += n
        number += 1
    return bins, place


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kept `row` (unique), `doc_id`, `piece`, `start`, `length`, `ids`, `ids_crc32`: documents as ids and the end
    id, those longer than `capacity` cut into pieces of that length, the last possibly shorter."""
    kind = id_type(path)
    if end_id >= 1 << (8 * kind.itemsize):
        raise ValueError("the end id does not fit the id type of the vocabulary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, blobs in encoded(batches, path, end_id):
            columns: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids", "ids_crc32")}
            for doc, blob in zip(doc_ids.to_pylist(), blobs, strict=True):
                ids = np.frombuffer(blob, kind)
                for number, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    crc = zlib.crc32(part.astype("<u4").tobytes())
                    for name, value in zip(columns, (doc, number, start, len(part), part.tobytes(), crc), strict=True):
                        columns[name].append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.record_batch({name: pa.array(columns[name], k) for name, k in zip(columns, kinds, strict=True)})

    schema = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"
    rows = map_arrow(texts(docs, id_col, text_col), cut, schema)
    return keep(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "pieces")


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id`, `piece`, `start`, `length`, `ids`, `ids_crc32`, `sequence_id`, `offset`: one row per piece.

    `ids` are little-endian integers of the vocabulary's width, the checksum is that of the ids as unsigned
    32-bit integers. A sequence is filled from offset 0 without gaps up to at most `capacity`. Only lengths are
    shuffled to be packed, in random groups of 65,536 pieces on average: each group loses less than a sequence
    or two, and no task holds more however large the corpus.

    Null and empty texts are the end id alone. Repeated rows and ids are documents of their own, so (doc_id,
    piece) repeats with them. An empty table gives no rows; other columns are not read.
    """
    kept = pieces(docs, path, capacity, end_id, id_col, text_col)
    groups = max(1, round(kept.count() / GROUP))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        bins, offset = best_two_fit(table["length"].to_numpy(), capacity)
        number = table["box"].to_numpy().astype(np.int64) << 32
        return pa.table({"row": table["row"], "sequence_id": number + bins, "offset": offset})

    dealt = kept.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("box"))
    placed = dealt.groupBy("box").applyInArrow(fit, "row long, sequence_id long, offset long")
    return kept.join(placed, "row").drop("row")
