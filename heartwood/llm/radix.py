"""Ranks of all rows by a composite integer key: a distributed radix sort from the least significant digit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heartwood.llm.common import keep

#: Bits of a digit, so that a pass counts 2048 values.
DIGIT_BITS = 11
#: Rows of a block, as a power of two: blocks are what a task sorts at a time.
BLOCK_BITS = 17
DIGITS = 1 << DIGIT_BITS


def _offsets(rows: DataFrame) -> DataFrame:
    """`of_block`, `of_digit`, `base`: where the rows of each block and digit begin in the next order.

    Counts are taken before the shuffle. A prefix sum over the digits' totals (2048 rows at most) and one over the
    blocks of each digit give the places.
    """
    sizes = rows.groupBy("block", "digit").agg(F.count("*").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("digit").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    starts = totals.select("digit", F.coalesce(F.sum("n").over(before.orderBy("digit")), zero).alias("start"))
    inside = F.coalesce(F.sum("n").over(before.partitionBy("digit").orderBy("block")), zero)
    placed = sizes.select("block", "digit", inside.alias("inside"))
    base = (F.col("start") + F.col("inside")).alias("base")
    return placed.join(F.broadcast(starts), "digit").select(F.col("block").alias("of_block"), F.col("digit").alias("of_digit"), base)


def _pass(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable counting sort of all rows by a digit: `pos` becomes the place after it."""
    schema = rows.schema
    rows = rows.withColumn("digit", digit.cast("int"))

    def place(block: pa.Table, bases: pa.Table) -> pa.Table:
        order = np.argsort(block["pos"].to_numpy(), kind="stable")
        digits = block["digit"].to_numpy()
        base = np.zeros(DIGITS, np.int64)
        base[bases["of_digit"].to_numpy()] = bases["base"].to_numpy()
        counts = np.bincount(digits, minlength=DIGITS)
        by_digit = order[np.argsort(digits[order], kind="stable")]
        in_order = digits[by_digit]
        local = np.arange(len(digits)) - (np.cumsum(counts) - counts)[in_order]
        to = np.empty(len(digits), np.int64)
        to[by_digit] = base[in_order] + local
        block = block.drop_columns(["pos", "block", "digit"])
        return block.append_column("pos", pa.array(to)).append_column("block", pa.array(to >> BLOCK_BITS))

    return keep(rows.groupBy("block").cogroup(_offsets(rows).groupBy("of_block")).applyInArrow(place, schema), "radix")


def _digits(key: Column, low: int | None, high: int | None, nulls: int, descending: bool) -> list[Column]:
    """The digits of a key that differ between rows, least significant first."""
    found = []
    if low is not None and low != high:
        if high - low < 1 << 62:
            distance = F.lit(high) - key if descending else key - F.lit(low)
            bits = (high - low).bit_length()
        else:
            distance, bits = key.bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 64
            distance = F.bitwise_not(distance) if descending else distance
        distance = F.coalesce(distance, F.lit(0).cast("long"))
        found = [F.shiftrightunsigned(distance, shift).bitwiseAND(F.lit(DIGITS - 1)) for shift in range(0, bits, DIGIT_BITS)]
    if nulls:
        found.append(F.when(key.isNull(), 1).otherwise(0))
    return found


def radix_ranks(rows: DataFrame, keys: Sequence[tuple[str, bool]], rank: str = "rank") -> DataFrame:
    """The columns of `rows` and `rank`, 1, 2, 3, ... in the order of `keys`.

    A key is the name of a column of whole numbers and whether the largest comes first; a null comes last. The
    composite key is cut into digits of 11 bits; a pass sorts stably by one digit, least significant first, and
    digits that all rows share are skipped. In a pass each block of 131,072 consecutive rows counts its digits,
    prefix sums over digits and blocks give each block its places, and the rows go to them; so each pass moves every
    row once, however the keys are spread, and no task holds more than one block. Passes are written tables: a lost
    executor repeats its blocks with the same places.

    Rows that agree in all keys follow one another in the order in which they were first written. `rank` replaces a
    column of that name; other columns are carried along. An empty table stays empty.
    """
    carried = F.struct(*[F.col(f"`{name}`") for name in rows.columns if name != rank])
    values = [F.col(f"`{name}`").cast("long").alias(f"key{at}") for at, (name, _) in enumerate(keys)]
    placed = rows.select(carried.alias("row"), *values, F.monotonically_increasing_id().alias("pos"))
    placed = keep(placed.withColumn("block", F.shiftright("pos", BLOCK_BITS)), "radix")
    found = placed.agg(
        *[f(F.col(f"key{at}")).alias(f"{f.__name__}{at}") for at in range(len(keys)) for f in (F.min, F.max)],
        *[F.count(F.when(F.col(f"key{at}").isNull(), 1)).alias(f"nulls{at}") for at in range(len(keys))],
    ).first()
    passes = []
    for at in reversed(range(len(keys))):
        passes += _digits(F.col(f"key{at}"), found[f"min{at}"], found[f"max{at}"], found[f"nulls{at}"], keys[at][1])
    for digit in passes or [F.lit(0)]:  # with equal keys one pass closes the gaps between places
        placed = _pass(placed, digit)
    return placed.select("row.*", (F.col("pos") + 1).alias(rank))
