"""DataFrame helpers: latest row per key, top rows per key, distributed row numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heartwood.functions.columns import newest_first
from heartwood.session import work_dir


# Up to this setting of the session Spark limits groups before the shuffle.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 64


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each key.

    Spark limits each group inside every map task before the shuffle
    (WindowGroupLimit), so a key that holds a third of all rows sends ``n``
    rows per task, not all of them. Above Spark's threshold for that, a first
    round keeps the best ``n`` per key and salt, spread over many tasks.
    """
    if n > int(df.sparkSession.conf.get(GROUP_LIMIT)):
        salted = df.withColumn("_salt", F.spark_partition_id() % SALTS)
        df = _first_rows(salted, [*keys, "_salt"], order, n, "_rank").drop("_rank", "_salt")
    kept = _first_rows(df, keys, order, n, rank or "_rank")
    return kept.withColumn(rank, F.col(rank).cast("bigint")) if rank else kept.drop("_rank")


def _first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def dedup_latest(
    df: DataFrame, keys: Sequence[str], order_col: str, tiebreak: Sequence[str] = (), repeated: DataFrame | None = None
) -> DataFrame:
    """Newest row of each key. An unknown time counts as newest; ``tiebreak`` settles equal times.

    ``repeated`` may name all keys that occur more than once (others among them do no harm), as `repeated_keys`
    finds them. Then only their rows are sorted, and all others stay where they are.
    """
    order = [newest_first(c) for c in (order_col, *tiebreak)]
    if repeated is None:
        return top_per_key(df, keys, order, 1)
    if repeated.isEmpty():
        return df
    named = repeated.select(*[F.col(key).alias(f"_{key}") for key in keys])
    same = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])
    once = df.join(named, same, "left_anti")
    return once.unionByName(top_per_key(df.join(named, same, "left_semi"), keys, order, 1))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys, NULL included, that more than one row has. Only keys and counts move."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys)


def outer_key(key: Column) -> Column:
    """Join key as text for the left side of an outer join, with the NULLs spread.

    NULL matches nothing, but in a shuffled join all NULL keys would go to one
    task. Here each map task gives its NULLs a key of their own that no real key
    equals.
    """
    return F.coalesce(key.cast("string"), F.concat(F.lit("none-"), F.spark_partition_id()))


def number_rows(df: DataFrame, order: Sequence[Column], name: str, start: int | Column = 1) -> DataFrame:
    """Consecutive numbers over the whole frame in the given order, without one task seeing all rows.

    The sort is written to the shared checkpoint folder first. That fixes which
    row sits in which partition, so the per-partition counts and the numbers
    built from them stay right when a task is run again.
    """
    work_dir(df.sparkSession)
    placed = (
        df.orderBy(*order)
        .checkpoint()
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # One row per partition: the window below runs over the partition count only.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    first = F.lit(start) if isinstance(start, int) else start
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + first)
        .drop("_part", "_pos", "_offset")
    )
