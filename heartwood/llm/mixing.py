"""Mix sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of per-source rates that are sent to every task; more sources are joined by a shuffle.
BROADCAST_ROWS = 10_000
#: Largest mean of one draw; a source with a higher rate sums several draws.
LARGEST_MEAN = 64.0


def rates(docs: DataFrame, weights: dict[str | None, float] | None, power: float, source_col: str, text_col: str) -> DataFrame:
    """`source`, `rate`: how often a document of each source should appear on average.

    The mixture is as large as the input in bytes of text (one more per document); a source's share of it is its
    weight, or without weights its size to the `power`. A source without a weight gets none.
    """
    size = F.octet_length(F.coalesce(text_col, F.lit(""))) + F.lit(1)
    sizes = docs.select(F.col(source_col).alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(power))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighted = sizes.withColumn("weight", weight)
    total = weighted.agg(F.sum("size").cast("double").alias("all_size"), F.sum("weight").alias("all_weight"))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    return weighted.join(F.broadcast(total)).select("source", (share * F.col("all_size") / F.col("size")).alias("rate"))


def cumulative(mean: Column) -> Column:
    """The cumulative Poisson probabilities of 0, 1, 2, ... up to where doubles end."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), (mean + 10 * F.sqrt(mean) + 24).cast("int")), start, step)["all"]


def uniform(*parts: Column) -> Column:
    """A number from 0 up to 1 that depends on nothing but the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    power: float = 0.5,
    seed: int = 11,
    copy_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The columns of `docs`, each row as often as a Poisson draw with its source's rate says, in random order.

    The draw inverts the cumulative Poisson probabilities at a number hashed from seed and doc_id (the text where
    that is null), so a retried task draws the same. Rows that share an id share the draw. `copy_col` adds the
    copy's number from 1, replacing a column of that name. Null source is a source of its own; null text counts
    as empty. An empty table stays empty. Any other columns are carried along untouched.
    """
    per_source = rates(docs, weights, power, source_col, text_col)
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")
    table = per_source.select("source", draws.alias("draws"), cumulative(F.col("rate") / draws).alias("cdf"))
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("text"), text_col)).otherwise(F.xxhash64(F.lit("id"), id_col))
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc"), key.alias("key"), F.col(source_col).alias("own"))
    joined = rows.join(F.broadcast(table) if few else table, F.col("own").eqNullSafe(F.col("source")))

    def drawn(acc: Column, number: Column) -> Column:
        u = uniform(F.col("key"), F.lit(seed), number)
        return acc + F.size(F.filter("cdf", lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), "draws"), F.lit(0), drawn)
    copies = joined.select("doc", "key", count.alias("count")).where("count > 0")
    copies = copies.select("doc", "key", F.explode(F.sequence(F.lit(1), "count")).alias("copy"))
    order = F.xxhash64("key", "copy", F.lit(seed + 1))
    shuffled = copies.withColumn("order", order).repartition("order").sortWithinPartitions("order")
    if copy_col is None:
        return shuffled.select("doc.*")
    return shuffled.select(*[F.col("doc")[name].alias(name) for name in docs.columns if name != copy_col], F.col("copy").alias(copy_col))
