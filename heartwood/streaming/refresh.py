"""Incremental refresh of derived tables with Structured Streaming.

Each step of a micro-batch merges into a bucketed table of its own (`store.py`) and hands on what changed: rows with
the rows they replaced. Aggregates follow as signed deltas, the new row's share less the old one's, so no step reads
more than the leaves that its batch falls into. A step that is run again finds its batch done and reads the changes
from that batch's folder; a late, older row loses by its time, not by its arrival.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heartwood.functions.columns import most_common, percentage
from heartwood.functions.frames import top_per_key
from heartwood.operators.curated import days_since
from heartwood.streaming.store import TOUCHED, WAS, Merge, VersionedTable, latest_rows

OnBatch = Callable[[DataFrame, int], None]

#: Newest dates that the aggregate holds per customer and channel.
HELD_DATES = 32


def run(source: DataFrame, checkpoint: str, *steps: OnBatch) -> int:
    """Process all available input, one micro-batch after the other, through the steps. Returns the rows read."""

    def each(batch: DataFrame, batch_id: int) -> None:
        for step in steps:
            step(batch, batch_id)

    query = (
        source.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(progress["numInputRows"] for progress in query.recentProgress)


def file_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, ``files`` per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files)
        .parquet(folder)
    )


ARRIVAL = ("arrived_at", "arrived_in", "arrived_as")


def with_arrival(stream: DataFrame) -> DataFrame:
    """Rows of a file stream with the order in which they arrived: time and path of the file, position inside it.

    The order belongs to the row, not to the micro-batch that happens to take its file.
    """
    meta = ("file_modification_time", "file_path", "row_index")
    return stream.select("*", *[F.col(f"_metadata.{name}").alias(own) for name, own in zip(meta, ARRIVAL, strict=True)])


def latest_table(path: str, schema: T.StructType, keys: tuple[str, ...], leaf_rows: int = 1_000_000) -> VersionedTable:
    return VersionedTable(path, schema, keys, leaf_rows, keeps_was=True)


def refresh(table: VersionedTable, transform: Callable[[DataFrame], DataFrame], order: tuple[str, ...]) -> OnBatch:
    """Step: keep the newest row per key, by `order` with NULL as the largest value."""
    merge = latest_rows(table, table.bucket_by, order)

    def step(batch: DataFrame, batch_id: int) -> None:
        table.apply(transform(batch), batch_id, merge)

    return step


# Interactions per customer and channel: sums as they are, and the newest dates with their counts. `floor` is the
# newest date that was ever left out, so all dates above it are held.
CHANNEL_SUMS = (
    "customer_id bigint, channel string, n bigint, complaints bigint, escalations bigint, floor timestamp_ntz,"
    " dates array<struct<at: timestamp_ntz, n: bigint>>"
)


def channel_table(path: str, leaf_rows: int = 1_000_000) -> VersionedTable:
    return VersionedTable(path, T.StructType.fromDDL(CHANNEL_SUMS), ("customer_id",), leaf_rows)


def interaction_deltas(changes: DataFrame) -> DataFrame:
    """Per customer, channel and date: what a batch adds, less what the rows it replaced had added."""
    columns = ("customer_id", "channel", "interaction_type", "resolution_status", "interaction_date")
    now = changes.select(F.lit(1).alias("sign"), *columns)
    was = changes.filter(F.col(WAS).isNotNull()).select(F.lit(-1).alias("sign"), *[F.col(f"{WAS}.{c}") for c in columns])

    def signed(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("sign")).otherwise(0)).cast("bigint")

    return now.unionByName(was).groupBy("customer_id", "channel", F.col("interaction_date").alias("at")).agg(
        F.sum("sign").cast("bigint").alias("n"),
        signed(F.col("interaction_type") == "Complaint").alias("complaints"),
        signed(F.col("resolution_status") == "ESCALATED").alias("escalations"),
    )


def _newest_dates(per_date: DataFrame, held: int) -> DataFrame:
    """`customer_id`, `channel`, `newest`: one date more than is held, newest first."""
    first = top_per_key(per_date, ["customer_id", "channel"], [F.col("at").desc()], held + 1)
    return first.groupBy("customer_id", "channel").agg(F.sort_array(F.collect_list(F.struct("at", "n")), asc=False).alias("newest"))


def _left(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """A left join on customer and channel, which may be NULL."""
    right = right.select(F.col("customer_id").alias("_customer"), F.col("channel").alias("_channel"), value)
    same = F.col("customer_id").eqNullSafe(F.col("_customer")) & F.col("channel").eqNullSafe(F.col("_channel"))
    return left.join(right, same, "left").drop("_customer", "_channel")


def merge_deltas(rows: Callable[[], DataFrame], held: int, cached: list[DataFrame]) -> Merge:
    """Merge: add signed deltas to the channel sums. What it caches for the write is added to `cached`.

    Sums and counts need nothing but the delta. The newest date and the most common channel follow from the held
    dates and the counts. Only where corrections have emptied the held dates of a customer and channel that still
    has rows are the dates taken from the `rows` themselves again, for these customers alone.
    """

    def merge(stored: DataFrame, deltas: DataFrame) -> DataFrame:
        keys = ["customer_id", "channel"]
        sums = ["n", "complaints", "escalations"]
        fresh = deltas.select(*keys, *sums, F.lit(None).cast("timestamp_ntz").alias("floor"), F.lit(True).alias(TOUCHED))
        known = stored.filter("n > 0").select(*keys, *sums, "floor", F.lit(False).alias(TOUCHED))
        totals = known.unionByName(fresh).groupBy(*keys).agg(
            *[F.sum(name).alias(name) for name in sums], F.max("floor").alias("floor"), F.bool_or(TOUCHED).alias(TOUCHED)
        )
        dates = stored.select(*keys, F.explode("dates").alias("d")).select(*keys, "d.at", "d.n")
        changed = deltas.filter(F.col("at").isNotNull()).select(*keys, "at", "n")
        per_date = dates.unionByName(changed).groupBy(*keys, "at").agg(F.sum("n").alias("n")).filter("n > 0")
        merged = _left(totals, _newest_dates(per_date, held), "newest")
        above = F.coalesce(F.filter("newest", lambda d: F.col("floor").isNull() | (d["at"] > F.col("floor"))), F.array())
        merged = merged.withColumn("newest", above)
        if not stored.filter("floor IS NOT NULL").isEmpty():  # only these can run dry
            merged = merged.persist()
            cached.append(merged)
            dry = merged.filter((F.col("n") > 0) & F.col("floor").isNotNull() & (F.size("newest") == 0)).select(*keys)
            if not dry.isEmpty():
                merged = _refilled(merged, dry, rows(), held)
        too_many = F.size("newest") > held
        return merged.select(
            *keys,
            *sums,
            F.when(too_many, F.col("newest")[held]["at"]).otherwise(F.col("floor")).alias("floor"),
            F.slice("newest", 1, held).alias("dates"),
            TOUCHED,
        )

    return merge


def _refilled(merged: DataFrame, dry: DataFrame, rows: DataFrame, held: int) -> DataFrame:
    """The held dates of some customers and channels, taken from all their rows."""
    wanted = dry.select(F.col("customer_id").alias("_customer"), F.col("channel").alias("_channel"))
    same = F.col("customer_id").eqNullSafe(F.col("_customer")) & F.col("channel").eqNullSafe(F.col("_channel"))
    theirs = rows.filter("interaction_date IS NOT NULL").join(wanted, same, "left_semi")
    per_date = theirs.groupBy("customer_id", "channel", F.col("interaction_date").alias("at")).agg(F.count("*").alias("n"))
    again = _newest_dates(per_date, held).withColumnRenamed("newest", "again")
    mark = dry.withColumn("is_dry", F.lit(True))
    found = _left(_left(merged, again, "again"), mark, "is_dry")
    newest = F.when(F.col("is_dry"), F.coalesce("again", F.array())).otherwise(F.col("newest"))
    floor = F.when(F.col("is_dry"), None).otherwise(F.col("floor"))
    return found.withColumns({"newest": newest, "floor": floor}).drop("again", "is_dry")


def refresh_interaction_agg(source: VersionedTable, target: VersionedTable, held: int = HELD_DATES) -> OnBatch:
    """Step: bring the channel sums up to date with what the batch changed in the interactions.

    What depends on today is left out, so untouched customers do not grow stale; `current_interaction_agg` adds it.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cached: list[DataFrame] = []
        merge = merge_deltas(lambda: source.read(spark), held, cached)
        try:
            target.apply(interaction_deltas(source.changes(spark, batch_id)), batch_id, merge)
        finally:
            for frame in cached:
                frame.unpersist()

    return step


def current_interaction_agg(spark: SparkSession, target: VersionedTable, as_of: datetime.date) -> DataFrame:
    """The interaction aggregate from the channel sums; the interactions are not read."""
    sums = target.read(spark).filter("n > 0")
    return days_since(
        sums.groupBy("customer_id").agg(
            F.sum("n").alias("total_interactions"),
            F.sum("complaints").alias("complaint_count"),
            F.sum("escalations").alias("escalation_count"),
            F.max(F.get("dates", F.lit(0))["at"]).alias("last_interaction_date"),
            most_common("channel", "n").alias("preferred_channel"),
        ),
        as_of,
    )


RATES = "failures bigint, replies bigint, failure_rate double, batch bigint"


def refresh_parse_failure(table: VersionedTable, name: str, log_dir: str) -> OnBatch:
    """Step: failures and replies counted on from the batch before, by what this batch changed."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        failed = lambda column: F.when(column.isNull(), 1).otherwise(0)
        had = F.col(WAS).isNotNull()
        changes = table.changes(spark, batch_id).select(
            (failed(F.col(name)) - F.when(had, failed(F.col(f"{WAS}.{name}"))).otherwise(0)).cast("bigint").alias("failures"),
            F.when(had, 0).otherwise(1).cast("bigint").alias("replies"),
        )
        if batch_id:
            earlier = spark.read.schema(RATES).parquet(f"{log_dir}/batch={batch_id - 1}")
            changes = changes.unionByName(earlier.select("failures", "replies"))
        sums = changes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("failures", "replies")])
        rate = sums.withColumn("failure_rate", percentage(F.col("failures"), F.col("replies")))
        rate.write.mode("overwrite").parquet(f"{log_dir}/batch={batch_id}")

    return step


def latest_metric(spark: SparkSession, log_dir: str) -> DataFrame:
    rows = spark.read.schema(RATES).parquet(log_dir)
    return rows.orderBy(F.col("batch").desc()).limit(1).select("failure_rate")


# Where a customer stands: below the line, at the crossing (raised, cleared), or above it since an earlier batch.
ALERTS = "customer_id bigint, customer_segment string, complaint_count bigint, state string"
COMPLAINTS_RAISE = 3


def alert_table(path: str, leaf_rows: int = 1_000_000) -> VersionedTable:
    return VersionedTable(path, T.StructType.fromDDL(ALERTS), ("customer_id",), leaf_rows)


def _transitions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each customer's next state, from the one stored and the count that came in."""
    sides = stored.select("customer_id", F.struct("customer_segment", "complaint_count", "state").alias("was"), F.lit(None).alias("now")), (
        incoming.select("customer_id", F.lit(None).alias("was"), F.struct("customer_segment", "complaint_count").alias("now"))
    )
    both = sides[0].unionByName(sides[1]).groupBy("customer_id").agg(F.any_value("was", True).alias("was"), F.any_value("now", True).alias("now"))
    before = F.coalesce(F.col("was.state").isin("raised", "still raised"), F.lit(False))
    above = F.col("now.complaint_count") >= COMPLAINTS_RAISE
    state = F.when(above & before, "still raised").when(above, "raised").when(before, "cleared").otherwise("below")
    touched = F.col("now").isNotNull()
    return both.select(
        "customer_id",
        *[F.when(touched, F.col(f"now.{c}")).otherwise(F.col(f"was.{c}")).alias(c) for c in ("customer_segment", "complaint_count")],
        F.when(touched, state).otherwise(F.col("was.state")).alias("state"),
        touched.alias(TOUCHED),
    )


def refresh_vip_alerts(sums: VersionedTable, customers: DataFrame, alerts: VersionedTable, log_dir: str) -> OnBatch:
    """Step: one event when a high-value customer's complaints reach three, and one when they fall below again.

    Three complaints alone put a customer at High risk, so the aggregate decides. Only customers the batch touched
    are looked at; one who stays above the line gives no further event.
    """
    people = customers.filter(F.col("customer_segment").isin("VIP", "Premium")).select("customer_id", "customer_segment")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        per_customer = sums.written(spark, batch_id).groupBy("customer_id").agg(F.sum("complaints").alias("complaint_count"), F.bool_or(TOUCHED).alias(TOUCHED))
        known = per_customer.filter(TOUCHED).join(people, "customer_id").select("customer_id", "customer_segment", "complaint_count")
        alerts.apply(known, batch_id, _transitions)
        events = alerts.changes(spark, batch_id).filter(F.col("state").isin("raised", "cleared"))
        events.select("customer_id", "customer_segment", "complaint_count", "state").write.mode("overwrite").parquet(f"{log_dir}/batch={batch_id}")

    return step


def alert_events(spark: SparkSession, log_dir: str) -> DataFrame:
    """Every crossing of the line, with its batch."""
    return spark.read.schema(f"{ALERTS}, batch bigint").parquet(log_dir)


def current_alerts(spark: SparkSession, alerts: VersionedTable) -> DataFrame:
    """Customers above the line now."""
    standing = alerts.read(spark).filter(F.col("state").isin("raised", "still raised"))
    return standing.select("customer_id", "customer_segment", "complaint_count")
