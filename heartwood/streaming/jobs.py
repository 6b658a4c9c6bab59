"""Refresh jobs over the given tables, each returning the table it keeps current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.operators.clean import normalise_interactions
from heartwood.operators.enrich import CHURN_FIELDS, parse_model_json
from heartwood.operators.quality import run_history_summary
from heartwood.plans.tables import Tables
from heartwood.sources.ingest import new_folder
from heartwood.sources.raw import raw_interactions, raw_model_output
from heartwood.sources.tables import SCHEMAS
from heartwood.streaming import history
from heartwood.streaming import refresh as r
from heartwood.streaming.store import VersionedTable


def given_stream(t: Tables, name: str) -> DataFrame:
    return r.file_stream(t.spark, t.sf_dir, SCHEMAS[name], pattern=f"{name}.parquet")


def interaction_table(t: Tables, folder: str) -> VersionedTable:
    return r.latest_table(f"{folder}/interactions", t["clean_interactions"].schema, ("interaction_id",))


def clean_step(table: VersionedTable) -> r.OnBatch:
    return r.refresh(table, lambda batch: normalise_interactions(raw_interactions(batch)), ("created_at", "customer_id"))


def refresh_interactions(t: Tables, folder: str) -> VersionedTable:
    table = interaction_table(t, folder)
    r.run(given_stream(t, "events"), f"{folder}/checkpoint", clean_step(table))
    return table


def stream_clean_interactions(t: Tables) -> DataFrame:
    return refresh_interactions(t, new_folder(t.spark, "stream")).read(t.spark)


def stream_interaction_agg(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "stream")
    table, sums = interaction_table(t, folder), r.channel_table(f"{folder}/channel_sums")
    steps = clean_step(table), r.refresh_interaction_agg(table, sums)
    r.run(given_stream(t, "events"), f"{folder}/checkpoint", *steps)
    return r.current_interaction_agg(t.spark, sums, t.as_of)


def parsed_replies(batch: DataFrame) -> DataFrame:
    score = parse_model_json(F.col("raw_text"), CHURN_FIELDS)["churn_risk_score"]
    return raw_model_output(batch, *r.ARRIVAL).select("customer_id", score.alias("churn_risk_score"), *r.ARRIVAL)


def reply_table(t: Tables, folder: str) -> VersionedTable:
    schema = "customer_id bigint, churn_risk_score double, arrived_at timestamp, arrived_in string, arrived_as bigint"
    return r.latest_table(f"{folder}/replies", r.T.StructType.fromDDL(schema), ("customer_id",))


def refresh_replies(t: Tables, folder: str) -> VersionedTable:
    table = reply_table(t, folder)
    steps = r.refresh(table, parsed_replies, r.ARRIVAL), r.refresh_parse_failure(table, "churn_risk_score", f"{folder}/rates")
    r.run(r.with_arrival(given_stream(t, "customer")), f"{folder}/checkpoint", *steps)
    return table


def stream_parse_failure(t: Tables) -> DataFrame:
    """Model replies as they arrive; the failure rate of all replies after the last change."""
    folder = new_folder(t.spark, "stream")
    refresh_replies(t, folder)
    return r.latest_metric(t.spark, f"{folder}/rates")


def refresh_alerts(t: Tables, folder: str) -> VersionedTable:
    table, sums = interaction_table(t, folder), r.channel_table(f"{folder}/channel_sums")
    alerts = r.alert_table(f"{folder}/alerts")
    steps = (
        clean_step(table),
        r.refresh_interaction_agg(table, sums),
        r.refresh_vip_alerts(sums, t["clean_customers"], alerts, f"{folder}/events"),
    )
    r.run(given_stream(t, "events"), f"{folder}/checkpoint", *steps)
    return alerts


def stream_alerts(t: Tables) -> DataFrame:
    return r.current_alerts(t.spark, refresh_alerts(t, new_folder(t.spark, "stream")))


def stream_alert_events(t: Tables) -> DataFrame:
    """The crossings of the line as they were sent; over one batch each standing alert has crossed it once."""
    folder = new_folder(t.spark, "stream")
    refresh_alerts(t, folder)
    return r.alert_events(t.spark, f"{folder}/events").drop("batch")


def run_log(t: Tables) -> DataFrame:
    """Two refresh jobs over the given tables, and the log they leave."""
    log_dir, folder = new_folder(t.spark, "runs"), new_folder(t.spark, "stream")
    jobs = {
        "refresh_interactions": (refresh_interactions, interaction_table),
        "refresh_parse_failure": (refresh_replies, reply_table),
    }
    for name, (job, table) in jobs.items():
        own = f"{folder}/{name}"
        history.logged(t.spark, log_dir, name, lambda job=job, own=own: job(t, own), [table(t, own)])
    return history.run_log(t.spark, log_dir)


def run_history(t: Tables) -> DataFrame:
    return run_history_summary(run_log(t)).drop("avg_seconds")


def run_list(t: Tables) -> DataFrame:
    """The list of runs without its times."""
    return history.recent_runs(run_log(t)).select("job", "state", "message", "batches", "rows_read", "rows_written", "rows_changed")
