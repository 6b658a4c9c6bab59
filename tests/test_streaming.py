"""Refreshing in micro-batches equals computing over all rows, however the input arrives."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from heartwood.functions.frames import dedup_latest
from heartwood.operators.curated import interaction_agg
from heartwood.operators.quality import run_history_summary
from heartwood.plans.tables import AS_OF
from heartwood.streaming import history
from heartwood.streaming import refresh as r
from heartwood.streaming.store import VersionedTable, latest_rows

SCHEMA = (
    "interaction_id BIGINT, customer_id BIGINT, channel STRING, interaction_type STRING, resolution_status STRING,"
    " interaction_date TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"
)


def row(key, customer, hour, kind="Complaint", channel="Phone"):
    at = f"TIMESTAMP_NTZ '2024-01-01 {hour:02d}:00:00'"
    return f"({key}L, {customer}L, '{channel}', '{kind}', 'PENDING', {at}, {at})"


# Versions of five interactions: 1 gets newer, 2 moves to another customer, 3 has an equal time.
ROWS = [
    row(1, 1, 1), row(1, 1, 5, "Payment"), row(2, 1, 2), row(2, 2, 6), row(3, 2, 3, channel="Chat"), row(3, 3, 3),
    row(4, 3, 4), row(5, 4, 1), row(5, 2, 9),
]
SPLITS = [
    [list(range(9))],
    [[0, 2, 4], [1, 3, 5], [6, 7, 8]],
    [[8, 5, 3, 1], [7, 6, 4, 2, 0]],
    [[i] for i in reversed(range(9))],
    [[0], [0, 1], [1, 2, 3, 4, 5, 6, 7, 8]],
]


def frame(spark, indices):
    return spark.sql(f"SELECT * FROM VALUES {', '.join(ROWS[i] for i in indices)}").toDF(
        *[f.split()[0] for f in SCHEMA.split(", ")]
    )


ORDER = ("created_at", "customer_id")


def latest(rows):
    return dedup_latest(rows, ["interaction_id"], *[ORDER[0], ORDER[1:]])


class Setup:
    def __init__(self, spark, folder, leaf_rows=1_000_000, held=r.HELD_DATES):
        self.spark, self.folder = spark, folder
        schema = spark.createDataFrame([], SCHEMA).schema
        self.table = r.latest_table(f"{folder}/t", schema, ("interaction_id",), leaf_rows)
        self.sums = r.channel_table(f"{folder}/a", leaf_rows)
        self.steps = (
            r.refresh(self.table, lambda batch: batch, ORDER),
            r.refresh_interaction_agg(self.table, self.sums, held),
        )

    def land(self, batches):
        """One file per batch, and one micro-batch per file."""
        for i, indices in enumerate(batches):
            frame(self.spark, indices).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        return self

    def run(self):
        source = r.file_stream(self.spark, f"{self.folder}/in", SCHEMA, files=1)
        r.run(source, f"{self.folder}/checkpoint", *self.steps)
        return self

    def give(self, rows, number):
        for step in self.steps:
            step(rows, number)
        return self

    def current(self):
        return sorted(self.table.read(self.spark).collect())

    def aggregates(self):
        return sorted(r.current_interaction_agg(self.spark, self.sums, AS_OF).collect(), key=str)

    def by_batch(self):
        return sorted(interaction_agg(self.table.read(self.spark), AS_OF).collect(), key=str)


@pytest.fixture
def setup(spark, tmp_path):
    return Setup(spark, str(tmp_path))


@pytest.mark.parametrize("split", SPLITS)
def test_any_split_in_any_order(spark, setup, split):
    setup.land(split).run()
    everything = latest(frame(spark, range(9)))
    assert setup.current() == sorted(everything.collect())
    assert setup.aggregates() == sorted(interaction_agg(everything, AS_OF).collect(), key=str)
    assert len(setup.current()) == 5
    assert len(setup.table.versions(spark)) == len(setup.sums.versions(spark)) == len(split)


def test_a_restart_takes_only_new_files(spark, setup):
    setup.land([[0, 2]]).run()
    assert setup.table.versions(spark) == [0]
    setup.run()
    assert setup.table.versions(spark) == [0]
    setup.land([[1, 3]]).run()
    assert sorted(x.customer_id for x in setup.table.read(spark).collect()) == [1, 2]


def test_a_repeated_batch_adds_nothing(spark, setup):
    for _ in range(2):
        setup.give(frame(spark, range(9)), 0)
    assert setup.table.versions(spark) == [0] and len(setup.current()) == 5
    assert setup.aggregates() == setup.by_batch()


def test_a_batch_that_stopped_between_its_steps_is_taken_up_again(spark, setup):
    setup.give(frame(spark, [0, 2, 4]), 0)
    setup.steps[0](frame(spark, [1, 3, 5, 6]), 1)  # the second step is lost
    setup.give(frame(spark, [1, 3, 5, 6]), 1)
    assert setup.aggregates() == setup.by_batch()


def test_a_late_older_row_changes_nothing(spark, setup):
    setup.land([[1], [0]]).run()
    assert [x.interaction_type for x in setup.table.read(spark).collect()] == ["Payment"]
    assert setup.table.changes(spark, 1).count() == 0


def test_a_customer_without_rows_leaves_the_aggregate(spark, setup):
    setup.land([[7], [8]]).run()
    assert [x.customer_id for x in setup.aggregates()] == [2]


def test_only_touched_customers_are_recomputed(spark, setup):
    setup.land([[0, 4, 6], [1]]).run()
    assert [x.customer_id for x in setup.sums.changes(spark, 1).collect()] == [1]


def corrections(seed, batches, size, customers=6):
    """Batches that add interactions and correct earlier ones: newer, older, moved, without date or customer."""
    draw, out = random.Random(seed), []
    for number in range(batches):
        rows = []
        for _ in range(size):
            key = draw.randint(1, size * (number + 1))
            at = "NULL" if draw.random() < 0.05 else f"TIMESTAMP_NTZ '2024-01-{draw.randint(1, 28):02d} 0{draw.randint(0, 9)}:00:00'"
            made = f"TIMESTAMP_NTZ '2024-02-{draw.randint(1, 28):02d} 00:{draw.randint(0, 59):02d}:00'"
            customer = "NULL" if draw.random() < 0.05 else f"{1 if draw.random() < 0.4 else draw.randint(1, customers)}L"
            kind, channel = draw.choice(["Complaint", "Payment"]), draw.choice(["'Phone'", "'Chat'", "NULL"])
            rows.append(f"({key}L, {customer}, {channel}, '{kind}', '{draw.choice(['ESCALATED', 'PENDING'])}', {at}, {made})")
        out.append(rows)
    return out


def to_frame(spark, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [f.split()[1] for f in SCHEMA.split(", ")]
    values = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)}").toDF(*names)
    return values.select(*[F.col(n).cast(t).alias(n) for n, t in zip(names, types, strict=True)])


@pytest.mark.parametrize("held", [1, 3, 32])
def test_five_batches_with_corrections_equal_the_batch_result(spark, tmp_path, held):
    setup = Setup(spark, str(tmp_path), leaf_rows=20, held=held)
    batches = corrections(held, 5, 30)
    for number, rows in enumerate(batches):
        setup.give(to_frame(spark, rows), number)
        assert setup.aggregates() == setup.by_batch(), number
    names = setup.table.schema.names
    keyed = lambda rows: {x.interaction_id: x.created_at for x in rows}
    everything = latest(to_frame(spark, [r for rows in batches for r in rows])).select(*names)
    assert keyed(setup.table.read(spark).collect()) == keyed(everything.collect())


def test_the_interactions_are_read_again_only_where_the_held_dates_run_dry(spark, tmp_path, monkeypatch):
    setup, asked = Setup(spark, str(tmp_path), held=2), []
    read = VersionedTable.read

    def watched(table, session, version=None):
        asked.append(table.path)
        return read(table, session, version)

    monkeypatch.setattr(VersionedTable, "read", watched)
    setup.give(to_frame(spark, [row(k, 1, k) for k in range(1, 7)]), 0)
    setup.give(to_frame(spark, [row(6, 1, 0).replace("2024-01-01 00", "2024-01-01 06").replace("Complaint", "Payment")]), 1)
    assert asked == []
    moved = [row(k, 9, k, "Payment").replace("created", "") for k in (5, 6)]
    later = [m[: m.rindex("TIMESTAMP_NTZ")] + "TIMESTAMP_NTZ '2024-03-01 00:00:00')" for m in moved]
    setup.give(to_frame(spark, later), 2)
    assert asked == [setup.table.path]
    assert setup.aggregates() == setup.by_batch()


def test_a_batch_reads_its_leaves_and_not_the_table(spark, tmp_path):
    schema = spark.createDataFrame([], "id bigint, v bigint").schema
    table = VersionedTable(str(tmp_path / "t"), schema, ("id",), leaf_rows=20, keeps_was=True)
    merge = latest_rows(table, ["id"], ["v"])
    for number in range(3):  # a leaf is split once per batch that writes it
        table.apply(spark.range(400).select("id", F.lit(number).cast("bigint").alias("v")), number, merge)
    leaves = table.version(spark).leaves
    assert sum(leaf.rows for leaf in leaves.values()) == 400 and len(leaves) > 20
    assert table.apply(spark.createDataFrame([(k, 9) for k in (7, 103, 299)], schema), 3, merge)
    work = table.version(spark).work
    assert work["arrived"] == work["touched"] == 3 and work["leaves_read"] <= 3 and work["rows_read"] <= 3 * 40
    assert sorted((x.id, x.v) for x in table.read(spark).collect()) == [(k, 9 if k in (7, 103, 299) else 2) for k in range(400)]


def test_a_reader_sees_the_table_before_or_after_a_batch(spark, setup, monkeypatch):
    setup.give(frame(spark, [0, 2]), 0)
    reader, before = setup.table.read(spark), setup.current()

    def stopped(*_):
        assert setup.current() == before  # all files are written, the manifest is not
        raise KeyboardInterrupt

    monkeypatch.setattr("heartwood.sources.files.SharedFiles.write_new", stopped)
    with pytest.raises(KeyboardInterrupt):
        setup.steps[0](frame(spark, [1, 3]), 1)
    monkeypatch.undo()
    assert setup.current() == before
    setup.steps[0](frame(spark, [1, 3]), 1)
    assert sorted(reader.collect()) == before and setup.current() != before
    assert sorted(setup.table.read(spark, setup.table.version(spark, 0)).collect()) == before


def test_two_writers_cannot_make_the_same_version(spark, setup, monkeypatch):
    setup.steps[0](frame(spark, [0]), 0)
    old = setup.table.version(spark)
    setup.steps[0](frame(spark, [1]), 1)
    monkeypatch.setattr(VersionedTable, "version", lambda *_: old)
    with pytest.raises(RuntimeError, match="another writer"):
        setup.steps[0](frame(spark, [2]), 2)


def test_vacuum_keeps_what_the_last_versions_name(spark, setup):
    for number, split in enumerate([[0], [1], [3], [5], [7, 8]]):
        setup.steps[0](frame(spark, split), number)
    before = setup.current()
    setup.table.vacuum(spark, keep=1)
    assert setup.table.versions(spark) == [4] and setup.current() == before
    setup.steps[0](frame(spark, range(9)), 5)
    assert setup.current() == sorted(latest(frame(spark, range(9))).collect())


def complaints(*customers):
    return [row(100 * c + k, c, k) for c, n in customers for k in range(1, n + 1)]


def test_an_alert_is_sent_when_the_line_is_crossed(spark, tmp_path, rows):
    setup = Setup(spark, str(tmp_path))
    customers = rows("customer_id, customer_segment", "(1L, 'VIP'), (2L, 'Premium'), (3L, 'Basic')")
    alerts, log = r.alert_table(f"{setup.folder}/alerts"), f"{setup.folder}/events"
    setup.steps = (*setup.steps, r.refresh_vip_alerts(setup.sums, customers, alerts, log))
    setup.give(to_frame(spark, complaints((1, 3), (2, 2), (3, 5))), 0)  # rise
    setup.give(to_frame(spark, [row(150, 1, 7)]), 1)  # repeat
    setup.give(to_frame(spark, [row(150, 1, 7)]), 1)  # the same batch again
    assert [(x.customer_id, x.complaint_count) for x in r.current_alerts(spark, alerts).collect()] == [(1, 4)]
    settled = [row(100 + k, 1, 20, "Payment") for k in (1, 2)]
    setup.give(to_frame(spark, settled), 2)  # fall
    events = [(x.batch, x.customer_id, x.state, x.complaint_count) for x in r.alert_events(spark, log).orderBy("batch").collect()]
    assert events == [(0, 1, "raised", 3), (2, 1, "cleared", 2)]
    assert r.current_alerts(spark, alerts).collect() == []
    setup.give(to_frame(spark, [row(151, 1, 7), row(202, 2, 22)]), 3)
    assert [(x.customer_id, x.complaint_count) for x in r.current_alerts(spark, alerts).collect()] == [(1, 3)]


def test_untouched_customers_age_with_today(spark, setup):
    setup.land([[0], [4]]).run()
    later = AS_OF + datetime.timedelta(days=30)
    found = {x.customer_id: x for x in r.current_interaction_agg(spark, setup.sums, later).collect()}
    assert sorted(found.values()) == sorted(interaction_agg(setup.table.read(spark), later).collect())
    assert len(found) == 2


REPLY = "customer_id BIGINT, score DOUBLE, arrived_at TIMESTAMP, arrived_in STRING, arrived_as BIGINT"


def replies(spark, folder):
    table = r.latest_table(f"{folder}/replies", spark.createDataFrame([], REPLY).schema, ("customer_id",))
    return r.refresh(table, lambda batch: batch, r.ARRIVAL), r.refresh_parse_failure(table, "score", f"{folder}/rates")


def test_any_cut_of_the_replies_gives_the_same_rate(spark, tmp_path):
    given = [(1, None), (2, 0.3), (1, 0.4), (3, None), (2, None), (3, 0.1), (2, None), (4, 0.2), (1, None)]
    want = {}
    for customer, score in given:
        want[customer] = score
    rate = round(100 * sum(s is None for s in want.values()) / len(want), 2)
    day = datetime.datetime(2024, 1, 1)
    rows = [(c, s, day + datetime.timedelta(hours=n // 4), f"file-{n // 2 % 2}", n % 2) for n, (c, s) in enumerate(given)]
    for name, cuts in {"one": [9], "each": [1, 2, 3, 5, 6, 8, 9], "some": [2, 7, 9]}.items():
        steps, low = replies(spark, f"{tmp_path}/{name}"), 0
        for number, high in enumerate(cuts):
            for step in steps:
                step(spark.createDataFrame(rows[low:high], REPLY), number)
            low = high
        assert r.latest_metric(spark, f"{tmp_path}/{name}/rates").first().failure_rate == rate, name


def test_replies_of_a_stream_carry_their_arrival(spark, tmp_path):
    for number in range(2):
        spark.createDataFrame([(1, None if number else 0.5), (2, 0.1)], "customer_id BIGINT, score DOUBLE").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for name, files in (("one", 1), ("both", 5)):
        source = r.with_arrival(r.file_stream(spark, f"{tmp_path}/in", "customer_id BIGINT, score DOUBLE", files=files))
        r.run(source, f"{tmp_path}/{name}/checkpoint", *replies(spark, f"{tmp_path}/{name}"))
        assert r.latest_metric(spark, f"{tmp_path}/{name}/rates").first().failure_rate == 50.0, name


def test_a_mended_reply_replaces_a_failed_one(spark, tmp_path):
    steps = replies(spark, str(tmp_path))
    for number, (score, rate) in enumerate([(None, 100.0), (0.4, 0.0), (None, 100.0), (0.1, 0.0), (0.1, 0.0)]):
        for step in steps:
            step(spark.createDataFrame([(1, score, datetime.datetime(2024, 1, 1 + number), "a", 0)], REPLY), number)
        assert r.latest_metric(spark, str(tmp_path / "rates")).first().failure_rate == rate


def test_run_log_keeps_whole_messages(spark, tmp_path):
    def fail():
        raise ValueError("x" * 2000)

    with pytest.raises(ValueError):
        history.logged(spark, str(tmp_path / "runs"), "job", fail)
    assert len(history.run_log(spark, str(tmp_path / "runs")).first().message) == 2000


def test_run_log_keeps_failures(spark, tmp_path):
    folder = str(tmp_path / "runs")
    history.logged(spark, folder, "job", lambda: None)
    with pytest.raises(ZeroDivisionError):
        history.logged(spark, folder, "job", lambda: 1 / 0)
    summary = run_history_summary(history.run_log(spark, folder)).first()
    assert (summary.runs, summary.succeeded, summary.failed) == (2, 1, 1)
    assert [x.state for x in history.recent_runs(history.run_log(spark, folder)).collect()] == ["FAILED", "SUCCEEDED"]


def test_run_log_counts_what_a_run_did(spark, setup):
    setup.land([[0, 2, 4], [1, 3]])
    history.logged(spark, f"{setup.folder}/runs", "first", setup.run, [setup.table])
    setup.land([[5, 6]])
    history.logged(spark, f"{setup.folder}/runs", "second", setup.run, [setup.table])
    runs = {x.job: x for x in history.run_log(spark, f"{setup.folder}/runs").collect()}
    assert (runs["first"].batches, runs["first"].rows_read, runs["first"].rows_changed) == (2, 5, 5)
    assert (runs["second"].batches, runs["second"].rows_read, runs["second"].rows_changed) == (1, 2, 2)
    assert all(x.seconds > 0 and x.finished_at > x.started_at for x in runs.values())
