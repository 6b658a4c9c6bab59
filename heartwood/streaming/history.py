"""The run log of refresh jobs: what each run read and wrote, how long it took, how it ended."""

from __future__ import annotations

import datetime
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from heartwood.streaming.store import VersionedTable

RUNS = (
    "job string, started_at timestamp, finished_at timestamp, seconds double, state string, message string,"
    " batches bigint, rows_read bigint, rows_written bigint, rows_changed bigint"
)


@dataclass
class Work:
    """What a run did, added up while it runs."""

    batches: int = 0
    rows_read: int = 0
    rows_written: int = 0
    rows_changed: int = 0


class ProgressListener(StreamingQueryListener):
    """Counts the batches and input rows of the streams that run while it listens."""

    def __init__(self, work: Work):
        self.work = work
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.work.batches += 1
            self.work.rows_read += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))


def logged(spark: SparkSession, log_dir: str, job: str, action: Callable[[], object], tables: Sequence[VersionedTable] = ()) -> None:
    """Run a job and leave one row about it.

    Rows read come from the streams' progress events, rows written and changed from what was observed while the
    batches of the run were written into the tables. A run that fails is logged as well and fails.
    """
    work, started, state, message = Work(), time.time(), "SUCCEEDED", None
    listener = ProgressListener(work)
    before = {table.path: table.version(spark).number for table in tables}
    spark.streams.addListener(listener)
    try:
        action()
    except Exception as error:
        state, message = "FAILED", str(error)
        raise
    finally:
        finished = time.time()
        _drain(spark)
        spark.streams.removeListener(listener)
        for table in tables:
            for version in table.history(spark):
                if version.number > before[table.path]:
                    work.rows_written += version.work["written"]
                    work.rows_changed += version.work["touched"]
        moments = [datetime.datetime.fromtimestamp(s) for s in (started, finished)]
        counts = (work.batches, work.rows_read, work.rows_written, work.rows_changed)
        row = spark.createDataFrame([(job, *moments, finished - started, state, message, *counts)], RUNS)
        row.write.mode("overwrite").parquet(f"{log_dir}/run={uuid.uuid4().hex}")


def _drain(spark: SparkSession, most: float = 10.0) -> None:
    """Wait until the events sent so far have reached the listeners."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(int(most * 1000))


def run_log(spark: SparkSession, log_dir: str) -> DataFrame:
    return spark.read.schema(RUNS).option("recursiveFileLookup", True).parquet(log_dir)


def recent_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    """The newest runs first."""
    order = [F.col("started_at").desc(), F.col("job").asc(), F.col("finished_at").desc()]
    return runs.orderBy(*order).limit(n)
