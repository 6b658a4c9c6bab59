"""Tables kept between jobs, and Arrow batches that never cut a group."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heartwood.session import work_dir


#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the one all executors share."""
    return f"{work_dir(spark)}/{name}-{uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs start there, whatever executors are lost."""
    spark = df.sparkSession
    free_shuffles(spark)
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def free_shuffles(spark: SparkSession, pause: float = 0.0) -> None:
    """Let Spark delete the shuffles behind tables that are written and plans that are dropped.

    It does so in the background when the driver's JVM collects their owners, which a quiet driver may not do for
    half an hour. A pause lets large ones go before the next job writes its own.
    """
    gc.collect()  # Python's ends of dropped plans
    spark.sparkContext._jvm.System.gc()
    time.sleep(pause)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """`doc_id`, `text`, and a struct `doc` of the carried columns, so that no other column can clash with them.

    Rows go to Python and back in batches that hold few texts: documents are long, and each worker holds a batch
    on its way in, the same one in work, and one on its way out.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    if carried is not None:
        columns.append(F.struct(*[F.col(f"`{name}`") for name in carried]).alias("doc"))
    return docs.select(*columns)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`mapInArrow`, giving memory back when a task ends: workers live on, and what they hold adds up beside the heap."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return df.mapInArrow(tidy, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes."""
    return column.cast(pa.binary()).to_pylist()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by integer keys. Memory: one batch and one group."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        cut = int(group_starts(table, keys)[-1])
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of a sorted table begins."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        values = table[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def binaries(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """A column of equally long binaries as the rows of a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)
