"""Batch ingest: new keys, appends that survive a retry, samples, exports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heartwood.functions.frames import number_rows
from heartwood.session import work_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared work folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def batch_sizes(n: float) -> dict[str, int]:
    """Rows per table of an ingest batch of ``n`` customers, at least one each."""
    shares = {"customers": 1, "policies": 1.5, "claims": 0.6, "loans": 0.8, "interactions": 3, "transcripts": 0.5}
    return {name: max(1, int(n * share)) for name, share in shares.items()}


def assign_batch_ids(new: DataFrame, existing: DataFrame, id_col: str, order: Sequence[Column]) -> DataFrame:
    """Consecutive keys after the largest existing one, 1 for an empty table."""
    largest = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).scalar()
    return number_rows(new, order, id_col, start=largest + 1)


def append_batch(rows: DataFrame, table_dir: str, batch: int) -> None:
    """Add rows to a table as one batch folder. Writing a batch again replaces it, so a retry adds nothing."""
    rows.write.mode("overwrite").parquet(f"{table_dir}/batch={batch}")


def read_batches(spark: SparkSession, table_dir: str, like: DataFrame) -> DataFrame:
    schema = T.StructType([*like.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(table_dir)


def replace_table(df: DataFrame, table_dir: str) -> DataFrame:
    """Create a table from a result, in place of an earlier one, and read it back."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(table_dir)
    return df.sparkSession.read.schema(df.schema).parquet(table_dir)


def newest(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Rows with the ``n`` largest keys."""
    return df.orderBy(F.col(id_col).desc()).limit(n)


def keys_above(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Distinct keys above the largest key minus ``n``."""
    largest = df.agg(F.max(id_col)).scalar()
    return df.filter(F.col(id_col) > largest - n).select(id_col).distinct()


def pick(values: Sequence[str], salt: str, *keys: Column) -> Column:
    """One of the values, chosen by a hash of the keys: the same row always gets the same value."""
    digest = F.md5(F.concat_ws("|", *keys, F.lit(salt)))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def sample_by_hash(
    df: DataFrame, id_col: str, dims: Mapping[str, Sequence[str]], n: int, salt: str = "batch"
) -> DataFrame:
    """``n`` rows in hash order, each with one value of every dimension.

    Stands for a random sample of the cross product of all lists. The product
    is never built: every row chooses its own values.
    """
    key = F.col(id_col).cast("string")
    chosen = df.withColumns({name: pick(values, f"{salt}-{name}", key) for name, values in dims.items()})
    return chosen.orderBy(F.md5(F.concat_ws("|", key, F.lit(salt))), id_col).limit(n)


CSV_OPTIONS = {"header": True, "escape": '"'}
NO_TEXT = "\u0000"  # stands for an unquoted empty field while reading, so that '' and NULL stay apart


def export_csv(df: DataFrame, path: str) -> None:
    """One file per task, each with a header. NULL is an empty field, '' a quoted one."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).options(**CSV_OPTIONS, nullValue=NO_TEXT).csv(path)
