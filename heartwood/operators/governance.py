"""Masking, regional row access and column tags. The acting role is an argument."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Roles that see everything.
PRIVILEGED = ("ACCOUNTADMIN", "SYSADMIN")

# Countries each role may read; ALL opens every country.
ROLE_REGIONS = (
    ("ACCOUNTADMIN", "ALL"),
    ("SYSADMIN", "ALL"),
    ("US_TEAM", "USA"),
    ("UK_TEAM", "UK"),
    ("APAC_TEAM", "JAPAN"),
    ("APAC_TEAM", "AUSTRALIA"),
    ("APAC_TEAM", "SINGAPORE"),
    ("APAC_TEAM", "INDIA"),
)

# Sensitivity of the customer columns and the domain of each table.
PII_LEVELS = {"email": "HIGH", "phone": "HIGH", "annual_income": "MEDIUM", "credit_score": "MEDIUM"}
DATA_DOMAINS = {
    "raw_customers": "CUSTOMER",
    "raw_policies": "POLICY",
    "raw_claims": "CLAIM",
    "raw_loans": "LOAN",
    "raw_interactions": "INTERACTION",
    "raw_documents": "DOCUMENT",
}


def mask_email(col: Column, role: str) -> Column:
    """First two characters and the domain stay. A local part of one character is left as it is."""
    return col if role in PRIVILEGED else F.regexp_replace(col, r"(^[^@]{2})[^@]*(@.*)", "$1***$2")


def mask_phone(col: Column, role: str) -> Column:
    """Prefix and last two digits stay. Needs eight or more digits in a row, shorter numbers are not masked."""
    return col if role in PRIVILEGED else F.regexp_replace(col, r"(\+?\d{1,3}[-.]?)\d{6,}(\d{2})", "$1******$2")


def mask_phone_strict(col: Column, role: str) -> Column:
    """Every digit but the last two is hidden, whatever the length."""
    if role in PRIVILEGED:
        return col
    tail = F.regexp_extract(col, r"(\d\D*\d\D*)$", 1)
    head = F.substring(col, F.lit(1), F.length(col) - F.length(tail))
    return F.concat(F.regexp_replace(head, r"\d", "*"), tail)


def mask_financial(col: Column, role: str) -> Column:
    return col if role in PRIVILEGED else F.when(F.lit(False), col)


MASKS = {"email": mask_email, "phone": mask_phone, "phone_strict": mask_phone_strict, "financial": mask_financial}

# Which mask is attached to which column.
MASKED_COLUMNS = {"email": "email", "phone": "phone", "annual_income": "financial", "credit_score": "financial"}


def masked(df: DataFrame, role: str, attached: Mapping[str, str] = MASKED_COLUMNS) -> DataFrame:
    present = {name: MASKS[kind](F.col(name), role) for name, kind in attached.items() if name in df.columns}
    return df.withColumns(present)


def role_region_mapping(spark: SparkSession, rows: Sequence[tuple[str, str]] = ROLE_REGIONS) -> DataFrame:
    return spark.createDataFrame(list(rows), "role_name string, allowed_country string")


def row_access(df: DataFrame, mapping: DataFrame, role: str, country_col: str = "country") -> DataFrame:
    """Rows the role may read. Its countries arrive as one array, so no row is moved."""
    if role in PRIVILEGED:
        return df
    countries = mapping.filter(F.col("role_name") == role).agg(F.collect_set("allowed_country")).scalar()
    return (
        df.withColumn("_allowed", countries)
        .filter(F.array_contains("_allowed", F.lit("ALL")) | F.array_contains("_allowed", F.col(country_col)))
        .drop("_allowed")
    )


def role_visibility(df: DataFrame, mapping: DataFrame, country_col: str = "country") -> DataFrame:
    """Visible rows per role: countries are counted once, then matched with the mapping."""
    per_country = df.groupBy(F.col(country_col).alias("allowed_country")).agg(F.count("*").alias("n"))
    everything = per_country.agg(F.sum("n").alias("n")).select(F.lit("ALL").alias("allowed_country"), "n")
    counts = per_country.unionByName(everything)
    return (
        mapping.join(counts, "allowed_country", "left")
        .groupBy("role_name")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("visible_rows"))
    )


def tag(df: DataFrame, tags: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Attach tags to columns as field metadata."""
    for name, values in tags.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, **values})
    return df


def pii_tag_coverage(df: DataFrame) -> DataFrame:
    """Each tagged column with its level, the rows of the table and how many of them hold a value."""
    tagged = [f for f in df.schema if "pii_level" in f.metadata]
    counts = df.agg(F.count("*").alias("rows"), *[F.count(f.name).alias(f.name) for f in tagged])
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.metadata["pii_level"]).alias("pii_level"),
            F.col("rows").alias("rows"),
            F.col(f.name).alias("filled"),
        )
        for f in tagged
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def tag_table(df: DataFrame, domain: str) -> DataFrame:
    """Attach the domain of a table to each of its columns, which is where a frame can carry it."""
    return tag(df, {name: {"data_domain": domain} for name in df.columns})


def table_domain(df: DataFrame) -> str | None:
    """The domain that all columns of a frame agree on."""
    found = {field.metadata.get("data_domain") for field in df.schema}
    return found.pop() if len(found) == 1 else None


def table_tag_coverage(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Each tagged table with its domain and its rows."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), F.lit(table_domain(df)).alias("data_domain"), "rows")
        for name, df in tables.items()
        if table_domain(df)
    ]
    return reduce(DataFrame.unionByName, counts)
