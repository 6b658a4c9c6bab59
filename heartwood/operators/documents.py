"""Documents: latest text per document and the fields on its label lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartwood.functions.columns import blank_to_null, is_blank
from heartwood.functions.frames import dedup_latest

# The label lines of claim forms and policy summaries, by field.
LABELS: dict[str, tuple[str, ...]] = {
    "reference_number": ("Claim Number", "Policy Number"),
    "policy_number": ("Policy Number",),
    "customer_name": ("Customer Name",),
    "customer_id": ("Customer ID",),
    "document_date": ("Date Filed", "Effective Date"),
    "amount": ("Claim Amount", "Annual Premium"),
    "category": ("Claim Type", "Policy Type"),
    "status": ("Status",),
}
DESCRIPTION = r"(?dms)^Description:\n(.*?)(?:\n\n|\z)"


def parsed_documents(raw: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    written = raw.filter(~is_blank(F.col("document_text")))
    return dedup_latest(written, ["document_id"], "created_at", ["customer_id"], repeated).select(
        "document_id",
        "customer_id",
        "file_name",
        "document_type",
        "file_size_bytes",
        F.col("created_at").alias("file_modified_at"),
        F.col("document_text").alias("parsed_text"),
    )


def labelled_line(text: Column, labels: tuple[str, ...]) -> Column:
    """Rest of the first line that starts with one of the labels, NULL when there is none."""
    return blank_to_null(F.regexp_extract(text, rf"(?dm)^(?:{'|'.join(labels)}): (.*)$", 1))


def document_extracted(parsed: DataFrame) -> DataFrame:
    text = F.col("parsed_text")
    return parsed.select(
        "document_id",
        "file_name",
        "document_type",
        "file_size_bytes",
        "file_modified_at",
        F.col("customer_id").alias("source_customer_id"),
        "parsed_text",
        *[labelled_line(text, labels).alias(field) for field, labels in LABELS.items()],
        blank_to_null(F.regexp_extract(text, DESCRIPTION, 1)).alias("description"),
    )
