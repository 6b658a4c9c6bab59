"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage gets the documents its predecessor kept and returns the columns of documents; the last returns one row
per packed piece. Nulls, empty and very long texts, repeated rows and extra columns are treated as the operators'
docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heartwood.llm.common import keep
from heartwood.llm.langid import known_language
from heartwood.llm.mixing import mix
from heartwood.llm.packing import pack
from heartwood.llm.similar import one_per_similar
from heartwood.llm.substrings import without_shared_windows
from heartwood.session import own_work_dir

#: Tokens of a sequence, the tokenizer's file and the id that ends a document.
CAPACITY, TOKENIZER, END_ID = 2048, "word_bpe_49k.json", 0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without letters, and those where no language has half of the probability, go."""
    return known_language(docs, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity 0.8 or more: of each group the document with the smallest doc_id stays."""
    return one_per_similar(docs, words=5, least=0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word windows that start elsewhere too are removed; documents of which nothing is left go."""
    return without_shared_windows(docs, window=35)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square root of their size, by Poisson replication, in random order."""
    return mix(docs, power=0.5)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, filled by best-two-fit."""
    packed = pack(docs, public_tokenizers.path(TOKENIZER), CAPACITY, END_ID)
    return packed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL can express neither the network nor the tokenizer; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    own_work_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
