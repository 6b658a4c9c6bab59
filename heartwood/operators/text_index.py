"""A stored inverted index for BM25: built once, asked by many queries, without reading texts again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.functions.frames import top_per_key
from heartwood.operators.enrich import words_of
from heartwood.operators.search import K1, B
from heartwood.sources.files import SharedFiles

#: Folders of the postings by default; a search reads those that its terms fall into.
BUCKETS = 64
#: Documents of a term that one task writes, about; more frequent terms are dealt out over several.
DOCUMENTS_PER_PART = 500_000
#: Asked terms that are sent to every task, and whose folders are named; more are joined by a shuffle.
FEW_TERMS = 20_000

ATTRIBUTES = ("customer_id", "source_type", "channel", "event_date")
POSTINGS = "term string, document_key string, tf bigint, length bigint, customer_id string, source_type string, channel string, event_date timestamp_ntz, bucket int"
TERMS = "term string, df bigint, bucket int"
STATISTICS = "documents bigint, words bigint, buckets int"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")


@dataclass(frozen=True)
class TextIndex:
    """Postings, document frequencies and collection statistics below a folder."""

    path: str

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def terms(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(TERMS).parquet(f"{self.path}/terms")

    def statistics(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(STATISTICS).parquet(f"{self.path}/statistics")

    @staticmethod
    def build(corpus: DataFrame, path: str, buckets: int = BUCKETS) -> TextIndex:
        """Index a corpus with one row per `document_key`.

        Words are counted per document before the shuffle. Postings lie in folders by a hash of the term, sorted by
        term, so that a search skips what it does not ask for. A folder is dealt out over tasks by a hash of the term
        and a frequent term by a hash of the document, both in proportion to their postings: what a task sorts does
        not grow with the corpus. Documents without words count for the mean length.
        """
        spark = corpus.sparkSession
        index = TextIndex(path.rstrip("/"))
        worded = corpus.withColumn("_words", words_of(F.coalesce("search_text", F.lit("")))).withColumn("length", F.size("_words").cast("bigint"))
        totals = worded.agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"), F.lit(buckets).alias("buckets"))
        totals.write.mode("overwrite").parquet(f"{index.path}/statistics")
        counted = (
            worded.select("document_key", "length", *ATTRIBUTES, F.explode("_words").alias("term"))
            .groupBy("term", "document_key", "length", *ATTRIBUTES)
            .agg(F.count("*").alias("tf"))
            .select("term", "document_key", "tf", "length", *ATTRIBUTES, _bucket(buckets))
        )
        counted.write.mode("overwrite").parquet(f"{index.path}/counts")
        counts = spark.read.schema(POSTINGS).parquet(f"{index.path}/counts")
        frequencies = counts.groupBy("term", "bucket").agg(F.count("*").alias("df"))
        frequencies.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/terms")
        frequent = index.terms(spark).filter(F.col("df") > DOCUMENTS_PER_PART).select("term", F.ceil(F.col("df") / DOCUMENTS_PER_PART).alias("parts"))
        folders = [r.n for r in index.terms(spark).groupBy("bucket").agg(F.sum("df").alias("n")).collect()]
        shares = -(-max(folders, default=1) // DOCUMENTS_PER_PART)  # of the fullest folder
        spread = F.col("parts").isNotNull()
        by_document = F.pmod(F.xxhash64("document_key", F.lit(1)), "parts")
        part = F.when(spread, by_document).otherwise(F.pmod(F.xxhash64("term", F.lit(1)), F.lit(shares)))
        placed = counts.join(frequent, "term", "left").withColumn("part", part).withColumn("alone", F.when(spread, F.col("term")))
        tasks = max(min(buckets, spark.sparkContext.defaultParallelism), 2 * (sum(folders) // DOCUMENTS_PER_PART))
        placed = placed.repartition(tasks, "bucket", "part", "alone")
        placed = placed.sortWithinPartitions("bucket", "term", "document_key").drop("parts", "part", "alone")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings")
        SharedFiles(spark, index.path).remove("counts")
        return index

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
        """Best ``k`` documents per query; `queries` has `query_id` and `text`, any number of rows.

        The asked terms with their document frequencies are few compared with the postings. Up to 20,000 are sent to
        every task and name the folders to read; more are joined by a shuffle on the term. ``where`` restricts the
        hits, not the statistics. Scores are those of `search_bm25`.
        """
        spark = queries.sparkSession
        words = F.explode(F.array_distinct(words_of(F.coalesce("text", F.lit("")))))
        asked = queries.select("query_id", words.alias("term")).distinct()
        totals = self.statistics(spark).first()
        asked = asked.withColumn("bucket", _bucket(totals.buckets))
        n, mean = float(totals.documents), totals.words / totals.documents if totals.documents else 0.0
        few = asked.select("term").distinct().limit(FEW_TERMS + 1).count() <= FEW_TERMS
        terms, postings = self.terms(spark), self.postings(spark)
        if few:
            named = [r.bucket for r in asked.select("bucket").distinct().collect()]
            terms, postings = (side.filter(F.col("bucket").isin(named)) for side in (terms, postings))
        df = F.col("df").cast("double")
        weighted = terms.join(F.broadcast(asked.drop("bucket")) if few else asked.drop("bucket"), "term")
        weighted = weighted.select("query_id", "term", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
        hits = postings.filter(where) if where is not None else postings
        tf = F.col("tf").cast("double")
        norm = 1 - F.lit(B) + F.lit(B) * F.col("length") / F.lit(mean or 1.0)
        weight = F.col("idf") * tf * (K1 + 1) / (tf + F.lit(K1) * norm)
        found = hits.join(F.broadcast(weighted) if few else weighted, "term")
        # Attributes are looked up for the best alone: sums are kept by hash, texts among them would have to be sorted.
        scored = found.groupBy("query_id", "document_key").agg(F.round(F.sum(weight), 6).alias("score")).filter("score > 0")
        best = top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("document_key").asc()], k, rank="rank")
        asked_for = best.select(F.col("document_key").alias("_key")).distinct()
        carried = hits.join(asked_for, F.col("document_key").eqNullSafe(F.col("_key"))).groupBy("_key")
        carried = carried.agg(*[F.any_value(name).alias(name) for name in ATTRIBUTES])
        named = best.join(carried, F.col("document_key").eqNullSafe(F.col("_key")))
        return named.select("query_id", "document_key", *ATTRIBUTES, "score", "rank").orderBy("query_id", "rank")
