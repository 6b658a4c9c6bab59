"""Bucketed tables that change in versions.

A table is split into leaves by a hash of its bucket columns. A batch reads the leaves that its rows fall into, and
no others, and writes them anew into a folder of its own; then one small file, the manifest, names the folder of
every leaf. A reader takes the newest manifest and sees the table before or after a batch, never between. A leaf
that grows beyond its size is split in two when it is next written, so what a batch reads follows the batch, not the
table. A batch that is run again is known by its number and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heartwood.sources.files import SharedFiles

Merge = Callable[[DataFrame, DataFrame], DataFrame]

#: Leaves of an empty table, as a power of two, and bits after which a leaf is not split again.
FIRST_DEPTH, LAST_DEPTH = 3, 40
#: Leaves that are named inside a plan; more are joined.
NAMED_LEAVES = 200
TOUCHED, WAS, LEAF = "_touched", "_was", "_leaf"


@dataclass(frozen=True)
class Leaf:
    """Rows whose hash ends in `index`, taking the last `depth` bits."""

    depth: int
    index: int
    folder: str | None = None
    rows: int = 0

    @property
    def name(self) -> str:
        return f"{self.depth}-{self.index}"

    def halves(self) -> list[Leaf]:
        return [Leaf(self.depth + 1, self.index), Leaf(self.depth + 1, self.index + (1 << self.depth))]


@dataclass(frozen=True)
class Version:
    number: int = -1
    batch: int = -1
    leaves: dict[str, Leaf] = field(default_factory=dict)
    #: What the batch read and wrote: rows that arrived, leaves and rows of them read, rows written.
    work: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        leaves = [[leaf.depth, leaf.index, leaf.folder, leaf.rows] for leaf in self.leaves.values()]
        return json.dumps({"batch": self.batch, "work": self.work, "leaves": leaves})

    @staticmethod
    def from_json(number: int, text: str) -> Version:
        told = json.loads(text)
        leaves = [Leaf(*values) for values in told["leaves"]]
        return Version(number, told["batch"], {leaf.name: leaf for leaf in leaves}, told["work"])


@dataclass(frozen=True)
class VersionedTable:
    """A table below `path`; rows that agree in `bucket_by` share a leaf of about `leaf_rows` rows.

    With `keeps_was` each row also holds the row that it replaced in its batch, for those who follow the changes.
    """

    path: str
    schema: T.StructType
    bucket_by: tuple[str, ...]
    leaf_rows: int = 1_000_000
    keeps_was: bool = False

    @property
    def stored(self) -> T.StructType:
        more = [T.StructField(TOUCHED, T.BooleanType())]
        if self.keeps_was:
            more.append(T.StructField(WAS, self.schema))
        return T.StructType([*self.schema.fields, *more])

    def versions(self, spark: SparkSession) -> list[int]:
        names = SharedFiles(spark, self.path).names("versions")
        return [int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith(".")]

    def version(self, spark: SparkSession, number: int | None = None) -> Version:
        """A version, the newest by default; one without leaves before the first batch."""
        known = self.versions(spark)
        if not known:
            return Version(leaves={leaf.name: leaf for leaf in (Leaf(FIRST_DEPTH, i) for i in range(1 << FIRST_DEPTH))})
        number = max(known) if number is None else number
        return Version.from_json(number, SharedFiles(spark, self.path).read(f"versions/{number:010d}.json"))

    def _rows(self, spark: SparkSession, leaves: Sequence[Leaf]) -> DataFrame:
        folders = [f"{self.path}/{leaf.folder}" for leaf in leaves if leaf.folder]
        if not folders:
            return spark.createDataFrame([], self.stored)
        return spark.read.schema(self.stored).parquet(*folders)

    def read(self, spark: SparkSession, version: Version | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        version = version or self.version(spark)
        return self._rows(spark, list(version.leaves.values())).select(*self.schema.names)

    def written(self, spark: SparkSession, batch: int) -> DataFrame:
        """All rows of the leaves that a batch wrote, with the marks of what it touched."""
        return spark.read.schema(self.stored).parquet(f"{self.path}/batch={batch}")

    def changes(self, spark: SparkSession, batch: int) -> DataFrame:
        """The rows that a batch changed, and what they were before if the table keeps that."""
        return self.written(spark, batch).filter(TOUCHED)

    def _in_leaf(self, rows: DataFrame, leaves: Sequence[Leaf]) -> DataFrame:
        """Rows with the name of their leaf among the given ones; rows of other leaves are left out."""
        bits = F.xxhash64(*[F.col(name) for name in self.bucket_by])
        depths = sorted({leaf.depth for leaf in leaves})
        names = [F.concat(F.lit(f"{d}-"), bits.bitwiseAND(F.lit((1 << d) - 1)).cast("string")) for d in depths]
        if len(leaves) <= NAMED_LEAVES:
            known = F.array(*[F.lit(leaf.name) for leaf in leaves])
            found: Column = F.coalesce(*[F.when(F.array_contains(known, name), name) for name in names])
            return rows.withColumn(LEAF, found).filter(F.col(LEAF).isNotNull())
        listed = rows.sparkSession.createDataFrame([(leaf.name,) for leaf in leaves], f"{LEAF} string")
        return rows.withColumn(LEAF, F.explode(F.array(*names))).join(listed, LEAF)

    def apply(self, incoming: DataFrame, batch: int, merge: Merge) -> bool:
        """Merge a batch into the leaves it falls into, as a new version. False if the table has this batch already.

        `merge` gets the stored rows of these leaves and the incoming ones, and returns all rows that the leaves
        shall hold, marked `_touched` (and `_was`) where the batch changed something.
        """
        spark = incoming.sparkSession
        before = self.version(spark)
        if batch <= before.batch:
            return False
        incoming = incoming.persist()
        try:
            placed = self._in_leaf(incoming, list(before.leaves.values()))
            arrived = {r[LEAF]: r["n"] for r in placed.groupBy(LEAF).agg(F.count("*").alias("n")).collect()}
            read = [before.leaves[name] for name in arrived]
            after: list[Leaf] = []
            for leaf in read:
                full = leaf.rows + arrived[leaf.name] > self.leaf_rows and leaf.depth < LAST_DEPTH
                after += leaf.halves() if full else [leaf]
            merged = merge(self._rows(spark, read), incoming).select(*self.stored.names)
            folder = f"batch={batch}"
            rows = {}
            seen = Observation()
            if after:
                out = self._in_leaf(merged, after).observe(seen, F.count("*").alias("written"), F.count_if(TOUCHED).alias("touched"))
                out.repartition(LEAF).write.mode("overwrite").partitionBy(LEAF).parquet(f"{self.path}/{folder}")
                found = spark.read.schema(f"{LEAF} string").parquet(f"{self.path}/{folder}")
                rows = {r[LEAF]: r["n"] for r in found.groupBy(LEAF).agg(F.count("*").alias("n")).collect()}
            else:
                merged.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        finally:
            incoming.unpersist()
        leaves = {name: leaf for name, leaf in before.leaves.items() if name not in arrived}
        for leaf in after:
            n = rows.get(leaf.name, 0)
            leaves[leaf.name] = Leaf(leaf.depth, leaf.index, f"{folder}/{LEAF}={leaf.name}" if n else None, n)
        work = {
            "arrived": sum(arrived.values()),
            "leaves_read": len(read),
            "rows_read": sum(leaf.rows for leaf in read),
            **{name: seen.get.get(name, 0) if after else 0 for name in ("written", "touched")},
        }
        fresh = Version(before.number + 1, batch, leaves, work)
        if not SharedFiles(spark, self.path).write_new(f"versions/{fresh.number:010d}.json", fresh.to_json()):
            raise RuntimeError(f"another writer has made version {fresh.number} of {self.path}")
        return True

    def history(self, spark: SparkSession) -> list[Version]:
        return [self.version(spark, number) for number in self.versions(spark)]

    def vacuum(self, spark: SparkSession, keep: int = 2) -> list[str]:
        """Remove the folders that none of the last `keep` versions refers to, and the manifests before those."""
        files, numbers = SharedFiles(spark, self.path), self.versions(spark)
        kept = [self.version(spark, number) for number in numbers[-keep:]]
        named = {leaf.folder.split("/")[0] for version in kept for leaf in version.leaves.values() if leaf.folder}
        named |= {f"batch={version.batch}" for version in kept}
        for number in numbers[:-keep]:
            files.remove(f"versions/{number:010d}.json")
        last = max((version.batch for version in kept), default=-1)
        gone = [n for n in files.names() if n.startswith("batch=") and n not in named and int(n.split("=")[1]) <= last]
        for name in gone:
            files.remove(name)
        return gone


def latest_rows(table: VersionedTable, keys: Sequence[str], order: Sequence[str]) -> Merge:
    """Merge: the newest row per key by the named columns, NULL as the largest value; full ties go by content."""
    names = table.schema.names
    content = F.struct(*[F.col(name) for name in names])
    rank = F.struct(*[part for name in order for part in (F.col(name).isNull(), F.col(name))], F.xxhash64(content))

    def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        sides = [
            rows.select(*[F.col(k).alias(f"_key_{k}") for k in keys], content.alias("row"), rank.alias("rank"), F.lit(known).alias("known"))
            for rows, known in ((stored, True), (incoming, False))
        ]
        merged = sides[0].unionByName(sides[1]).groupBy(*[f"_key_{k}" for k in keys]).agg(
            F.max_by("row", "rank").alias("now"),
            F.any_value(F.when(F.col("known"), F.col("row")), True).alias("was"),
        )
        return merged.select("now.*", (~F.col("now").eqNullSafe(F.col("was"))).alias(TOUCHED), F.col("was").alias(WAS))

    return merge
