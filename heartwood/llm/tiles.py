"""Compare the rows of each bucket without a hot bucket in one task and without emitting its pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.llm.common import keep

#: Rows of a bucket that are compared with one another at a time.
CHUNK = 512
#: Largest count of hot buckets that is sent to every task (24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def tiled(rows: DataFrame, row: str, chunk: int = CHUNK) -> DataFrame:
    """Rows with `bucket` dealt into tiles: `bucket`, `tile`, `side`, and the rows' own columns.

    A bucket of up to `chunk` rows is one tile. A larger one is cut into chunks by a hash of the column `row`,
    and each pair of chunks is a tile of its own, so any number of tasks can share the bucket: a row goes to
    one tile per chunk. Column `cross` says that only rows of different `side` are to be compared.
    The result is dealt by (bucket, tile) and sorted.
    """
    sizes = rows.groupBy("bucket").count().where(F.col("count") > chunk)
    hot = sizes.select("bucket", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    hot = keep(hot, "hot")  # `rows` is not made again to count them and to send them
    few = hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = rows.join(F.broadcast(hot) if few else hot, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    marked = marked.withColumn("side", F.pmod(F.xxhash64(row, F.lit(7)), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = marked.withColumn("other", other)
    low, high = F.least("side", "other"), F.greatest("side", "other")
    dealt = dealt.withColumn("tile", (low * F.col("chunks").cast("long") + high)).withColumn("cross", low < high)
    dealt = dealt.drop("other", "chunks")
    return dealt.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")


def spanning(linked: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix of links, the smallest row of its component."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def comparable(side: np.ndarray, cross: bool) -> np.ndarray:
    """Which pairs of a tile's rows are its own to compare."""
    return side[:, None] != side[None, :] if cross else ~np.eye(len(side), dtype=bool)
