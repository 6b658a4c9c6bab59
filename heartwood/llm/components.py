"""Connected components by contraction, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """`id`, `component` (smallest id reachable) for every id in the long columns `a`, `b` of `links`.

    Each round joins every node to the neighbour of least random priority, then replaces the ends of each
    link by what they were joined to. The priorities are drawn anew per round, so a long chain shrinks by a
    constant factor as a star does: expected rounds grow with the logarithm of the nodes. Minima are combined
    before the shuffle, joins on a hub are inner joins that adaptive execution splits, and each round is
    written down, so neither a hub nor a lost executor matters. Null ends and loops are left out; a repeated
    link counts once; no links give no rows.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = keep(links.where("a is not null and b is not null and a <> b").select(a, b).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(hooks))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("p"), F.col("b").alias("n"))).alias("best"))
        own = F.struct(F.xxhash64("a", seed).alias("p"), F.col("a").alias("n"))
        hook = keep(best.select(F.col("a").alias("node"), F.least("best", own)["n"].alias("root")), "hooks")
        hooks.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = hook.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = keep(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    member = hooks[0].select(F.col("node").alias("id"), "root")
    for hook in hooks[1:]:
        step = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
        member = member.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    member = keep(member, "members")
    least = member.groupBy("root").agg(F.min("id").alias("component"))
    return member.join(least, "root").select("id", "component")
