"""Components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorframe.llm.common import drop_stage, free, stage


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root), root the smallest node of its component, for every node of ``edges`` (a, b): alternating large and small stars until only stars are left."""

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return _oriented(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return _oriented(moved.unionByName(low.select("a", F.col("m").alias("b"))))

    def settled(e: DataFrame) -> bool:
        """Whether every edge leads from a node with no other edge down to the root of a star; counts combine before the shuffle."""
        up, down = F.col("a").alias("node"), F.col("b").alias("node")
        ends = e.select(up, F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(down, F.lit(0).alias("up"), F.lit(1).alias("down")))
        unlike = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1")
        return unlike.agg(F.count(F.lit(1))).first()[0] == 0

    now = stage(_oriented(edges), "stars")
    while not settled(now):
        then = stage(small(large(now)), "stars")
        drop_stage(now)
        now = then
        free(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def joined(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps``, a staged result of ``components``, with what further ``edges`` (a, b) join: only edges between different components are followed."""
    low = {c: comps.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")) for c in ("a", "b")}
    between = edges.join(low["a"], "a", "left").join(low["b"], "b", "left").select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))
    tops = stage(components(between), "tops")
    known = comps.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.unionByName(tops.join(comps, "node", "left_anti"))
