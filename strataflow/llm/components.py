"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges and ``m``, the least ``b`` of their ``a``. The minimum is combined before the shuffle. The edges of a centre with
    very many are split by Spark in the join: it does so only where both sides come right from a shuffle, hence the second
    one of the minima, of which each node has one."""
    least = edges.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).repartition(F.col("c"))
    return edges.join(least.hint("merge"), F.col("a") == F.col("c")).drop("c")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node."""
    pairs = F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")
    return _with_least(edges.where("a > b")).select(pairs).select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: comparable ids): root is the smallest reachable id.

    Each round is written to the shared folder, so that a lost executor costs one round at most.
    Rounds grow with the logarithm of the longest path; no node or edge ever goes to the driver.
    """
    directed = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = materialize(directed, "edges")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(found):
            break
        mark = tuple(found)
        new = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        now = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
