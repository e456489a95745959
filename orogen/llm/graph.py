"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node's neighbours (the larger ones, or else the smaller ones) are tied to the least node around it."""
    way = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = way.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = way.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its least node) of every node of ``edges`` (a, b), by alternating large and small stars.

    Each round is two groupings with partial minima and two joins whose large partitions Spark
    splits; its edges are written to the shared folder, so lost executors cost one round. It ends when a
    round changes nothing: every component is then a star.
    """
    edges = stored(edges.where("a is not null and b is not null and a <> b").distinct(), "edges")
    nodes = edges
    last = None
    for _ in range(rounds):
        edges = stored(_stars(_stars(edges, True), False), "edges")
        sign = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if last == (sign["n"], sign["s"]):
            break
        last = (sign["n"], sign["s"])
    else:
        raise RuntimeError("components did not settle")
    roots = nodes.select(F.col("a").alias("node")).union(nodes.select(F.col("b").alias("node"))).distinct().join(edges.select(F.col("a").alias("node"), "b"), "node", "left")
    return roots.select("node", F.coalesce("b", "node").alias("component"))
