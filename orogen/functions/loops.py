"""Fixed-point loops over DataFrames."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder of ``spark.checkpoint.dir`` and read it back, which cuts its lineage and survives lost executors.

    Only a session in one process (``local[...]``) may go without such a folder; it gets a temporary one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orogen-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/orogen-loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fixpoint(df: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame], DataFrame], rounds: int = 64) -> DataFrame:
    """Repeat ``step`` until ``changed`` of its result has no rows; each round's table is checkpointed."""
    for _ in range(rounds):
        df = checkpointed(step(df))
        if changed(df).isEmpty():
            return df
    raise RuntimeError(f"no fixed point in {rounds} rounds")


def least_reached(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """node and least (the least node that edges lead to, both ways) of every node of ``edges`` (a, b).

    Each round a node takes the least label around it, then that label's own, so labels travel further every round.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())

    def step(t: DataFrame) -> DataFrame:
        near = both.join(t.select(F.col("node").alias("b"), F.col("least").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        joined = t.select("node", "least").join(near, "node").select("node", F.least("least", "other").alias("near"), "least")
        far = t.select(F.col("node").alias("near"), F.col("least").alias("further"))
        return joined.join(far, "near").select("node", F.col("further").alias("least"), (F.col("further") != F.col("least")).alias("moved"))

    start = both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("least"), F.lit(True).alias("moved"))
    return fixpoint(start, step, lambda t: t.where("moved"), rounds).select("node", "least")
