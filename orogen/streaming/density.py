"""Density maps of a stream of sources: masses add up, so each batch is spread and appended, and the map is a sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orogen.operators.density import Grid, finalise, points


def accumulate(sources: DataFrame, grid: Grid, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Spread each micro-batch of sources (id, x, y, mass, sigma) and write its cells to a folder of its own.

    A batch that is run again overwrites its folder, so each source counts once.
    """
    def write(batch: DataFrame, number: int) -> None:
        points(batch, grid).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def density_map(spark: SparkSession, out: str, grid: Grid) -> DataFrame:
    """The map of all batches so far."""
    return finalise(spark.read.parquet(out).select("row", "col", "mass", "sigma_mass"), grid)


def settlement_rates(rounds: DataFrame, late: str = "2 days", span: str = "7 days") -> DataFrame:
    """profile, window and mean settlement of a stream of observations (profile, ts, settle); those later than ``late`` are left out."""
    return rounds.withWatermark("ts", late).groupBy("profile", F.window("ts", span)).agg(F.avg("settle").alias("settle"), F.count("*").alias("n"))
