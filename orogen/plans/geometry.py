"""Points, rasters, boreholes and profiles derived from the star schema, which has no coordinates of its own; and the same as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orogen.functions.joins import dealt

#: Metres a point has to itself along each axis; points cover a square whose side grows with their number.
SPACING = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side_of(rows: DataFrame, key: str, share: float = 1.0) -> int:
    """Places along each side of a square that ``share`` of the keys from 0 on fill."""
    top = rows.agg(F.max(key)).first()[0]
    return math.ceil(math.sqrt(((-1 if top is None else top) + 1) * share)) or 1


def _placed(key, side: int) -> tuple:
    """x and y of a key: a lattice of ``SPACING``, each place moved by up to 28 and 30 metres."""
    x = key % side * SPACING + key * 7919 % 29
    y = F.floor(key / side) * SPACING + key * 104729 % 31
    return x.cast("double").alias("x"), y.cast("double").alias("y")


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each customer; every tenth stands where the one before it does."""
    rows = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    at = k - F.when(k % 10 == 9, 1).otherwise(0)
    x, y = _placed(at, side_of(rows, "c_custkey"))
    return rows.select(k.alias("id"), x, y, F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("class"), F.col("c_nationkey").alias("zone"))


def extent(spark: SparkSession, sf_dir: str) -> float:
    """Side of the square that all points lie in, in metres."""
    return float(side_of(table(spark, sf_dir, "customer"), "c_custkey") * SPACING)


def lattice(spark: SparkSession, sf_dir: str, step: float) -> DataFrame:
    """Targets (id, x, y) every ``step`` metres over the points' square."""
    n = math.ceil(extent(spark, sf_dir) / step)
    at = lambda k: k * step + step / 2
    return spark.range(n * n).select("id", at(F.col("id") % n).alias("x"), at(F.floor(F.col("id") / n)).alias("y"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_points(spark, sf_dir).groupBy("x", "y").agg(F.min("id").alias("id"), F.avg("v").alias("v"))


def raster(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """A square raster with a cell for one and a half orders."""
    o = table(spark, sf_dir, "orders")
    nx = side_of(o, "o_orderkey", 1 / 1.5)
    o = o.where(F.col("o_orderstatus") == status) if status else o
    flat = F.col("o_orderkey") % (nx * nx)
    placed = o.select(F.floor(flat / nx).cast("int").alias("row"), (flat % nx).cast("int").alias("col"), "o_totalprice")
    return placed.repartition(dealt(o), "row", "col").groupBy("row", "col").agg((F.avg("o_totalprice") / 1000).alias("z"))


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, rows = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    x, y = _placed(k, side_of(rows, "o_orderkey"))
    return rows.select(k.alias("hole_id"), x, y, (F.col("o_totalprice") / 1000).alias("z"), (F.col("o_custkey") % 200).cast("double").alias("eoh"), k.alias("seq"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order are intervals down its hole, each as long as its quantity."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("l_quantity").cast("double")
    end = F.sum(q).over(order)
    rows = table(spark, sf_dir, "lineitem")
    return rows.repartition(dealt(rows), "l_orderkey").select(F.col("l_orderkey").alias("hole_id"), (end - q).alias("frm"), end.alias("to"), F.col("l_returnflag").alias("code"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount").cast("double")).alias("grade"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user are a profile: stations by time, heights by value."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sec"), n.alias("seq"), (n * 10.0 + F.col("event_id") % 7).cast("double").alias("d"), F.col("value").cast("double").alias("z"))


SQL = {
    "raw": """side AS (SELECT CAST(ceil(sqrt(max(c_custkey) + 1)) AS BIGINT) AS s FROM customer),
        raw AS (SELECT c_custkey AS id, CAST(j % s * 32 + j * 7919 % 29 AS DOUBLE) AS x, CAST(j // s * 32 + j * 104729 % 31 AS DOUBLE) AS y,
            c_acctbal AS v, c_mktsegment AS class, c_nationkey AS zone
            FROM (SELECT *, c_custkey - CASE WHEN c_custkey % 10 = 9 THEN 1 ELSE 0 END AS j FROM customer), side)""",
    "pts": "pts AS (SELECT min(id) AS id, x, y, avg(v) AS v FROM raw GROUP BY x, y)",
    "ras": """rside AS (SELECT CAST(ceil(sqrt((max(o_orderkey) + 1) * (1 / 1.5))) AS BIGINT) AS w FROM orders),
        ras AS (SELECT CAST((o_orderkey % (w * w)) // w AS INT) AS row, CAST(o_orderkey % (w * w) % w AS INT) AS col, avg(o_totalprice) / 1000 AS z
            FROM orders, rside GROUP BY 1, 2)""",
    "rasf": """rasf AS (SELECT CAST((o_orderkey % (w * w)) // w AS INT) AS row, CAST(o_orderkey % (w * w) % w AS INT) AS col, avg(o_totalprice) / 1000 AS z
            FROM orders, rside WHERE o_orderstatus = 'F' GROUP BY 1, 2)""",
    "dim": "dim AS (SELECT max(row) + 1 AS ny, max(col) + 1 AS nx FROM ras)",
    "cells": "cells AS (SELECT CAST(r.r AS INT) AS row, CAST(c.c AS INT) AS col, ras.z FROM dim, range(0, dim.ny) r(r), range(0, dim.nx) c(c) LEFT JOIN ras ON ras.row = r.r AND ras.col = c.c)",
    "hol": """hside AS (SELECT CAST(ceil(sqrt(max(o_orderkey) + 1)) AS BIGINT) AS s FROM orders),
        hol AS (SELECT o_orderkey AS hole_id, CAST(o_orderkey % s * 32 + o_orderkey * 7919 % 29 AS DOUBLE) AS x,
            CAST(o_orderkey // s * 32 + o_orderkey * 104729 % 31 AS DOUBLE) AS y, o_totalprice / 1000 AS z, CAST(o_custkey % 200 AS DOUBLE) AS eoh0
            FROM orders, hside)""",
    "ivs": "ivs AS (SELECT l_orderkey AS hole_id, sum(CAST(l_quantity AS DOUBLE)) OVER w - CAST(l_quantity AS DOUBLE) AS frm, sum(CAST(l_quantity AS DOUBLE)) OVER w AS \"to\", l_returnflag AS code, CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_discount AS DOUBLE) END AS grade FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING))",
    "pro": "pro AS (SELECT user_id AS sec, n AS seq, CAST(n * 10.0 + event_id % 7 AS DOUBLE) AS d, CAST(value AS DOUBLE) AS z FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL.get(n, n) for n in names) + " "
