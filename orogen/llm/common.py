"""Reading, writing and session helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words; the same set as ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only, with null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session in one process (``local[...]``) may go without; it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="orogen-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_table(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orogen-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def chars_of(docs: DataFrame) -> tuple[int, int]:
    """Rows and characters of a table of texts, by one aggregate."""
    row = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    return int(row["n"]), int(row["c"])


def drawn(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows, one a doc_id, drawn by a hash of the doc_id and so the same each time."""
    return labels.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
