"""A corpus pipeline: toxic documents go, shared lines go, near duplicates go, personal data is masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of documents. ``run`` writes each stage's rows as Parquet into the shared
folder and reads them again as the next one's documents. A document's ``n_chars``, where there is such a
column, follows its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import line_dedup, ngram_join, packing, pii, toxicity
from orogen.llm.common import documents, fresh, stored
from orogen.session import ship


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with ``n_chars`` counted anew."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(dict(like.dtypes)["n_chars"]))
    return docs.select(like.columns)


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic passages make a label of 1 likelier than not go; the labels of rows held out are never used."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def shared_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share go everywhere; documents stay, with an empty text if nothing is left."""
    ship(spark)
    names = fresh(docs, "kept", "n_lines", "n_dropped")
    return _with_text(line_dedup.dedup(docs, least_docs=10, names=names).withColumn("text", F.col(names[0])), docs)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; a row without a doc_id stays too."""
    ship(spark)
    gone = fresh(docs, "gone")[0]
    linked = ngram_join.link(docs.select("doc_id", "text")).where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(gone))
    return docs.join(linked, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets."""
    ship(spark)
    return _with_text(pii.redact(docs, pii.fit(docs)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_documents_out),
    ("line_dedup", shared_lines_out),
    ("ngram_jaccard", near_duplicates_out),
    ("pii", personal_data_masked),
    ("packing", packed),
]

#: No SQL expresses the stages that learn; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
