"""Quality: every trusted document counts."""

from pyspark.sql import functions as F

from orogen.llm import quality


def test_all_trusted_documents_count(spark):
    """If all documents are trusted, target and raw counts are the same, however many there are."""
    docs = spark.range(0, 30_040, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id"), F.lit(" of many")).alias("text"))
    got = quality.judge(docs, docs.select("doc_id", F.lit(1).alias("quality")), buckets=1 << 12)
    assert got.where("ratio <> 0").count() == 0 and got.count() == 30_040
