"""A corpus pipeline: what is toxic, repeated or taken from a benchmark goes, personal data
is masked, and what is left is packed. Every stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eralens.llm import decontam, minhash, packing, pii, toxicity
from eralens.llm.common import fresh, stage, table
from eralens.llm.queries import fold


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    return toxicity.apply(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0)), drop=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words) the document with the smallest
    id stays, once: a document is an id with its text, so another text of the same id is
    judged by itself. Of equal rows, and of rows that differ in other columns only, the first
    in the order of all columns stays. Documents without an id are no one's duplicates."""
    node, hashed = fresh("node", docs.columns), F.xxhash64("text")
    # nearly all ids have one text; only where an id has several is the text a part of its name
    several = stage(docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high")).where("low <> high").select(F.col("doc_id").alias(node)), "several")
    body = F.when(F.col(node).isNotNull(), hashed).otherwise(F.lit(0).cast("bigint"))
    named = docs.join(several, F.col("doc_id") == F.col(node), "left").withColumn(node, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", body.alias("body"))))
    known = named.where(F.col(node).isNotNull())
    seen = stage(minhash.deduplicate(known.select(node, "text"), node, "text", words=5).select(F.col("doc_id").alias(node), "kept"), "judged")
    gone = stage(seen.where(~F.col("kept")).select(node).distinct(), "gone")
    twice = stage(seen.where("kept").groupBy(node).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(node), "twice")
    left = known.join(gone, node, "left_anti")
    place = fresh("place", named.columns)
    first = Window.partitionBy(node).orderBy(*docs.columns)
    once = left.join(twice, node, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return left.join(twice, node, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns)).unionByName(docs.where("doc_id is null"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.find(docs, table(spark, sf_dir, "benchmark"), drop=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; ``n_chars``, where there is one, follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic), ("minhash", near_duplicates), ("decontamination", benchmark_leaks), ("pii", personal_data), ("packing", packed)]

# Tokenizing, the fitted toxicity model and the span classifier have no SQL form; the tests
# compare every stage of a run with a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
