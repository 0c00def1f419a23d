"""The corpus pipeline: documents through five operators of planar.llm, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. Stages
other than the last return the columns of documents, extra ones of any name too.

Defined results: rows whose doc_id is null are known by their texts, as numbers of 2^62 and more to the near-dedup, so that a copy with an id stays before one
without, and as numbers under -2^62 to the decontamination; no other row's doc_id should be such a number; rows that repeat a doc_id count as one document, of which the least text stays; null and empty texts are judged by the quality
classifier like any other, are each other's near-duplicates, and have no words to mix, so the mix drops them; very long texts
are read whole by every stage; an empty table, or one that a stage leaves empty, goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planar.llm import decontamination, mixing, quality, simhash, token_files
from planar.llm.common import free_name, stored, table

#: Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR = 5, 0.8


#: Rows of an Arrow batch. A batch stands in Spark's and in the worker's memory at once, and 10,000 whole texts of 5 kB, Spark's own setting, make 50 MB several times over.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """The pipeline's session passes texts in small batches; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def named(sign: int) -> Column:
    """doc_id, and for rows without one a number from their text with the bit of `sign` set: above (2**62) or below (-(2**63)) usual ids."""
    own = F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(sign))
    return F.coalesce(F.col("doc_id").cast("long"), own)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1."""
    small_batches(spark)
    return quality.kept(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates."""
    small_batches(spark)
    key, copy = free_name(docs, "key"), free_name(docs, "copy")
    rows = docs.withColumn(key, named(2**62))
    groups = simhash.similar_groups(rows.withColumn("doc_id", F.col(key)), SHINGLE_WORDS, SIMILAR)
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    same = Window.partitionBy(key).orderBy("text")
    return rows.join(others, key, "left_anti").withColumn(copy, F.row_number().over(same)).where(F.col(copy) == 1).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    key = free_name(docs, "key")
    rows = docs.withColumn(key, named(-(2**63)))
    hit = decontamination.contaminated(rows.withColumn("doc_id", F.col(key)), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(hit, key, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut and repeated as the source weights ask; n_chars follows the text."""
    small_batches(spark)
    out = mixing.mixed_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' digests, read back by key."""
    small_batches(spark)
    return token_files.token_files(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
