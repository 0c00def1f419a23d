"""Extensions over streams: running render metrics and the live state of an element index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def render_metrics(accesses: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, hits and mean render time by document and window of a stream of accesses (doc_id, at, hit, ms)."""
    a = accesses.withWatermark("at", late).groupBy("doc_id", F.window("at", window).alias("w"))
    per = a.agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"), F.sum(F.when(~F.col("hit"), F.col("ms"))).alias("render_ms"))
    return per.select("doc_id", F.col("w.start").alias("start"), "requests", "hits", F.coalesce(F.try_divide("hits", "requests"), F.lit(0.0)).alias("hit_ratio"), F.coalesce(F.try_divide("render_ms", F.col("requests") - F.col("hits")), F.lit(0.0)).alias("average_ms"))


def latest_boxes(mutations: DataFrame) -> DataFrame:
    """The last mutation of each element of a stream (doc_id, element_id, seq, op, box); rows whose op is remove are gone."""
    return mutations.groupBy("doc_id", "element_id").agg(F.max_by(F.struct("op", "left", "top", "right", "bottom"), "seq").alias("last")).select("doc_id", "element_id", "last.*")
