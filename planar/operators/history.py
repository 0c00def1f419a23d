"""Order-dependent reports: capped history, least-recently-used cache, render metrics, page offsets, words of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters besides white space that end a word.
SEPARATORS = "\u0000\u0002\u0003\u000c￾￿"


def latest(history: DataFrame, most: int = 500) -> DataFrame:
    """The last rows of each document's history (doc_id, ts, event_id)."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return history.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def cached_tiles(accesses: DataFrame, capacity: float) -> DataFrame:
    """What a least-recently-used cache of `capacity` bytes holds after the accesses (doc_id, tile, at, seq, bytes)."""
    last = accesses.groupBy("doc_id", "tile").agg(F.max(F.struct("at", "seq", "bytes")).alias("l")).select("doc_id", "tile", "l.*")
    order = Window.partitionBy("doc_id").orderBy(F.desc("at"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return last.withColumn("held", F.sum("bytes").over(order)).where(F.col("held") <= capacity)


def render_metrics(accesses: DataFrame) -> DataFrame:
    """Requests, hits, hit ratio and mean render time (ms) of each document; the first request of a tile is a miss."""
    order = Window.partitionBy("doc_id", "tile").orderBy("at", "seq")
    a = accesses.withColumn("hit", F.row_number().over(order) > 1)
    per = a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("renders"), F.sum(F.when(~F.col("hit"), F.col("ms"))).alias("render_ms"))
    return per.select("doc_id", "requests", "hits", F.coalesce(F.try_divide("hits", "requests"), F.lit(0.0)).alias("hit_ratio"), F.coalesce(F.try_divide("render_ms", "renders"), F.lit(0.0)).alias("average_ms"))


def page_offsets(pages: DataFrame, gap: float = 10.0) -> DataFrame:
    """Pages (doc_id, number, height) stacked downwards with a gap; page p's layers are ordered from (p - 1) * 10 + 1."""
    before = Window.partitionBy("doc_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("number"))
    return pages.select("*", F.coalesce(F.sum(F.col("height") + gap).over(before), F.lit(0.0)).alias("offset_y"), ((place - 1) * 10 + 1).alias("first_layer_order"))


def words_of_characters(chars: DataFrame) -> DataFrame:
    """Words (file, page, word, text, box) of characters (file, page, n, ch and a box that may be null).

    White space and control marks end a word; so does a character that leaves the line by over 0.55, jumps ahead by over 0.65
    or moves back by over 0.65 of the greater height, as against the last character with a box since the last word's end.
    """
    order = Window.partitionBy("file", "page").orderBy("n")
    c = chars.withColumn("gap", F.col("ch").isNull() | F.col("ch").rlike(r"^\s*$") | F.col("ch").isin(*SEPARATORS))
    c = c.withColumn("stretch", F.sum(F.col("gap").cast("int")).over(order)).where(~F.col("gap"))
    own = Window.partitionBy("file", "page", "stretch").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("left").isNotNull(), F.struct("left", "right", "bottom", "top")), True).over(own)
    c = c.withColumn("last", last)
    h = F.greatest(F.lit(0.1), F.greatest(F.col("top") - F.col("bottom"), F.col("last.top") - F.col("last.bottom")))
    breaks = (F.abs(F.col("bottom") - F.col("last.bottom")) > h * 0.55) | (F.col("left") - F.col("last.right") > h * 0.65) | (F.col("left") < F.col("last.left") - h * 0.65)
    c = c.withColumn("word", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(Window.partitionBy("file", "page", "stretch").orderBy("n")))
    per = c.groupBy("file", "page", "stretch", "word").agg(F.min("n").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "ch"))), lambda x: x["ch"]), "").alias("text"), F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"))
    return per.select("file", "page", F.col("first"), "text", "left", "bottom", (F.col("right") - F.col("left")).alias("width"), (F.col("top") - F.col("bottom")).alias("height"))
