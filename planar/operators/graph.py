"""Connected components of a relation of links."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame, label: str) -> DataFrame:
    """df through Parquet in the folder of spark.checkpoint.dir, which cuts its lineage; all that an application writes there is in one folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='planar-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/planar-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component (the least id that is reachable) of the ids in links (a, b).

    Links are turned towards ever smaller ids, first from larger neighbours and then among smaller ones, until they form stars.
    """
    e = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = up.join(up.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = written(down.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return e.union(e.select("v", "v").distinct()).select(F.col("u").alias("id"), F.col("v").alias("component"))
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
