"""Helpers shared by the operators: inputs, shared storage, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of bytes other than the ASCII white space 0x20, 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of our own (tests), a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='planar-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, below one folder for each application, which may go when the application ends."""
    return f"{shared_folder(spark)}/planar-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there, and a lost executor loses none of it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one with more underscores that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def integer_key(docs: DataFrame, name: str = "doc_id") -> Column:
    """The column as a long; keys of another kind than integers would lose their values, so they are an error."""
    kind = dict(docs.dtypes)[name]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{name} must be an integer column, not {kind}")
    return F.col(name).cast("long").alias(name)


def partitions_for(docs: DataFrame, bytes_each: int) -> int:
    """As many partitions as keep the texts of each near bytes_each, never under the session's setting; it reads the texts' sizes once."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each))


def prefix_sums(rows: DataFrame, order: str, value: str, name: str, run: int = 4096) -> DataFrame:
    """rows (one for each value of `order`, integers from 0) with the sum of `value` before each: within runs of `run`, and over the runs."""
    rows = rows.withColumn("planar_run", F.floor(F.col(order) / run))
    before = lambda w: F.coalesce(F.sum("planar_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = rows.groupBy("planar_run").agg(F.sum(value).alias("planar_n")).withColumn("planar_base", before(Window.orderBy("planar_run"))).drop("planar_n")
    inner = rows.withColumn("planar_n", F.col(value)).withColumn("planar_inner", before(Window.partitionBy("planar_run").orderBy(order)))
    return inner.join(runs, "planar_run").withColumn(name, F.col("planar_base") + F.col("planar_inner")).drop("planar_run", "planar_n", "planar_base", "planar_inner")


def held_out(key: Column, of: int) -> Column:
    """True for the rows whose labels or texts are kept from training: crc32 of the key as text leaves 2; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % of == 2, F.lit(False))


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
