"""Folders of boards in mixed formats: every file goes to the reader of its extension, and what can't be read becomes a row, not a failure.

Spark lists the folder and reads it in file partitions, once for each reader and only the files of its extensions; paths can be of any store that Spark
reads. Relations of the readers come together by name: layers, tracks, pads, vias, components, nets and outlines, each with doc_id (the path) and reader.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planar.sources import boards, formats

#: Relation -> its columns besides doc_id and reader.
TABLES = {
    "layers": "layer_id string, layer_type string, side string, ord int, name string",
    "tracks": "element_no long, layer_id string, x1 double, y1 double, x2 double, y2 double, width double, net_id string",
    "pads": "element_no long, x double, y double, diameter double",
    "vias": "element_no long, x double, y double, diameter double",
    "components": "n long, reference string, value string, x double, y double, rotation double, side string",
    "nets": "net_id string, name string",
    "outlines": "points array<struct<x:double,y:double>>",
}


def _files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """doc_id and content (binary) of the files with these extensions, in any case."""
    either = lambda c: f"[{c}{c.upper()}]" if c.isalpha() else c
    glob = "*{" + ",".join("".join(map(either, e)) for e in extensions) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select(F.col("path").alias("doc_id"), "content")


def _read(spark: SparkSession, files: DataFrame, reader: str) -> dict[str, DataFrame]:
    texts = files.select("doc_id", F.decode("content", "UTF-8").alias("content"))
    if reader == "gerber":
        e = boards.gerber(texts)
        tracks = e.where("kind = 'Track'").select("doc_id", "element_no", "x1", "y1", "x2", "y2", F.col("size").alias("width"))
        return {"tracks": tracks, "pads": e.where("kind = 'Pad'").select("doc_id", "element_no", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("size").alias("diameter"))}
    if reader == "excellon":
        return {"vias": boards.excellon(texts)}
    if reader == "odb++":
        return {"layers": boards.odb_layers(files)}
    return {"kicad-pcb": boards.kicad, "eagle": boards.eagle, "ipc-2581": boards.ipc2581, "legacy-pcb": boards.legacy}[reader](texts)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """TABLES of all boards below path, `files` (doc_id and reader, null where none takes it) and `errors` (doc_id, reader, error).

    Errors are files without a reader, archives that are broken or hold no layers, and exchange files whose root is another. A file in which a
    reader finds nothing has no rows but its four layers.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"))
    listed = every.withColumn("reader", formats.reader(F.col("doc_id")))
    parts: dict[str, list[DataFrame]] = {t: [] for t in TABLES}
    errors = [listed.where("reader IS NULL").select("doc_id", "reader", F.lit("no reader").alias("error"))]
    for reader, extensions in formats.READERS:
        files = _files(spark, path, extensions).where(formats.reader(F.col("doc_id")) == reader)
        failed = boards.odb_errors(files) if reader == "odb++" else boards.ipc2581_errors(files.select("doc_id", F.decode("content", "UTF-8").alias("content"))) if reader == "ipc-2581" else None
        if failed is not None:
            errors.append(failed.select("doc_id", F.lit(reader).alias("reader"), "error"))
        found = _read(spark, files, reader) | {}
        found["layers"] = boards.skeleton(spark, files.select("doc_id")).unionByName(found["layers"], allowMissingColumns=True) if "layers" in found else boards.skeleton(spark, files.select("doc_id"))
        if failed is not None:
            found = {t: df.join(failed.select("doc_id"), "doc_id", "left_anti") for t, df in found.items()}
        for t, df in found.items():
            parts[t].append(df.withColumn("reader", F.lit(reader)))
    out = {}
    for t, columns in TABLES.items():
        empty = spark.createDataFrame([], f"doc_id string, reader string, {columns}")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts[t], empty)
        out[t] = rows.select("doc_id", "reader", *[F.col(c).cast(kind).alias(c) for c, kind in (x.split(" ", 1) for x in columns.split(", "))])
    return out | {"files": listed, "errors": reduce(DataFrame.unionByName, errors)}
