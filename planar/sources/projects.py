"""Repair projects: JSON at rest, one row each, with nested annotations, links and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: our name -> the name in a file
FIELDS = {"format_version": "formatVersion", "name": "name", "board_file": "boardFile", "schematic_file": "schematicFile", "last_reference": "lastReference", "annotations": "annotations", "reference_links": "referenceLinks", "history": "history", "updated_utc": "updatedUtc"}


def save(projects: DataFrame, path: str) -> None:
    """Written with the time of saving; the commit of the job makes it appear as a whole."""
    stamped = projects.withColumn("updated_utc", F.current_timestamp())
    known = [F.col(k).alias(v) for k, v in FIELDS.items() if k in stamped.columns]
    stamped.select(*known).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Projects under path; names of fields match without regard to case."""
    raw = spark.read.json(path)
    back = {v.lower(): k for k, v in FIELDS.items()}
    return raw.select(*[F.col(f"`{c}`").alias(back[c.lower()]) for c in raw.columns if c.lower() in back])


def annotate(project: DataFrame, reference: str, title: str, status: str, at: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Appends an annotation at a position to each project; a title without text is an error."""
    if not title.strip():
        raise ValueError("an annotation has a text")
    place = F.struct(F.lit(at[0]).alias("x"), F.lit(at[1]).alias("y"))
    new = F.struct(
        F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")).alias("id"), F.lit(reference).alias("reference"), F.lit(title.strip()).alias("title"), F.lit(status).alias("status"),
        place.alias("position"), F.current_timestamp().alias("created_utc"),
    )
    return project.withColumn("annotations", F.concat(F.coalesce("annotations", F.array()), F.array(new)) if "annotations" in project.columns else F.array(new))


def remove_annotation(project: DataFrame, annotation_id: str) -> DataFrame:
    """Without the annotation of this id; `removed` tells which projects had it."""
    other = F.filter("annotations", lambda a: a["id"] != annotation_id)
    return project.withColumn("removed", F.size("annotations") > F.size(other)).withColumn("annotations", other)


def plugins(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the plug-ins of a folder: its .dll files, listed and not read, in order without regard to case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dll").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.dll$", 1).alias("name")).orderBy(F.upper("name"))
