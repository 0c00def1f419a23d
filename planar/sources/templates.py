"""Footprint templates: the built-in rows, and a reader for folders of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("name", "family", "min_pads", "max_pads", "min_rows", "max_rows", "min_columns", "max_columns", "min_pitch", "max_pitch", "min_occupancy", "max_occupancy", "min_symmetry", "min_aspect", "max_aspect", "square", "two_rows", "four_sides", "acceptance", "priority")
#: Fixed values, in the order of priority, which is that of the result: name, family, ranges of pads, rows, columns, pitch and occupancy, least symmetry, range of aspect, needs (square matrix, two rows, four sides), acceptance, priority.
ROWS = (
    ("CHIP-2", "Chip2", 2, 2, 1, 2, 1, 2, 0.0, 10.0, 0.8, 1.0, 0.5, 0.0, 20.0, False, False, False, 0.75, 100),
    ("BGA", "Bga", 9, 2500, 3, 60, 3, 60, 0.3, 1.5, 0.55, 1.0, 0.7, 0.65, 1.55, True, False, False, 0.75, 95),
    ("TSSOP", "Tssop", 8, 64, 2, 2, 4, 32, 0.3, 0.79, 0.7, 1.0, 0.65, 1.2, 8.0, False, True, False, 0.72, 90),
    ("QFN", "Qfn", 8, 100, 3, 30, 3, 30, 0.25, 1.0, 0.15, 0.75, 0.65, 0.75, 1.35, False, False, True, 0.7, 85),
    ("QFP", "Qfp", 16, 256, 4, 80, 4, 80, 0.3, 1.27, 0.05, 0.65, 0.7, 0.6, 1.7, False, False, True, 0.72, 84),
    ("SOIC", "Soic", 6, 32, 2, 2, 3, 16, 0.8, 1.5, 0.7, 1.0, 0.65, 1.2, 6.0, False, True, False, 0.72, 80),
    ("FFC", "Ffc", 4, 100, 1, 2, 2, 100, 0.2, 1.5, 0.6, 1.0, 0.5, 2.0, 100.0, False, False, False, 0.68, 70),
    ("CONNECTOR-DUAL", "DualRowConnector", 4, 200, 2, 2, 2, 100, 0.5, 5.0, 0.6, 1.0, 0.45, 1.0, 100.0, False, True, False, 0.65, 35),
    ("CONNECTOR-SINGLE", "SingleRowConnector", 3, 100, 1, 1, 3, 100, 0.5, 5.0, 0.8, 1.0, 0.4, 2.0, 100.0, False, False, False, 0.65, 30),
    ("ARRAY", "Array", 3, 2500, 1, 100, 1, 100, 0.0, 10.0, 0.0, 1.0, 0.0, 0.0, 100.0, False, False, False, 0.45, 1),
)
TEMPLATES = [dict(zip(FIELDS, row)) for row in ROWS]
#: Acceptance of the built-in rows where no folder of templates is given; ARRAY keeps its own.
PLAIN = [t | {"acceptance": 0.45 if t["name"] == "ARRAY" else 0.7} for t in TEMPLATES]
#: field of a JSON template -> our field
JSON_NAMES = {"requiresSquareMatrix": "square", "requiresTwoRows": "two_rows", "requiresFourSides": "four_sides", "acceptanceScore": "acceptance", "minAspectRatio": "min_aspect", "maxAspectRatio": "max_aspect"}


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Valid templates of a folder of JSON files, by priority and name; names are matched without regard to case."""
    raw = spark.read.json(folder, multiLine=True, pathGlobFilter="*.json")
    known = {k.lower(): v for k, v in JSON_NAMES.items()} | {f.replace("_", ""): f for f in FIELDS}
    rows = raw.select(*[F.col(f"`{c}`").alias(known[c.lower()]) for c in raw.columns if c.lower() in known])
    ordered = [F.col(f"min_{r}") <= F.col(f"max_{r}") for r in ("pads", "rows", "columns", "pitch", "occupancy", "aspect")]
    valid = (F.trim("name") != "") & F.col("acceptance").between(0, 1)
    for o in ordered:
        valid = valid & o
    return rows.where(valid).orderBy(F.desc("priority"), "name")


def templates(spark: SparkSession, folder: str | None = None) -> list[dict]:
    """A folder's templates, or the built-in ones where it has none. A dimension of some rows."""
    rows = [r.asDict() for r in read_templates(spark, folder).collect()] if folder else []
    return rows or sorted(PLAIN, key=lambda t: (-t["priority"], t["name"]))
