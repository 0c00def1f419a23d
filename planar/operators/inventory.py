"""The geometry database and counts, extents and reports over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.data import KINDS
from planar.functions import geometry as g

#: What an element can mean.
MEANINGS = ("Unknown", "BoardOutline", "Copper", "Pad", "Via", "Hole", "Silkscreen", "Mechanical", "Text", "ComponentBody")


def geometry_database(elements: DataFrame) -> DataFrame:
    """One row for each element, with its measures; ordered by layer, top, left within a document by `entry`-making consumers."""
    return elements.select("doc_id", "element_ord", F.col("element_id").alias("source_element_id"), "layer_id", "kind", "is_closed", "is_filled", "left", "top", "right", "bottom", g.width().alias("width"), g.height().alias("height"), g.area().alias("bounding_area"))


def ordered(database: DataFrame) -> DataFrame:
    return database.orderBy("doc_id", "layer_id", "top", "left", "element_ord")


def kind_counts(database: DataFrame) -> DataFrame:
    """A column for each kind, zero where a document has none."""
    return database.groupBy("doc_id").pivot("kind", list(KINDS)).count().na.fill(0)


def extent(elements: DataFrame, *keys: str) -> DataFrame:
    """The union of boxes by key; boxes without an area don't count."""
    full = elements.where(~g.is_empty())
    return full.groupBy(*keys).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("n"))


def element_bounds(geometry: DataFrame) -> DataFrame:
    """Boxes of raw geometry (kind, x, y, x2, y2, w, h, diameter, radius, stroke, text) by the rule of each kind."""
    k, half = F.col("kind"), F.col("stroke") / 2
    round_ = F.when(k.isin("Via", "DrillHole"), F.col("diameter") / 2).when(k == "Arc", F.col("radius") + half)
    rx = F.when(k.isin("Pad"), F.col("w") / 2).when(k == "Ellipse", F.col("w") + half).otherwise(round_)
    ry = F.when(k.isin("Pad"), F.col("h") / 2).when(k == "Ellipse", F.col("h") + half).otherwise(round_)
    line = k.isin("Track", "Line", "Polyline", "Bezier")
    box = k.isin("Rectangle", "RasterImage", "Polygon")
    low = lambda a, b: F.least(a, b)
    text_width = F.greatest(F.col("h") * 0.5, F.col("h") * 0.6 * F.length("text"))
    left = F.when(line, low("x", "x2") - half).when(box, low("x", "x2")).when(k == "Text", F.col("x")).otherwise(F.col("x") - rx)
    right = F.when(line, F.greatest("x", "x2") + half).when(box, F.greatest("x", "x2")).when(k == "Text", F.col("x") + text_width).otherwise(F.col("x") + rx)
    top = F.when(line, low("y", "y2") - half).when(box, low("y", "y2")).when(k == "Text", F.col("y") - F.col("h")).otherwise(F.col("y") - ry)
    bottom = F.when(line, F.greatest("y", "y2") + half).when(box, F.greatest("y", "y2")).when(k == "Text", F.col("y")).otherwise(F.col("y") + ry)
    return geometry.withColumns({"left": left, "top": top, "right": right, "bottom": bottom})


def counts_by(rows: DataFrame, key: str, values) -> DataFrame:
    """doc_id and a map from every value to its number of rows, zero where a document has none."""
    each = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.count_if(F.col(key) == v) for v in values]))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), each.alias("counts"))


def grouped_digits(number) -> Column:
    return F.format_number(number, 0)


def summary(*parts) -> Column:
    """`12 pads · 1,024 vias`: numbers with their names."""
    return F.concat_ws(" · ", *[F.concat_ws(" ", grouped_digits(n), F.lit(name)) for n, name in parts])


def database_summary(counts: DataFrame) -> DataFrame:
    """A line for each document of counts_by(kind)."""
    of = lambda k: F.col("counts")[k]
    parts = [(F.col("total"), "records"), (of("Rectangle"), "rectangles"), (of("Ellipse"), "ellipses"), (of("Polyline"), "polylines"), (of("Line"), "lines"), (of("Text"), "texts")]
    return counts.select("doc_id", summary(*parts).alias("summary"))


def semantic_summary(counts: DataFrame) -> DataFrame:
    of = lambda k: F.col("counts")[k]
    parts = [(of("Pad"), "pads"), (of("Via"), "vias"), (of("Hole"), "holes"), (of("ComponentBody"), "bodies"), (of("BoardOutline"), "outlines"), (of("Unknown"), "unknown")]
    return counts.select("doc_id", summary(*parts).alias("summary"))


def inspector_report(database: DataFrame, classified: DataFrame, semantics: DataFrame, candidates: DataFrame, pads: DataFrame, footprints: DataFrame) -> DataFrame:
    """The JSON report of each document: database, classification, meaning and recognition, with the kinds that it has none of.

    A report is one row, as it is one file; its entries are in the order of the database."""
    listed = lambda df, name, *columns: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    counted = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    kinds, meanings = counts_by(database, "kind", KINDS), counts_by(semantics, "semantic", MEANINGS)
    parts = [
        kinds.join(database_summary(kinds), "doc_id").select("doc_id", F.col("counts").alias("kinds"), F.col("summary").alias("kind_summary")),
        listed(database, "entries", "layer_id", "top", "left", "element_ord", "kind"), listed(classified, "primitives", "element_ord", "primitive", "confidence"),
        meanings.join(semantic_summary(meanings), "doc_id").select("doc_id", F.col("counts").alias("meanings"), F.col("summary").alias("meaning_summary")),
        listed(semantics, "labels", "element_ord", "semantic", "confidence"),
        candidates.groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("reason") == "None").alias("accepted")), counted(pads, "pads"), counted(footprints, "footprints"),
    ]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.join(p, "doc_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    report = F.struct(
        F.struct(F.col("kind_summary").alias("summary"), F.col("kinds").alias("counts"), "entries").alias("database"), F.coalesce("primitives", F.array()).alias("classification"),
        F.struct(F.col("meaning_summary").alias("summary"), F.col("meanings").alias("counts"), F.col("labels").alias("primitives")).alias("semantic"),
        F.struct(number("candidates").alias("candidateCount"), number("accepted").alias("acceptedBeforeDeduplication"), number("pads").alias("padCount"), number("footprints").alias("footprintCount")).alias("recognition"),
    )
    return all_.select("doc_id", F.to_json(report).alias("report"))
