"""From the pages of technical documents to a board: pages stacked downwards, three layers a page, graphics as elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.operators import history

#: layer of a page -> its type
PAGE_LAYERS = (("text", "Document"), ("vector", "Document"), ("image", "Document"))
KINDS = {"Text": "Text", "Line": "Line", "Polyline": "Polyline", "Rectangle": "Rectangle", "Circle": "Ellipse", "Ellipse": "Ellipse", "Bezier": "Bezier", "Polygon": "Polygon", "Image": "RasterImage"}


def layers(pages: DataFrame) -> DataFrame:
    """Three layers for each page (doc_id, number, height), in the order of pages."""
    rows = F.array(*[F.struct(F.lit(n).alias("part"), F.lit(t).alias("layer_type"), F.lit(k).alias("k")) for k, (n, t) in enumerate(PAGE_LAYERS)])
    p = history.page_offsets(pages).withColumn("l", F.explode(rows))
    return p.select("doc_id", F.concat(F.lit("pdf-p"), "number", F.lit("-"), "l.part").alias("layer_id"), "l.layer_type", (F.col("first_layer_order") + F.col("l.k")).alias("ord"))


def elements(pages: DataFrame, graphics: DataFrame) -> DataFrame:
    """Graphics (doc_id, page, graphic_id, kind and box) as elements of the stacked board."""
    p = history.page_offsets(pages).select("doc_id", F.col("number").alias("page"), "offset_y")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind"))
    part = F.when(kind == "Text", "text").when(kind == "RasterImage", "image").otherwise("vector")
    g = graphics.join(p, ["doc_id", "page"])
    return g.select("doc_id", F.concat(F.lit("pdf-p"), "page", F.lit("-"), "graphic_id").alias("element_id"), kind.alias("kind"), F.concat(F.lit("pdf-p"), "page", F.lit("-"), part).alias("layer_id"), "left", (F.col("top") + F.col("offset_y")).alias("top"), "right", (F.col("bottom") + F.col("offset_y")).alias("bottom"))
