"""What each element means, by the first rule that holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.functions import geometry as g

OUTLINE_SHARE, BODY_SHARE, LARGEST_PAD = 0.35, 0.00008, 20.0
#: layer type -> meaning
BY_LAYER = {"Copper": "Copper", "Silkscreen": "Silkscreen", "Outline": "BoardOutline", "Mechanical": "Mechanical", "Drill": "Hole"}


def semantics(elements: DataFrame, layers: DataFrame, pads: DataFrame, vias: DataFrame, holes: DataFrame, classified: DataFrame) -> DataFrame:
    """doc_id, element_ord, kind, semantic, confidence and rule of every element; layers are those of its own document."""
    key = ["doc_id", "element_ord"]
    flag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    first = classified.groupBy(*key).agg(F.first("conductive").alias("conductive"), F.first("confidence").alias("p_confidence"))
    size = elements.where(~g.is_empty()).groupBy("doc_id").agg(F.greatest(F.lit(0.000001), (F.max("right") - F.min("left")) * (F.max("bottom") - F.min("top"))).alias("doc_area"))
    e = elements.join(flag(pads, "is_pad"), key, "left").join(flag(vias, "is_via"), key, "left").join(flag(holes, "is_hole"), key, "left").join(first, key, "left")
    e = e.join(layers.select("doc_id", "layer_id", "layer_type"), ["doc_id", "layer_id"], "left").join(size, "doc_id", "left")
    kind, share = F.col("kind"), F.greatest(F.lit(0.0), g.area()) / F.coalesce("doc_area", F.lit(0.000001))
    said = lambda name, conf, rule: F.struct(F.lit(name).alias("semantic"), (F.lit(conf) if isinstance(conf, float) else conf).alias("confidence"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"))
    layer = F.coalesce("layer_type", F.lit("Unknown"))
    rule = F.when(F.col("is_hole") | (kind == "DrillHole"), said("Hole", 1.0, "ExplicitOrRecognizedHole")).when(F.col("is_via") | (kind == "Via"), said("Via", 0.98, "ExplicitOrRecognizedVia"))
    rule = rule.when(F.col("is_pad") | (kind == "Pad"), said("Pad", 0.98, "ExplicitOrRecognizedPad")).when(kind == "Text", said("Text", 1.0, "TextPrimitive"))
    for name, meaning in BY_LAYER.items():
        rule = rule.when(layer == name, said(meaning, 0.92, f"Layer:{name}"))
    rule = rule.when(F.col("is_closed") & (share >= OUTLINE_SHARE), said("BoardOutline", 0.90, "ClosedLargeDocumentBoundary")).when(kind == "Track", said("Copper", 0.95, "ExplicitTrack"))
    rule = rule.when(F.col("conductive") & (F.greatest(g.width(), g.height()) <= LARGEST_PAD), said("Pad", F.greatest(F.lit(0.55), F.col("p_confidence")), "ConductiveGeometryCandidate"))
    rule = rule.when(F.col("is_closed") & (share >= BODY_SHARE) & kind.isin("Rectangle", "Polygon", "Polyline"), said("ComponentBody", 0.68, "ClosedMediumScaleBody"))
    rule = rule.when(kind.isin("Line", "Polyline", "Bezier", "Arc"), said("Silkscreen", 0.52, "DocumentStroke")).when(kind == "RasterImage", said("Mechanical", 0.40, "RasterReference"))
    return e.withColumn("s", rule.otherwise(said("Unknown", 0.20, "InsufficientEvidence"))).select(*key, "element_id", "kind", "s.*")
