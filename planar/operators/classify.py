"""From elements to pads: shapes, donuts, size groups, aligned neighbours, confidence, acceptance, duplicates, vias and holes.

Everything is a projection, a grid join or an aggregation within a document. Two choices depend on order, made by greedy.first_come: which sizes begin
a group, among distinct sizes with alikes, and which duplicates go, among pads with a rival.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planar.functions import geometry as g
from planar.operators import greedy
from planar.operators.graph import written

#: Fixed values, which results must equal.
SIZE_TOLERANCE, ALIGNMENT, MAX_ASPECT = 0.12, 18.0, 6.0
#: Confidence by kind of primitive before repetition and alignment.
BASE = {"ExplicitPad": 1.0, "ExplicitHole": 1.0, "FilledRectangle": 0.90, "FilledEllipse": 0.92, "FilledPolygon": 0.82, "Donut": 0.90, "OutlineRectangle": 0.50, "OutlineEllipse": 0.54, "OutlinePolygon": 0.45}
SLOT = (0.86, 0.58)


def rectangular(points: Column) -> Column:
    """Whether each of 4 or 5 points lies on a corner of their box, to max(0.001, 8 % of the lesser side)."""
    at = lambda f, axis: f(F.transform(points, lambda p: p[axis]))
    left, right, top, bottom = at(F.array_min, "x"), at(F.array_max, "x"), at(F.array_min, "y"), at(F.array_max, "y")
    tolerance = F.greatest(F.lit(0.001), F.least(right - left, bottom - top) * 0.08)
    on = lambda p, axis, a, b: (F.abs(p[axis] - a) <= tolerance) | (F.abs(p[axis] - b) <= tolerance)
    return F.size(points).between(4, 5) & F.forall(points, lambda p: on(p, "x", left, right) & on(p, "y", top, bottom))


def primitives(elements: DataFrame, max_aspect: float = MAX_ASPECT) -> DataFrame:
    """One row for each element with a shape that may be a pad or a hole. A closed polyline counts as a rectangle if its points, where given, are rectangular."""
    w, h, kind = g.width(), g.height(), F.col("kind")
    usable = (g.aspect(w, h) <= max_aspect) & ~g.is_empty()
    slot = g.aspect(w, h) >= 1.45
    box = rectangular(F.col("points")) if "points" in elements.columns else F.lit(True)
    named = lambda name: F.concat(F.when(F.col("is_filled"), "Filled").otherwise("Outline"), F.lit(name))
    primitive = (
        F.when(kind == "Pad", "ExplicitPad").when(kind == "DrillHole", "ExplicitHole").when((kind == "Rectangle") & usable, named("Rectangle"))
        .when((kind == "Ellipse") & slot, "Slot").when(kind == "Ellipse", named("Ellipse"))
        .when((kind == "Polyline") & F.col("is_closed") & box & usable, "OutlineRectangle").when((kind == "Polygon") & usable, named("Polygon"))
    )
    shape = F.when(kind == "Pad", F.col("shape")).when(kind.isin("Rectangle", "Polyline"), "Rectangle").when((kind == "Ellipse") & slot, "Oval").when(kind.isin("Ellipse", "DrillHole"), "Circle").when(kind == "Polygon", "Polygon")
    filled = F.when(kind == "Pad", True).when(kind.isin("DrillHole", "Polyline"), False).otherwise(F.col("is_filled"))
    out = elements.withColumns({"primitive": primitive, "p_shape": shape, "p_filled": filled}).where(F.col("primitive").isNotNull() & ~g.is_empty())
    return out.select("doc_id", "element_ord", "element_id", "layer_id", "primitive", F.col("p_shape").alias("shape"), F.col("p_filled").alias("is_filled"), "left", "top", "right", "bottom", w.alias("w"), h.alias("h"), g.center_x().alias("cx"), g.center_y().alias("cy"))


def around(df: DataFrame, size: Column, x: str = "cx", y: str = "cy") -> DataFrame:
    """Rows in the nine cells about their own (cell_x, cell_y)."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = df.withColumn("step", F.explode(steps))
    return spread.withColumns({"cell_x": F.floor(F.col(x) / size) + F.col("step.i"), "cell_y": F.floor(F.col(y) / size) + F.col("step.j")}).drop("step")


def donuts(prims: DataFrame) -> DataFrame:
    """Circles with a smaller circle at their centre become Donut.

    Cells are 8 % of the outer diameter rounded up to a power of two; an inner circle, at least a fifth as wide, goes to the grids of the
    four levels of outer circles that it could belong to.
    """
    c = prims.where("shape = 'Circle'").withColumn("d", F.greatest("w", "h")).withColumn("level", F.ceil(F.log2("d")).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level")) * 0.08
    inner = c.withColumn("level", F.explode(F.sequence(F.col("level"), F.col("level") + 3)))
    inner = inner.select("doc_id", "level", F.floor(F.col("cx") / size).alias("cell_x"), F.floor(F.col("cy") / size).alias("cell_y"), F.col("w").alias("iw"), F.col("h").alias("ih"), F.col("d").alias("inner_d"), F.col("cx").alias("ix"), F.col("cy").alias("iy"))
    outer = around(c, size)
    near = g.distance(F.col("cx"), F.col("cy"), F.col("ix"), F.col("iy")) <= F.col("d") * 0.08
    hit = outer.join(inner, ["doc_id", "level", "cell_x", "cell_y"]).where((F.col("iw") < F.col("w")) & (F.col("ih") < F.col("h")) & near & (F.col("inner_d") >= F.col("d") * 0.2))
    marked = hit.select("doc_id", "element_ord").distinct().withColumn("donut", F.lit(True))
    return prims.join(marked, ["doc_id", "element_ord"], "left").withColumn("primitive", F.when(F.col("donut"), "Donut").otherwise(F.col("primitive"))).drop("donut")


def size_groups(prims: DataFrame, tolerance: float = SIZE_TOLERANCE) -> DataFrame:
    """group: the number of the first size of a document, in ascending order of area, that a primitive's size is alike in both sides and shape.

    Sizes that can be alike lie in neighbouring cells of the logarithms of their sides. A size that no earlier group's first size is alike begins a
    group; only sizes with alikes wait for each other in that choice.
    """
    sizes = prims.groupBy("doc_id", "shape", "w", "h").agg(F.min("element_ord").alias("first"))
    sizes = written(sizes.withColumn("rank", F.struct((F.col("w") * F.col("h")).alias("area"), "first")), "sizes")
    step = -math.log(1 - tolerance) * (1 + 1e-9)
    cell = lambda c: F.floor(F.log(c) / step)
    filed = sizes.where("w > 0 AND h > 0").withColumns({"cell_w": cell("w"), "cell_h": cell("h")})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = filed.withColumn("s", F.explode(steps)).withColumns({"cell_w": F.col("cell_w") + F.col("s.i"), "cell_h": F.col("cell_h") + F.col("s.j")}).drop("s")
    other = filed.select("doc_id", "shape", "cell_w", "cell_h", F.col("w").alias("ow"), F.col("h").alias("oh"), F.col("rank").alias("other"))
    alike = lambda a, b: F.least(a, b) / F.greatest(F.lit(1e-6), F.greatest(a, b)) >= 1 - tolerance
    pairs = asked.join(other, ["doc_id", "shape", "cell_w", "cell_h"]).where((F.col("rank") != F.col("other")) & alike(F.col("w"), F.col("ow")) & alike(F.col("h"), F.col("oh")))
    pairs = written(pairs.select("doc_id", "rank", "other"), "alike-sizes")
    met = F.struct(F.least("rank", "other").alias("a"), F.greatest("rank", "other").alias("b"))
    heads = greedy.first_come(pairs.select("doc_id", "rank", met.alias("resource")), ["doc_id"])
    heads = heads.unionByName(sizes.join(pairs.select("doc_id", "rank").distinct(), ["doc_id", "rank"], "left_anti").select("doc_id", "rank"))
    heads = written(heads.withColumn("group", (F.row_number().over(Window.partitionBy("doc_id").orderBy("rank")) - 1).cast("long")), "size-heads")
    joined = pairs.join(heads.withColumnRenamed("rank", "other"), ["doc_id", "other"]).groupBy("doc_id", "rank").agg(F.min("group").alias("joined"))
    groups = sizes.join(heads, ["doc_id", "rank"], "left").join(joined, ["doc_id", "rank"], "left")
    return prims.join(groups.select("doc_id", "shape", "w", "h", F.coalesce("group", "joined").alias("group")), ["doc_id", "shape", "w", "h"])


def aligned(grouped: DataFrame, factor: float = ALIGNMENT) -> DataFrame:
    """repetition (members of the group) and aligned (members in the row or column of a primitive, within `factor` times its greater side)."""
    stats = grouped.groupBy("doc_id", "group").agg(F.count(F.lit(1)).alias("repetition"), (F.max(F.greatest("w", "h")) * factor).alias("reach"))
    own = grouped.join(stats, ["doc_id", "group"])
    tolerance, reach = F.greatest(F.greatest(F.lit(0.000001), F.least("w", "h")) * 0.7, F.lit(0.01)), F.greatest("w", "h") * factor
    other = own.select("doc_id", "group", F.floor(F.col("cx") / F.col("reach")).alias("cell_x"), F.floor(F.col("cy") / F.col("reach")).alias("cell_y"), F.col("element_ord").alias("o_ord"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    dx, dy = F.abs(F.col("ox") - F.col("cx")), F.abs(F.col("oy") - F.col("cy"))
    pairs = around(own, F.col("reach")).join(other, ["doc_id", "group", "cell_x", "cell_y"]).where((F.col("element_ord") != F.col("o_ord")) & (((dy <= tolerance) & (dx <= reach)) | ((dx <= tolerance) & (dy <= reach))))
    n = pairs.groupBy("doc_id", "element_ord").agg(F.count(F.lit(1)).alias("aligned"))
    return own.drop("reach").join(n, ["doc_id", "element_ord"], "left").na.fill(0, ["aligned"])


def confidence() -> Column:
    base = F.when(F.col("primitive") == "Slot", F.when(F.col("is_filled"), SLOT[0]).otherwise(SLOT[1]))
    for kind, value in BASE.items():
        base = base.when(F.col("primitive") == kind, F.lit(value))
    plus = lambda c, least, x: F.when(F.col(c) >= least, F.lit(x)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), base.otherwise(F.lit(0.2)) + plus("repetition", 2, 0.10) + plus("repetition", 4, 0.06) + plus("aligned", 1, 0.14) + plus("aligned", 3, 0.08))


def classified(elements: DataFrame, max_aspect: float = MAX_ASPECT) -> DataFrame:
    grouped = written(size_groups(donuts(primitives(elements, max_aspect))), "size-groups")  # three steps read it
    out = aligned(grouped).withColumn("confidence", confidence())
    conductive = (F.col("primitive") == "ExplicitPad") | F.col("is_filled") | (F.col("primitive") == "Donut") | ((F.col("repetition") >= 2) & (F.col("aligned") >= 1))
    return written(out.withColumn("conductive", conductive), "classified")


def size_limits(elements: DataFrame) -> DataFrame:
    """The least and greatest pad size of each document, from its extent."""
    full = elements.where(~g.is_empty()).groupBy("doc_id").agg((F.max("right") - F.min("left")).alias("doc_w"), (F.max("bottom") - F.min("top")).alias("doc_h"))
    ref = F.greatest(F.lit(1.0), F.least("doc_w", "doc_h"))
    return full.select("doc_id", "doc_w", "doc_h", F.greatest(F.lit(0.04), F.least(F.lit(0.35), ref * 0.00008)).alias("least"), F.least(F.lit(20.0), F.greatest(F.lit(2.0), ref * 0.035)).alias("most"))


def candidates(prims: DataFrame, limits: DataFrame, max_aspect: float = MAX_ASPECT) -> DataFrame:
    """reason: why a primitive is no pad, or None."""
    p = prims.join(limits, "doc_id")
    explicit, w, h = F.col("primitive") == "ExplicitPad", F.col("w"), F.col("h")
    bare = ~F.col("is_filled") & (F.col("primitive") != "Donut") & ~((F.col("repetition") >= 2) & (F.col("aligned") >= 1))
    reason = (
        F.when(F.col("primitive") == "ExplicitHole", "UnsupportedGeometry").when(explicit, "None")
        .when((w < F.col("least")) | (h < F.col("least")), "TooSmall").when((w > F.col("most")) | (h > F.col("most")), "TooLarge")
        .when(g.aspect(w, h) > max_aspect, "InvalidAspectRatio").when(bare, "OutlineWithoutPattern")
        .when(F.col("confidence") < F.when(F.col("is_filled"), 0.68).otherwise(0.60), "LowConfidence").otherwise("None")
    )
    return p.withColumn("reason", reason)


def rejections(judged: DataFrame) -> DataFrame:
    return judged.groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n")).where("n > 0")


def distinct_pads(accepted: DataFrame) -> DataFrame:
    """Accepted pads without duplicates, best first: a pad goes if a better one has nearly its centre and size. pad_no numbers what stays by row, then column."""
    lesser = F.greatest(F.lit(0.005), F.col("w") * 0.18)
    own = accepted.withColumn("level", F.greatest(F.lit(-10), F.ceil(F.log2(lesser))).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level"))
    # The lesser of two widths bounds the distance, so the narrower pad looks around at its own level, where every wider one is filed too.
    b = own.select("doc_id", F.col("level").alias("own_level"), F.col("element_ord").alias("b_ord"), F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh"))
    b = b.withColumn("level", F.explode(F.sequence(F.col("own_level") - 1, F.col("own_level")))).withColumns({"cell_x": F.floor(F.col("bx") / size), "cell_y": F.floor(F.col("by") / size)})
    ratio = lambda a, c: F.least(a, c) / F.greatest(F.lit(0.000001), F.greatest(a, c))
    like = ratio(F.col("w"), F.col("bw")) * ratio(F.col("h"), F.col("bh")) >= 0.78
    near = g.distance(F.col("cx"), F.col("cy"), F.col("bx"), F.col("by")) <= F.greatest(F.lit(0.005), F.least("w", "bw") * 0.18)
    rivals = around(own, size).join(b, ["doc_id", "level", "cell_x", "cell_y"]).where((F.col("element_ord") != F.col("b_ord")) & like & near).select("doc_id", F.col("element_ord").alias("a"), F.col("b_ord").alias("b")).distinct()
    rivals = rivals.union(rivals.select("doc_id", "b", "a")).distinct()
    rank = F.struct((-F.col("confidence")).alias("c"), (F.col("w") * F.col("h")).alias("area"), "cy", "cx", "layer_id", "top", "left", "element_ord")
    ranked = accepted.select("doc_id", F.col("element_ord").alias("a"), rank.alias("rank"))
    met = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    uses = written(rivals.join(ranked, ["doc_id", "a"]).select("doc_id", "rank", met.alias("resource")), "rival-pads")
    stay = greedy.first_come(uses, ["doc_id"]).select("doc_id", F.col("rank.element_ord").alias("element_ord"))
    gone = uses.select("doc_id", F.col("rank.element_ord").alias("element_ord")).distinct().join(stay, ["doc_id", "element_ord"], "left_anti")
    kept = accepted.join(gone, ["doc_id", "element_ord"], "left_anti")
    return kept.withColumn("pad_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("cy", "cx", "element_ord")))


def vias(pads: DataFrame) -> DataFrame:
    """Circular pads up to 1.08 times the size at a third of their order, in documents with three or more."""
    size = F.greatest("w", "h")
    order = Window.partitionBy("doc_id").orderBy("size", "pad_no")
    c = pads.where("shape = 'Circle'").withColumn("size", size).withColumn("rn", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where("n >= 3")
    every = Window.partitionBy("doc_id")
    cut = F.greatest(F.max(F.when(F.col("rn") == 1, F.col("w"))).over(every), F.max(F.when(F.col("rn") == F.floor(F.col("n") / 3) + 1, F.col("size"))).over(every))
    found = c.withColumn("cut", cut).where(F.col("size") <= F.col("cut") * 1.08)
    return found.select("doc_id", "element_ord", "element_id", F.col("rn").alias("via_no"), F.col("size").alias("diameter"), F.least(F.lit(0.92), F.col("confidence")).alias("confidence"))


def holes(elements: DataFrame, pads: DataFrame, limits: DataFrame) -> DataFrame:
    """Drill holes, and round unfilled ellipses of a fitting size that are no pads."""
    w, h = g.width(), g.height()
    drilled = elements.where("kind = 'DrillHole'").select("doc_id", "element_ord", "element_id", w.alias("diameter"), F.lit(1.0).alias("confidence"))
    open_ = elements.where("kind = 'Ellipse' AND NOT is_filled").join(pads.select("doc_id", "element_ord"), ["doc_id", "element_ord"], "left_anti").join(limits, "doc_id")
    open_ = open_.withColumn("diameter", F.greatest(w, h)).where((g.aspect(w, h) <= 1.15) & (F.col("diameter") >= F.col("least")) & (F.col("diameter") <= F.col("most") * 2))
    return drilled.unionByName(open_.select("doc_id", "element_ord", "element_id", "diameter", F.lit(0.74).alias("confidence")))
