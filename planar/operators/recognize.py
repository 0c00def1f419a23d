"""From pads to components: clusters, their metrics, template scores, reference texts; and the simpler low-level footprints.

Clusters are connected components of the pads within a document's radius, by a grid join and rounds of links, so no document is held by one task.
Bands are folds over a cluster's sorted centres. The assignment of texts is made by
greedy.matched; only low-level footprints are grown in order, each component of the pads within reach by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planar.functions import geometry as g
from planar.operators import graph, greedy
from planar.operators.spatial import pad_neighbors
from planar.sources.templates import TEMPLATES

#: Fixed values, which results must equal: the greatest radius of a cluster, the scale of its radius and of low-level reach, the greatest ratio of sizes, the
#: tolerance of a band, the weights of a score and the pattern of designators.
MAX_RADIUS, SCALE, COMPATIBLE, AXIS = 3.5, 4.5, 2.75, 0.75
#: Weights of the factors of a template's score, in the order of addition.
WEIGHTS = (("pads", 2.2), ("rows", 1.3), ("columns", 1.3), ("pitch", 1.5), ("occupancy", 1.2), ("symmetry", 1.0), ("aspect", 0.8), ("topology", 2.2))
DESIGNATOR = r"(?i)^(?:R|C|L|D|Q|U|IC|J|P|CN|TP|XW|PP|F|Y|K|M)[0-9]+[A-Z0-9_-]*$"


def positive_median(x: Column) -> Column:
    return F.coalesce(F.percentile(F.when(x > 0, x), F.lit(0.5)), F.lit(0.1))


def clustered(pads: DataFrame, least: int = 2) -> DataFrame:
    """Pads (doc_id, element_ord unique in the corpus, cx, cy, w, h) with the least ordinal of their cluster; clusters of fewer than `least` go."""
    size = F.greatest("w", "h")
    radius = pads.groupBy("doc_id").agg(positive_median(size).alias("m")).select("doc_id", F.least(F.lit(MAX_RADIUS), F.greatest(F.col("m") * SCALE, F.col("m") * 1.5)).alias("radius"))
    near = pad_neighbors(pads.join(radius, "doc_id"), F.col("radius"), MAX_RADIUS)
    a, b = size, F.greatest("b_w", "b_h")
    links = near.where(F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(0.000001)) <= COMPATIBLE).select(F.col("element_ord").alias("a"), F.col("b_element_ord").alias("b"))
    found = graph.components(links)
    return pads.join(found.select(F.col("id").alias("element_ord"), F.col("component").alias("cluster")), "element_ord").withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("cluster"))).where(F.col("members") >= least)


def bands(xs: Column, tolerance: Column) -> Column:
    """Means of runs of sorted values, each value within the tolerance of the running mean before it."""
    empty = F.array().cast("array<struct<s:double,n:int>>")
    one = lambda x: F.array(F.struct(x.alias("s"), F.lit(1).alias("n")))

    def merge(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last["s"] + x).alias("s"), (last["n"] + 1).alias("n"))))
        return F.when(F.size(acc) == 0, one(x)).when(F.abs(x - last["s"] / last["n"]) <= tolerance, grown).otherwise(F.concat(acc, one(x)))

    return F.transform(F.aggregate(F.array_sort(xs), empty, merge), lambda b: b["s"] / b["n"])


def median_step(axis: Column) -> Column:
    """The median positive difference of neighbours; 0 for fewer than two, 0.1 if none is positive."""
    steps = F.array_sort(F.filter(F.transform(F.sequence(F.lit(1), F.size(axis) - 1), lambda k: F.element_at(axis, k + 1) - F.element_at(axis, k)), lambda d: d > 0))
    n = F.size(steps)
    mid = F.floor(n / 2).cast("int")
    median = F.when(n % 2 == 0, (F.element_at(steps, mid) + F.element_at(steps, mid + 1)) / 2).otherwise(F.element_at(steps, mid + 1))
    return F.when(F.size(axis) < 2, F.lit(0.0)).otherwise(F.when(n == 0, F.lit(0.1)).otherwise(median))


def metrics(clusters: DataFrame) -> DataFrame:
    """One row for each cluster: box, counts, pitches, symmetry, rotation, confidence; numbered by first pad."""
    size = F.greatest("w", "h")
    # A cluster's centres are collected once, for its bands.
    per = clusters.groupBy("doc_id", "cluster").agg(
        F.count(F.lit(1)).cast("int").alias("pads"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        positive_median(size).alias("median"), F.collect_list(F.struct("cx", "cy")).alias("at"), F.min(F.struct("cy", "cx", "element_ord")).alias("first"),
    )
    w, h = g.width(), g.height()
    per = per.withColumn("tolerance", F.greatest(F.col("median") * AXIS, F.lit(0.03)))
    per = per.withColumn("xs", bands(F.col("at.cx"), F.col("tolerance"))).withColumn("ys", bands(F.col("at.cy"), F.col("tolerance")))
    compact = g.clamp(F.col("pads") * F.col("median") * F.col("median") / F.greatest(w * h, F.lit(0.000001)), 0.0, 1.0)
    per = per.join(mirrored(clusters, per), ["doc_id", "cluster"], "left").na.fill(0, ["mirrored"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    return per.select(
        "doc_id", "cluster", number.alias("number"), "pads", "left", "top", "right", "bottom", F.size("ys").alias("rows"), F.size("xs").alias("columns"), median_step(F.col("xs")).alias("pitch_x"), median_step(F.col("ys")).alias("pitch_y"),
        (F.col("mirrored") / F.greatest(F.lit(1), F.col("pads"))).alias("symmetry"), F.when(w >= h, 0.0).otherwise(90.0).alias("rotation"), (F.lit(0.55) + compact * 0.4).alias("cluster_confidence"),
    )


def mirrored(clusters: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, cluster and mirrored: the pads that have one within the tolerance of their centre turned about the centre of the cluster's box (left, top, right, bottom,
    tolerance). Centres meet in cells as wide as the tolerance, so a cluster of any number of pads is no row and no task of its own."""
    cell = lambda v: F.floor(v / F.col("tolerance"))
    box = boxes.select("doc_id", "cluster", (g.center_x() * 2).alias("mx"), (g.center_y() * 2).alias("my"), "tolerance")
    own = clusters.select("doc_id", "cluster", "element_ord", "cx", "cy").join(box, ["doc_id", "cluster"])
    filed = own.select("doc_id", "cluster", cell(F.col("cx")).alias("cell_x"), cell(F.col("cy")).alias("cell_y"), F.col("cx").alias("qx"), F.col("cy").alias("qy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    turned = own.withColumns({"tx": F.col("mx") - F.col("cx"), "ty": F.col("my") - F.col("cy")}).withColumn("s", F.explode(steps))
    turned = turned.select("doc_id", "cluster", "element_ord", "tx", "ty", "tolerance", (cell(F.col("tx")) + F.col("s.i")).alias("cell_x"), (cell(F.col("ty")) + F.col("s.j")).alias("cell_y"))
    near = turned.join(filed, ["doc_id", "cluster", "cell_x", "cell_y"]).where((F.abs(F.col("qx") - F.col("tx")) <= F.col("tolerance")) & (F.abs(F.col("qy") - F.col("ty")) <= F.col("tolerance")))
    return near.select("doc_id", "cluster", "element_ord").distinct().groupBy("doc_id", "cluster").agg(F.count(F.lit(1)).alias("mirrored"))


def range_score(value: Column, low: Column, high: Column) -> Column:
    span = F.greatest(high - low, F.greatest(F.abs(high), F.lit(1.0)))
    off = F.when(value < low, low - value).otherwise(value - high)
    return F.when((value >= low) & (value <= high), 1.0).otherwise(g.clamp(1.0 - off / span, 0.0, 1.0))


def template_scores(solved: DataFrame, templates: list[dict] = TEMPLATES) -> DataFrame:
    """A row for each cluster and template, with the factors and the score."""
    kinds = {str: lambda v: F.lit(v), bool: lambda v: F.lit(v), int: lambda v: F.lit(float(v)), float: lambda v: F.lit(v)}
    array = F.array(*[F.struct(*[kinds[type(v)](v).alias(k) for k, v in t.items()]) for t in templates])
    c = solved.withColumn("t", F.explode(array))
    t = lambda name: F.col(f"t.{name}")
    between = lambda x, name: range_score(x.cast("double"), t(f"min_{name}"), t(f"max_{name}"))
    occupancy = F.col("pads") / F.greatest(F.lit(1), F.col("rows") * F.col("columns"))
    pitch = F.when((F.col("pitch_x") > 0) & (F.col("pitch_y") > 0), (F.col("pitch_x") + F.col("pitch_y")) / 2).otherwise(F.greatest("pitch_x", "pitch_y"))
    side = F.least("rows", "columns") / F.greatest("rows", "columns")
    topology = (
        F.when(t("two_rows") & (F.col("rows") != 2) & (F.col("columns") != 2), 0.0).when(t("square") & ((side < 0.7) | (occupancy < 0.5)), 0.0)
        .when(t("four_sides") & ((F.col("rows") < 3) | (F.col("columns") < 3)), 0.0).when(t("four_sides") & (occupancy > 0.72) & (t("family") != "Qfn"), 0.35).otherwise(1.0)
    )
    factors = {
        "pads": between(F.col("pads"), "pads"), "rows": between(F.col("rows"), "rows"), "columns": between(F.col("columns"), "columns"),
        "pitch": F.when((pitch <= 0) & (t("min_pitch") > 0), 0.0).otherwise(between(pitch, "pitch")), "occupancy": between(occupancy, "occupancy"),
        "symmetry": F.when(t("min_symmetry") <= 0, 1.0).otherwise(g.clamp(F.col("symmetry") / t("min_symmetry"), 0.0, 1.0)), "aspect": between(g.aspect(g.width(), g.height()), "aspect"), "topology": topology,
    }
    c = c.withColumn("f", F.struct(*[v.alias(k) for k, v in factors.items()]))
    total = F.lit(0.0)
    for name, weight in WEIGHTS:
        total = total + F.col(f"f.{name}") * weight
    score = g.clamp(total / sum(w for _, w in WEIGHTS), 0.0, 1.0)
    return c.withColumn("score", score).withColumn("accepted", (F.col("score") >= t("acceptance")) & (F.col("f.pads") > 0) & (F.col("f.topology") > 0))


def footprints(solved: DataFrame, templates: list[dict] = TEMPLATES) -> DataFrame:
    """The best template of each cluster (first by priority, then name, among equals), its name and confidence."""
    best = Window.partitionBy("doc_id", "cluster").orderBy(F.desc("score"), F.desc("t.priority"), "t.name")
    won = template_scores(solved, templates).withColumn("place", F.row_number().over(best)).where("place = 1")
    prefix = F.create_map(*[x for k, v in {"Chip2": "CHIP-2", "Soic": "SOIC", "Tssop": "TSSOP", "Qfn": "QFN", "Qfp": "QFP", "Bga": "BGA", "Ffc": "FFC", "SingleRowConnector": "CONN", "DualRowConnector": "DUAL"}.items() for x in (F.lit(k), F.lit(v))])
    family = F.col("t.family")
    name = F.when(~F.col("accepted"), F.concat(F.lit("UNRESOLVED-"), "pads")).when(family == "Chip2", F.lit("CHIP-2")).otherwise(F.concat(F.coalesce(F.try_element_at(prefix, family), F.lit("ARRAY")), F.lit("-"), "pads"))
    return won.select(*solved.columns, family.alias("family"), name.alias("name"), "accepted", "score", g.clamp((F.col("cluster_confidence") + F.col("score")) / 2, 0.0, 1.0).alias("confidence"))


def components(found: DataFrame, texts: DataFrame) -> DataFrame:
    """A component for each footprint, named by the nearest designator text that no earlier footprint took.

    Candidates are pairs within 2.5 times the greater side + 2, from a grid join; footprints choose among them in order (greedy.matched).
    """
    reach = F.greatest(g.width(), g.height()) * 2.5 + 2
    f = found.withColumns({"x": g.center_x(), "y": g.center_y(), "reach": reach}).withColumn("level", F.ceil(F.log2("reach")).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    looks = f.withColumn("s", F.explode(steps)).withColumns({"cell_x": F.floor(F.col("x") / size) + F.col("s.i"), "cell_y": F.floor(F.col("y") / size) + F.col("s.j")})
    levels = f.select("doc_id", "level").distinct()
    named = texts.where(F.trim("text").rlike(DESIGNATOR)).select("doc_id", F.col("element_ord").alias("text_ord"), F.trim("text").alias("reference"), g.center_x().alias("tx"), g.center_y().alias("ty"))
    filed = named.join(levels, "doc_id").withColumns({"cell_x": F.floor(F.col("tx") / size), "cell_y": F.floor(F.col("ty") / size)})
    dist = g.distance(F.col("tx"), F.col("ty"), F.col("x"), F.col("y"))
    order = Window.partitionBy("doc_id").orderBy("top", "left", "number")
    numbered = f.withColumn("component_no", F.row_number().over(order)).select("doc_id", "cluster", "component_no")
    pairs = looks.join(filed, ["doc_id", "level", "cell_x", "cell_y"]).withColumn("distance", dist).where(F.col("distance") <= F.col("reach")).join(numbered, ["doc_id", "cluster"]).select("doc_id", "component_no", "text_ord", "reference", "distance")

    pairs = pairs.select("doc_id", F.col("component_no").alias("item"), F.struct("text_ord", "reference").alias("other"), F.struct("distance", "text_ord").alias("cost"))
    given = greedy.matched(pairs, ["doc_id"]).select("doc_id", F.col("item").alias("component_no"), F.col("other.reference").alias("reference"))
    out = found.join(numbered, ["doc_id", "cluster"]).join(given, ["doc_id", "component_no"], "left")
    conf = F.when(F.col("reference").isNull(), F.col("confidence") * 0.8).otherwise(F.least(F.lit(1.0), F.col("confidence") + 0.08))
    return out.select("doc_id", F.format_string("component-%04d", "component_no").alias("component_id"), F.coalesce("reference", F.format_string("X%04d", "component_no")).alias("reference"), "name", "pads", "rotation", conf.alias("confidence"))


def low_level_footprints(pads: DataFrame, limits: DataFrame, most: int = 512, factor: float = SCALE) -> DataFrame:
    """Groups of pads grown from each unseen pad in order: neighbours of a like size, while the group's box stays within a span.

    The growth depends on order, but never leaves the pads that are linked by steps within reach. So each such component, found by
    a grid join and rounds of links, is grown by itself; median, reach and span are the document's, and the groups are numbered by their first pads.
    """
    scale = pads.groupBy("doc_id").agg(F.percentile(F.greatest("w", "h"), F.lit(0.5)).alias("median")).join(limits.select("doc_id", "doc_w", "doc_h"), "doc_id")
    short = F.least("doc_w", "doc_h")
    scale = scale.withColumn("reach", F.greatest(F.col("median") * factor, short * 0.0015)).select("doc_id", "median", "reach", F.greatest(F.col("reach") * 12, short * 0.06).alias("span"))
    own = pads.select("doc_id", "element_ord", "shape", "left", "top", "right", "bottom", "w", "h", "cx", "cy").join(scale, "doc_id")
    own = graph.written(own, "footprint-pads")
    wide = F.col("reach") * (1 + 1e-9)  # the distance is compared exactly while growing
    near = pad_neighbors(own, wide, wide).where("element_ord < b_element_ord")
    linked = graph.components(near.select(F.col("element_ord").alias("a"), F.col("b_element_ord").alias("b")))

    def grow(pdf):
        import math
        from collections import deque

        import numpy as np
        import pandas as pd

        columns = ["doc_id", "class", "pads", "left", "top", "right", "bottom", "rotation", "confidence", "cy", "cx", "element_ord"]
        p = pdf.sort_values(["cy", "cx", "element_ord"], kind="mergesort").reset_index(drop=True)
        median, reach, span = float(p["median"][0]), float(p.reach[0]), float(p.span[0])
        x, y, root = p.cx.to_numpy(), p.cy.to_numpy(), np.sqrt(p.w * p.h).to_numpy()
        box = p[["left", "top", "right", "bottom"]].to_numpy()
        cells: dict = {}
        for k in range(len(p)):
            cells.setdefault((math.floor(x[k] / reach), math.floor(y[k] / reach)), []).append(k)
        free, out = np.ones(len(p), bool), []
        for seed in range(len(p)):
            if not free[seed]:
                continue
            free[seed] = False
            group, todo, own = [seed], deque([seed]), box[seed].copy()
            while todo and len(group) < most:
                k = todo.popleft()
                i, j = math.floor(x[k] / reach), math.floor(y[k] / reach)
                for c in sorted(c for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for c in cells.get((a, b), ())):
                    if not free[c] or math.sqrt((x[c] - x[k]) ** 2 + (y[c] - y[k]) ** 2) > reach:
                        continue
                    new = np.array([min(own[0], box[c][0]), min(own[1], box[c][1]), max(own[2], box[c][2]), max(own[3], box[c][3])])
                    if new[2] - new[0] > span or new[3] - new[1] > span or max(root[seed], root[c]) / max(1e-6, min(root[seed], root[c])) > COMPATIBLE:
                        continue
                    free[c] = False
                    group.append(c)
                    todo.append(c)
                    own = new
            if len(group) < 2:
                continue
            areas = (p.w * p.h).to_numpy()[group]
            mid = float(np.median(areas))
            even = max(0.0, 1 - min(1.0, float(np.mean(np.abs(areas - mid) / mid)))) if mid > 0 else 0.0
            dx, dy = x[group] - x[group].mean(), y[group] - y[group].mean()
            turn = math.atan2(2 * float((dx * dy).sum()), float((dx * dx).sum() - (dy * dy).sum())) * 90 / math.pi
            pad = max(0.02, median * 0.35)
            out.append((p.doc_id[0], kind_of(p["shape"].to_numpy()[group], x[group], y[group]), len(group), own[0] - pad, own[1] - pad, own[2] + pad, own[3] + pad, turn, min(0.97, 0.68 + min(len(group), 12) * 0.018 + even * 0.12), y[seed], x[seed], p.element_ord[seed]))
        return pd.DataFrame(out, columns=columns)

    def lanes(v):
        v = sorted(v)
        tolerance, n, at = max(1e-5, max(1e-6, v[-1] - v[0]) / max(20.0, len(v) * 3.0)), 1, v[0]
        for z in v[1:]:
            if abs(z - at) > tolerance:
                n, at = n + 1, z
        return n

    def kind_of(shapes, xs, ys):
        n = len(xs)
        if n == 2:
            return "2-PAD"
        if all(s == "Circle" for s in shapes):
            return f"CIRCULAR-{n}"
        rows, columns = lanes(ys), lanes(xs)
        return f"ARRAY-{rows}x{columns}" if rows >= 3 and columns >= 3 and rows * columns >= n * 0.7 else f"MULTIPAD-{n}"

    grown = own.join(linked.withColumnRenamed("id", "element_ord"), "element_ord").groupBy("doc_id", "component").applyInPandas(
        grow, "doc_id long, class string, pads int, left double, top double, right double, bottom double, rotation double, confidence double, cy double, cx double, element_ord long")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("cy", "cx", "element_ord"))
    return grown.withColumn("footprint_no", number).drop("cy", "cx", "element_ord")
