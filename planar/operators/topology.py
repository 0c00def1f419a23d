"""Segment graphs: rectangles as 4-cycles, contours as chains, circles of curves.

Groups of segments (doc_id, group_key) never touch each other. Cycles are found by joins of edges. Which ends are nodes and which of overlapping
cycles are kept depends on the order of the segments; these choices are made by greedy.first_come.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planar.operators import assembly, graph, greedy


@dataclasses.dataclass(frozen=True)
class Limits:
    """Tolerances of the kernel: ends within `snap` are one node, angles and lengths may differ by `angle`, and the least edge and area."""

    snap: float = 0.01
    angle: float = 0.035
    edge: float = 0.01
    area: float = 0.0001


#: Points that differ by no more than this on both axes are one.
POINT = 1e-4
#: The limits for the segments of a page.
PAGE = Limits(edge=0.005, area=0.00005)
GROUP = ("doc_id", "group_key")


def _long(limits: Limits) -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return F.sqrt(dx * dx + dy * dy) >= limits.edge


def nodes(segments: DataFrame, limits: Limits = Limits(), held: int = greedy.HELD) -> tuple[DataFrame, DataFrame]:
    """Ends of segments snapped first come, first served: (nodes, ends).

    An end belongs to a node within `snap` in the cell of its own rounded key or one around it, to the first of these cells by x and then y;
    where there is none it becomes a node. Only the first end at a point can become one, so the choice is made over distinct points that have others
    within reach, and later ends follow what had become a node before them. nodes: group, node (seg_ord and side of its end), x, y. ends: group, seg_ord, side, node.
    """
    ends = segments.where(_long(limits)).select(*GROUP, F.explode(F.array(*[F.struct(F.struct("seg_ord", F.lit(k).alias("side")).alias("at"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)])).alias("e")).select(*GROUP, "e.*")
    key = lambda c: F.rint(F.col(c) / limits.snap).cast("long")
    points = graph.written(ends.groupBy(*GROUP, "x", "y").agg(F.min("at").alias("at")).withColumns({"kx": key("x"), "ky": key("y")}), "points")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = points.select(*GROUP, F.col("at").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "kx", "ky")
    asked = points.select(*GROUP, "at", "x", "y", F.explode(around).alias("d"), "kx", "ky").withColumns({"kx": F.col("kx") + F.col("d.i"), "ky": F.col("ky") + F.col("d.j")})
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    near = asked.join(other, [*GROUP, "kx", "ky"]).where(F.sqrt(dx * dx + dy * dy) <= limits.snap).where("at <> other")
    near = graph.written(near.select(*GROUP, "at", "other", (F.col("d.i") * 3 + F.col("d.j")).alias("cell")), "near")
    pair = F.struct(F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b"))
    chosen = greedy.first_come(near.select(*GROUP, F.col("at").alias("rank"), pair.alias("resource")), [*GROUP], held)
    lonely = points.join(near.select(*GROUP, "at").distinct(), [*GROUP, "at"], "left_anti").select(*GROUP, "at")
    made = graph.written(lonely.unionByName(chosen.withColumnRenamed("rank", "at")), "nodes")
    # What a point may meet, as it becomes a node: from then on, unless an earlier cell has one already.
    reach = near.join(made.withColumnRenamed("at", "other"), [*GROUP, "other"]).select(*GROUP, "at", F.col("other").alias("node"), "cell")
    reach = reach.unionByName(made.select(*GROUP, "at", F.col("at").alias("node"), F.lit(0).alias("cell")))
    order = Window.partitionBy(*GROUP, "at").orderBy("node")
    best = F.min(F.struct("cell", "node")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))["node"]
    steps = reach.withColumn("best", best).withColumn("until", F.lead("node").over(order)).select(*GROUP, F.col("at").alias("point"), F.col("node").alias("since"), "until", "best")
    named = ends.join(points.select(*GROUP, "x", "y", F.col("at").alias("point")), [*GROUP, "x", "y"]).join(steps, [*GROUP, "point"])
    named = named.where("since <= at AND (until IS NULL OR at < until)").select(*GROUP, "at.seg_ord", "at.side", F.col("best").alias("node"))
    placed = points.select(*GROUP, F.col("at").alias("node"), "x", "y").join(made.select(*GROUP, F.col("at").alias("node")), [*GROUP, "node"], "left_semi")
    return placed, named


def all_edges(segments: DataFrame, limits: Limits = Limits(), held: int = greedy.HELD) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): segments of the least length whose ends are two nodes: group, seg_ord, segment_id, p and q (a node with its place)."""
    made, ends = nodes(segments, limits, held)
    at = graph.written(ends.join(made, [*GROUP, "node"]).select(*GROUP, "seg_ord", "side", F.struct("node", "x", "y").alias("n")), "ends")
    side = lambda k, name: at.where(F.col("side") == k).select(*GROUP, "seg_ord", F.col("n").alias(name))
    e = side(1, "p").join(side(2, "q"), [*GROUP, "seg_ord"]).where("p.node <> q.node")
    return made, graph.written(e.join(segments.select(*GROUP, "seg_ord", "segment_id"), [*GROUP, "seg_ord"]), "edges")


def _paths(edges: DataFrame) -> DataFrame:
    """Paths a-m-c of edges, of parallel ones the first, from a node a that comes before the other two; e1 and e2 are the edges' orders and ids."""
    first = edges.withColumns({"a": F.least("p", "q"), "b": F.greatest("p", "q")}).groupBy(*GROUP, "a", "b").agg(F.min(F.struct("seg_ord", "segment_id")).alias("e"))
    one = first.select(*GROUP, "a", F.col("b").alias("m"), F.col("e").alias("e1"))
    two = first.select(*GROUP, F.col("a").alias("m"), F.col("b").alias("c"), F.col("e").alias("e2")).unionByName(first.select(*GROUP, F.col("b").alias("m"), F.col("a").alias("c"), F.col("e").alias("e2")))
    return one.join(two, [*GROUP, "m"]).where("a.node < c.node")


def _angles(limits: Limits):
    x = lambda p: F.col(f"{p}.x")
    y = lambda p: F.col(f"{p}.y")
    side = lambda p, q: (x(q) - x(p), y(q) - y(p))
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1])
    dot = lambda v, w: F.abs(v[0] * w[0] + v[1] * w[1]) / (length(v) * length(w))
    cross = lambda v, w: F.abs(v[0] * w[1] - v[1] * w[0]) / (length(v) * length(w))
    return side, length, dot, cross


def rectangles(edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Valid rectangles of edges (all_edges), each once: corners a to d, edge ids and orders in that sequence, rank and axis_aligned.

    A cycle is found at its first node a; b comes before d among a's neighbours by the first edge to each. rank says when it is met: by a, then
    by the edges a-b, a-d and b-c. Paths a-b-c and a-d-c meet on (a, c); a path that bends by more than the other corners allow goes before that.
    """
    side, length, dot, cross = _angles(limits)
    path = _paths(edges).where(dot(side("a", "m"), side("m", "c")) <= 4 * limits.angle)
    b = path.select(*GROUP, "a", "c", F.col("m").alias("b"), F.col("e1").alias("ab"), F.col("e2").alias("bc"))
    d = path.select(*GROUP, "a", "c", F.col("m").alias("d"), F.col("e1").alias("da"), F.col("e2").alias("cd"))
    cycle = b.join(d, [*GROUP, "a", "c"]).where("ab.seg_ord < da.seg_ord")
    ab, bc, cd, da = side("a", "b"), side("b", "c"), side("c", "d"), side("d", "a")
    even = lambda v, w: F.abs(length(v) - length(w)) <= F.greatest(F.lit(limits.snap), F.greatest(length(v), length(w)) * limits.angle)
    square = (dot(ab, bc) <= limits.angle) & (dot(bc, cd) <= limits.angle) & (cross(ab, cd) <= limits.angle) & (cross(bc, da) <= limits.angle)
    long_ = F.least(*map(length, (ab, bc, cd, da))) >= limits.edge
    valid = long_ & square & even(ab, cd) & even(bc, da) & (F.abs(ab[0] * bc[1] - ab[1] * bc[0]) >= limits.area)
    flat = lambda v: F.abs(v[1]) <= limits.snap
    tall = lambda v: F.abs(v[0]) <= limits.snap
    each = lambda c: F.array(*[F.col(f"{e}.{c}") for e in ("ab", "bc", "cd", "da")])
    rank = F.struct(F.col("a.node").alias("node"), F.col("ab.seg_ord").alias("ab"), F.col("da.seg_ord").alias("da"), F.col("bc.seg_ord").alias("bc"))
    return cycle.where(valid).select(*GROUP, *"abcd", each("segment_id").alias("edge_ids"), each("seg_ord").alias("edge_ords"), rank.alias("rank"), ((flat(ab) & tall(bc)) | (tall(ab) & flat(bc))).alias("axis_aligned"))


#: Counters of a kernel's run.
COUNTERS = ("input", "discarded", "nodes", "edges", "cycles", "accepted", "rejected", "consumed", "remaining")


class Kernel:
    """Rectangles of the segments of each group that share no edge, first come; the segments that remain; counters of each document.

    segments: doc_id, group_key, seg_ord (orderable, unique in a group), segment_id, x1 to y2.
    """

    def __init__(self, segments: DataFrame, limits: Limits = Limits(), held: int = greedy.HELD):
        self.segments, self.limits = segments, limits
        self.nodes, self.edges = all_edges(segments, limits, held)
        found = graph.written(rectangles(self.edges, limits), "rectangles")
        uses = found.select(*GROUP, "rank", F.explode("edge_ords").alias("resource"))
        self.rectangles = graph.written(found.join(greedy.first_come(uses, [*GROUP], held), [*GROUP, "rank"], "left_semi"), "accepted")

    def numbered(self) -> DataFrame:
        """The rectangles with their number in the document: groups as their first segments come, in a group as met."""
        n = self.rectangles.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).join(self.segments.groupBy(*GROUP).agg(F.min("seg_ord").alias("begin")), [*GROUP])
        before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inner = F.row_number().over(Window.partitionBy(*GROUP).orderBy("rank"))
        return self.rectangles.withColumn("inner", inner).join(n.select(*GROUP, before.alias("before")), [*GROUP]).withColumn("rectangle_no", F.col("before") + F.col("inner")).drop("inner", "before")

    def remaining(self) -> DataFrame:
        consumed = self.rectangles.select(*GROUP, F.explode("edge_ords").alias("seg_ord"))
        return self.segments.where(_long(self.limits)).join(consumed, [*GROUP, "seg_ord"], "left_anti")

    def counters(self) -> DataFrame:
        """doc_id and COUNTERS. Cycles are counted by the paths between two nodes, without listing them."""
        count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
        pairs = _paths(self.edges).groupBy(*GROUP, "a", "c").agg(F.count(F.lit(1)).alias("n"))
        cycles = pairs.groupBy("doc_id").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("cycles"))
        out = count(self.segments, "input")
        for df, name in ((self.nodes, "nodes"), (self.edges, "edges"), (self.rectangles, "accepted")):
            out = out.join(count(df, name), "doc_id", "left")
        out = out.join(cycles, "doc_id", "left").join(self.segments.where(_long(self.limits)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("long")), "doc_id", "left").na.fill(0)
        return out.select(
            "doc_id", "input", (F.col("input") - F.col("edges")).alias("discarded"), "nodes", "edges", "cycles", "accepted", (F.col("cycles") - F.col("accepted")).alias("rejected"),
            (F.col("accepted") * 4).alias("consumed"), (F.col("long") - F.col("accepted") * 4).alias("remaining"),
        )


def kernel(segments: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Accepted rectangles with their numbers, and the segments that remain."""
    k = Kernel(segments, limits)
    return k.numbered(), k.remaining()


def path_segments(contours: DataFrame, least: float = 1e-4) -> DataFrame:
    """Segments between consecutive points of contours (path_id, points, is_closed), the closing one too; equal neighbours are skipped."""
    n = F.size("points")
    nxt = F.when(F.col("is_closed") & (n > 2), F.concat(F.slice("points", 2, n - 1), F.slice("points", 1, 1))).otherwise(F.slice("points", 2, F.greatest(n - 1, F.lit(0))))
    pairs = F.arrays_zip(F.slice("points", 1, F.size(nxt)).alias("p"), nxt.alias("q"))
    s = contours.select("doc_id", "path_id", F.posexplode(pairs).alias("k", "s")).select("doc_id", "path_id", "k", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return s.where(F.sqrt(dx * dx + dy * dy) > least).withColumn("segment_no", F.row_number().over(Window.partitionBy("doc_id", "path_id").orderBy("k")))


def contours(segments: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Chains of segments joined where the ends of exactly two meet, as contours: chain (its first seg_ord), segments, is_closed, points."""
    p = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    each = segments.select(*GROUP, F.col("seg_ord").alias("ord"), p.alias("points"), F.lit(False).alias("is_closed"))
    return assembly.outlines(assembly.chains(each, tolerance), tolerance).withColumnRenamed("contours", "segments")


def circle_fit(curves: Column) -> Column:
    """x, y and radius of the circle that four curves (x1, y1 to x2, y2) close, or null: each begins where the one before ends, the box is square to 2 %,
    and all ends have the radius to 3 %."""
    near = lambda p, q: (F.abs(p["x2"] - q["x1"]) <= POINT) & (F.abs(p["y2"] - q["y1"]) <= POINT)
    chained = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda k: near(F.get(curves, k), F.get(curves, (k + 1) % 4)))
    ends = F.concat(F.transform(curves, lambda p: F.struct(p["x1"].alias("x"), p["y1"].alias("y"))), F.transform(curves, lambda p: F.struct(p["x2"].alias("x"), p["y2"].alias("y"))))
    low, high = lambda c: F.array_min(F.transform(ends, lambda p: p[c])), lambda c: F.array_max(F.transform(ends, lambda p: p[c]))
    w, h = high("x") - low("x"), high("y") - low("y")
    cx, cy, r = (low("x") + high("x")) / 2, (low("y") + high("y")) / 2, (w + h) / 4
    on = F.forall(ends, lambda p: F.abs(F.sqrt((p["x"] - cx) * (p["x"] - cx) + (p["y"] - cy) * (p["y"] - cy)) - r) <= F.greatest(F.lit(POINT), r * 0.03))
    good = (F.size(curves) == 4) & (w > POINT) & (h > POINT) & (F.abs(w - h) <= F.greatest(w, h) * 0.02)
    return F.when(good, F.when(chained & on, F.struct(cx.alias("x"), cy.alias("y"), r.alias("radius"))))


def circle(curves: Column) -> Column:
    """The radius of circle_fit."""
    return circle_fit(curves)["radius"]


def axis_rectangle(points: Column, is_closed: Column | None = None) -> Column:
    """left, top, right, bottom of a closed outline that is a rectangle along the axes, or null.

    An outline is closed if is_closed says so or if it ends where it began. Equal neighbours count once. While more than four points are left, the
    first that lies between its neighbours on a line goes; the four that remain must be the corners of their box, joined along the axes.
    """
    same = lambda p, q: (F.abs(p["x"] - q["x"]) <= POINT) & (F.abs(p["y"] - q["y"]) <= POINT)
    end = lambda a: F.try_element_at(a, F.lit(-1))
    closed = F.coalesce(same(F.get(points, 0), end(points)), F.lit(False))
    closed = closed if is_closed is None else closed | is_closed
    kept = F.aggregate(points, F.slice(points, 1, 0), lambda a, p: F.when((F.size(a) == 0) | ~same(end(a), p), F.array_append(a, p)).otherwise(a))
    kept = F.when((F.size(kept) > 1) & same(F.get(kept, 0), end(kept)), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)

    def between(a, i):
        p, q, r = F.get(a, (i + F.size(a) - 1) % F.size(a)), F.get(a, i), F.get(a, (i + 1) % F.size(a))
        ux, uy, vx, vy = q["x"] - p["x"], q["y"] - p["y"], r["x"] - q["x"], r["y"] - q["y"]
        size = F.greatest(F.lit(1.0), F.abs(ux) + F.abs(uy) + F.abs(vx) + F.abs(vy))
        return (F.abs(ux * vy - uy * vx) <= POINT * size) & (-(ux * vx + uy * vy) <= POINT)

    def fewer(a, _):
        at = F.array_position(F.transform(a, lambda p, i: between(a, i)), F.lit(True)).cast("int")
        return F.when((F.size(a) > 4) & (at > 0), F.concat(F.slice(a, 1, at - 1), F.slice(a, at + 1, F.size(a) - at))).otherwise(a)

    four = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(kept) - 4, F.lit(1))), kept, fewer)
    side = lambda a, f, c: f(F.transform(a, lambda p: p[c]))

    def boxed(a):
        left, right, top, bottom = side(a, F.array_min, "x"), side(a, F.array_max, "x"), side(a, F.array_min, "y"), side(a, F.array_max, "y")
        tol = F.greatest(F.lit(POINT), F.least(right - left, bottom - top) * 0.015)
        near = lambda v, w: F.abs(v - w) <= tol
        edge = lambda i: (near(F.get(a, i)["y"], F.get(a, (i + 1) % 4)["y"])) != (near(F.get(a, i)["x"], F.get(a, (i + 1) % 4)["x"]))
        corner = lambda p: F.when(near(p["x"], left) != near(p["x"], right), F.when(near(p["y"], top) != near(p["y"], bottom), near(p["x"], left).cast("int") * 2 + near(p["y"], top).cast("int")))
        corners = F.array_distinct(F.transform(a, corner))
        good = (F.size(a) == 4) & (right > left) & (bottom > top) & F.forall(F.sequence(F.lit(0), F.lit(3)), edge) & (F.size(corners) == 4) & F.forall(corners, lambda c: c.isNotNull())
        return F.when(good, F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))

    # transform over one value names it once, so that the fold is not written out again for each use
    return F.when(closed & (F.size(points) >= 4), F.get(F.transform(F.array(four), boxed), 0))
