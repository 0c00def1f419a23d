"""Open contours joined end to end, by list ranking instead of walks.

Two contours are joined where the ends of exactly two meet. Each contour can be passed forwards or backwards; which pass follows which is a relation
of successors, and pointer doubling ranks it: a round joins the relation with itself, so that a chain of n contours takes log n rounds, whatever
task its contours are in. The places of points come from the same sums. Only where ends lie within the tolerance without having one
key, or on a closed contour, the joins depend on the order of contours; chains that meet at such places are walked in one task each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planar.operators import graph

GROUP = ("doc_id", "group_key")
POINTS = "array<struct<x:double,y:double>>"


def _equal(p, q, tolerance: float):
    return (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance)


def normalized(contours: DataFrame, tolerance: float) -> DataFrame:
    """doc_id, group_key, ord, points and is_closed: points without equal neighbours, two at least; closed ones end where they begin."""
    end = lambda a: F.try_element_at(a, F.lit(-1))
    p = F.col("points")
    kept = F.aggregate(p, F.slice(p, 1, 0), lambda a, q: F.when((F.size(a) == 0) | ~_equal(end(a), q, tolerance), F.array_append(a, q)).otherwise(a))
    c = contours.select(*GROUP, "ord", kept.alias("points"), "is_closed").where("size(points) > 1")
    back = _equal(F.get(p, 0), end(p), tolerance)
    closed = F.col("is_closed") | ((F.size(p) > 2) & back)
    return c.select(*GROUP, "ord", F.when(closed & ~back, F.array_append(p, F.get(p, 0))).otherwise(p).alias("points"), (closed | back).alias("is_closed"))


def _ends(open_: DataFrame) -> DataFrame:
    """The two ends of each contour: side 0 is its begin."""
    p = F.col("points")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.get(p, 0).alias("p")), F.struct(F.lit(1).alias("side"), F.try_element_at(p, F.lit(-1)).alias("p")))
    return open_.select(*GROUP, "ord", "is_closed", F.explode(sides).alias("e")).select(*GROUP, "ord", "is_closed", "e.side", "e.p")


def _keyed(ends: DataFrame, tolerance: float) -> DataFrame:
    rounded = lambda c: F.rint(F.col(f"p.{c}") / tolerance).cast("long").alias(c)
    return ends.withColumn("k", F.struct(rounded("x"), rounded("y")))


def _met(ends: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Ends of open contours whose key has two: group, ord, side and the other end (to, to_side); plain where no third contour
    lies within the tolerance of either. And the third contours."""
    cell = lambda c: F.floor(F.col(f"p.{c}") / tolerance).cast("long")
    keyed = _keyed(ends, tolerance).withColumns({"cx": cell("x"), "cy": cell("y")})
    two = keyed.where("NOT is_closed").groupBy(*GROUP, "k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "side", "p", "cx", "cy")).alias("a"), F.max(F.struct("ord", "side", "p", "cx", "cy")).alias("b")).where("n = 2 AND a.ord <> b.ord")
    joints = graph.written(two.select(*GROUP, "k", "a", "b"), "joints")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
    asked = joints.unionByName(joints.select(*GROUP, "k", F.col("b").alias("a"), F.col("a").alias("b"))).select(*GROUP, "k", "a", F.col("b.ord").alias("other"), around)
    asked = asked.select(*GROUP, "k", "a", "other", (F.col("a.cx") + F.col("d.i")).alias("cx"), (F.col("a.cy") + F.col("d.j")).alias("cy"))
    third = asked.join(keyed.select(*GROUP, "cx", "cy", F.col("ord").alias("third"), F.col("p").alias("q")), [*GROUP, "cx", "cy"])
    third = graph.written(third.where(_equal(F.col("a.p"), F.col("q"), tolerance)).where("third <> a.ord AND third <> other").select(*GROUP, "k", F.col("a.ord").alias("ord"), "third").distinct(), "third-ends")
    side = lambda p, q: joints.select(*GROUP, "k", F.col(f"{p}.ord").alias("ord"), F.col(f"{p}.side").alias("side"), F.col(f"{q}.ord").alias("to"), F.col(f"{q}.side").alias("to_side"))
    both = side("a", "b").unionByName(side("b", "a"))
    return both.join(third.select(*GROUP, "k", F.lit(False).alias("plain")).distinct(), [*GROUP, "k"], "left").withColumn("plain", F.coalesce("plain", F.lit(True))), third


def _ranked(next_: DataFrame) -> DataFrame:
    """Pointer doubling over passes (group, at, to, low, weight): of each pass the last one it leads to, the sum of the weights from it on (rest) and the least
    contour from it on (low). A pass of a circle has no last one (to stays); its low is the circle's. at and to: structs (ord, back)."""
    state = graph.written(next_.select(*GROUP, "at", "to", F.col("at").alias("last"), F.col("at.ord").alias("low"), F.col("weight").alias("rest")), "passes")
    while True:
        ahead = state.select(*GROUP, F.col("at").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("low").alias("low2"), F.col("rest").alias("rest2"))
        met = state.where("to IS NOT NULL").join(ahead, [*GROUP, "to"])
        moved = met.select(*GROUP, "at", F.col("to2").alias("to"), F.col("last2").alias("last"), F.least("low", "low2").alias("low"), (F.col("rest") + F.col("rest2")).alias("rest"), ((F.col("low2") < F.col("low")) | F.col("to2").isNull()).alias("changed"))
        now = graph.written(state.where("to IS NULL").withColumn("changed", F.lit(False)).unionByName(moved), "passes")
        state = now.drop("changed")
        if now.where("changed").isEmpty():
            return state


def chains(contours: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Assembled contours, a row for each contour in them: doc_id, group_key, chain (the ord of its first contour), place, back (passed backwards), points
    (those that it adds) and first (the number of the first of them, from 0), and is_closed of the chain.

    contours: doc_id, group_key, ord (an integer, unique), points, is_closed. A chain runs in the direction of its first contour; a shared point is
    that of the contour nearer to it. Defined results: nulls in points are errors of the reader; contours of fewer than two different points go.
    """
    c = graph.written(normalized(contours, tolerance), "contours")
    met, third = _met(_ends(c), tolerance)
    met = graph.written(met, "met")
    weights = c.select(*GROUP, "ord", (F.size("points") - 1).cast("long").alias("weight"))
    # A forward pass leaves at side 1 and goes on where the other contour's end is its begin (forwards) or its end (backwards).
    follows = met.where("plain").select(*GROUP, F.struct("ord", (F.col("side") == 0).alias("back")).alias("at"), F.struct(F.col("to").alias("ord"), (F.col("to_side") == 1).alias("back")).alias("to"))
    joined = follows.select(*GROUP, "at.ord").distinct()
    passes = joined.select(*GROUP, F.explode(F.array(*[F.struct("ord", F.lit(b).alias("back")) for b in (False, True)])).alias("at")).join(follows, [*GROUP, "at"], "left")
    passes = graph.written(passes.withColumn("ord", F.col("at.ord")).join(weights, [*GROUP, "ord"]).drop("ord"), "next")
    ranked = _ranked(passes)
    # Circles are opened before their least contour, passed forwards.
    circles = ranked.where("to IS NOT NULL").select(*GROUP, "at", "low")
    cut = passes.join(circles, [*GROUP, "at"]).withColumn("to", F.when((F.col("to.ord") == F.col("low")) & ~F.col("to.back"), None).otherwise(F.col("to")))
    paths = ranked.where("to IS NULL")
    if not circles.isEmpty():
        paths = paths.unionByName(_ranked(cut).where("to IS NULL"))
    paths = graph.written(paths.select(*GROUP, "at", "last", "low", "rest"), "ranked")
    whole = paths.groupBy(*GROUP, "last").agg(F.min("low").alias("chain"), F.max("rest").alias("total"))
    seed = paths.where("NOT at.back").select(*GROUP, F.col("at.ord").alias("chain"), "last", F.col("rest").alias("seed_rest"))
    of = whole.join(seed, [*GROUP, "last", "chain"])  # of a chain's two directions the one that passes its least contour forwards
    many = paths.join(of, [*GROUP, "last"]).select(*GROUP, "chain", F.col("at.ord").alias("ord"), F.col("at.back").alias("back"), (F.col("total") - F.col("rest")).alias("first"), F.sign(F.col("seed_rest") - F.col("rest")).cast("int").alias("after"))
    alone = c.join(joined, [*GROUP, "ord"], "left_anti").select(*GROUP, F.col("ord").alias("chain"), "ord", F.lit(False).alias("back"), F.lit(0).cast("long").alias("first"), F.lit(0).alias("after"))
    plain = graph.written(many.unionByName(alone), "chains")
    rows = plain.join(c, [*GROUP, "ord"])
    unclear = met.where("NOT plain")
    if not unclear.isEmpty():
        links = third.select(*GROUP, F.col("ord").alias("a"), F.col("third").alias("b")).unionByName(unclear.select(*GROUP, F.col("ord").alias("a"), F.col("to").alias("b")))
        names = lambda x: plain.select(*GROUP, F.col("ord").alias(x), F.struct(*GROUP, "chain").alias(f"{x}c"))
        linked = links.join(names("a"), [*GROUP, "a"]).join(names("b"), [*GROUP, "b"]).select(F.col("ac").alias("a"), F.col("bc").alias("b"))
        parts = graph.written(graph.components(linked).select("id.*", F.col("component").alias("part")), "parts")
        # Ends of a key may belong to contours of other parts, so each end brings the number of ends of its key.
        counted = _keyed(_ends(c), tolerance).where("NOT is_closed").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*GROUP, "k")))
        degrees = counted.groupBy(*GROUP, "ord").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("n0"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("n1"))
        walked = rows.join(parts, [*GROUP, "chain"]).join(degrees, [*GROUP, "ord"], "left").na.fill(0, ["n0", "n1"]).select("part", *GROUP, "ord", "points", "is_closed", "n0", "n1")
        kinds = {f.name: f.dataType.simpleString() for f in walked.schema.fields}
        schema = f"doc_id {kinds['doc_id']}, group_key {kinds['group_key']}, chain {kinds['ord']}, ord {kinds['ord']}, back boolean, first long, after int"
        again = walked.groupBy("part").applyInPandas(lambda pdf: _walk(pdf, tolerance), schema)
        rest = plain.join(parts.select(*GROUP, "chain"), [*GROUP, "chain"], "left_anti")
        rows = graph.written(rest.unionByName(again), "chains").join(c, [*GROUP, "ord"])
    p = F.when(F.col("back"), F.reverse("points")).otherwise(F.col("points"))
    adds = F.when(F.col("after") > 0, F.slice(p, 2, F.size(p) - 1)).when(F.col("after") < 0, F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    first = F.col("first") + (F.col("after") > 0).cast("long")
    return rows.select(*GROUP, "chain", "ord", "back", first.alias("first"), adds.alias("points"), "is_closed")


def _walk(pdf, tolerance: float):
    """Contours of unclear neighbourhoods, joined one after the other in their order."""
    import collections

    import pandas as pd

    rows = pdf.sort_values("ord")
    points = {r.ord: [(p["x"], p["y"]) for p in r.points] for r in rows.itertuples()}
    closed = {r.ord: r.is_closed for r in rows.itertuples()}
    key = lambda p: (round(p[0] / tolerance), round(p[1] / tolerance))
    equal = lambda p, q: abs(p[0] - q[0]) <= tolerance and abs(p[1] - q[1]) <= tolerance
    degree = {key(points[r.ord][k]): n for r in rows.itertuples() if not r.is_closed for k, n in ((0, r.n0), (-1, r.n1))}
    left, out = dict.fromkeys(points), []
    while left:
        seed = next(iter(left))
        del left[seed]
        chain = collections.deque([(seed, False)])
        ends = [points[seed][0], points[seed][-1]]
        for side in (-1, 0):  # behind its end, then before its begin
            while not closed[seed] and not equal(*ends) and degree.get(key(ends[side])) == 2:
                found = [(o, hit) for o in left if any(hit := [equal(ends[side], points[o][k]) for k in (0, -1)])]
                if len(found) != 1:
                    break
                o, (at_begin, at_end) = found[0]
                back = at_end if side else at_begin
                del left[o]
                ends[side] = points[o][0 if back == bool(side) else -1]
                chain.append((o, back)) if side else chain.appendleft((o, back))
        at, first = [o for o, _ in chain].index(seed), 0
        for k, (o, back) in enumerate(chain):
            out.append((pdf.doc_id.iloc[0], pdf.group_key.iloc[0], seed, o, back, first, (k > at) - (k < at)))
            first += len(points[o]) - 1
    return pd.DataFrame(out, columns=["doc_id", "group_key", "chain", "ord", "back", "first", "after"])


def points(assembled: DataFrame) -> DataFrame:
    """The points of chains as rows: doc_id, group_key, chain, n, x, y."""
    each = assembled.select(*GROUP, "chain", "first", F.posexplode("points").alias("k", "p"))
    return each.select(*GROUP, "chain", (F.col("first") + F.col("k")).alias("n"), "p.x", "p.y")


def outlines(assembled: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """A row for each chain: contours, points and is_closed. A chain's points are one value, as an outline is."""
    per = assembled.groupBy(*GROUP, "chain").agg(F.count(F.lit(1)).alias("contours"), F.bool_or("is_closed").alias("was"), F.array_sort(F.collect_list(F.struct("first", "points"))).alias("parts"))
    out = per.withColumn("points", F.flatten("parts.points"))
    p = F.col("points")
    return out.select(*GROUP, "chain", "contours", (((F.col("contours") == 1) & F.col("was")) | ((F.size(p) > 2) & _equal(F.get(p, 0), F.try_element_at(p, F.lit(-1)), tolerance))).alias("is_closed"), "points")
