"""Registered queries on the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window  # noqa: F401
from pyspark.sql import functions as F

from planar import data
from planar.data import SQL_COMPONENTS, SQL_ELEMENTS, SQL_LAYERS, SQL_NETS, SQL_SEGMENTS, sql_words, table
from planar.functions import geometry as g
from planar.operators import classify, graph, history, inventory, quality, recognize, search, semantic, spatial, topology
from planar.registry import ORACLES, QUERIES, query
from planar.sources import boards, templates

__all__ = ["ORACLES", "QUERIES"]

BOX = "left", "top", "right", "bottom"
W6 = lambda c: F.round(c, 6)


HIT = '"left" <= 60 AND "right" >= 40 AND top <= 240 AND bottom >= 100'


@query(f"""WITH {SQL_ELEMENTS} SELECT layer_id, kind, count(*) AS n, min(element_ord) AS first_ord FROM elements WHERE {HIT} AND is_visible GROUP BY layer_id, kind""")
def q_window(spark, d):
    found = spatial.window(spatial.attribute_filter(data.elements(spark, d)), 40.0, 100.0, 60.0, 240.0)
    return found.groupBy("layer_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("element_ord").alias("first_ord"))


def sql_near(x: int, y: int, radius: float) -> str:
    away = f'sqrt(power(greatest("left" - {x}e0, 0e0, {x}e0 - "right"), 2) + power(greatest(top - {y}e0, 0e0, {y}e0 - bottom), 2))'
    return f"""near AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, element_id)::INT AS place FROM (SELECT *, {away} AS distance FROM elements) WHERE distance <= {radius})"""


@query(f"""WITH {SQL_ELEMENTS}, {sql_near(50, 100, 20)} SELECT doc_id, place, element_id, round(distance, 6) AS distance FROM near WHERE place <= 5""")
def q_near_topk(spark, d):
    return spatial.near(data.elements(spark, d), 50.0, 100.0, 20.0, 5).select("doc_id", "place", "element_id", W6("distance").alias("distance"))


@query(f"""WITH {SQL_ELEMENTS} SELECT element_id, layer_id, net_id, component_id, kind FROM elements WHERE is_visible AND layer_id IN ('view', 'error') AND net_id IN ('n1', 'n2', 'n3', 'n4', 'n5', 'n6') AND kind IN ('DrillHole', 'Pad')""")
def q_attr_filter(spark, d):
    return spatial.attribute_filter(data.elements(spark, d), layers=["view", "error"], nets=[f"n{k}" for k in range(1, 7)], kinds=["DrillHole", "Pad"]).select("element_id", "layer_id", "net_id", "component_id", "kind")


def views(spark, d):
    """A box for each customer."""
    c = table(spark, d, "customer")
    x, y = F.pmod(F.col("c_custkey") * 37, F.lit(100)).cast("double"), F.pmod(F.col("c_custkey") * 11, F.lit(300)).cast("double")
    return c.select(F.col("c_custkey").alias("query_id"), x.alias("ql"), y.alias("qt"), (x + 4.5).alias("qr"), (y + 7.25).alias("qb"))


SQL_VIEWS = "views AS (SELECT c_custkey AS query_id, ((c_custkey * 37) % 100)::DOUBLE AS ql, ((c_custkey * 11) % 300)::DOUBLE AS qt, ((c_custkey * 37) % 100)::DOUBLE + 4.5e0 AS qr, ((c_custkey * 11) % 300)::DOUBLE + 7.25e0 AS qb FROM customer)"


@query(f"""WITH {SQL_ELEMENTS}, {SQL_VIEWS} SELECT query_id, count(*) AS hits, min(element_ord) AS first_ord, max(element_ord) AS last_ord FROM views JOIN elements ON "left" <= qr AND "right" >= ql AND top <= qb AND bottom >= qt GROUP BY query_id""")
def q_grid_join(spark, d):
    pairs = spatial.grid_join(views(spark, d), data.elements(spark, d))
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("element_ord").alias("first_ord"), F.max("element_ord").alias("last_ord"))


@query(f"""WITH {SQL_ELEMENTS}, {SQL_VIEWS}, p AS (SELECT query_id, element_id, sqrt(power(greatest("left" - ql, 0e0, ql - "right"), 2) + power(greatest(top - qt, 0e0, qt - bottom), 2)) AS distance FROM views JOIN elements ON "left" <= ql + 3 AND "right" >= ql - 3 AND top <= qt + 3 AND bottom >= qt - 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, element_id) AS place FROM p WHERE distance <= 3) SELECT query_id, place::INT AS place, element_id, round(distance, 6) AS distance FROM r WHERE place <= 3""")
def q_radius_join(spark, d):
    points = views(spark, d).select("query_id", F.col("ql").alias("x"), F.col("qt").alias("y"))
    return spatial.radius_join(points, data.elements(spark, d), 3.0, 3).select("query_id", "place", "element_id", W6("distance").alias("distance"))


PADS = "kind = 'Pad'"


@query(f"""WITH {SQL_ELEMENTS}, p AS (SELECT * FROM elements WHERE {PADS}) SELECT a.element_ord, count(*) AS neighbors, min(b.element_ord) AS first_neighbor FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.element_ord <> b.element_ord AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 3.5e0 * 3.5e0 GROUP BY a.element_ord""")
def q_pad_neighbors(spark, d):
    near = spatial.pad_neighbors(data.elements(spark, d).where(PADS), F.lit(3.5), 3.5)
    return near.groupBy("element_ord").agg(F.count(F.lit(1)).alias("neighbors"), F.min("b_element_ord").alias("first_neighbor"))


@query(f"""WITH {SQL_ELEMENTS}, {sql_near(30, 60, 12.5)} SELECT doc_id, element_id, w * h AS area FROM near WHERE place <= 4""")
def q_hit_test(spark, d):
    return spatial.hit_test(data.elements(spark, d), 30.0, 60.0, 12.5, 4).select("doc_id", "element_id", (F.col("w") * F.col("h")).alias("area"))


@query(f"""WITH {SQL_ELEMENTS}, {SQL_LAYERS}, {sql_near(30, 60, 12)}, hits AS (SELECT n.*, ord FROM near n JOIN layers USING (doc_id, layer_id) WHERE place <= 32),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, ord DESC, element_ord) AS k FROM hits) SELECT doc_id, element_id, layer_id FROM best WHERE k = 1""")
def q_click_select(spark, d):
    return spatial.click_select(data.elements(spark, d), data.layers(spark, d), 30.0, 60.0, 0.5).select("doc_id", "element_id", "layer_id")


@query(f"""WITH {SQL_ELEMENTS}, {SQL_LAYERS} SELECT doc_id, ord, element_id FROM elements JOIN layers USING (doc_id, layer_id) WHERE {HIT} AND is_visible AND layer_visible""")
def q_visible_objects(spark, d):
    return spatial.visible_objects(data.elements(spark, d), data.layers(spark, d), 40.0, 100.0, 60.0, 240.0).select("doc_id", "ord", "element_id")


@query(f"""WITH {SQL_ELEMENTS}, c AS (SELECT *, unnest(range(floor("left" / 10)::BIGINT, floor("right" / 10)::BIGINT + 1)) AS x FROM elements), k AS (SELECT *, unnest(range(floor(top / 10)::BIGINT, floor(bottom / 10)::BIGINT + 1)) AS y FROM c),
i AS (SELECT doc_id, count(*) AS items FROM elements GROUP BY doc_id), o AS (SELECT doc_id, count(DISTINCT (x, y)) AS cells, count(*) AS entries FROM k GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT element_id) AS candidates, count(DISTINCT CASE WHEN {HIT} THEN element_id END) AS hits FROM k WHERE x BETWEEN 4 AND 6 AND y BETWEEN 10 AND 24 GROUP BY doc_id)
SELECT i.doc_id, items, cells, entries, coalesce(candidates, 0) AS candidates, coalesce(hits, 0) AS hits FROM i JOIN o USING (doc_id) LEFT JOIN s USING (doc_id)""")
def q_index_statistics(spark, d):
    return spatial.index_statistics(data.elements(spark, d), 40.0, 100.0, 60.0, 240.0)


def mutations(spark, d):
    e = table(spark, d, "events")
    op = data.pick(("add", "update", "remove", "update"), F.col("event_id") % 4)
    x = (F.col("event_id") % 3).cast("double")
    op = F.when(F.col("event_id") % 97 == 0, "clear").otherwise(op)
    return e.select(F.floor(F.col("user_id") / 8).alias("doc_id"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("e"), F.col("user_id"), F.lit("-"), F.col("event_id") % 5).alias("element_id"), x.alias("left"), x.alias("top"), (x + 1).alias("right"), (x + 1).alias("bottom"))


SQL_MUTATIONS = """l0 AS (SELECT user_id // 8 AS doc_id, event_id AS seq, 'e' || user_id || '-' || (event_id % 5) AS element_id,
CASE WHEN event_id % 97 = 0 THEN 'clear' ELSE ['add', 'update', 'remove', 'update'][event_id % 4 + 1] END AS op, event_id % 3 AS x FROM events),
l1 AS (SELECT doc_id, seq, element_id, op, x FROM l0 WHERE op <> 'clear' UNION ALL SELECT c.doc_id, c.seq, f.element_id, 'clear', NULL FROM l0 c
  JOIN (SELECT doc_id, element_id, min(seq) AS first FROM l0 WHERE op <> 'clear' GROUP BY doc_id, element_id) f ON f.doc_id = c.doc_id AND f.first < c.seq WHERE c.op = 'clear'),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, element_id ORDER BY seq) AS k FROM l1),
f AS (SELECT doc_id, element_id, seq, k, op, CASE WHEN op = 'add' THEN x END AS box, op = 'add' AS done FROM m WHERE k = 1
UNION ALL SELECT m.doc_id, m.element_id, m.seq, m.k, m.op, CASE WHEN m.op = 'add' THEN coalesce(f.box, m.x) WHEN m.op IN ('remove', 'clear') OR f.box IS NULL THEN NULL ELSE m.x END,
CASE WHEN m.op = 'add' THEN f.box IS NULL WHEN m.op IN ('remove', 'clear') THEN f.box IS NOT NULL ELSE f.box IS NOT NULL AND f.box <> m.x END FROM f JOIN m ON m.element_id = f.element_id AND m.doc_id = f.doc_id AND m.k = f.k + 1)"""


@query(f"""WITH RECURSIVE {SQL_MUTATIONS}, v AS (SELECT doc_id, count(*) FILTER (done AND op <> 'clear') + count(DISTINCT seq) FILTER (done AND op = 'clear') AS version FROM f GROUP BY doc_id),
z AS (SELECT doc_id, element_id, arg_max(box IS NOT NULL, k) AS there FROM f GROUP BY doc_id, element_id) SELECT doc_id, any_value(version) AS version, count(*) FILTER (there) AS items FROM z JOIN v USING (doc_id) GROUP BY doc_id""")
def q_mutation_fold(spark, d):
    return spatial.mutation_fold(mutations(spark, d))[1]


@query(f"""WITH {SQL_ELEMENTS} SELECT doc_id, net_id, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom, count(*) AS n FROM elements WHERE w > 0 AND h > 0 GROUP BY doc_id, net_id""")
def q_extent(spark, d):
    return inventory.extent(data.elements(spark, d), "doc_id", "net_id")


@query(f"""WITH {SQL_ELEMENTS} SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS {chr(34)}{k}{chr(34)}" for k in data.KINDS)} FROM elements GROUP BY doc_id""")
def q_geomdb_counts(spark, d):
    return inventory.kind_counts(inventory.geometry_database(data.elements(spark, d)))


def raw_geometry(spark, d):
    e = data.elements(spark, d)
    return e.select("element_id", "kind", F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("cx") + F.col("w")).alias("x2"), (F.col("cy") - F.col("h")).alias("y2"), "w", "h", F.col("w").alias("diameter"), F.col("w").alias("radius"), F.lit(0.25).alias("stroke"), "text")


@query(f"""WITH {SQL_ELEMENTS}, s AS (SELECT element_id, kind, CASE WHEN kind IN ('Via', 'DrillHole', 'Pad') THEN w / 2 WHEN kind = 'Arc' THEN w + 0.125e0 WHEN kind = 'Ellipse' THEN w + 0.125e0 END AS rx, CASE WHEN kind = 'Pad' THEN h / 2 WHEN kind IN ('Via', 'DrillHole') THEN w / 2 WHEN kind = 'Arc' THEN w + 0.125e0 WHEN kind = 'Ellipse' THEN h + 0.125e0 END AS ry,
cx, cy, w, h, text, kind IN ('Track', 'Line', 'Polyline', 'Bezier') AS line, kind IN ('Rectangle', 'RasterImage', 'Polygon') AS box FROM elements)
SELECT element_id, CASE WHEN line THEN cx - 0.125e0 WHEN box OR kind = 'Text' THEN cx ELSE cx - rx END AS "left", CASE WHEN line THEN cx + w + 0.125e0 WHEN box THEN cx + w WHEN kind = 'Text' THEN cx + greatest(h * 0.5e0, h * 0.6e0 * length(text)) ELSE cx + rx END AS "right",
CASE WHEN line THEN cy - h - 0.125e0 WHEN box OR kind = 'Text' THEN cy - h ELSE cy - ry END AS top, CASE WHEN line THEN cy + 0.125e0 WHEN box OR kind = 'Text' THEN cy ELSE cy + ry END AS bottom FROM s""")
def q_bounds_projection(spark, d):
    return inventory.element_bounds(raw_geometry(spark, d)).select("element_id", *BOX)


@query("""SELECT o_orderkey, round((o_orderkey % 100 + 10e0) * 2e0, 6) AS x, round((o_custkey % 50 + 20e0) * 3e0, 6) AS y, round((o_custkey % 1000)::DOUBLE / 25.4e0, 6) AS inches, round((o_orderkey % 1000) * (25.4e0 / 72e0), 6) AS mm,
round(sqrt(power(o_orderkey % 30, 2) + power(o_custkey % 40, 2)), 6) AS length, round(degrees(atan2((o_custkey % 40)::DOUBLE, (o_orderkey % 30)::DOUBLE)), 6) AS angle, (((o_orderkey % 1000 - 500) % 360) + 360) % 360::DOUBLE AS rotation FROM orders""")
def q_affine_units_measure(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = g.affine(g.append((1.0, 0.0, 0.0, 1.0, 10.0, 20.0), (2.0, 0.0, 0.0, 3.0, 0.0, 0.0)), (k % 100).cast("double"), (c % 50).cast("double"))
    zero = F.lit(0.0)
    dx, dy = (k % 30).cast("double"), (c % 40).cast("double")
    return o.select("o_orderkey", W6(x).alias("x"), W6(y).alias("y"), W6(g.converted((c % 1000).cast("double"), F.lit("Millimeter"), "Inch")).alias("inches"), W6(g.converted((k % 1000).cast("double"), F.lit("PdfPoint"), "Millimeter")).alias("mm"),
                    W6(g.distance(dx, dy, zero, zero)).alias("length"), W6(F.degrees(F.atan2(dy, dx))).alias("angle"), g.rotation((k % 1000 - 500).cast("double")).alias("rotation"))


SQL_PRIMS = f"""{SQL_ELEMENTS}, prims AS (SELECT doc_id, element_ord, element_id, layer_id, w, h, cx, cy, "left", top, "right", bottom,
  CASE WHEN kind = 'Pad' THEN 'ExplicitPad' WHEN kind = 'DrillHole' THEN 'ExplicitHole' WHEN kind = 'Rectangle' THEN CASE WHEN is_filled THEN 'FilledRectangle' ELSE 'OutlineRectangle' END
  WHEN kind = 'Ellipse' AND greatest(w, h) / least(w, h) >= 1.45e0 THEN 'Slot' WHEN kind = 'Ellipse' THEN CASE WHEN is_filled THEN 'FilledEllipse' ELSE 'OutlineEllipse' END
  WHEN kind = 'Polyline' AND is_closed THEN 'OutlineRectangle' WHEN kind = 'Polygon' THEN CASE WHEN is_filled THEN 'FilledPolygon' ELSE 'OutlinePolygon' END END AS primitive,
  CASE WHEN kind = 'Pad' THEN shape WHEN kind IN ('Rectangle', 'Polyline') THEN 'Rectangle' WHEN kind = 'Ellipse' AND greatest(w, h) / least(w, h) >= 1.45e0 THEN 'Oval' WHEN kind IN ('Ellipse', 'DrillHole') THEN 'Circle' WHEN kind = 'Polygon' THEN 'Polygon' END AS shape,
  CASE WHEN kind = 'Pad' THEN true WHEN kind IN ('DrillHole', 'Polyline') THEN false ELSE is_filled END AS is_filled FROM elements),
p0 AS (SELECT * FROM prims WHERE primitive IS NOT NULL),
dn AS (SELECT DISTINCT o.element_ord FROM p0 o JOIN p0 i ON o.doc_id = i.doc_id AND o.shape = 'Circle' AND i.shape = 'Circle' AND i.w < o.w AND i.h < o.h AND sqrt(power(i.cx - o.cx, 2) + power(i.cy - o.cy, 2)) <= greatest(o.w, o.h) * 0.08e0 AND greatest(i.w, i.h) >= greatest(o.w, o.h) * 0.2e0),
p1 AS (SELECT p0.* REPLACE (CASE WHEN dn.element_ord IS NOT NULL THEN 'Donut' ELSE primitive END AS primitive) FROM p0 LEFT JOIN dn ON p0.element_ord = dn.element_ord),
p2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, shape, w, h) AS repetition FROM p1),
al AS (SELECT a.element_ord, count(*) AS aligned FROM p2 a JOIN p2 b ON a.doc_id = b.doc_id AND a.shape = b.shape AND a.w = b.w AND a.h = b.h AND a.element_ord <> b.element_ord AND
  ((abs(a.cy - b.cy) <= greatest(least(a.w, a.h) * 0.7e0, 0.01e0) AND abs(a.cx - b.cx) <= greatest(a.w, a.h) * 18e0) OR (abs(a.cx - b.cx) <= greatest(least(a.w, a.h) * 0.7e0, 0.01e0) AND abs(a.cy - b.cy) <= greatest(a.w, a.h) * 18e0)) GROUP BY a.element_ord),
p3 AS (SELECT p2.*, coalesce(aligned, 0) AS aligned FROM p2 LEFT JOIN al ON p2.element_ord = al.element_ord),
cls AS (SELECT *, least(1e0, CASE primitive WHEN 'ExplicitPad' THEN 1e0 WHEN 'ExplicitHole' THEN 1e0 WHEN 'FilledRectangle' THEN 0.9e0 WHEN 'FilledEllipse' THEN 0.92e0 WHEN 'FilledPolygon' THEN 0.82e0 WHEN 'Donut' THEN 0.9e0 WHEN 'Slot' THEN CASE WHEN is_filled THEN 0.86e0 ELSE 0.58e0 END
  WHEN 'OutlineRectangle' THEN 0.5e0 WHEN 'OutlineEllipse' THEN 0.54e0 WHEN 'OutlinePolygon' THEN 0.45e0 ELSE 0.2e0 END + CASE WHEN repetition >= 2 THEN 0.1e0 ELSE 0e0 END + CASE WHEN repetition >= 4 THEN 0.06e0 ELSE 0e0 END + CASE WHEN aligned >= 1 THEN 0.14e0 ELSE 0e0 END + CASE WHEN aligned >= 3 THEN 0.08e0 ELSE 0e0 END) AS confidence,
  primitive = 'ExplicitPad' OR is_filled OR primitive = 'Donut' OR (repetition >= 2 AND aligned >= 1) AS conductive FROM p3)"""
SQL_LIMITS = """lim AS (SELECT doc_id, max("right") - min("left") AS doc_w, max(bottom) - min(top) AS doc_h FROM elements GROUP BY doc_id),
lims AS (SELECT *, greatest(0.04e0, least(0.35e0, greatest(1e0, least(doc_w, doc_h)) * 0.00008e0)) AS lo, least(20e0, greatest(2e0, greatest(1e0, least(doc_w, doc_h)) * 0.035e0)) AS hi FROM lim)"""
SQL_JUDGED = f"""{SQL_PRIMS}, {SQL_LIMITS}, judged AS (SELECT cls.*, lo, hi, CASE WHEN primitive = 'ExplicitHole' THEN 'UnsupportedGeometry' WHEN primitive = 'ExplicitPad' THEN 'None' WHEN w < lo OR h < lo THEN 'TooSmall' WHEN w > hi OR h > hi THEN 'TooLarge'
WHEN NOT is_filled AND primitive <> 'Donut' AND NOT (repetition >= 2 AND aligned >= 1) THEN 'OutlineWithoutPattern' WHEN confidence < CASE WHEN is_filled THEN 0.68e0 ELSE 0.6e0 END THEN 'LowConfidence' ELSE 'None' END AS reason FROM cls JOIN lims USING (doc_id))"""


@query(f"WITH {SQL_PRIMS} SELECT element_id, primitive, shape, is_filled, repetition, aligned, round(confidence, 6) AS confidence, conductive FROM cls")
def q_classify(spark, d):
    return classify.classified(data.elements(spark, d)).select("element_id", "primitive", "shape", "is_filled", "repetition", "aligned", W6("confidence").alias("confidence"), "conductive")


def judged(spark, d):
    e = data.elements(spark, d)
    limits = classify.size_limits(e)
    return e, limits, classify.candidates(classify.classified(e), limits)


@query(f"WITH {SQL_JUDGED} SELECT element_id, reason, reason = 'None' AS accepted FROM judged")
def q_pad_candidates(spark, d):
    return judged(spark, d)[2].select("element_id", "reason", (F.col("reason") == "None").alias("accepted"))


@query(f"WITH {SQL_JUDGED} SELECT doc_id, reason, count(*) AS n FROM judged GROUP BY doc_id, reason")
def q_reject_histogram(spark, d):
    return classify.rejections(judged(spark, d)[2])


SQL_PADS = f"""{SQL_JUDGED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, w * h, cy, cx, layer_id, top, "left", element_ord) AS rk FROM judged WHERE reason = 'None'),
rivals AS (SELECT a.doc_id, a.rk, list(b.rk) AS better FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND b.rk < a.rk AND sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) <= greatest(0.005e0, least(a.w, b.w) * 0.18e0)
  AND (least(a.w, b.w) / greatest(a.w, b.w)) * (least(a.h, b.h) / greatest(a.h, b.h)) >= 0.78e0 GROUP BY a.doc_id, a.rk),
total AS (SELECT doc_id, max(rk) AS n FROM ranked GROUP BY doc_id),
steps AS (SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM total UNION ALL SELECT s.doc_id, s.k + 1, CASE WHEN r.better IS NOT NULL AND list_has_any(s.kept, r.better) THEN s.kept ELSE list_append(s.kept, s.k + 1) END
  FROM steps s JOIN total t ON t.doc_id = s.doc_id AND s.k < t.n LEFT JOIN rivals r ON r.doc_id = s.doc_id AND r.rk = s.k + 1),
kept AS (SELECT doc_id, unnest(l) AS rk FROM (SELECT doc_id, arg_max(kept, k) AS l FROM steps GROUP BY doc_id)),
pads AS (SELECT ranked.*, (row_number() OVER (PARTITION BY doc_id ORDER BY cy, cx, element_ord))::INT AS pad_no FROM ranked JOIN kept USING (doc_id, rk)),
circles AS (SELECT *, greatest(w, h) AS size, (row_number() OVER (PARTITION BY doc_id ORDER BY greatest(w, h), pad_no))::INT AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM pads WHERE shape = 'Circle'),
cuts AS (SELECT *, greatest(max(w) FILTER (rn = 1) OVER (PARTITION BY doc_id), max(size) FILTER (rn = n // 3 + 1) OVER (PARTITION BY doc_id)) AS cut FROM circles WHERE n >= 3),
vias AS (SELECT doc_id, element_ord, element_id, rn AS via_no, size AS diameter, least(0.92e0, confidence) AS confidence FROM cuts WHERE size <= cut * 1.08e0),
holes AS (SELECT doc_id, element_ord, element_id, w AS diameter, 1e0 AS confidence FROM elements WHERE kind = 'DrillHole' UNION ALL SELECT e.doc_id, e.element_ord, e.element_id, greatest(e.w, e.h), 0.74e0 FROM elements e JOIN lims USING (doc_id)
  WHERE kind = 'Ellipse' AND NOT is_filled AND e.element_ord NOT IN (SELECT element_ord FROM pads) AND greatest(e.w, e.h) / least(e.w, e.h) <= 1.15e0 AND greatest(e.w, e.h) BETWEEN lo AND hi * 2)"""
SQL_MEANING = f"""{SQL_PADS}, {SQL_LAYERS}, m AS (SELECT e.*, e.element_ord IN (SELECT element_ord FROM holes) OR kind = 'DrillHole' AS is_hole, e.element_ord IN (SELECT element_ord FROM vias) OR kind = 'Via' AS is_via, e.element_ord IN (SELECT element_ord FROM pads) OR kind = 'Pad' AS is_pad,
  c.conductive, c.confidence AS pc, layer_type, e.w * e.h / greatest(0.000001e0, doc_w * doc_h) AS share FROM elements e LEFT JOIN cls c ON c.element_ord = e.element_ord LEFT JOIN layers y ON y.layer_id = e.layer_id AND y.doc_id = e.doc_id JOIN lims ON lims.doc_id = e.doc_id),
t AS (SELECT *, CASE WHEN is_hole THEN 1 WHEN is_via THEN 2 WHEN is_pad THEN 3 WHEN kind = 'Text' THEN 4 WHEN layer_type IN ('Copper', 'Silkscreen', 'Mechanical') THEN 5 WHEN is_closed AND share >= 0.35e0 THEN 6 WHEN kind = 'Track' THEN 7 WHEN conductive AND greatest(w, h) <= 20 THEN 8
  WHEN is_closed AND share >= 0.00008e0 AND kind IN ('Rectangle', 'Polygon', 'Polyline') THEN 9 WHEN kind IN ('Line', 'Polyline', 'Bezier', 'Arc') THEN 10 WHEN kind = 'RasterImage' THEN 11 ELSE 12 END AS k FROM m)"""


def pads(spark, d):
    e, limits, j = judged(spark, d)
    return e, limits, j, graph.written(classify.distinct_pads(j.where("reason = 'None'")), "pads")


@query(f"WITH RECURSIVE {SQL_PADS} SELECT doc_id, element_id, pad_no, round(confidence, 6) AS confidence FROM pads")
def q_distinct_pads(spark, d):
    """Greedy; the SQL goes through the pads of a document one by one."""
    return pads(spark, d)[3].select("doc_id", "element_id", "pad_no", W6("confidence").alias("confidence"))


@query(f"WITH RECURSIVE {SQL_PADS} SELECT doc_id, element_id, via_no, diameter, round(confidence, 6) AS confidence FROM vias")
def q_vias(spark, d):
    return classify.vias(pads(spark, d)[3]).select("doc_id", "element_id", "via_no", "diameter", W6("confidence").alias("confidence"))


@query(f"WITH RECURSIVE {SQL_PADS} SELECT doc_id, element_id, diameter, confidence FROM holes")
def q_holes(spark, d):
    e, limits, _, p = pads(spark, d)
    return classify.holes(e, p, limits).select("doc_id", "element_id", "diameter", "confidence")


@query(f"""WITH RECURSIVE {SQL_MEANING} SELECT doc_id, element_id, kind, CASE WHEN k = 5 THEN layer_type ELSE ['Hole', 'Via', 'Pad', 'Text', '', 'BoardOutline', 'Copper', 'Pad', 'ComponentBody', 'Silkscreen', 'Mechanical', 'Unknown'][k] END AS semantic,
round(CASE WHEN k = 8 THEN greatest(0.55e0, pc) ELSE [1e0, 0.98e0, 0.98e0, 1e0, 0.92e0, 0.9e0, 0.95e0, 0e0, 0.68e0, 0.52e0, 0.4e0, 0.2e0][k] END, 6) AS confidence,
CASE WHEN k = 5 THEN 'Layer:' || layer_type ELSE ['ExplicitOrRecognizedHole', 'ExplicitOrRecognizedVia', 'ExplicitOrRecognizedPad', 'TextPrimitive', '', 'ClosedLargeDocumentBoundary', 'ExplicitTrack', 'ConductiveGeometryCandidate', 'ClosedMediumScaleBody', 'DocumentStroke', 'RasterReference', 'InsufficientEvidence'][k] END AS rule FROM t""")
def q_semantic(spark, d):
    e, limits, j, p = pads(spark, d)
    return semantic.semantics(e, data.layers(spark, d), p, classify.vias(p), classify.holes(e, p, limits), j).select("doc_id", "element_id", "kind", "semantic", W6("confidence").alias("confidence"), "rule")


@query(f"""WITH RECURSIVE {SQL_ELEMENTS}, p AS (SELECT *, greatest(w, h) AS size FROM elements WHERE {PADS}), r AS (SELECT doc_id, least(3.5e0, greatest(median(size) * 4.5e0, median(size) * 1.5e0)) AS radius FROM p GROUP BY doc_id),
l AS (SELECT a.element_ord AS a, b.element_ord AS b FROM p a JOIN r USING (doc_id) JOIN p b ON a.doc_id = b.doc_id AND a.element_ord <> b.element_ord AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= radius * radius AND greatest(a.size, b.size) / least(a.size, b.size) <= 2.75e0),
t AS (SELECT a, a AS b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a), c AS (SELECT a AS element_ord, min(b) AS cluster FROM t GROUP BY a) SELECT element_ord, cluster, count(*) OVER (PARTITION BY cluster) AS members FROM c""")
def q_clusters(spark, d):
    return recognize.clustered(data.elements(spark, d).where(PADS)).select("element_ord", "cluster", "members")


def solved(spark, d):
    return graph.written(recognize.metrics(recognize.clustered(pads(spark, d)[3])), "clusters")


SQL_SOLVED = f"""{SQL_PADS}, cp AS (SELECT *, greatest(w, h) AS size FROM pads),
cr AS (SELECT doc_id, least(3.5e0, greatest(m * 4.5e0, m * 1.5e0)) AS radius FROM (SELECT doc_id, coalesce(median(size) FILTER (size > 0), 0.1e0) AS m FROM cp GROUP BY doc_id)),
cl AS (SELECT a.element_ord AS a, b.element_ord AS b FROM cp a JOIN cr USING (doc_id) JOIN cp b ON a.doc_id = b.doc_id AND a.element_ord <> b.element_ord
  AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= radius * radius AND greatest(a.size, b.size) / least(a.size, b.size) <= 2.75e0),
ct AS (SELECT a, a AS b FROM cl UNION SELECT ct.a, cl.b FROM ct JOIN cl ON ct.b = cl.a), cc AS (SELECT a AS element_ord, min(b) AS cluster FROM ct GROUP BY a),
cm AS (SELECT cp.*, cluster FROM cp JOIN cc USING (element_ord)),
per AS (SELECT doc_id, cluster, count(*)::INT AS pads, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom, coalesce(median(size) FILTER (size > 0), 0.1e0) AS med, list(cx ORDER BY cx) AS vx, list(cy ORDER BY cy) AS vy,
  min((cy, cx, element_ord)) AS first FROM cm GROUP BY doc_id, cluster),
tol AS (SELECT *, greatest(med * 0.75e0, 0.03e0) AS tolerance, (row_number() OVER (PARTITION BY doc_id ORDER BY first))::INT AS number FROM per),
bb AS (SELECT cluster, axis, v, tolerance, 1::BIGINT AS k, v[1] AS s, 1::BIGINT AS n, []::DOUBLE[] AS means FROM (SELECT cluster, 'x' AS axis, vx AS v, tolerance FROM tol UNION ALL SELECT cluster, 'y', vy, tolerance FROM tol)
  UNION ALL SELECT cluster, axis, v, tolerance, k + 1, CASE WHEN abs(v[k + 1] - s / n) <= tolerance THEN s + v[k + 1] ELSE v[k + 1] END, CASE WHEN abs(v[k + 1] - s / n) <= tolerance THEN n + 1 ELSE 1 END,
  CASE WHEN abs(v[k + 1] - s / n) <= tolerance THEN means ELSE list_append(means, s / n) END FROM bb WHERE k < len(v)),
bands AS (SELECT cluster, axis, list_append(means, s / n) AS m FROM bb WHERE k = len(v)),
gaps AS (SELECT cluster, axis, len(m)::INT AS n, list_filter(list_transform(range(1, len(m)), lambda i: m[i + 1] - m[i]), lambda x: x > 0) AS l FROM bands),
pitches AS (SELECT cluster, axis, n, CASE WHEN n < 2 THEN 0e0 WHEN len(l) = 0 THEN 0.1e0 ELSE list_aggregate(l, 'median') END AS pitch FROM gaps),
mirror AS (SELECT p.cluster, count(*) AS n FROM cm p JOIN tol USING (cluster) WHERE EXISTS (FROM cm q WHERE q.cluster = p.cluster AND abs(q.cx - (tol."left" + tol."right" - p.cx)) <= tolerance AND abs(q.cy - (tol.top + tol.bottom - p.cy)) <= tolerance) GROUP BY p.cluster),
solved AS (SELECT tol.*, y.n AS rows, x.n AS columns, x.pitch AS pitch_x, y.pitch AS pitch_y, coalesce(mirror.n, 0) / pads AS symmetry, CASE WHEN "right" - "left" >= bottom - top THEN 0e0 ELSE 90e0 END AS rotation,
  0.55e0 + least(1e0, greatest(0e0, pads * med * med / greatest(("right" - "left") * (bottom - top), 0.000001e0))) * 0.4e0 AS cluster_confidence
  FROM tol JOIN pitches x ON x.cluster = tol.cluster AND x.axis = 'x' JOIN pitches y ON y.cluster = tol.cluster AND y.axis = 'y' LEFT JOIN mirror ON mirror.cluster = tol.cluster)"""


@query(f"""WITH RECURSIVE {SQL_SOLVED} SELECT doc_id, number, pads, rows, columns, round(pitch_x, 6) AS pitch_x, round(pitch_y, 6) AS pitch_y, round(symmetry, 6) AS symmetry, rotation, round(cluster_confidence, 6) AS confidence FROM solved""")
def q_cluster_metrics(spark, d):
    return solved(spark, d).select("doc_id", "number", "pads", "rows", "columns", W6("pitch_x").alias("pitch_x"), W6("pitch_y").alias("pitch_y"), W6("symmetry").alias("symmetry"), "rotation", W6("cluster_confidence").alias("confidence"))


def sql_value(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{float(v)}e0"


def sql_range(value: str, name: str) -> str:
    """1 within the template's range, less by how far it lies outside."""
    low, high = f"min_{name}", f"max_{name}"
    off = f"CASE WHEN {value} < {low} THEN {low} - {value} ELSE {value} - {high} END"
    return f"CASE WHEN {value} BETWEEN {low} AND {high} THEN 1e0 ELSE greatest(0e0, least(1e0, 1e0 - ({off}) / greatest({high} - {low}, greatest(abs({high}), 1e0)))) END"


SQL_FOUND = f"""{SQL_SOLVED}, templates({", ".join(templates.FIELDS)}) AS (VALUES {", ".join("(" + ", ".join(map(sql_value, row)) + ")" for row in templates.ROWS)}),
shape AS (SELECT *, pads / greatest(1, rows * columns) AS occupancy, CASE WHEN pitch_x > 0 AND pitch_y > 0 THEN (pitch_x + pitch_y) / 2 ELSE greatest(pitch_x, pitch_y) END AS pitch, least(rows, columns) / greatest(rows, columns) AS side,
  greatest("right" - "left", bottom - top) / greatest(0.000001e0, least("right" - "left", bottom - top)) AS aspect FROM solved),
factors AS (SELECT shape.*, templates.*, {sql_range("pads", "pads")} AS f1, {sql_range("rows", "rows")} AS f2, {sql_range("columns", "columns")} AS f3,
  CASE WHEN pitch <= 0 AND min_pitch > 0 THEN 0e0 ELSE {sql_range("pitch", "pitch")} END AS f4, {sql_range("occupancy", "occupancy")} AS f5, CASE WHEN min_symmetry <= 0 THEN 1e0 ELSE greatest(0e0, least(1e0, symmetry / min_symmetry)) END AS f6,
  {sql_range("aspect", "aspect")} AS f7, CASE WHEN two_rows AND rows <> 2 AND columns <> 2 THEN 0e0 WHEN square AND (side < 0.7e0 OR occupancy < 0.5e0) THEN 0e0 WHEN four_sides AND (rows < 3 OR columns < 3) THEN 0e0
  WHEN four_sides AND occupancy > 0.72e0 AND family <> 'Qfn' THEN 0.35e0 ELSE 1e0 END AS f8 FROM shape, templates),
scored AS (SELECT *, greatest(0e0, least(1e0, ({" + ".join(f"f{k} * {w}e0" for k, (_, w) in enumerate(recognize.WEIGHTS, 1))}) / {sum(w for _, w in recognize.WEIGHTS)}e0)) AS score FROM factors),
best AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, priority DESC, name) AS place, score >= acceptance AND f1 > 0 AND f8 > 0 AS accepted FROM scored),
found AS (SELECT * EXCLUDE (name), CASE WHEN NOT accepted THEN 'UNRESOLVED-' || pads WHEN family = 'Chip2' THEN 'CHIP-2' ELSE CASE family WHEN 'Soic' THEN 'SOIC' WHEN 'Tssop' THEN 'TSSOP' WHEN 'Qfn' THEN 'QFN' WHEN 'Qfp' THEN 'QFP' WHEN 'Bga' THEN 'BGA'
  WHEN 'Ffc' THEN 'FFC' WHEN 'SingleRowConnector' THEN 'CONN' WHEN 'DualRowConnector' THEN 'DUAL' ELSE 'ARRAY' END || '-' || pads END AS name, greatest(0e0, least(1e0, (cluster_confidence + score) / 2)) AS confidence FROM best WHERE place = 1)"""


@query(f"WITH RECURSIVE {SQL_FOUND} SELECT doc_id, number, family, name, accepted, round(score, 6) AS score, round(confidence, 6) AS confidence FROM found")
def q_template_match(spark, d):
    return recognize.footprints(solved(spark, d)).select("doc_id", "number", "family", "name", "accepted", W6("score").alias("score"), W6("confidence").alias("confidence"))


@query(rf"""WITH RECURSIVE {SQL_FOUND}, numbered AS (SELECT *, ("left" + "right") / 2 AS x, (top + bottom) / 2 AS y, (row_number() OVER (PARTITION BY doc_id ORDER BY top, "left", number))::INT AS component_no FROM found),
texts AS (SELECT doc_id, element_ord AS text_ord, trim(text) AS said, ("left" + "right") / 2 AS tx, (top + bottom) / 2 AS ty FROM elements WHERE kind = 'Text' AND regexp_matches(trim(text), '(?i)^(?:R|C|L|D|Q|U|IC|J|P|CN|TP|XW|PP|F|Y|K|M)[0-9]+[A-Z0-9_-]*$')),
near AS (SELECT n.doc_id, component_no, text_ord, said, sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)) AS distance, greatest("right" - "left", bottom - top) * 2.5e0 + 2 AS reach FROM numbered n JOIN texts t ON t.doc_id = n.doc_id),
options AS (SELECT doc_id, component_no, list(text_ord ORDER BY distance, text_ord) AS l FROM near WHERE distance <= reach GROUP BY doc_id, component_no), last AS (SELECT doc_id, max(component_no) AS n FROM numbered GROUP BY doc_id),
walk AS (SELECT doc_id, 0 AS k, []::BIGINT[] AS used, NULL::BIGINT AS own FROM last UNION ALL SELECT w.doc_id, w.k + 1, CASE WHEN len(free) > 0 THEN list_append(w.used, free[1]) ELSE w.used END, free[1]
  FROM (SELECT w0.*, list_filter(coalesce(o.l, []), lambda t: NOT list_contains(w0.used, t)) AS free FROM walk w0 JOIN last ON last.doc_id = w0.doc_id AND w0.k < last.n LEFT JOIN options o ON o.doc_id = w0.doc_id AND o.component_no = w0.k + 1) w),
given AS (SELECT w.doc_id, w.k AS component_no, said AS given FROM walk w JOIN texts t ON t.doc_id = w.doc_id AND t.text_ord = w.own)
SELECT n.doc_id, printf('component-%04d', component_no) AS component_id, coalesce(given, printf('X%04d', component_no)) AS reference, name, pads, rotation, round(CASE WHEN given IS NULL THEN confidence * 0.8e0 ELSE least(1e0, confidence + 0.08e0) END, 6) AS confidence FROM numbered n LEFT JOIN given USING (doc_id, component_no)""")
def q_components(spark, d):
    return recognize.components(recognize.footprints(solved(spark, d)), data.elements(spark, d).where("kind = 'Text'")).withColumn("confidence", W6("confidence"))


@query()
def q_low_level_footprints(spark, d):
    _, limits, _, p = pads(spark, d)
    rest = p.join(classify.vias(p).select("doc_id", "element_ord"), ["doc_id", "element_ord"], "left_anti")
    return recognize.low_level_footprints(rest, limits).select("doc_id", "footprint_no", "class", "pads", W6("rotation").alias("rotation"), W6("confidence").alias("confidence"))


@query(f"""WITH {SQL_ELEMENTS}, {SQL_LAYERS}, {SQL_NETS}, {SQL_COMPONENTS} SELECT 'Component' AS entity, component_id AS id, trim(reference || ' ' || value) AS label, 100 AS score FROM components WHERE contains(upper(reference), 'E1') OR contains(upper(value), 'E1')
UNION ALL SELECT 'Net', net_id, name, 90 FROM nets WHERE contains(upper(name), 'E1') UNION ALL SELECT 'Layer', layer_id, layer_id, 80 FROM layers WHERE contains(upper(layer_id), 'E1')
UNION ALL SELECT 'Element', element_id, element_id, CASE WHEN "left" <= 50 AND "right" >= 50 AND top <= 100 AND bottom >= 100 THEN 110 ELSE 70 END FROM elements WHERE contains(upper(element_id), 'E1') OR ("left" <= 50 AND "right" >= 50 AND top <= 100 AND bottom >= 100)""")
def q_keyword_search(spark, d):
    return search.keyword(data.components(spark, d), data.nets(spark, d), data.layers(spark, d), data.elements(spark, d), "e1", at=(50.0, 100.0))


@query(f"""WITH {sql_words()}, f AS (SELECT file, page, count(*) AS n FROM words WHERE contains(upper(text), 'TION') GROUP BY file, page) SELECT file, sum(n)::BIGINT AS occurrences, count(*) AS pages, array_to_string(list_sort(list(page))[1:8], ',') AS first_pages FROM f GROUP BY file""")
def q_substring_search(spark, d):
    return search.substring(data.words(spark, d), "tion").withColumn("first_pages", F.array_join("first_pages", ","))


#: Words that are put together to one reference.
TOGETHER = (1, 2, 3, 5, 8)


def wanted(spark, d):
    """References to look for: the items' words, and some neighbouring words put together, which only joined fragments can give."""
    w = table(spark, d, "benchmark").select(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w")).where("w IS NOT NULL")
    put = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(k)), ""))
    each = [put(k) for k in TOGETHER]
    return w.select(F.explode(F.concat(*each)).alias("query")).distinct()


SQL_NORM = r"upper(regexp_replace(trim({0}), '[^\p{{L}}\p{{Nd}}_]', '', 'g'))"
SQL_WANTED = rf"""bw AS (SELECT regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
wanted AS (SELECT query, q, regexp_replace(q, '_E$', '') AS k FROM (SELECT query, {SQL_NORM.format("query")} AS q FROM (SELECT DISTINCT unnest({" || ".join(f"list_transform(range(1, greatest(len(w) - {k} + 2, 2)), lambda i: array_to_string(w[i:i + {k - 1}], ''))" for k in TOGETHER)}) AS query FROM bw)) WHERE q <> ''),
starts AS (SELECT DISTINCT query, q, k, unnest(list_transform(range(1, length(q) + 1), lambda i: q[1:i]) || [k || '_E']) AS two FROM wanted)"""


def sql_references(role: str, name: str) -> str:
    """Words by themselves; runs of each size whose first two fragments begin or are a reference, whose fragments are tied and of which all that
    begins them begins it. Then from the left."""
    text = lambda k: "norm" + "".join(f" || n{j}" for j in range(1, k))
    tied = lambda k: "".join(f" AND j{j}" for j in range(2, k))
    begins = lambda k: "".join(f" AND starts_with(q, {text(j)})" for j in range(2, k))
    runs = " UNION ALL ".join(f"SELECT file, page, query, pos, {k} AS size FROM {name}_c WHERE regexp_replace({text(k)}, '_E$', '') = k{tied(k)}{begins(k)}" for k in range(2, 9))
    leads = ", ".join(f"lead(norm, {k}) OVER w AS n{k}, coalesce(lead(joined, {k}) OVER w, false) AS j{k}" for k in range(1, 8))
    return rf"""{sql_words(role, name)}, {name}_j AS (SELECT file, page, row_number() OVER w AS pos, {SQL_NORM.format("text")} AS norm,
coalesce(abs(bottom - lag(bottom) OVER w) <= 6.5e0 AND "left" - lag("left" + width) OVER w BETWEEN -3.5e0 AND 17.5e0, false) AS joined FROM {name} WINDOW w AS (PARTITION BY file, page ORDER BY n)),
{name}_l AS (SELECT file, page, pos, norm, {leads} FROM {name}_j WINDOW w AS (PARTITION BY file, page ORDER BY pos)),
{name}_c AS (SELECT l.*, query, q, k FROM (SELECT * FROM {name}_l WHERE norm <> '' AND j1) l JOIN starts ON two = norm || n1),
{name}_a AS (SELECT file, page, query, pos, 1 AS size FROM (SELECT *, regexp_replace(norm, '_E$', '') AS bare FROM {name}_l WHERE norm <> '') JOIN wanted ON bare = k UNION ALL {runs}),
{name}_h AS (SELECT file, page, query, pos, min(size) AS size, row_number() OVER (PARTITION BY file, page, query ORDER BY pos) AS i FROM {name}_a GROUP BY file, page, query, pos),
{name}_g AS (SELECT file, page, query, i, pos + size AS free, 1::BIGINT AS n FROM {name}_h WHERE i = 1 UNION ALL
  SELECT g.file, g.page, g.query, h.i, CASE WHEN h.pos >= g.free THEN h.pos + h.size ELSE g.free END, g.n + (h.pos >= g.free)::BIGINT FROM {name}_g g JOIN {name}_h h ON h.file = g.file AND h.page = g.page AND h.query = g.query AND h.i = g.i + 1),
{name}_r AS (SELECT file, page, query, max(n) AS occurrences FROM {name}_g GROUP BY ALL)"""


@query(f"WITH RECURSIVE {SQL_WANTED}, {sql_references('board', 'words')} SELECT * FROM words_r")
def q_reference_search(spark, d):
    return search.references(data.words(spark, d), wanted(spark, d))


@query(f"""WITH RECURSIVE {SQL_WANTED}, {sql_references('board', 'b')}, {sql_references('schematic', 's')}, x AS (SELECT query, sum(occurrences)::BIGINT AS n, min(page) AS p FROM b_r GROUP BY query),
y AS (SELECT query, sum(occurrences)::BIGINT AS n, min(page) AS p FROM s_r GROUP BY query)
SELECT query, coalesce(x.n, 0) AS board_occurrences, coalesce(x.p, 0) AS board_page, coalesce(y.n, 0) AS schematic_occurrences, coalesce(y.p, 0) AS schematic_page,
CASE WHEN x.n IS NOT NULL AND y.n IS NOT NULL THEN 'both' WHEN x.n IS NOT NULL THEN 'board' WHEN y.n IS NOT NULL THEN 'schematic' ELSE 'none' END AS status FROM (SELECT query FROM wanted UNION SELECT 'nowhere-' || i_id FROM (SELECT item_id AS i_id FROM benchmark)) LEFT JOIN x USING (query) LEFT JOIN y USING (query)""")
def q_cross_probe(spark, d):
    """Both roles in one search; a name for each item that is nowhere."""
    q = wanted(spark, d).where(g.reference(F.col("query")) != "").unionByName(table(spark, d, "benchmark").select(F.concat(F.lit("nowhere-"), "item_id").alias("query")))
    words = data.words(spark, d).withColumn("role", F.lit("board")).unionByName(data.words(spark, d, "schematic").withColumn("role", F.lit("schematic")))
    return search.cross_probe(search.references(words, q, by=("role", "file", "page")), q)


SQL_ISSUES = f"""{SQL_ELEMENTS}, {SQL_LAYERS}, {SQL_NETS}, docs AS (SELECT DISTINCT user_id // 8 AS doc_id FROM events),
pages AS (SELECT doc_id, unnest([1, 2]) AS number FROM docs), on_pages AS (SELECT doc_id, number, unnest([{", ".join(f"'{k}'" for k in data.LAYERS)}]) AS layer_id, unnest(range({len(data.LAYERS)})) AS "at" FROM pages),
members AS (SELECT doc_id, component_id, min(element_ord) AS ord, count(*) AS n FROM elements WHERE component_id IS NOT NULL GROUP BY doc_id, component_id),
issues AS (SELECT doc_id, 'Error' AS severity, 'CORE001' AS code, NULL::VARCHAR AS subject, 0 AS part, 0::BIGINT AS row, 0 AS rule, 0::BIGINT AS "at" FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM layers)
UNION ALL SELECT doc_id, 'Error', 'CORE006', number::VARCHAR, 1, number, 0, 0 FROM pages WHERE number = 2 AND doc_id % 3 = 0
UNION ALL SELECT doc_id, 'Error', 'CORE007', number::VARCHAR, 1, number, 1, "at" FROM on_pages p WHERE NOT EXISTS (FROM layers l WHERE l.doc_id = p.doc_id AND l.layer_id = p.layer_id)
UNION ALL SELECT doc_id, 'Warning', 'CORE002', element_id, 2, element_ord, 0, 0 FROM elements WHERE w <= 0 OR h <= 0
UNION ALL SELECT doc_id, 'Error', 'CORE003', element_id, 2, element_ord, 1, 0 FROM elements e WHERE NOT EXISTS (FROM layers l WHERE l.doc_id = e.doc_id AND l.layer_id = e.layer_id)
UNION ALL SELECT doc_id, 'Error', 'CORE004', element_id, 2, element_ord, 2, 0 FROM elements e WHERE net_id IS NOT NULL AND NOT EXISTS (FROM nets n WHERE n.doc_id = e.doc_id AND n.net_id = e.net_id)
UNION ALL SELECT doc_id, 'Error', 'CORE005', component_id, 3, ord, 0, n FROM members WHERE ord % 3 = 0)"""


@query(f"""WITH {SQL_ISSUES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, row, rule, "at", subject))::INT AS issue_ord, severity, code, subject FROM issues""")
def q_validate(spark, d):
    return quality.validate(data.documents(spark, d), data.elements(spark, d), data.layers(spark, d), data.nets(spark, d), data.members(spark, d), data.pages(spark, d))


@query(f"""WITH {SQL_ISSUES} SELECT doc_id, bool_and(severity <> 'Error') AS valid, count(*) AS issues FROM issues GROUP BY doc_id""")
def q_validity(spark, d):
    return quality.is_valid(quality.validate(data.documents(spark, d), data.elements(spark, d), data.layers(spark, d), data.nets(spark, d), data.members(spark, d), data.pages(spark, d)))


@query(f"""WITH {SQL_ELEMENTS}, {SQL_NETS}, asked AS (SELECT DISTINCT doc_id, lower(name) AS query FROM nets UNION SELECT doc_id, upper(net_id) FROM nets UNION SELECT doc_id, 'nothing' FROM nets),
m AS (SELECT a.doc_id, query, count(DISTINCT net_id) AS matches, min(net_id) AS net_id, min(name) AS name FROM asked a LEFT JOIN nets n ON n.doc_id = a.doc_id AND (lower(n.name) = lower(query) OR lower(n.net_id) = lower(query)) GROUP BY a.doc_id, query),
t AS (SELECT doc_id, net_id, count(*) AS elements, min("left") AS l, min(top) AS t, max("right") AS r, max(bottom) AS b FROM elements WHERE net_id IS NOT NULL GROUP BY doc_id, net_id)
SELECT m.doc_id, query, matches, CASE WHEN matches = 1 THEN m.net_id END AS net_id, CASE WHEN matches = 1 THEN name END AS name, CASE WHEN matches = 1 THEN coalesce(elements, 0) END AS elements, l AS "left", t AS top, r AS "right", b AS bottom
FROM m LEFT JOIN t ON matches = 1 AND t.doc_id = m.doc_id AND t.net_id = m.net_id""")
def q_net_trace(spark, d):
    nets = data.nets(spark, d)
    asked = nets.select("doc_id", F.lower("name").alias("query")).union(nets.select("doc_id", F.upper("net_id"))).union(nets.select("doc_id", F.lit("nothing")))
    return quality.net_trace(data.elements(spark, d), nets, asked)


@query("""SELECT o_custkey AS doc_id, o_orderkey AS number, coalesce(sum((o_orderkey % 7) * 50e0 + 10e0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS offset_y, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 10 + 1)::INT AS first_layer_order FROM orders""")
def q_page_offsets(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("number"), ((F.col("o_orderkey") % 7) * 50.0).alias("height"))
    return history.page_offsets(p).select("doc_id", "number", "offset_y", "first_layer_order")


@query(f"""WITH {SQL_SEGMENTS}, e AS (SELECT doc_id, group_key, x1, y1, x2, y2, arg_min(segment_id, seg_ord) AS s FROM segments GROUP BY ALL)
SELECT b.doc_id, b.group_key, b.x1::BIGINT AS x, b.y1::BIGINT AS y FROM e b JOIN e l ON l.doc_id = b.doc_id AND l.group_key = b.group_key AND l.x1 = b.x1 AND l.y1 = b.y1 AND l.x2 = l.x1 AND b.y2 = b.y1
JOIN e t ON t.doc_id = b.doc_id AND t.group_key = b.group_key AND t.x1 = b.x1 AND t.y1 = b.y1 + 1 AND t.y2 = t.y1 JOIN e r ON r.doc_id = b.doc_id AND r.group_key = b.group_key AND r.x1 = b.x1 + 1 AND r.y1 = b.y1 AND r.x2 = r.x1""")
def q_rect_cycles(spark, d):
    """On this lattice of unit edges the rectangles are its unit squares."""
    r = topology.rectangles(topology.all_edges(data.segments(spark, d))[1])
    low = lambda c: F.round(F.least(*[F.col(f"{p}.{c}") for p in "abcd"])).cast("long").alias(c)
    return r.select("doc_id", "group_key", low("x"), low("y"))


@query(f"""WITH RECURSIVE {SQL_SEGMENTS}, {data.sql_kernel("segments")},
done AS (SELECT doc_id, group_key, count(*) AS rectangles FROM k_kept GROUP BY ALL), total AS (SELECT doc_id, group_key, count(*) AS segments FROM segments GROUP BY ALL)
SELECT t.doc_id, t.group_key, segments - 4 * coalesce(rectangles, 0) AS remaining, coalesce(rectangles, 0) AS rectangles FROM total t LEFT JOIN done USING (doc_id, group_key) WHERE segments > 4 * coalesce(rectangles, 0)""")
def q_topology_kernel(spark, d):
    kept, rest = topology.kernel(data.segments(spark, d))
    left = rest.groupBy("doc_id", "group_key").agg(F.count(F.lit(1)).alias("remaining"))
    return left.join(kept.groupBy("doc_id", "group_key").agg(F.count(F.lit(1)).alias("rectangles")), ["doc_id", "group_key"], "left").na.fill(0, ["rectangles"])


@query(f"""WITH RECURSIVE {data.SQL_STROKES}, {data.sql_kernel("strokes")}, g AS (SELECT doc_id, group_key, min(seg_ord) AS o FROM strokes GROUP BY ALL), c AS (SELECT doc_id, group_key, count(*) AS n FROM k_kept GROUP BY ALL),
f AS (SELECT doc_id, group_key, sum(n) OVER (PARTITION BY doc_id ORDER BY o) - n AS before FROM g JOIN c USING (doc_id, group_key))
SELECT doc_id, group_key, (before + place)::BIGINT AS rectangle_no, 's' || ab || ',s' || bc || ',s' || cd || ',s' || da AS edges, axis_aligned FROM k_kept JOIN f USING (doc_id, group_key)""")
def q_kernel_rectangles(spark, d):
    """Rectangles of the strokes, in the order in which they are met."""
    k = topology.Kernel(data.strokes(spark, d))
    return k.numbered().select("doc_id", "group_key", "rectangle_no", F.array_join("edge_ids", ",").alias("edges"), "axis_aligned")


_counted = lambda name, alias: f"(SELECT doc_id, count(*) AS {alias} FROM {name} GROUP BY doc_id)"


@query(f"""WITH RECURSIVE {data.SQL_STROKES}, {data.sql_kernel("strokes")}, t AS (SELECT doc_id, input, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, coalesce(cycles, 0) AS cycles, coalesce(accepted, 0) AS accepted, coalesce(long_, 0) AS long_
FROM {_counted("strokes", "input")} {" ".join(f"LEFT JOIN {_counted(name, alias)} USING (doc_id)" for name, alias in (("k_node", "nodes"), ("k_edge", "edges"), ("k_cycle", "cycles"), ("k_kept", "accepted"), ("k_long", "long_")))})
SELECT doc_id, input, input - edges AS discarded, nodes, edges, cycles, accepted, cycles - accepted AS rejected, 4 * accepted AS consumed, long_ - 4 * accepted AS remaining FROM t""")
def q_kernel_counters(spark, d):
    """The kernel's nine counters for each document."""
    return topology.Kernel(data.strokes(spark, d)).counters()


@query(f"""WITH RECURSIVE {SQL_SEGMENTS}, ends AS (SELECT doc_id, group_key, seg_ord, x1 AS x, y1 AS y FROM segments UNION ALL SELECT doc_id, group_key, seg_ord, x2, y2 FROM segments),
joints AS (SELECT doc_id, group_key, x, y, min(seg_ord) AS a, max(seg_ord) AS b FROM ends GROUP BY ALL HAVING count(*) = 2 AND min(seg_ord) <> max(seg_ord)), l AS (SELECT a, b FROM joints UNION SELECT b, a FROM joints),
t AS (SELECT a, a AS b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a), c AS (SELECT a AS seg_ord, min(b) AS chain FROM t GROUP BY a), s AS (SELECT g.doc_id, g.group_key, g.seg_ord, coalesce(chain, g.seg_ord) AS chain FROM segments g LEFT JOIN c USING (seg_ord)),
n AS (SELECT doc_id, group_key, chain, count(*) AS segments FROM s GROUP BY ALL), f AS (SELECT chain, count(*) AS free, count(DISTINCT (e.x, e.y)) AS nodes FROM ends e JOIN s USING (seg_ord) WHERE NOT EXISTS (FROM joints k WHERE k.doc_id = e.doc_id AND k.group_key = e.group_key AND k.x = e.x AND k.y = e.y) GROUP BY chain)
SELECT doc_id, group_key, count(*) AS contours, count(*) FILTER ((free IS NULL OR (free = 2 AND nodes = 1)) AND segments > 1) AS closed, sum(segments)::BIGINT AS segments FROM n LEFT JOIN f USING (chain) GROUP BY doc_id, group_key""")
def q_contours(spark, d):
    return topology.contours(data.segments(spark, d)).groupBy("doc_id", "group_key").agg(F.count(F.lit(1)).alias("contours"), F.count_if("is_closed").alias("closed"), F.sum("segments").alias("segments"))


@query("""WITH v AS (SELECT o_orderkey AS view_id, (o_custkey % 2000 + 1)::DOUBLE AS pw, (o_orderkey % 1500 + 1)::DOUBLE AS ph, (o_orderkey % 600)::DOUBLE - 50 AS l, (o_custkey % 600)::DOUBLE - 50 AS t FROM orders), c AS (SELECT *, greatest(0e0, l) AS cl, greatest(0e0, t) AS ct, least(l + 1024, pw) AS cr, least(t + 512, ph) AS cb FROM v),
y AS (SELECT *, unnest(range(floor(ct / 512)::BIGINT, least(floor(cb / 512), ceil(ph / 512) - 1)::BIGINT + 1)) AS tile_y FROM c WHERE cr > cl AND cb > ct), x AS (SELECT *, unnest(range(floor(cl / 512)::BIGINT, least(floor(cr / 512), ceil(pw / 512) - 1)::BIGINT + 1)) AS tile_x FROM y)
SELECT view_id, tile_x, tile_y, least(512e0, pw - tile_x * 512) AS tile_width, least(512e0, ph - tile_y * 512) AS tile_height FROM x""")
def q_visible_tiles(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    left, top = (k % 600).cast("double") - 50, (c % 600).cast("double") - 50
    v = table(spark, d, "orders").select(k.alias("view_id"), (c % 2000 + 1).cast("double").alias("page_width"), (k % 1500 + 1).cast("double").alias("page_height"), left.alias("left"), top.alias("top"), (left + 1024).alias("right"), (top + 512).alias("bottom"))
    return spatial.visible_tiles(v)


def accesses(spark, d):
    return table(spark, d, "events").select(F.floor(F.col("user_id") / 8).alias("doc_id"), F.concat(F.col("user_id"), F.lit("/"), F.floor(F.col("value") / 10).cast("long")).alias("tile"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 + 1).cast("long").alias("bytes"), (F.col("event_id") % 16).cast("long").alias("ms"))


SQL_ACCESS = 'a AS (SELECT user_id // 8 AS doc_id, user_id || \'/\' || floor(value / 10)::BIGINT AS tile, ts AS "at", event_id AS seq, event_id % 4 + 1 AS bytes, event_id % 16 AS ms FROM events)'


@query("SELECT doc_id, event_id FROM (SELECT user_id // 8 AS doc_id, event_id, row_number() OVER (PARTITION BY user_id // 8 ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 500")
def q_history_cap(spark, d):
    return history.latest(table(spark, d, "events").select(F.floor(F.col("user_id") / 8).alias("doc_id"), "ts", "event_id")).select("doc_id", "event_id")


@query(f"""WITH {SQL_ACCESS}, l AS (SELECT doc_id, tile, arg_max(bytes, ("at", seq)) AS bytes, max(("at", seq)) AS k FROM a GROUP BY doc_id, tile) SELECT doc_id, tile, held FROM (SELECT doc_id, tile, sum(bytes) OVER (PARTITION BY doc_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS held FROM l) WHERE held <= 100""")
def q_lru_cache(spark, d):
    return history.cached_tiles(accesses(spark, d), 100).select("doc_id", "tile", "held")


@query(f"""WITH {SQL_ACCESS}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tile ORDER BY "at", seq) > 1 AS hit FROM a) SELECT doc_id, count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) / count(*) AS hit_ratio, coalesce(sum(ms) FILTER (NOT hit) / count(*) FILTER (NOT hit), 0) AS average_ms FROM h GROUP BY doc_id""")
def q_render_metrics(spark, d):
    return history.render_metrics(accesses(spark, d))


@query(r"""WITH t AS (SELECT conv_id * 1000 + turn AS file, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM conversations WHERE text IS NOT NULL) SELECT file, len(w) AS words, array_to_string(w, ' ') AS joined FROM t WHERE len(w) > 0""")
def q_char_words(spark, d):
    """Texts laid out character by character and put together again."""
    c = table(spark, d, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("file"), F.lit(1).alias("page"), F.posexplode(F.split("text", "")).alias("n", "ch")).where("ch <> ''")
    c = c.withColumns({"left": F.col("n") * 5.0, "right": F.col("n") * 5.0 + 5, "bottom": F.lit(0.0), "top": F.lit(10.0)})
    w = history.words_of_characters(c)
    return w.groupBy("file").agg(F.count(F.lit(1)).alias("words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), " ").alias("joined"))


def written_files(spark, d, line, head: str, separator: str, tail: str = ""):
    """A text file for each group of customers' orders, one line an order."""
    o = table(spark, d, "orders").withColumn("line", line)
    per = o.groupBy(F.floor(F.col("o_custkey") / 50).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))).alias("l"))
    return per.select("doc_id", F.concat(F.lit(head), F.array_join("l.line", separator), F.lit(tail)).alias("content"))


@query("""WITH t AS (SELECT o_custkey // 50 AS doc_id, o_orderkey AS n, (o_orderkey % 3 + 1)::INT AS op, (o_orderkey % 500) * 0.001e0 AS x, (o_custkey % 400) * 0.001e0 AS y, CASE WHEN o_orderkey % 2 = 0 THEN 0.25e0 ELSE 0.75e0 END AS size FROM orders),
l AS (SELECT *, coalesce(lag(x) OVER w, 0e0) AS x1, coalesce(lag(y) OVER w, 0e0) AS y1 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY n)), k AS (SELECT *, CASE WHEN op = 1 AND (x1 <> x OR y1 <> y) THEN 'Track' WHEN op = 3 THEN 'Pad' END AS kind FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n)::INT AS element_no, kind, round(CASE WHEN kind = 'Pad' THEN x ELSE x1 END, 6) AS x1, round(CASE WHEN kind = 'Pad' THEN y ELSE y1 END, 6) AS y1, round(x, 6) AS x2, round(y, 6) AS y2, size FROM k WHERE kind IS NOT NULL""")
def q_gerber_scan(spark, d):
    k = F.col("o_orderkey")
    line = F.concat(F.lit("D1"), F.when(k % 2 == 0, "0").otherwise("1"), F.lit("*\nX"), k % 500, F.lit("Y"), F.col("o_custkey") % 400, F.lit("D0"), k % 3 + 1, F.lit("*\n"))
    files = written_files(spark, d, line, "%MOMM*%\n%ADD10C,0.25*%\n%ADD11C,0.75*%\nG04 start*\n", "")
    # The definitions match the coordinate pattern as D1 at the origin, which draws nothing.
    return boards.gerber(files).select("doc_id", "element_no", "kind", *[W6(c).alias(c) for c in ("x1", "y1", "x2", "y2")], "size")


@query("""WITH t AS (SELECT o_custkey // 50 AS doc_id, o_orderkey AS n, o_orderkey % 4 AS tool, o_orderkey % 700 AS x, -(o_custkey % 300) AS y FROM orders) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n)::INT AS element_no, round(x * 0.001e0, 6) AS x, round(y * 0.001e0, 6) + 0e0 AS y, CASE tool WHEN 1 THEN 0.5e0 WHEN 2 THEN 0.8e0 ELSE 0.3e0 END AS diameter FROM t""")
def q_excellon_scan(spark, d):
    line = F.concat(F.lit("T"), F.col("o_orderkey") % 4, F.lit("\nX"), F.col("o_orderkey") % 700, F.lit("Y-"), F.col("o_custkey") % 300)
    files = written_files(spark, d, line, "M48\nMETRIC\nT1C0.5\nT2C0.8\n%\n", "\n")
    return boards.excellon(files).select("doc_id", "element_no", W6("x").alias("x"), (W6("y") + 0.0).alias("y"), "diameter")


@query("""SELECT o_custkey // 50 AS doc_id, row_number() OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey)::INT AS element_no, CASE WHEN o_orderkey % 2 = 0 THEN 'bottom-copper' ELSE 'top-copper' END AS layer_id, (o_orderkey % 90)::DOUBLE AS x1, (o_custkey % 70) + 0.5e0 AS y2, 0.25e0 AS width, 'net-n' || (o_custkey % 9) AS net_id FROM orders""")
def q_kicad_scan(spark, d):
    k = F.col("o_orderkey")
    line = F.concat(F.lit("(segment (start "), k % 90, F.lit(" 1.0) (end 2.0 "), F.col("o_custkey") % 70, F.lit('.5) (layer "'), F.when(k % 2 == 0, "B.Cu").otherwise("F.Cu"), F.lit('")(net 1 "N'), F.col("o_custkey") % 9, F.lit('") (width 0.25))'))
    return boards.kicad(written_files(spark, d, line, "(kicad_pcb\n", "\n", ")"))["tracks"].select("doc_id", "element_no", "layer_id", "x1", "y2", "width", "net_id")


@query("""SELECT o_custkey // 50 AS doc_id, row_number() OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey)::INT AS n, 'R' || o_orderkey AS reference, (o_orderkey % 80)::DOUBLE AS x, CASE WHEN o_orderkey % 3 = 0 THEN 'Bottom' ELSE 'Top' END AS side, ((o_orderkey % 4) * 90)::DOUBLE AS rotation FROM orders""")
def q_eagle_scan(spark, d):
    k = F.col("o_orderkey")
    line = F.concat(F.lit('<element name="R'), k, F.lit('" value="1k" x="'), k % 80, F.lit('" y="2" rot="'), F.when(k % 3 == 0, "M").otherwise(""), F.lit("R"), (k % 4) * 90, F.lit('"/>'))
    files = written_files(spark, d, line, "<eagle><board><elements>", "\n", "</elements></board></eagle>")
    return boards.eagle(files)["components"].select("doc_id", "n", "reference", "x", "side", "rotation")


@query(r"""SELECT doc_id, net_id, arg_min(name, n) AS name FROM (SELECT p_partkey % 20 AS doc_id, p_partkey AS n, p_brand || ' ' || p_type AS name, 'net-' || trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^\p{L}\p{Nd}]', '-', 'g'), '-') AS net_id FROM part) GROUP BY doc_id, net_id""")
def q_net_slugs(spark, d):
    return boards.nets(table(spark, d, "part").select((F.col("p_partkey") % 20).alias("doc_id"), F.col("p_partkey").alias("n"), F.concat_ws(" ", "p_brand", "p_type").alias("name")))


from planar import queries_documents  # noqa: E402, F401  registers its queries
