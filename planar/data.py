"""The engine's relations, derived from the driver's tables so that they grow with these.

elements <- events (a document holds eight users), layers <- event types, nets <- users, components <- parts, words <- documents and
conversations, segments <- orders, accesses <- events. Sizes are multiples of 1/8, so that bounds are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("Pad", "Via", "DrillHole", "Track", "Arc", "Line", "Polyline", "Bezier", "Rectangle", "Ellipse", "Polygon", "Text", "RasterImage")
SHAPES = ("Circle", "Rectangle", "Oval", "RoundedRectangle", "Polygon")
#: layer -> (type, side, order, visible)
LAYERS = {"view": ("Copper", "Top", 10, True), "click": ("Silkscreen", "Top", 20, True), "error": ("Document", "None", 30, True), "purchase": ("Unknown", "Bottom", 40, True), "signup": ("Mechanical", "None", 50, False)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = pick(KINDS, e % 13)
    w = 1 + (e % 5) * 0.25
    h = F.when(kind.isin("Via", "DrillHole"), w).otherwise(1 + (e % 3) * 0.5)
    rows = table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 8).alias("doc_id"), e.alias("element_ord"), F.concat(F.lit("e"), e).alias("element_id"), kind.alias("kind"),
        F.col("event_type").alias("layer_id"), F.when(e % 7 != 0, F.concat(F.lit("n"), F.col("user_id"))).alias("net_id"),
        F.when(kind == "DrillHole", F.concat(F.lit("c"), e % 50)).alias("component_id"), (F.floor(F.col("value") * 8) / 8).alias("cx"), (F.col("user_id") * 2.0).alias("cy"), w.alias("w"), h.alias("h"),
        (e % 10 != 7).alias("is_visible"), (kind.isin("Rectangle", "Ellipse", "Polygon") & (e % 2 == 0)).alias("is_filled"), (kind.isin("Pad", "Via", "DrillHole", "Rectangle", "Ellipse", "Polygon") | ((kind == "Polyline") & (e % 4 < 2))).alias("is_closed"),
        F.when(kind == "Pad", pick(SHAPES, e % 5)).alias("shape"), F.when(kind == "Text", F.concat(F.when(e % 3 == 0, "R").when(e % 3 == 1, "note ").otherwise("U"), e)).alias("text"),
    )
    return rows.select("*", (F.col("cx") - F.col("w") / 2).alias("left"), (F.col("cy") - F.col("h") / 2).alias("top"), (F.col("cx") + F.col("w") / 2).alias("right"), (F.col("cy") + F.col("h") / 2).alias("bottom"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 8).alias("doc_id")).distinct()


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of each document: one of the five is missing in four of five documents, another one each time; document 4 has none."""
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("layer_id", "layer_type", "side", "ord", "layer_visible", "place"), (k, *v, at))]) for at, (k, v) in enumerate(LAYERS.items())])
    each = documents(spark, sf_dir).where("doc_id <> 4").select("doc_id", F.explode(rows).alias("l")).select("doc_id", "l.*")
    return each.where(F.col("doc_id") % 5 != F.col("place") + 1).drop("place")


def nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets of even users only, so that elements refer to missing nets; their names occur in many documents, and some twice in one."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().where(F.col("user_id") % 2 == 0)
    return users.select(F.floor(F.col("user_id") / 8).alias("doc_id"), F.concat(F.lit("n"), F.col("user_id")).alias("net_id"), F.concat(F.lit("NET_"), F.col("user_id") % 6).alias("name"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of each document with their elements; every third component lists one that does not exist."""
    e = elements(spark, sf_dir).where("component_id IS NOT NULL")
    per = e.groupBy("doc_id", "component_id").agg(F.min("element_ord").alias("ord"), F.sort_array(F.collect_list("element_id")).alias("element_ids"))
    gone = F.when(F.col("ord") % 3 == 0, F.array(F.concat("component_id", F.lit("-gone")))).otherwise(F.array().cast("array<string>"))
    return per.withColumn("element_ids", F.concat("element_ids", gone))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages for each document with the five layers; the second one of every third document is empty."""
    ids = F.array(*[F.lit(k) for k in LAYERS])
    p = documents(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("number"))
    return p.select("doc_id", "number", F.lit(100.0).alias("width"), F.when((F.col("number") == 2) & (F.col("doc_id") % 3 == 0), 0.0).otherwise(50.0).alias("height"), ids.alias("layer_ids"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("c"), F.col("p_partkey")).alias("component_id"), F.concat(F.lit("U"), F.col("p_partkey")).alias("reference"), F.col("p_name").alias("value"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") * 75 - 400).cast("double").alias("rotation"))


def words(spark: SparkSession, sf_dir: str, role: str = "board") -> DataFrame:
    """file, page, pos, text and box of the words of documents (board) or conversations (schematic), 200 to a page, in justified lines of ten; on every other line a wide gap follows every
    fourth word, so that fragments join within the runs between, and on the others all do."""
    if role == "board":
        texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    else:
        texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("file"), "text")
    w = texts.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("n", "text"))
    return w.select("file", (F.floor(F.col("n") / 200) + 1).cast("int").alias("page"), "n", "text", ((F.col("n") % 10) * 100.0).alias("left"), (F.floor(F.col("n") / 10) * 12.0).alias("bottom"), F.when((F.col("n") % 4 == 3) & (F.floor(F.col("n") / 10) % 2 == 0), 75.0).otherwise(95.0).alias("width"), F.lit(10.0).alias("height"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit edges of a lattice of 8 x 8 nodes for each customer group; group_key is the order's priority."""
    o = table(spark, sf_dir, "orders")
    a, b = F.col("o_orderkey") % 8, F.floor(F.col("o_totalprice")).cast("long") % 8
    along = F.floor(F.col("o_orderkey") / 8) % 2 == 0
    return o.select(F.floor(F.col("o_custkey") / 50).alias("doc_id"), F.col("o_orderkey").alias("seg_ord"), F.concat(F.lit("s"), F.col("o_orderkey")).alias("segment_id"), F.col("o_orderpriority").alias("group_key"),
                    a.cast("double").alias("x1"), b.cast("double").alias("y1"), F.when(along, a + 1).otherwise(a).cast("double").alias("x2"), F.when(along, b).otherwise(b + 1).cast("double").alias("y2"))


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice of segments() as drawn by hand: ends moved by up to 0.012, short strokes, and by document plain, turned, or sheared by 0.03 or 0.05."""
    s, k = segments(spark, sf_dir), F.col("seg_ord")
    turned, shear = F.col("doc_id") % 4 == 1, F.when(F.col("doc_id") % 4 == 2, 0.03).when(F.col("doc_id") % 4 == 3, 0.05).otherwise(0.0)
    short = (k % 11 == 0) | (k % 13 == 0)
    x2 = F.when(short, F.col("x1") + F.when(k % 11 == 0, 0.004).otherwise(0.0105)).otherwise(F.col("x2"))
    y2 = F.when(short, F.col("y1")).otherwise(F.col("y2"))
    moved = lambda x, y, by: F.when(turned, x * 0.6 - y * 0.8).otherwise(x + y * shear) + by * 0.004
    along = lambda x, y: F.when(turned, x * 0.8 + y * 0.6).otherwise(y)
    x1, y1 = F.col("x1"), F.col("y1")
    return s.select("doc_id", "seg_ord", "segment_id", "group_key", moved(x1, y1, k % 4).alias("x1"), along(x1, y1).alias("y1"), moved(x2, y2, F.floor(k / 4) % 4).alias("x2"), along(x2, y2).alias("y2"))


_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
#: The same relations for DuckDB.
SQL_ELEMENTS = f"""
e0 AS (SELECT *, {_list(KINDS)}[event_id % 13 + 1] AS kind FROM events),
e1 AS (SELECT user_id // 8 AS doc_id, event_id AS element_ord, 'e' || event_id AS element_id, kind, event_type AS layer_id, CASE WHEN event_id % 7 <> 0 THEN 'n' || user_id END AS net_id,
  CASE WHEN kind = 'DrillHole' THEN 'c' || (event_id % 50) END AS component_id, floor(value * 8) / 8 AS cx, user_id * 2e0 AS cy, 1e0 + (event_id % 5) * 0.25e0 AS w,
  CASE WHEN kind IN ('Via', 'DrillHole') THEN 1e0 + (event_id % 5) * 0.25e0 ELSE 1e0 + (event_id % 3) * 0.5e0 END AS h, event_id % 10 <> 7 AS is_visible,
  kind IN ('Rectangle', 'Ellipse', 'Polygon') AND event_id % 2 = 0 AS is_filled, kind IN ('Pad', 'Via', 'DrillHole', 'Rectangle', 'Ellipse', 'Polygon') OR (kind = 'Polyline' AND event_id % 4 < 2) AS is_closed,
  CASE WHEN kind = 'Pad' THEN {_list(SHAPES)}[event_id % 5 + 1] END AS shape, CASE WHEN kind = 'Text' THEN (CASE event_id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'note ' ELSE 'U' END) || event_id END AS text FROM e0),
elements AS (SELECT *, cx - w / 2 AS "left", cy - h / 2 AS top, cx + w / 2 AS "right", cy + h / 2 AS bottom FROM e1)"""
SQL_LAYERS = f"""five(layer_id, layer_type, side, ord, layer_visible, place) AS (VALUES {", ".join(f"('{k}', '{v[0]}', '{v[1]}', {v[2]}, {v[3]}, {at})" for at, (k, v) in enumerate(LAYERS.items()))}),
layers AS (SELECT doc_id, layer_id, layer_type, side, ord, layer_visible FROM (SELECT DISTINCT user_id // 8 AS doc_id FROM events), five WHERE doc_id <> 4 AND doc_id % 5 <> place + 1)"""
SQL_NETS = "nets AS (SELECT DISTINCT user_id // 8 AS doc_id, 'n' || user_id AS net_id, 'NET_' || user_id % 6 AS name FROM events WHERE user_id % 2 = 0)"
SQL_COMPONENTS = "components AS (SELECT 'c' || p_partkey AS component_id, 'U' || p_partkey AS reference, p_name AS value, p_size::DOUBLE AS x, p_retailprice AS y, (p_partkey * 75 - 400)::DOUBLE AS rotation FROM part)"


def sql_words(role: str = "board", name: str = "words") -> str:
    source = "SELECT doc_id AS file, text FROM documents" if role == "board" else "SELECT conv_id * 1000 + turn AS file, text FROM conversations"
    return rf"""{name}_t AS (SELECT file, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM ({source})),
{name}_u AS (SELECT file, unnest(l) AS text, unnest(range(len(l))) AS n FROM {name}_t),
{name} AS (SELECT file, (n // 200 + 1)::INT AS page, n, text, (n % 10) * 100e0 AS "left", (n // 10) * 12e0 AS bottom, CASE WHEN n % 4 = 3 AND n // 10 % 2 = 0 THEN 75e0 ELSE 95e0 END AS width, 10e0 AS height FROM {name}_u)"""


SQL_SEGMENTS = """g0 AS (SELECT o_custkey // 50 AS doc_id, o_orderkey AS seg_ord, 's' || o_orderkey AS segment_id, o_orderpriority AS group_key, o_orderkey % 8 AS a, floor(o_totalprice)::BIGINT % 8 AS b, (o_orderkey // 8) % 2 = 0 AS along FROM orders),
segments AS (SELECT doc_id, seg_ord, segment_id, group_key, a::DOUBLE AS x1, b::DOUBLE AS y1, (CASE WHEN along THEN a + 1 ELSE a END)::DOUBLE AS x2, (CASE WHEN along THEN b ELSE b + 1 END)::DOUBLE AS y2 FROM g0)"""
SQL_STROKES = SQL_SEGMENTS + """,
g1 AS (SELECT *, seg_ord AS k, CASE doc_id % 4 WHEN 2 THEN 0.03e0 WHEN 3 THEN 0.05e0 ELSE 0e0 END AS shear, seg_ord % 11 = 0 OR seg_ord % 13 = 0 AS short FROM segments),
g2 AS (SELECT * REPLACE (CASE WHEN short THEN x1 + CASE WHEN k % 11 = 0 THEN 0.004e0 ELSE 0.0105e0 END ELSE x2 END AS x2, CASE WHEN short THEN y1 ELSE y2 END AS y2) FROM g1),
strokes AS (SELECT doc_id, seg_ord, segment_id, group_key, CASE WHEN doc_id % 4 = 1 THEN x1 * 0.6e0 - y1 * 0.8e0 ELSE x1 + y1 * shear END + (k % 4) * 0.004e0 AS x1, CASE WHEN doc_id % 4 = 1 THEN x1 * 0.8e0 + y1 * 0.6e0 ELSE y1 END AS y1,
  CASE WHEN doc_id % 4 = 1 THEN x2 * 0.6e0 - y2 * 0.8e0 ELSE x2 + y2 * shear END + (k // 4 % 4) * 0.004e0 AS x2, CASE WHEN doc_id % 4 = 1 THEN x2 * 0.8e0 + y2 * 0.6e0 ELSE y2 END AS y2 FROM g2)"""


def sql_kernel(source: str, snap: str = "0.01e0", edge: str = "0.01e0", area: str = "0.0001e0", angle: str = "0.035e0") -> str:
    """The kernel of the segments of `source`: relations k_long, k_node, k_edge, k_cycle and k_kept (accepted rectangles, place: their order in the group)."""
    length = lambda v: f"sqrt({v}x * {v}x + {v}y * {v}y)"
    dot = lambda v, w: f"abs({v}x * {w}x + {v}y * {w}y) / ({length(v)} * {length(w)}) <= {angle}"
    cross = lambda v, w: f"abs({v}x * {w}y - {v}y * {w}x) / ({length(v)} * {length(w)}) <= {angle}"
    even = lambda v, w: f"abs({length(v)} - {length(w)}) <= greatest({snap}, greatest({length(v)}, {length(w)}) * {angle})"
    flat, tall = (lambda v: f"abs({v}y) <= {snap}"), (lambda v: f"abs({v}x) <= {snap}")
    return f"""k_long AS (SELECT * FROM {source} WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= {edge}),
k_end AS (SELECT *, round_even(x / {snap}, 0)::BIGINT AS kx, round_even(y / {snap}, 0)::BIGINT AS ky, row_number() OVER (PARTITION BY doc_id, group_key ORDER BY seg_ord, side) AS i
  FROM (SELECT doc_id, group_key, seg_ord, 1 AS side, x1 AS x, y1 AS y FROM k_long UNION ALL SELECT doc_id, group_key, seg_ord, 2, x2, y2 FROM k_long)),
k_snap AS (SELECT doc_id, group_key, i, i AS node, [{{'kx': kx, 'ky': ky, 'i': i, 'x': x, 'y': y}}] AS nodes FROM k_end WHERE i = 1 UNION ALL
  SELECT doc_id, group_key, i, coalesce(found.i, i), CASE WHEN found IS NULL THEN list_append(nodes, {{'kx': kx, 'ky': ky, 'i': i, 'x': x, 'y': y}}) ELSE nodes END FROM (
    SELECT e.*, s.nodes, list_sort(list_filter(s.nodes, lambda n: abs(n.kx - e.kx) <= 1 AND abs(n.ky - e.ky) <= 1 AND sqrt((n.x - e.x) * (n.x - e.x) + (n.y - e.y) * (n.y - e.y)) <= {snap}))[1] AS found
    FROM k_snap s JOIN k_end e ON e.doc_id = s.doc_id AND e.group_key = s.group_key AND e.i = s.i + 1)),
k_node AS (SELECT doc_id, group_key, i, x, y FROM k_snap JOIN k_end USING (doc_id, group_key, i) WHERE node = i),
k_edge AS (SELECT doc_id, group_key, seg_ord, min(node) AS a, max(node) AS b FROM k_snap JOIN k_end USING (doc_id, group_key, i) GROUP BY ALL HAVING min(node) <> max(node)),
k_first AS (SELECT doc_id, group_key, a, b, min(seg_ord) AS o FROM k_edge GROUP BY ALL),
k_both AS (SELECT * FROM k_first UNION ALL SELECT doc_id, group_key, b, a, o FROM k_first),
k_path AS (SELECT f.doc_id, f.group_key, f.a, f.b AS m, s.b AS c, f.o AS o1, s.o AS o2 FROM k_first f JOIN k_both s ON s.doc_id = f.doc_id AND s.group_key = f.group_key AND s.a = f.b WHERE f.a < s.b),
k_cycle AS (SELECT b.doc_id, b.group_key, b.a, b.m AS b, b.c, d.m AS d, b.o1 AS ab, b.o2 AS bc, d.o2 AS cd, d.o1 AS da FROM k_path b JOIN k_path d ON d.doc_id = b.doc_id AND d.group_key = b.group_key AND d.a = b.a AND d.c = b.c AND b.o1 < d.o1),
k_side AS (SELECT k.*, q.x - p.x AS px, q.y - p.y AS py, r.x - q.x AS qx, r.y - q.y AS qy, s.x - r.x AS rx, s.y - r.y AS ry, p.x - s.x AS sx, p.y - s.y AS sy FROM k_cycle k
  {" ".join(f"JOIN k_node {n} ON {n}.doc_id = k.doc_id AND {n}.group_key = k.group_key AND {n}.i = k.{c}" for n, c in zip("pqrs", "abcd"))}),
k_valid AS (SELECT *, ({flat("p")} AND {tall("q")}) OR ({tall("p")} AND {flat("q")}) AS axis_aligned, row_number() OVER (PARTITION BY doc_id, group_key ORDER BY a, ab, da, bc) AS rk, count(*) OVER (PARTITION BY doc_id, group_key) AS n FROM k_side
  WHERE least({", ".join(map(length, "pqrs"))}) >= {edge} AND {dot("p", "q")} AND {dot("q", "r")} AND {cross("p", "r")} AND {cross("q", "s")} AND {even("p", "r")} AND {even("q", "s")} AND abs(px * qy - py * qx) >= {area}),
k_use AS (SELECT doc_id, group_key, rk, unnest([ab, bc, cd, da]) AS o FROM k_valid),
k_rival AS (SELECT a.doc_id, a.group_key, a.rk, list(DISTINCT b.rk) AS better FROM k_use a JOIN k_use b ON a.doc_id = b.doc_id AND a.group_key = b.group_key AND a.o = b.o AND b.rk < a.rk GROUP BY ALL),
k_step AS (SELECT DISTINCT doc_id, group_key, n, 0::BIGINT AS k, []::BIGINT[] AS kept FROM k_valid UNION ALL SELECT s.doc_id, s.group_key, s.n, s.k + 1, CASE WHEN r.better IS NOT NULL AND list_has_any(s.kept, r.better) THEN s.kept ELSE list_append(s.kept, s.k + 1) END
  FROM k_step s LEFT JOIN k_rival r ON r.doc_id = s.doc_id AND r.group_key = s.group_key AND r.rk = s.k + 1 WHERE s.k < s.n),
k_kept AS (SELECT v.*, list_position(kept, rk) AS place FROM k_valid v JOIN (SELECT * FROM k_step WHERE k = n) s ON s.doc_id = v.doc_id AND s.group_key = v.group_key WHERE list_contains(kept, rk))"""
