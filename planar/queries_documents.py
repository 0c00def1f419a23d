"""Registered queries on formats, pages, paths, views and reports, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planar import data
from planar.data import SQL_ELEMENTS, sql_words, table
from planar.functions import geometry as g
from planar.operators import classify, inventory, paths, recognize, search, semantic, spatial
from planar.queries import SQL_JUDGED, SQL_MEANING, SQL_MUTATIONS, W6, mutations, pads, written_files
from planar.registry import query
from planar.sources import boards, formats

ENDINGS = (".GTL", ".kicad_pcb", ".gko", ".tar.gz", ".exc", ".BRD", ".txt", ".pbr", ".xml", ".zip", ".pdf", ".drl", ".gts", ".tar", "", ".pcb")
_known = ", ".join(f"('{e}', '{name}', '{category}', {k})" for k, (name, category, all_) in enumerate(formats.KNOWN) for e in all_)
_readers = ", ".join(f"('{e}', '{name}', {k})" for k, (name, all_) in enumerate(formats.READERS) for e in all_)


@query(rf"""WITH p AS (SELECT p_partkey AS file, 'dir.d/' || p_name || [{", ".join(f"'{e}'" for e in ENDINGS)}][p_partkey % {len(ENDINGS)} + 1] AS path FROM part),
x AS (SELECT *, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ending FROM p), k(ending, format, category, o) AS (VALUES {_known}), r(ending, reader, o) AS (VALUES {_readers})
SELECT file, ending, k.format, k.category, r.reader, regexp_extract(path, '([^/]*?)(\.[^./]*)?$', 1) AS stem FROM x LEFT JOIN k USING (ending) LEFT JOIN r USING (ending)""")
def q_format_detection(spark, d):
    """Formats and readers of paths; only readers know .gko and .exc, only the table of formats .gts, .pbr and .tar."""
    path = F.concat(F.lit("dir.d/"), "p_name", data.pick(ENDINGS, F.col("p_partkey") % len(ENDINGS)))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("file"), path.alias("path")).withColumn("found", formats.detected(F.col("path")))
    return p.select("file", g.extension(F.col("path")).alias("ending"), "found.format", "found.category", formats.reader(F.col("path")).alias("reader"), g.stem(F.col("path")).alias("stem"))


#: Flags and pages of inspected documents.
FLAGS = ("pdf", "encrypted", "form", "xfa", "dot_ret", "pages")
MARKS = ("%PDF-1.7", "/AcroForm", "/XFA dynamicRender", "/Encrypt", "/XFA", "/Type /Page /Type /Pages /Type /Page", "/DotRet", "")


@query(rf"""WITH m AS (SELECT page_id AS doc_id, CASE WHEN page_id % 11 = 0 THEN '' ELSE '%PDF-' END || [{", ".join(f"'{m}'" for m in MARKS)}][page_id % 8 + 1] || html AS content, page_id % 3 AS vectors, page_id % 2 AS words FROM pages),
f AS (SELECT *, contains(content, '%PDF-') AS pdf, contains(content, '/Encrypt') AS encrypted, contains(content, '/AcroForm') AS form, contains(content, '/XFA') AS xfa, contains(content, 'dynamicRender') OR contains(content, 'Please wait') AS dyn,
  contains(content, '/DotRet') AS dot_ret, greatest(1, (length(content) - length(replace(content, '/Type /Page', ''))) // 11 - (length(content) - length(replace(content, '/Type /Pages', ''))) // 12)::INT AS pages FROM m),
t AS (SELECT *, CASE WHEN NOT pdf THEN 'Corrupted' WHEN encrypted THEN 'Protected' WHEN xfa AND dyn THEN 'XfaDynamic' WHEN xfa THEN 'XfaStatic' WHEN dot_ret THEN 'Standard' WHEN form THEN 'AcroForm' WHEN vectors > 0 THEN 'Technical'
  WHEN words > 0 THEN 'Standard' ELSE 'ImageOnly' END AS type FROM f)
SELECT doc_id, pdf, encrypted, form, xfa, dot_ret, pages, type, type IN ('Standard', 'ImageOnly', 'Technical', 'AcroForm') AS viewable, NOT dot_ret AND type IN ('Standard', 'Technical', 'AcroForm') AS analysable FROM t""")
def q_format_inspection(spark, d):
    key = F.col("page_id")
    content = F.concat(F.when(key % 11 == 0, "").otherwise("%PDF-"), data.pick(MARKS, key % 8), "html")
    p = table(spark, d, "pages").select(key.alias("doc_id"), content.alias("content"))
    found = boards.inspect(p).withColumn("type", boards.document_type(F.col("doc_id") % 3, F.col("doc_id") % 2))
    flags = ("pdf", "encrypted", "form", "xfa", "dot_ret", "pages", "type")
    return found.select("doc_id", *flags, boards.viewable(F.col("type")).alias("viewable"), boards.analysable(F.col("type"), F.when(F.col("dot_ret"), False)).alias("analysable"))


@query(rf"""WITH m AS (SELECT page_id AS doc_id, CASE WHEN page_id % 11 = 0 THEN '' ELSE '%PDF-' END || [{", ".join(f"'{m}'" for m in MARKS)}][page_id % 8 + 1] || html AS content FROM pages)
SELECT doc_id, contains(content, '%PDF-') AS pdf, contains(content, '/Encrypt') AS encrypted, contains(content, '/AcroForm') AS form, contains(content, '/XFA') AS xfa, contains(content, '/DotRet') AS dot_ret,
greatest(1, (length(content) - length(replace(content, '/Type /Page', ''))) // 11 - (length(content) - length(replace(content, '/Type /Pages', ''))) // 12)::INT AS pages FROM m""")
def q_line_inspection(spark, d):
    """The same flags from the lines of documents, as files that are split are read."""
    key = F.col("page_id")
    content = F.concat(F.when(key % 11 == 0, "").otherwise("%PDF-"), data.pick(MARKS, key % 8), "html")
    lines = table(spark, d, "pages").select(key.alias("doc_id"), F.explode(F.split(content, "\n")).alias("content"))
    return boards.inspect_lines(lines).select("doc_id", *FLAGS)


def commands(spark, d, page=lambda k: F.lit(1)):
    """A path for each order, a command for each of its lines in order: a second move in every third order, curves, closes; every fourth order draws a rectangle, side by side.

    Lines that the SQL orders by further columns are alike in all that a command is made of. The window is by the path's key, which what follows is dealt by too."""
    key = F.col("l_orderkey")
    lines = table(spark, d, "lineitem").select((key % 50).alias("file"), page(key).alias("page"), "l_orderkey", "l_partkey", "l_linenumber")
    rows = lines.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey", "file", "page").orderBy("l_linenumber", "l_partkey")))
    k, n, p = F.col("l_orderkey"), F.col("n"), F.col("l_partkey")
    square = k % 4 == 0
    op = F.when(n == 1, "move").when(square, F.when(n == 5, "close").otherwise("line")).when((n == 4) & (k % 3 == 0), "move")
    op = op.when((n == 3) & (p % 3 == 0), "curve").when((n == 6) | ((n == 3) & (k % 5 == 0)), "close").otherwise("line")
    x = F.when(square, F.when(n.isin(2, 3), 8.0).otherwise(0.0) + F.floor(k / 4) % 5 * 8).otherwise(p % 40 + n * 0.125)
    y = F.when(square, F.when(n.isin(3, 4), 5.0).otherwise(0.0) + F.floor(k / 20) % 4 * 5).otherwise((p * 7) % 30 + n * 0.25)
    at = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    shifted = F.struct((at["x"] + 1).alias("x"), at["y"].alias("y"))
    points = F.when(op == "close", F.array().cast("array<struct<x:double,y:double>>")).when(op == "curve", F.array(shifted, shifted, at)).otherwise(F.array(at))
    return rows.select("file", "page", k.alias("path"), n.alias("n"), op.alias("op"), points.alias("points"))


SQL_CONTOURS = """cn AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity))::INT AS n FROM lineitem),
c0 AS (SELECT l_orderkey AS path, n, l_partkey AS p, l_orderkey % 4 = 0 AS square, CASE WHEN n = 1 THEN 'move' WHEN l_orderkey % 4 = 0 THEN CASE WHEN n = 5 THEN 'close' ELSE 'line' END
  WHEN n = 4 AND l_orderkey % 3 = 0 THEN 'move' WHEN n = 3 AND l_partkey % 3 = 0 THEN 'curve' WHEN n = 6 OR (n = 3 AND l_orderkey % 5 = 0) THEN 'close' ELSE 'line' END AS op FROM cn),
c1 AS (SELECT path, n, op, CASE WHEN square THEN CASE WHEN n IN (2, 3) THEN 8e0 ELSE 0e0 END + path // 4 % 5 * 8 ELSE p % 40 + n * 0.125e0 END AS x, CASE WHEN square THEN CASE WHEN n IN (3, 4) THEN 5e0 ELSE 0e0 END + path // 20 % 4 * 5 ELSE (p * 7) % 30 + n * 0.25e0 END AS y,
  (sum((op = 'move')::INT) OVER (PARTITION BY path ORDER BY n))::BIGINT AS contour FROM c0),
c2 AS (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, lag(op) OVER w AS before, lag(x) OVER w AS bx, lag(y) OVER w AS "by" FROM c1 WINDOW w AS (PARTITION BY path, contour ORDER BY n)),
c3 AS (SELECT path, contour, n, 0 AS k, bx AS x, "by" AS y FROM c2 WHERE op = 'line' AND before = 'curve' UNION ALL SELECT path, contour, n, 1, x, y FROM c2 WHERE op IN ('move', 'line') UNION ALL SELECT path, contour, n, 2, fx, fy FROM c2 WHERE op = 'close'),
c4 AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly, count(*) FILTER (k < 2) OVER w AS had FROM c3 WINDOW w AS (PARTITION BY path, contour ORDER BY n, k)),
c5 AS (SELECT * FROM c4 WHERE k < 2 OR (had > 1 AND NOT (abs(lx - x) <= 1e-4 AND abs(ly - y) <= 1e-4))),
c6 AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c5 WINDOW w AS (PARTITION BY path, contour ORDER BY n, k)),
pts AS (SELECT path, contour, count(*) AS points, list(x ORDER BY n, k) AS xs, list(y ORDER BY n, k) AS ys FROM c6 GROUP BY path, contour),
ops AS (SELECT path, contour, bool_or(op = 'close') AS is_closed, count(*) FILTER (op = 'curve') AS curves FROM c1 GROUP BY path, contour),
con0 AS (SELECT *, is_closed AND points > 1 AND NOT (abs(xs[1] - xs[-1]) <= 1e-4 AND abs(ys[1] - ys[-1]) <= 1e-4) AS gap FROM pts JOIN ops USING (path, contour) WHERE points > 1 OR curves > 0),
con1 AS (SELECT path % 50 AS file, path, row_number() OVER (PARTITION BY path ORDER BY contour) AS contour, points + gap::INT AS points, is_closed, curves, CASE WHEN gap THEN list_append(xs, xs[1]) ELSE xs END AS xs, CASE WHEN gap THEN list_append(ys, ys[1]) ELSE ys END AS ys FROM con0),
con2 AS (SELECT *, list_filter(range(2, points + 1), lambda i: NOT (abs(xs[i] - xs[i - 1]) <= 1e-4 AND abs(ys[i] - ys[i - 1]) <= 1e-4)) AS moves FROM con1),
con AS (SELECT *, len(moves) AS steps, CASE WHEN curves > 0 THEN 'Bezier' WHEN is_closed AND len(moves) = 4 AND len(list_distinct(xs)) = 2 AND len(list_distinct(ys)) = 2 AND len(list_filter(moves, lambda i: (xs[i] = xs[i - 1]) = (ys[i] = ys[i - 1]))) = 0 THEN 'Rectangle'
  WHEN points - (is_closed AND points > 1)::INT = 2 THEN 'Line' ELSE 'Polyline' END AS kind FROM con2)"""


@query(f"""WITH {SQL_CONTOURS} SELECT file, path, contour, points::INT AS points, is_closed, curves::INT AS curves, kind FROM con""")
def q_path_contours(spark, d):
    return paths.primitives(paths.contours(commands(spark, d))).select("file", "path", F.col("contour").cast("long").alias("contour"), F.size("points").alias("points"), "is_closed", F.size("curves").alias("curves"), "kind")


@query(f"""WITH {SQL_CONTOURS} SELECT path, contour, steps AS segments, round(list_sum(list_transform(moves, lambda i: sqrt(power(xs[i] - xs[i - 1], 2) + power(ys[i] - ys[i - 1], 2)))), 4) AS length FROM con WHERE steps > 0""")
def q_contour_segments(spark, d):
    s = paths.contour_segments(paths.contours(commands(spark, d)))
    long_ = g.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return s.groupBy("path", F.col("contour").cast("long").alias("contour")).agg(F.max("segment").cast("long").alias("segments"), F.round(F.sum(long_), 4).alias("length"))


def page_words(spark, d):
    """Words with a blank one after every tenth."""
    w = data.words(spark, d)
    blank = w.where("n % 10 = 9").withColumn("text", F.lit(" "))
    return w.unionByName(blank).withColumn("file", F.col("file") % 50)


def drawn(spark, d):
    """Commands and styles of the paths: eight pages to a file, some styles to a page."""
    page = lambda k: (F.floor(k / 50) % 8 + 1).cast("int")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    styles = table(spark, d, "orders").select(
        (k % 50).alias("file"), page(k).alias("page"), k.alias("path"), (c % 2 * 0.25).alias("width"), F.lit(True).alias("is_stroked"), (c % 5 == 0).alias("is_filled"),
        F.when(c % 3 == 0, "#FF0000").alias("stroke_color"), F.lit(None).cast("string").alias("fill_color"),
    )
    return paths.PageVectors(commands(spark, d, page), styles)


SQL_VECTORS = f"""{SQL_CONTOURS}, styles AS (SELECT o_orderkey AS path, o_orderkey % 50 * 10 + o_orderkey // 50 % 8 + 1 AS doc_id, (o_custkey % 2)::VARCHAR || (o_custkey % 5 = 0) || (o_custkey % 3 = 0) AS group_key FROM orders),
lined AS (SELECT path, contour, unnest(moves) AS i, generate_subscripts(moves, 1) AS s, xs, ys FROM con WHERE curves = 0),
lines AS (SELECT doc_id, group_key, path * 1000 + contour * 100 + s AS seg_ord, format('page-{{}}-path-{{}}-contour-{{}}-segment-{{}}', doc_id % 10, path, contour, s) AS segment_id, xs[i - 1] AS x1, ys[i - 1] AS y1, xs[i] AS x2, ys[i] AS y2 FROM lined JOIN styles USING (path)),
{data.sql_kernel("lines", edge="0.005e0", area="0.00005e0")},
shapes AS (SELECT doc_id, CASE WHEN points - (is_closed AND points > 1)::INT = 2 THEN 'Line' ELSE 'Polyline' END AS kind, 1 AS n FROM con JOIN styles USING (path) WHERE curves > 0 AND points > 1
  UNION ALL SELECT doc_id, 'Bezier', curves FROM con JOIN styles USING (path) WHERE curves > 0 UNION ALL SELECT doc_id, CASE WHEN axis_aligned THEN 'Rectangle' ELSE 'Polyline' END, 1 FROM k_kept
  UNION ALL SELECT doc_id, 'Line', 1 FROM k_long l WHERE NOT EXISTS (FROM k_kept k WHERE k.doc_id = l.doc_id AND l.seg_ord IN (k.ab, k.bc, k.cd, k.da))),
vectors AS (SELECT doc_id // 10 AS file, (doc_id % 10)::INT AS page, paths, coalesce(lines, 0) AS lines, coalesce(polylines, 0) AS polylines, coalesce(rectangles, 0) AS rectangles, 0::BIGINT AS circles, coalesce(beziers, 0) AS beziers
  FROM (SELECT doc_id, count(*) AS paths FROM styles GROUP BY doc_id) LEFT JOIN (SELECT doc_id, {", ".join(f"coalesce(sum(n) FILTER (kind = '{k}'), 0)::BIGINT AS {k.lower()}s" for k in ("Line", "Polyline", "Rectangle", "Bezier"))} FROM shapes GROUP BY doc_id) USING (doc_id))"""


@query(f"""WITH RECURSIVE {SQL_VECTORS} SELECT * FROM vectors""")
def q_page_vectors(spark, d):
    """The vectors of each page by kind: rectangles and lines of its style graphs, curves and their outlines."""
    return drawn(spark, d).counters()


@query(f"""WITH RECURSIVE {SQL_VECTORS} SELECT doc_id // 10 AS file, (doc_id % 10)::INT AS page, segment_id AS graphic_id, x1, y1, x2, y2 FROM k_long l WHERE NOT EXISTS (FROM k_kept k WHERE k.doc_id = l.doc_id AND l.seg_ord IN (k.ab, k.bc, k.cd, k.da))""")
def q_page_lines(spark, d):
    """The lines of each page: segments of all contours that no rectangle has taken."""
    return drawn(spark, d).lines().select("file", "page", "graphic_id", "x1", "y1", "x2", "y2")


@query(f"""WITH RECURSIVE {sql_words()}, {SQL_VECTORS}, t AS (SELECT file % 50 AS file, count(*) AS texts, count(DISTINCT page) AS pages FROM words GROUP BY file % 50),
v AS (SELECT file, {", ".join(f"sum({c})::BIGINT AS {c}" for c in paths.VECTORS)} FROM vectors GROUP BY file),
n AS (SELECT t.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in paths.VECTORS)} FROM t LEFT JOIN v USING (file))
SELECT *, lines + polylines + rectangles + circles + beziers AS vectors, lines + polylines + rectangles + circles + beziers + texts AS graphics FROM n""")
def q_technical_totals(spark, d):
    w = page_words(spark, d)
    return paths.totals(w.select("file", "page").distinct(), paths.text_graphics(w), drawn(spark, d).counters())


@query(f"""WITH {sql_words()}, t AS (SELECT file, page, n, row_number() OVER (PARTITION BY file, page ORDER BY n) AS k, "left" * (25.4e0 / 72e0) AS l, bottom * (25.4e0 / 72e0) AS b, width * (25.4e0 / 72e0) AS w FROM words)
SELECT file, page, count(*) AS texts, 'page-' || page || '-text-' || max(k) AS last_id, round(sum(l), 3) AS lefts, round(sum(b), 3) AS bottoms, round(sum(w), 3) AS widths FROM t GROUP BY file, page""")
def q_text_graphics(spark, d):
    w = data.words(spark, d)
    t = paths.text_graphics(w.unionByName(w.where("n % 10 = 9").withColumn("text", F.lit(" \t"))))
    total = lambda c, name: F.round(F.sum(c), 3).alias(name)
    return t.groupBy("file", "page").agg(F.count(F.lit(1)).alias("texts"), F.max_by("text_id", "text_no").alias("last_id"), total("left", "lefts"), total("bottom", "bottoms"), total("width", "widths"))


@query(f"""WITH {sql_words()} SELECT file, page, count(*) AS words, md5(string_agg(text, ' ' ORDER BY n)) AS digest FROM words GROUP BY file, page""")
def q_page_words(spark, d):
    return paths.word_counts(data.words(spark, d)).select("file", "page", "words", F.md5("text").alias("digest"))


@query("""WITH docs AS (SELECT c_custkey AS file, c_custkey % 10 = 0 AS bad, greatest(1, c_custkey % 4) AS estimated FROM customer),
w AS (SELECT l_orderkey AS page, count(*) AS words FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY l_orderkey)
SELECT o_custkey AS file, o_orderkey::INT AS page, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE coalesce(words, 0) END AS words, CASE WHEN o_orderkey % 13 = 0 THEN 0e0 ELSE 210e0 END AS width, CASE WHEN o_orderkey % 13 = 0 THEN 0e0 ELSE (o_orderkey % 100)::DOUBLE END AS height,
CASE WHEN o_orderkey % 13 = 0 THEN 'page failed' END AS warning FROM orders JOIN docs ON file = o_custkey AND NOT bad LEFT JOIN w ON w.page = o_orderkey
UNION ALL SELECT file, unnest(range(1, estimated + 1))::INT, 0, 0e0, 0e0, 'document failed' FROM docs WHERE bad""")
def q_safe_index(spark, d):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    docs = table(spark, d, "customer").select(c.alias("file"), F.when(c % 10 == 0, "document failed").alias("error"), (c % 4).alias("estimated_pages"))
    orders = table(spark, d, "orders")
    pages = orders.select(F.col("o_custkey").alias("file"), o.alias("page"), F.lit(210.0).alias("width"), (o % 100).cast("double").alias("height"), F.when(o % 13 == 0, "page failed").alias("error"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise("w").alias("text"))
    return paths.safe_index(docs, pages, lines.join(pages.select("file", "page"), "page"))


@query("""WITH b AS (SELECT c_custkey AS k, (c_custkey % 50)::DOUBLE AS "left", (c_custkey % 30)::DOUBLE AS top, (c_custkey % 50)::DOUBLE + c_custkey % 7 AS "right", (c_custkey % 30)::DOUBLE + c_custkey % 5 + 1 AS bottom, 1 + c_custkey % 3 AS zoom FROM customer),
v AS (SELECT *, "right" - "left" <= 0 AS empty, least(780e0 / greatest("right" - "left", 0.000001e0), 580e0 / greatest(bottom - top, 0.000001e0)) AS fit, least(500e0, greatest(0.02e0, zoom * 300e0)) AS next FROM b),
s AS (SELECT *, CASE WHEN empty THEN 1e0 ELSE greatest(0.000001e0, fit * zoom) END AS scale FROM v),
o AS (SELECT *, CASE WHEN empty THEN 0e0 ELSE (800 - ("right" - "left") * scale) / 2 + 5 END AS ox, CASE WHEN empty THEN 0e0 ELSE (600 - (bottom - top) * scale) / 2 - 3 END AS oy FROM s),
w AS (SELECT *, "left" + (100 - ox) / scale AS wx, top + (50 - oy) / scale AS wy, CASE WHEN empty THEN 1e0 ELSE greatest(0.000001e0, fit * next) END AS scale2 FROM o)
SELECT k, round(scale, 6) AS scale, round(ox, 6) AS offset_x, round(oy, 6) AS offset_y, round(wx, 6) AS world_x, round(wy, 6) AS world_y, next AS zoom, round(5 + 100 - (CASE WHEN empty THEN 0e0 ELSE (800 - ("right" - "left") * scale2) / 2 + 5 END + (wx - "left") * scale2), 3) AS pan_x,
"left" - 2.5e0 AS inflated_left, bottom + 2.5e0 AS inflated_bottom, round(CASE WHEN k % 7 = 0 AND k % 5 = 0 THEN 0 ELSE (k % 7) / sqrt(power(k % 7, 2) + power(k % 5, 2)) END, 6) AS unit_x, round((-(top + 2) + 1) * 25.4e0, 6) AS space_x, round(("left" + 1 + 4) * 25.4e0, 6) AS space_y,
printf('#%02X%02X%02X', k % 256, 128, CASE WHEN k % 2 = 0 THEN 255 ELSE 0 END) AS color, ceil((k % 900) * (96e0 / 72e0 * 1.5e0))::INT AS pixels, (k % 100 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)::INT AS whole FROM w""")
def q_views(spark, d):
    """Cameras, screens, coordinate spaces, colours and pixels, over a box for each customer."""
    k = F.col("c_custkey")
    x, y = (k % 50).cast("double"), (k % 30).cast("double")
    b = table(spark, d, "customer").select(k.alias("k"), x.alias("left"), y.alias("top"), (x + k % 7).alias("right"), (y + k % 5 + 1).alias("bottom"), (1 + k % 3).cast("double").alias("zoom"))
    k, zoom, five, three = F.col("k"), F.col("zoom"), F.lit(5.0), F.lit(-3.0)
    view = g.fitted(800.0, 600.0, 10.0, zoom, five, three)
    wx, wy = g.from_screen(F.lit(100.0), F.lit(50.0), view)
    then = g.zoomed_at(F.lit(100.0), F.lit(50.0), F.lit(300.0), 800.0, 600.0, 10.0, zoom, five, three)
    left, _, _, bottom = g.inflate(2.5)
    sx, sy = g.to_world(F.col("left"), F.col("top"), (1.0, 2.0), g.append(g.rotate(90.0), g.translate(1.0, 4.0)), "Inch")
    unit = g.unit_vector((k % 7).cast("double"), (k % 5).cast("double"))[0]
    return b.select(
        "k", W6(view["scale"]).alias("scale"), W6(view["offset_x"]).alias("offset_x"), W6(view["offset_y"]).alias("offset_y"), W6(wx).alias("world_x"), W6(wy).alias("world_y"),
        then["zoom"].alias("zoom"), F.round(then["pan_x"], 3).alias("pan_x"), left.alias("inflated_left"), bottom.alias("inflated_bottom"), W6(unit).alias("unit_x"), W6(sx).alias("space_x"), W6(sy).alias("space_y"),
        g.rgb((k % 256) / 255, F.lit(128.0), F.when(k % 2 == 0, 1.0).otherwise(0.0)).alias("color"), g.rendered((k % 900).cast("double"), 1.5).alias("pixels"), g.whole_pixels(k % 100 + F.when(k % 2 == 0, 0.5).otherwise(0.25)).alias("whole"),
    )


@query(f"""WITH {SQL_ELEMENTS} SELECT doc_id, count(*) FILTER (CASE WHEN layer_id = 'click' THEN false ELSE is_visible END) AS shown FROM elements GROUP BY doc_id""")
def q_layer_visibility(spark, d):
    return spatial.set_visible(data.elements(spark, d), "click", False).groupBy("doc_id").agg(F.count_if("is_visible").alias("shown"))


@query(f"""WITH RECURSIVE {SQL_MUTATIONS}, v AS (SELECT doc_id, count(*) FILTER (done AND op <> 'clear') + count(DISTINCT seq) FILTER (done AND op = 'clear') AS version FROM f GROUP BY doc_id),
z AS (SELECT doc_id, element_id, arg_max(box IS NOT NULL, k) AS there FROM f GROUP BY doc_id, element_id), s AS (SELECT doc_id, element_id FROM z WHERE there), i AS (SELECT doc_id, count(*) AS items FROM s GROUP BY doc_id),
b AS (SELECT user_id // 8 AS doc_id, CASE WHEN (user_id // 8) % 3 = 0 THEN 'e' || user_id || '-' || (event_id % 5) ELSE 'b' || user_id || '-' || CASE WHEN (user_id // 8) % 3 = 1 THEN event_id ELSE event_id % 100 END END AS element_id FROM events WHERE event_id % 50 = 1),
p AS (SELECT doc_id, count(*) AS n, CASE WHEN count(*) > count(DISTINCT element_id) THEN 'duplicates in the batch' WHEN bool_or((doc_id, element_id) IN (SELECT (doc_id, element_id) FROM s)) THEN 'already indexed' END AS problem FROM b GROUP BY doc_id)
SELECT v.doc_id, version + coalesce((problem IS NULL AND n > 0)::BIGINT, 0) AS version, coalesce(items, 0) + coalesce(CASE WHEN problem IS NULL THEN n END, 0) AS items, problem FROM v LEFT JOIN i USING (doc_id) LEFT JOIN p USING (doc_id)""")
def q_add_range(spark, d):
    """A batch for each document on top of its log: some name present ids, some an id twice, some are taken as a whole."""
    state, versions = spatial.mutation_fold(mutations(spark, d))
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.floor(u / 8) % 3
    name = F.when(kind == 0, F.concat(F.lit("e"), u, F.lit("-"), e % 5)).when(kind == 1, F.concat(F.lit("b"), u, F.lit("-"), e)).otherwise(F.concat(F.lit("b"), u, F.lit("-"), e % 100))
    batch = table(spark, d, "events").where(e % 50 == 1).select(F.floor(u / 8).alias("doc_id"), name.alias("element_id"), *[F.lit(0.0).alias(c) for c in ("left", "top", "right", "bottom")])
    return spatial.add_range(state, versions, batch)[1]


@query(f"WITH {SQL_JUDGED} SELECT doc_id, primitive, count(*) AS n FROM cls GROUP BY doc_id, primitive")
def q_primitive_counts(spark, d):
    return classify.classified(data.elements(spark, d)).groupBy("doc_id", "primitive").agg(F.count(F.lit(1)).alias("n"))


SEMANTIC = "CASE WHEN k = 5 THEN layer_type ELSE ['Hole', 'Via', 'Pad', 'Text', '', 'BoardOutline', 'Copper', 'Pad', 'ComponentBody', 'Silkscreen', 'Mechanical', 'Unknown'][k] END"


def meanings(spark, d):
    e, limits, j, p = pads(spark, d)
    return e, limits, j, p, semantic.semantics(e, data.layers(spark, d), p, classify.vias(p), classify.holes(e, p, limits), j)


@query(f"""WITH RECURSIVE {SQL_MEANING}, s AS (SELECT doc_id, {SEMANTIC} AS semantic FROM t), c AS (SELECT doc_id, {", ".join(f"count(*) FILTER (semantic = '{m}') AS {m}" for m in inventory.MEANINGS)} FROM s GROUP BY doc_id)
SELECT doc_id, Pad AS pads, Mechanical AS mechanical, format('{{:,}} pads · {{:,}} vias · {{:,}} holes · {{:,}} bodies · {{:,}} outlines · {{:,}} unknown', Pad, Via, Hole, ComponentBody, BoardOutline, Unknown) AS summary FROM c""")
def q_semantic_counts(spark, d):
    counts = inventory.counts_by(meanings(spark, d)[4], "semantic", inventory.MEANINGS)
    return counts.join(inventory.semantic_summary(counts), "doc_id").select("doc_id", F.col("counts")["Pad"].alias("pads"), F.col("counts")["Mechanical"].alias("mechanical"), "summary")


@query(f"""WITH {SQL_ELEMENTS} SELECT doc_id, format('{{:,}} records · {{:,}} rectangles · {{:,}} ellipses · {{:,}} polylines · {{:,}} lines · {{:,}} texts', count(*), count(*) FILTER (kind = 'Rectangle'), count(*) FILTER (kind = 'Ellipse'),
count(*) FILTER (kind = 'Polyline'), count(*) FILTER (kind = 'Line'), count(*) FILTER (kind = 'Text')) AS summary FROM elements GROUP BY doc_id""")
def q_database_summary(spark, d):
    return inventory.database_summary(inventory.counts_by(inventory.geometry_database(data.elements(spark, d)), "kind", data.KINDS))


@query(f"""WITH RECURSIVE {SQL_MEANING}, s AS (SELECT doc_id, count(*) AS total, count(*) FILTER (kind = 'Arc') AS arcs, count(*) FILTER ({SEMANTIC} = 'Silkscreen') AS silkscreen FROM t GROUP BY doc_id), j AS (SELECT doc_id, count(*) AS candidates, count(*) FILTER (reason = 'None') AS accepted FROM judged GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS pads FROM pads GROUP BY doc_id), f AS (SELECT doc_id, arg_min(kind, (layer_id, top, "left", element_ord)) AS first_kind FROM elements GROUP BY doc_id)
SELECT doc_id, total, arcs, silkscreen, coalesce(candidates, 0) AS candidates, coalesce(accepted, 0) AS accepted, coalesce(pads, 0) AS pads, first_kind FROM s JOIN f USING (doc_id) LEFT JOIN j USING (doc_id) LEFT JOIN p USING (doc_id)""")
def q_json_report(spark, d):
    """The whole JSON report of each document, read back."""
    e, limits, j, p, s = meanings(spark, d)
    prints = recognize.low_level_footprints(p.join(classify.vias(p).select("doc_id", "element_ord"), ["doc_id", "element_ord"], "left_anti"), limits)
    report = inventory.inspector_report(inventory.geometry_database(e), classify.classified(e), s, j, p, prints)
    at = lambda path, kind="long": F.get_json_object("report", path).cast(kind)
    listed = F.size(F.from_json(F.get_json_object("report", "$.database.entries"), "array<struct<kind:string>>")).cast("long")
    return report.select(
        "doc_id", listed.alias("total"), at("$.database.counts.Arc").alias("arcs"), at("$.semantic.counts.Silkscreen").alias("silkscreen"), at("$.recognition.candidateCount").alias("candidates"),
        at("$.recognition.acceptedBeforeDeduplication").alias("accepted"), at("$.recognition.padCount").alias("pads"), at("$.database.entries[0].kind", "string").alias("first_kind"),
    )


@query("""WITH r AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'schematic' ELSE 'board' END AS role, o_orderkey AS hit, o_custkey % 40 AS page FROM orders) SELECT role, hit, page, count(*) OVER (PARTITION BY role) AS in_role FROM r""")
def q_search_groups(spark, d):
    o = table(spark, d, "orders")
    return search.grouped(o.select(F.when(F.col("o_orderkey") % 3 == 0, "schematic").otherwise("board").alias("role"), F.col("o_orderkey").alias("hit"), (F.col("o_custkey") % 40).alias("page")))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS found, 'set' AS after, 2::INT AS n FROM part""")
def q_properties(spark, d):
    """Maps whose keys match without regard to case."""
    p = table(spark, d, "part")
    m = F.create_map(F.when(F.col("p_partkey") % 2 == 0, " Title ").otherwise("TITLE"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")), F.lit("other"), F.lit("x"))
    after = g.with_property(m, "title", F.lit("set"))
    return p.select(F.col("p_partkey").alias("k"), g.looked_up(m, " tItle").alias("found"), g.looked_up(after, "Title").alias("after"), F.size(after).alias("n"))


@query("""SELECT o_custkey // 50 AS doc_id, (row_number() OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey))::INT AS n, 'R' || o_orderkey AS reference, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'v' || (o_orderkey % 5) END AS value,
(o_orderkey % 90)::DOUBLE AS x, -(o_custkey % 70) - 0.5e0 AS y, CASE WHEN o_orderkey % 3 = 0 THEN 90e0 ELSE 0e0 END AS rotation FROM orders""")
def q_kicad_components(spark, d):
    k = F.col("o_orderkey")
    turn = F.when(k % 3 == 0, " 90").otherwise("")
    value = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("v"), k % 5))
    line = F.concat(F.lit('(footprint "p" (property "Reference" "R'), k, F.lit('") (property "Value" "'), value, F.lit('") (at '), k % 90, F.lit(" -"), F.col("o_custkey") % 70, F.lit(".5"), turn, F.lit("))"))
    return boards.kicad(written_files(spark, d, line, "(kicad_pcb\n", "\n", ")"))["components"].select("doc_id", F.col("n").cast("int").alias("n"), "reference", "value", "x", "y", "rotation")


@query("""WITH e AS (SELECT o_custkey // 50 AS doc_id, o_orderkey, (o_orderkey % 90)::DOUBLE AS x, (o_custkey % 70)::DOUBLE AS y FROM orders WHERE o_orderkey % 9 = 0)
SELECT doc_id, count(*)::INT AS points, sum(x) AS xs, first(y ORDER BY o_orderkey) AS first_y FROM e GROUP BY doc_id HAVING count(*) >= 3""")
def q_board_outlines(spark, d):
    """Edge lines of a board as its outline polygon; other lines are no edges."""
    k = F.col("o_orderkey")
    layer = F.when(k % 9 == 0, "Edge.Cuts").otherwise("F.SilkS")
    line = F.concat(F.lit("(gr_line (start "), k % 90, F.lit(" "), F.col("o_custkey") % 70, F.lit(') (end 0 0) (layer "'), layer, F.lit('")) (x "'), k, F.lit('")'))
    only = written_files(spark, d, F.when(k % 9 == 0, line).otherwise(F.lit("(other)")), "(kicad_pcb\n", "\n", ")")
    found = boards.kicad(only)["outlines"]
    return found.select("doc_id", F.size("points").alias("points"), F.aggregate(F.transform("points", lambda p: p["x"]), F.lit(0.0), lambda a, x: a + x).alias("xs"), F.get("points", F.lit(0))["y"].alias("first_y"))


@query("""WITH w AS (SELECT o_custkey // 50 AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey) AS k, count(*) FILTER (o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey) AS even,
count(*) FILTER (o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey // 50) AS parts FROM orders)
SELECT doc_id, (parts + k - even)::INT AS element_no, CASE WHEN o_orderkey % 3 = 0 THEN 'bottom-copper' ELSE 'top-copper' END AS layer_id, (o_orderkey % 80)::DOUBLE AS x1, CASE WHEN o_orderkey % 7 = 0 THEN 0.5e0 ELSE 0.15e0 END AS width FROM w WHERE o_orderkey % 2 = 1""")
def q_eagle_tracks(spark, d):
    """Wires, numbered behind the components of their file."""
    k = F.col("o_orderkey")
    wide = F.when(k % 7 == 0, '" width="0.5').otherwise("")
    wire = F.concat(F.lit('<wire layer="'), F.when(k % 3 == 0, "16").otherwise("1"), F.lit('" x1="'), k % 80, F.lit('" y1="0" x2="1" y2="1'), wide, F.lit('"/>'))
    line = F.when(k % 2 == 0, F.concat(F.lit('<element name="R'), k, F.lit('" x="1" y="2"/>'))).otherwise(wire)
    files = written_files(spark, d, line, "<eagle><board>", "\n", "</board></eagle>")
    return boards.eagle(files)["tracks"].select("doc_id", F.col("element_no").cast("int").alias("element_no"), "layer_id", "x1", "width")


@query("""WITH s AS (SELECT o_custkey // 50 AS doc_id, o_orderkey AS k, sum(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey) AS n FROM orders)
SELECT doc_id, n::INT AS n, CASE WHEN k % 5 = 0 THEN 'U' || (n - 1) WHEN k % 5 = 1 THEN 'N' || k ELSE 'C' || k END AS reference, CASE WHEN k % 2 = 0 THEN 'p&1' ELSE '' END AS value, (k % 60)::DOUBLE AS x, 0e0 AS y FROM s WHERE doc_id % 3 <> 0""")
def q_ipc_components(spark, d):
    """Components of files whose root is one of the format's; every third file has another root."""
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit(' name="N'), k, F.lit('"'))).otherwise(F.concat(F.lit(' refDes="C'), k, F.lit('"')))
    line = F.concat(F.lit("<ns:Component"), name, F.when(k % 2 == 0, ' part="p&1"').otherwise(""), F.lit(' x="'), k % 60, F.lit('"/>'))
    files = written_files(spark, d, line, "", "\n")
    root = F.when(F.col("doc_id") % 3 == 0, "Other").otherwise("IPC-2581")
    files = files.withColumn("content", F.concat(F.lit("<?xml version='1.0'?><"), root, F.lit(">"), "content", F.lit("</"), root, F.lit(">")))
    return boards.ipc2581(files)["components"].select("doc_id", F.col("n").cast("int").alias("n"), "reference", "value", "x", "y")


@query("""SELECT o_custkey // 50 AS doc_id, (row_number() OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey))::INT AS element_no, (o_orderkey % 90)::DOUBLE AS x1, -(o_custkey % 30) - 0.25e0 AS y1, 2e0 AS x2, 3.5e0 AS y2, 0.3e0 AS width FROM orders""")
def q_legacy_tracks(spark, d):
    line = F.concat(F.lit("Po 0 "), F.col("o_orderkey") % 90, F.lit(" -"), F.col("o_custkey") % 30, F.lit(".25 2 3.5 0.3"))
    t = boards.legacy(written_files(spark, d, line, "PCBNEW\n", "\n"))["tracks"]
    return t.select("doc_id", F.col("element_no").cast("int").alias("element_no"), "x1", "y1", "x2", "y2", "width")


@query("""WITH five(layer_id, layer_type, side, ord) AS (VALUES ('top-copper', 'Copper', 'Top', 10), ('bottom-copper', 'Copper', 'Bottom', 20), ('outline', 'Outline', 'Both', 30), ('drill', 'Drill', 'Both', 40))
SELECT doc_id, layer_id, layer_type, side, ord FROM (SELECT DISTINCT user_id // 8 AS doc_id FROM events), five""")
def q_board_skeleton(spark, d):
    return boards.skeleton(spark, data.documents(spark, d))


@query(f"""WITH {SQL_ELEMENTS} SELECT doc_id, layer_id, count(*) AS n, (row_number() OVER (PARTITION BY doc_id ORDER BY layer_id))::INT AS layer_no FROM elements GROUP BY doc_id, layer_id""")
def q_document_layers(spark, d):
    """The distinct layers of a document in order, with their elements."""
    per = inventory.geometry_database(data.elements(spark, d)).groupBy("doc_id", "layer_id").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("layer_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("layer_id")))
