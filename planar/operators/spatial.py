"""Spatial access: windows, radii, top-k, grid joins, hit tests, tiles.

A join on space is an equality join on grid cells. Each side is exploded to the cells that it touches, and a pair is kept in
the one cell that holds the upper left corner of its intersection, so that no distinct is needed. A box over more than `wide`
cells on an axis is dealt to coarser cells, and a pair meets on the coarser level of its two boxes, so neither side explodes without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planar.functions import geometry as g
from planar.operators import graph

CELL = 10.0


def attribute_filter(elements: DataFrame, visible_only: bool = True, layers=None, nets=None, components=None, kinds=None) -> DataFrame:
    """All given filters hold; a null key fails a set filter."""
    where = F.col("is_visible") if visible_only else F.lit(True)
    for name, values in (("layer_id", layers), ("net_id", nets), ("component_id", components), ("kind", kinds)):
        if values is not None:
            where = where & F.col(name).isin(*values)
    return elements.where(where)


def window(elements: DataFrame, left: float, top: float, right: float, bottom: float, predicate: Column | None = None) -> DataFrame:
    found = elements.where(g.intersects(F.lit(left), F.lit(top), F.lit(right), F.lit(bottom)))
    return found if predicate is None else found.where(predicate)


def document(elements: DataFrame, doc_id) -> DataFrame:
    """The elements of one document, for the queries below."""
    return elements.where(F.col("doc_id") == doc_id)


def first_of_each(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first `most` rows of each document."""
    ranked = Window.partitionBy("doc_id").orderBy(*order)
    return rows.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= most)


def near(elements: DataFrame, x: float, y: float, radius: float, most: int | None = None) -> DataFrame:
    """Elements of each document whose box is within the radius, the nearest `most` under `place`, ties by id."""
    boxed = window(elements, x - radius, y - radius, x + radius, y + radius)
    found = boxed.withColumn("distance", g.distance_to_box(F.lit(x), F.lit(y))).where(F.col("distance") <= radius)
    return found if most is None else first_of_each(found, most, "distance", "element_id")


def hit_test(elements: DataFrame, x: float, y: float, tolerance: float = 0.25, most: int = 128) -> DataFrame:
    """The nearest elements of each document with their area, by which they are ordered."""
    return near(elements, x, y, tolerance, most).drop("place").withColumn("area", g.area()).orderBy("doc_id", "area", "element_id")


def click_select(elements: DataFrame, layers: DataFrame, x: float, y: float, scale: float, most: int = 32) -> DataFrame:
    """The nearest element of each document within six pixels; of equally near ones that of the highest layer."""
    hits = near(elements, x, y, 6 / scale, most).drop("place").join(layers, ["doc_id", "layer_id"])
    return first_of_each(hits, 1, "distance", F.desc("ord"), "element_ord").drop("place")


def visible_objects(elements: DataFrame, layers: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    shown = layers.where("layer_visible")
    return window(elements, left, top, right, bottom, F.col("is_visible")).join(shown, ["doc_id", "layer_id"]).orderBy("doc_id", "ord", "element_id")


def set_visible(rows: DataFrame, layer_id: str, visible: bool, column: str = "is_visible") -> DataFrame:
    """Layers or elements with the visibility of one layer set."""
    return rows.withColumn(column, F.when(F.col("layer_id") == layer_id, F.lit(visible)).otherwise(F.col(column)))


def cells(left, top, right, bottom, size: float = CELL) -> tuple[Column, Column]:
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return span(left, right), span(top, bottom)


def level_of(width, height, size: float, wide: int) -> Column:
    """How often the cell is doubled until a box of this size touches at most about `wide` cells on an axis."""
    extent = F.greatest(width, height, F.lit(size)) / (size * wide)
    return F.greatest(F.lit(0), F.ceil(F.log2(extent))).cast("int")


#: Elements of a cell beyond which it is split, how often its side is halved at most, and the share of elements whose counts decide it.
DENSE, HALVINGS, SAMPLED = 20_000, 12, 0.1


def grid_join(queries: DataFrame, elements: DataFrame, size: float = CELL, wide: int = 8, dense: int = DENSE, halvings: int = HALVINGS, sampled: float = SAMPLED) -> DataFrame:
    """Pairs of query boxes (query_id, ql, qt, qr, qb and more) and elements whose boxes intersect; both may carry doc_id, which then must agree.

    A pair meets on the coarser one of its two boxes' levels, so neither a large element nor a large query is dealt to many cells. Cells with more
    than `dense` elements become quadtrees: both sides go on to the quarters that they touch, until a cell holds fewer or is `halvings` deep; what
    lies at one place even then is dealt by a salt. A pair is kept in the one leaf that holds the corner of its intersection.
    """
    e = elements.withColumn("e_level", level_of(g.width(), g.height(), size, wide))
    q = queries.withColumn("q_level", level_of(F.col("qr") - F.col("ql"), F.col("qb") - F.col("qt"), size, wide))
    levels = sorted(r[0] for r in e.select("e_level").union(q.select("q_level")).distinct().collect())  # at most the binary logarithm of the extent
    every = F.array(*map(F.lit, levels)).cast("array<int>")
    doc = ["doc_id"] if "doc_id" in queries.columns and "doc_id" in elements.columns else []
    node = ["level", "depth", "cell_x", "cell_y", *doc]
    side = F.pow(F.lit(2.0), F.col("level") - F.col("depth")) * size
    span = lambda a, b: F.sequence(F.floor(a / side), F.floor(b / side))

    def filed(df, own, left, top, right, bottom):
        df = df.withColumn("level", F.explode(F.filter(every, lambda x: x >= F.col(own)))).withColumn("depth", F.lit(0))
        return df.withColumn("cell_x", F.explode(span(left, right))).withColumn("cell_y", F.explode(span(top, bottom)))

    def quartered(df, split, left, top, right, bottom):
        """Rows of split nodes at the quarters that they touch, beside the other rows."""
        inner = df.join(split, node, "left_semi").withColumn("depth", F.col("depth") + 1)
        part = lambda cell, a, b: F.explode(F.filter(F.array(F.col(cell) * 2, F.col(cell) * 2 + 1), lambda k: (k >= F.floor(a / side)) & (k <= F.floor(b / side))))
        inner = inner.withColumn("cell_x", part("cell_x", left, right)).withColumn("cell_y", part("cell_y", top, bottom))
        return df.join(split, node, "left_anti").unionByName(inner)

    boxes = [[F.col(c) for c in names] for names in (("left", "top", "right", "bottom"), ("ql", "qt", "qr", "qb"))]
    some = filed(e if sampled >= 1 else e.sample(sampled, 7), "e_level", *boxes[0])
    e, q = filed(e, "e_level", *boxes[0]), filed(q, "q_level", *boxes[1])
    while True:
        counts = some.groupBy(*node).agg((F.count(F.lit(1)) / sampled).alias("n")).where(F.col("n") > dense)
        counts = graph.written(counts, "dense-cells")
        split = counts.where(F.col("depth") < halvings)
        if split.isEmpty():
            break
        some, e, q = (graph.written(quartered(df, split, *box), "quartered") for df, box in ((some, boxes[0]), (e, boxes[0]), (q, boxes[1])))
    salt = []
    if not counts.isEmpty():  # at one place
        salt = ["salt"]
        many = counts.select(*node, F.ceil(F.col("n") / dense).cast("int").alias("parts"))
        e = e.join(many, node, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("element_id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        q = q.join(many, node, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = q.join(e, [*node, *salt]).where((F.col("level") == F.greatest("e_level", "q_level")) & g.intersects(F.col("ql"), F.col("qt"), F.col("qr"), F.col("qb")))
    own = (F.floor(F.greatest("left", "ql") / side) == F.col("cell_x")) & (F.floor(F.greatest("top", "qt") / side) == F.col("cell_y"))
    return both.where(own).drop("cell_x", "cell_y", "level", "depth", "e_level", "q_level", *salt)


def radius_join(points: DataFrame, elements: DataFrame, radius: float, most: int | None = None, size: float = CELL) -> DataFrame:
    """Elements within the radius of each point (query_id, x, y), nearest first under `place`."""
    q = points.withColumns({"ql": F.col("x") - radius, "qt": F.col("y") - radius, "qr": F.col("x") + radius, "qb": F.col("y") + radius})
    found = grid_join(q, elements, size).withColumn("distance", g.distance_to_box(F.col("x"), F.col("y"))).where(F.col("distance") <= radius)
    if most is not None:
        ranked = Window.partitionBy("query_id").orderBy("distance", "element_id")
        found = found.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= most)
    return found.drop("ql", "qt", "qr", "qb")


def pad_neighbors(pads: DataFrame, radius, most_radius: Column | float) -> DataFrame:
    """Pairs a, b (pad and ordinals) of a document whose centres are within the radius (a Column of the pad a, at most most_radius), by a grid of
    cells of that size, which may differ by document."""
    own = pads.withColumns({"ax": F.floor(F.col("cx") / most_radius), "ay": F.floor(F.col("cy") / most_radius)})
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    a = own.withColumn("d", F.explode(around)).withColumns({"ax": F.col("ax") + F.col("d.dx"), "ay": F.col("ay") + F.col("d.dy")}).drop("d").withColumn("r", radius)
    b = own.select("doc_id", "ax", "ay", *[F.col(c).alias(f"b_{c}") for c in ("element_ord", "cx", "cy", "w", "h")])
    dx, dy = F.col("cx") - F.col("b_cx"), F.col("cy") - F.col("b_cy")
    return a.join(b, ["doc_id", "ax", "ay"]).where((dx * dx + dy * dy <= F.col("r") * F.col("r")) & (F.col("element_ord") != F.col("b_element_ord"))).drop("ax", "ay", "r")


def index_statistics(elements: DataFrame, left: float, top: float, right: float, bottom: float, size: float = CELL) -> DataFrame:
    """items, occupied cells, candidates and hits of one window for each document."""
    xs, ys = cells(F.col("left"), F.col("top"), F.col("right"), F.col("bottom"), size)
    spread = elements.withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))
    inside = F.col("cell_x").between(F.floor(F.lit(left) / size), F.floor(F.lit(right) / size)) & F.col("cell_y").between(F.floor(F.lit(top) / size), F.floor(F.lit(bottom) / size))
    per = spread.groupBy("doc_id", "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("entries"))
    seen = spread.where(inside).select("doc_id", "element_id", "left", "top", "right", "bottom").distinct()
    hits = seen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(g.intersects(F.lit(left), F.lit(top), F.lit(right), F.lit(bottom))).alias("hits"))
    items = elements.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"))
    return items.join(per, "doc_id").join(hits, "doc_id", "left").na.fill(0, ["candidates", "hits"])


def mutation_log(log: DataFrame) -> DataFrame:
    """What each operation of a log (doc_id, seq, op, element_id, box) does: before and after (boxes or null), done, and problem.

    op is add, update, remove or clear. A removal or update of an absent id and an update to the same box do nothing; an add of a present id does
    nothing and is a problem, `already indexed`. A clear ends an epoch of its document: epochs are numbered over the log, and within its epoch each
    element's operations follow each other, so no clear meets elements.
    """
    epoch = F.sum(F.when(F.col("op") == "clear", 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    box = F.struct("left", "top", "right", "bottom")
    step = log.withColumn("epoch", F.coalesce(epoch, F.lit(0))).where("op <> 'clear'").withColumn("row", F.struct("seq", "op", box.alias("box")))
    folded = step.groupBy("doc_id", "epoch", "element_id").agg(F.array_sort(F.collect_list("row")).alias("ops"))
    none = F.lit(None).cast("struct<left:double,top:double,right:double,bottom:double>")
    entry = lambda r, before, after, done: F.struct(r["seq"].alias("seq"), r["op"].alias("op"), before.alias("before"), after.alias("after"), done.alias("done"))

    def apply(entries, r):
        before = F.coalesce(F.try_element_at(entries, F.lit(-1))["after"], none)
        done = F.when(r["op"] == "add", before.isNull()).when(r["op"] == "remove", before.isNotNull()).otherwise(before.isNotNull() & (before != r["box"]))
        after = F.when(~done, before).when(r["op"] == "remove", none).otherwise(r["box"])
        return F.array_append(entries, entry(r, before, after, done))

    seq = log.schema["seq"].dataType.simpleString()
    shape = f"array<struct<seq:{seq},op:string,before:{(b := 'struct<left:double,top:double,right:double,bottom:double>')},after:{b},done:boolean>>"
    done = folded.withColumn("e", F.explode(F.aggregate("ops", F.array().cast(shape), apply))).select("doc_id", "epoch", "element_id", "e.*")
    return done.withColumn("problem", F.when((F.col("op") == "add") & ~F.col("done"), "already indexed"))


def mutation_fold(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after a log, and each document's version and items. A clear counts one version if it finds an element."""
    steps = graph.written(mutation_log(log), "mutations")
    last = steps.groupBy("doc_id", "epoch", "element_id").agg(F.max_by("after", "seq").alias("box"))
    clears = log.where("op = 'clear'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("now"))
    ended = last.join(clears, "doc_id", "left").withColumn("now", F.coalesce("now", F.lit(0)))
    state = ended.where((F.col("epoch") == F.col("now")) & F.col("box").isNotNull()).select("doc_id", "element_id", "box.*")
    found = ended.where((F.col("epoch") < F.col("now")) & F.col("box").isNotNull()).groupBy("doc_id").agg(F.count_distinct("epoch").alias("clears"))
    per = steps.groupBy("doc_id").agg(F.count_if("done").alias("changes")).join(found, "doc_id", "left").join(state.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items")), "doc_id", "left").na.fill(0)
    return state, per.select("doc_id", (F.col("changes") + F.col("clears")).alias("version"), "items")


def add_range(state: DataFrame, versions: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State and versions after a batch (doc_id, element_id, box) for each document: all of it and one version, or an error as `problem`.

    A batch with an id twice, or with one that the document has already, is refused as a whole."""
    keys = ["doc_id", "element_id"]
    twice = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    known = batch.join(state.select(*keys), keys, "left_semi").select("doc_id").distinct().withColumn("known", F.lit(True))
    problem = F.when(F.col("n") > 1, "duplicates in the batch").when(F.col("known"), "already indexed")
    judged = twice.join(known, "doc_id", "left").select("doc_id", problem.alias("problem"))
    taken = batch.join(judged.where("problem IS NULL"), "doc_id", "left_semi")
    after = versions.join(judged, "doc_id", "full_outer").withColumn("n", F.when(F.col("problem").isNull() & F.col("doc_id").isNotNull(), 1))
    added = taken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("added"))
    after = after.join(added, "doc_id", "left").select("doc_id", (F.coalesce("version", F.lit(0)) + F.when(F.col("added") > 0, 1).otherwise(0)).alias("version"), (F.coalesce("items", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("items"), "problem")
    return state.unionByName(taken.select(*state.columns)), after


def visible_tiles(views: DataFrame, tile: int = 512) -> DataFrame:
    """Tiles (tile_x, tile_y and their clipped box) of each view (view_id, page_width, page_height, left, top, right, bottom), row by row; an aligned right edge counts the next column if the page has it."""
    clip = views.withColumns({"l": F.greatest(F.lit(0.0), F.col("left")), "t": F.greatest(F.lit(0.0), F.col("top")), "r": F.least("right", "page_width"), "b": F.least("bottom", "page_height")}).where("r > l AND b > t")
    last = lambda edge, size: F.least(F.floor(F.col(edge) / tile), F.ceil(F.col(size) / tile) - 1)
    out = clip.withColumn("tile_y", F.explode(F.sequence(F.floor(F.col("t") / tile), last("b", "page_height")))).withColumn("tile_x", F.explode(F.sequence(F.floor(F.col("l") / tile), last("r", "page_width"))))
    x, y = F.col("tile_x") * tile, F.col("tile_y") * tile
    return out.select("view_id", "tile_x", "tile_y", F.least(F.lit(float(tile)), F.col("page_width") - x).alias("tile_width"), F.least(F.lit(float(tile)), F.col("page_height") - y).alias("tile_height"))
