"""Keyword, substring and reference search, and the comparison of two document roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planar.functions import geometry as g
from planar.operators import fragments as fragments_
from planar.operators import graph

#: The most fragments that are joined to one reference.
FRAGMENTS = 8
#: Characters of references that every task may hold.
LISTED = 16_000_000


def keyword(components: DataFrame, nets: DataFrame, layers: DataFrame, elements: DataFrame, term: str, field: str = "Any", at: tuple[float, float] | None = None, tolerance: float = 0.0) -> DataFrame:
    """Hits (entity, id, label, score), best first. An empty term matches all."""
    term = term.strip()
    match = lambda c: F.contains(F.upper(c), F.upper(F.lit(term)))
    hit = lambda df, entity, key, label, score: df.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("id"), label.alias("label"), F.lit(score).cast("int").alias("score") if isinstance(score, int) else score.cast("int").alias("score"))
    parts = []
    if field in ("Any", "Reference", "Value"):
        own = [match(F.col(c)) for c, no in (("reference", "Value"), ("value", "Reference")) if field != no]
        where = own[0] | own[1] if len(own) == 2 else own[0]
        parts.append(hit(components.where(where), "Component", "component_id", F.trim(F.concat_ws(" ", "reference", "value")), 100))
    if field in ("Any", "Net"):
        parts.append(hit(nets.where(match(F.col("name"))), "Net", "net_id", F.col("name"), 90))
    if field in ("Any", "Layer"):
        parts.append(hit(layers.where(match(F.col("layer_id"))), "Layer", "layer_id", F.col("layer_id"), 80))
    named = match(F.col("element_id")) if field in ("Any", "ElementId") else F.lit(False)
    here = F.lit(False) if at is None else (F.col("left") - tolerance <= at[0]) & (F.col("right") + tolerance >= at[0]) & (F.col("top") - tolerance <= at[1]) & (F.col("bottom") + tolerance >= at[1])
    parts.append(hit(elements.where(named | here), "Element", "element_id", F.col("element_id"), F.when(here, 110).otherwise(70)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("score"), F.upper("label"), "id")


def substring(words: DataFrame, term: str, pages: int = 8) -> DataFrame:
    """For each file: occurrences of words that hold the term, pages with one, and the first of these pages."""
    found = words.where(F.contains(F.upper("text"), F.upper(F.lit(term)))).groupBy("file", "page").agg(F.count(F.lit(1)).alias("n"))
    per = found.groupBy("file").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("pages"), F.array_sort(F.collect_list("page")).alias("all"))
    return per.select("file", "occurrences", "pages", F.slice("all", 1, pages).alias("first_pages"))


def runs_of(words: DataFrame, by: tuple[str, ...], fragments: int, longest: int) -> DataFrame:
    """What each word and the fragments close behind it on its line give together: by, pos (from 1), size, text and begun (the text before the last fragment).

    One exchange and one sort put the words of a page side by side; runs that are longer than any reference can be are not made.
    """
    order = Window.partitionBy(*by).orderBy("n")
    middle = F.col("bottom") + F.col("height") / 2
    last = lambda c: F.lag(c).over(order)
    tall = F.greatest(F.lit(0.5), F.greatest(F.col("height"), last("height")))
    gap = F.col("left") - (last("left") + last("width"))
    close = (F.abs(middle - last(middle)) <= tall * 0.65) & (gap >= -(tall * 0.35)) & (gap <= tall * 1.75)
    w = words.where("text IS NOT NULL").select(*by, "n", F.row_number().over(order).alias("pos"), g.reference(F.col("text")).alias("norm"), F.coalesce(close, F.lit(False)).alias("joined"))
    ahead = [F.when(F.lead("joined", k).over(order), F.lead("norm", k).over(order)).alias(f"t{k}") for k in range(1, fragments)]
    w = w.select(*by, "pos", "norm", *ahead)
    parts = ["norm", *[f"t{k}" for k in range(1, fragments)]]
    text = lambda k: F.concat(*parts[:k])  # null where a fragment is not close
    each = F.array(*[F.struct(F.lit(k).alias("size"), text(k).alias("text"), text(max(1, k - 1)).alias("begun")) for k in range(1, fragments + 1)])
    each = F.filter(each, lambda r: r["text"].isNotNull() & (r["text"] != "") & (F.length(r["text"]) <= longest))
    return w.select(*by, "pos", F.explode(each).alias("r")).select(*by, "pos", "r.*")


def references(words: DataFrame, queries: DataFrame, fragments: int = FRAGMENTS, by: tuple[str, ...] = ("file", "page"), listed: int = LISTED) -> DataFrame:
    """Occurrences of each query reference (query) by file and page.

    A word matches if it is the reference, a `_E` at the end of either aside. Else up to `fragments` neighbouring fragments are joined while they
    stay close on a line and what they give begins the reference. Up to `listed` characters of references go to every task. What a run gives of more of them is joined with the
    references by equality, so none of their beginnings is listed. Overlapping matches count once, the first from the left.
    """
    q = graph.written(queries.select("query", g.reference(F.col("query")).alias("wanted")).where("wanted <> ''").distinct(), "queries")
    listed_ = q.agg(F.coalesce(F.sum(F.length("query") + F.length("wanted")), F.lit(0))).first()[0] <= listed
    whole = dict(words.dtypes)["n"] in ("tinyint", "smallint", "int", "bigint")
    return _listed(words, q, fragments, by) if listed_ and whole else _met(words, q, fragments, by)


def _listed(words: DataFrame, q: DataFrame, fragments: int, by: tuple[str, ...]) -> DataFrame:
    """references() where each task has all of them: a page's words are packed, exchanged once and read side by side, and only the page's counts come back."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(fragments_.References([tuple(r) for r in q.collect()]))
    kinds = dict(words.dtypes)
    types = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    w = words.where("text IS NOT NULL").select(*by, F.coalesce(F.col("n").cast("long"), F.lit(-(2**62))).alias("n"), g.reference(F.col("text")).alias("norm"), *[F.col(c).cast("double").alias(c) for c in fragments_.BOX])
    w = w.mapInArrow(fragments_.packed(by), f"{types}, n long, words int, size int, data binary")
    # a sort compares most rows by the first column alone
    w = w.withColumn("row", F.row_number().over(Window.partitionBy(*sorted(by, key=lambda c: kinds[c] == "string")).orderBy("n")))
    return w.mapInArrow(fragments_.found(shared, by, fragments), f"{types}, query string, occurrences long")


def _met(words: DataFrame, q: DataFrame, fragments: int, by: tuple[str, ...]) -> DataFrame:
    """references() by a join of runs and references."""
    d = graph.written(q.select("wanted", g.without_side(F.col("wanted")).alias("key")).distinct(), "wanted")  # of a known size, so that a small one is broadcast
    longest = (d.agg(F.max(F.length("wanted"))).first()[0] or 0) + 2
    hits = runs_of(words, by, fragments, longest).withColumn("key", g.without_side(F.col("text"))).join(d, "key")
    hits = hits.where((F.col("size") < 3) | F.startswith("wanted", F.col("begun")))
    per = hits.groupBy(*by, "wanted").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most"), F.collect_list(F.struct("pos", "size")).alias("hits"))
    start = F.struct(F.lit(0).cast("long").alias("count"), F.lit(-1).cast("long").alias("free"))
    step = lambda s, h: F.when(h["pos"] >= s["free"], F.struct((s["count"] + 1).alias("count"), (h["pos"] + h["size"]).cast("long").alias("free"))).otherwise(s)
    # Single words can't overlap. Of a place the shortest run comes first, and covers the others.
    apart = F.when(F.col("most") == 1, F.col("n")).otherwise(F.aggregate(F.array_sort("hits"), start, step)["count"])
    return per.select(*by, "wanted", apart.alias("occurrences")).join(q, "wanted").select(*by, "query", "occurrences")


def grouped(results: DataFrame, roles: tuple[str, ...] = ("board", "schematic")) -> DataFrame:
    """Search results (role, page and more) in the order of roles and pages, with the number of results of their role."""
    rank = F.array_position(F.array(*map(F.lit, roles)), F.col("role"))
    counts = results.groupBy("role").agg(F.count(F.lit(1)).alias("in_role"))
    return results.join(F.broadcast(counts), "role").orderBy(rank, "page")  # a row for each role


def cross_probe(found: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query where it was found (role board or schematic, page, query, occurrences): totals, first pages (0 where it was not) and status; queries found nowhere too."""
    of = lambda role, c: F.when(F.col("role") == role, F.col(c))
    each = [f(of(role, c)).alias(f"{role}_{name}") for role in ("board", "schematic") for f, c, name in ((F.sum, "occurrences", "occurrences"), (F.min, "page", "page"))]
    both = queries.select("query").distinct().join(found.groupBy("query").agg(*each), "query", "left").na.fill(0)
    b, s = F.col("board_occurrences") > 0, F.col("schematic_occurrences") > 0
    return both.withColumn("status", F.when(b & s, "both").when(b, "board").when(s, "schematic").otherwise("none"))
