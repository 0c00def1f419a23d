"""Choices made in order: an item is taken if none of its resources was taken before it.

Only items that share a resource wait for each other. Rounds take every item that comes first at all of its resources and drop what shares one with it, as
aggregations and joins over all items at once. When no group has more open uses than one task may hold, each group's rest is walked in order
by one task; the result is the same however many rounds came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.operators import graph

#: Uses (item, resource) of a group that one task may walk.
HELD = 200_000


def first_come(uses: DataFrame, within: list[str], held: int = HELD) -> DataFrame:
    """The items (within, rank) that are taken. uses: within, rank (orderable and unique for each item of a group), resource."""
    by, at = [*within, "rank"], [*within, "resource"]
    left, taken = graph.written(uses.select(*by, "resource").distinct(), "uses"), None
    while True:
        most = left.groupBy(*within).count().agg(F.max("count")).first()[0] or 0
        if most <= held:
            break
        least = left.groupBy(*at).agg(F.min("rank").alias("least"))
        won = graph.written(left.join(least, at).groupBy(*by).agg(F.bool_and(F.col("rank") == F.col("least")).alias("won")).where("won").select(*by), "won")
        gone = left.join(won, by, "left_semi").select(*at).distinct()
        out = left.join(gone, at, "left_semi").select(*by).distinct()
        left = graph.written(left.join(out, by, "left_anti"), "uses")
        taken = won if taken is None else taken.unionByName(won)
    rest = left.groupBy(*by).agg(F.collect_set("resource").alias("resources"))
    kinds = {f.name: f.dataType.simpleString() for f in rest.schema.fields}

    def walked(pdf):
        used, keep = set(), []
        order = sorted(range(len(pdf)), key=lambda k: _key(pdf["rank"].iloc[k]))
        for k in order:
            own = [_key(r) for r in pdf["resources"].iloc[k]]
            if used.isdisjoint(own):
                used.update(own)
                keep.append(k)
        return pdf.iloc[keep][by]

    rest = rest.groupBy(*within).applyInPandas(walked, ", ".join(f"{c} {kinds[c]}" for c in by))
    return rest if taken is None else taken.unionByName(rest)


def matched(pairs: DataFrame, within: list[str], held: int = HELD) -> DataFrame:
    """(within, item, other) of items that choose in their order, each the best of its others that no earlier item took.

    pairs: within, item (orderable), other, cost (orderable, unique for each item). A pair is certain if the other is the item's best and the
    item the first of the other's; rounds take all such pairs at once and drop what they use. As soon as each group fits one task, the rest is walked.
    """
    left, taken = graph.written(pairs.select(*within, "item", "other", "cost"), "pairs"), None
    while True:
        most = left.groupBy(*within).count().agg(F.max("count")).first()[0] or 0
        if most <= held:
            break
        best = left.groupBy(*within, "item").agg(F.min("cost").alias("cost"))
        first = left.groupBy(*within, "other").agg(F.min("item").alias("item"))
        sure = graph.written(left.join(best, [*within, "item", "cost"]).join(first, [*within, "other", "item"]).select(*within, "item", "other"), "matched")
        left = graph.written(left.join(sure.select(*within, "item"), [*within, "item"], "left_anti").join(sure.select(*within, "other"), [*within, "other"], "left_anti"), "pairs")
        taken = sure if taken is None else taken.unionByName(sure)
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}

    def walked(pdf):
        done, keep = (set(), set()), []
        rows = [(_key(i), _key(c), _key(o)) for i, c, o in zip(pdf["item"], pdf["cost"], pdf["other"])]
        for k in sorted(range(len(rows)), key=lambda k: rows[k][:2]):
            item, _, other = rows[k]
            if item not in done[0] and other not in done[1]:
                done[0].add(item)
                done[1].add(other)
                keep.append(k)
        return pdf.iloc[keep][[*within, "item", "other"]]

    rest = left.groupBy(*within).applyInPandas(walked, ", ".join(f"{c} {kinds[c]}" for c in [*within, "item", "other"]))
    return rest if taken is None else taken.unionByName(rest)


def _key(value):
    """A struct or a plain value as something that sorts, nulls first, and hashes."""
    if hasattr(value, "asDict"):
        return tuple(_key(v) for v in value)
    if isinstance(value, dict):
        return tuple(_key(v) for v in value.values())
    return (value is not None, value)
