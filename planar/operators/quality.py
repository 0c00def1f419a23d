"""Checks of the document model, and the trace of a net. Keys are looked up within a row's own document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planar.functions import geometry as g

#: code -> (part, rule): issues stand by part (document, pages, elements, components), then row, then rule.
ORDER = {"CORE001": (0, 0), "CORE006": (1, 0), "CORE007": (1, 1), "CORE002": (2, 0), "CORE003": (2, 1), "CORE004": (2, 2), "CORE005": (3, 0)}


def issue(rows: DataFrame, code: str, row: str | None, subject: str | None, severity: str = "Error", at: str | None = None) -> DataFrame:
    """Issues of one code: doc_id, severity, code, subject, and where they stand among others (part, row, rule, at)."""
    part, rule = ORDER[code]
    column = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
    return rows.select(
        "doc_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), column(subject, "string").alias("subject"),
        F.lit(part).alias("part"), F.coalesce(column(row, "long"), F.lit(0)).alias("row"), F.lit(rule).alias("rule"), F.coalesce(column(at, "long"), F.lit(0)).alias("at"),
    )


def missing(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key their document's `other` lacks."""
    return rows.where(F.col(key).isNotNull()).join(other.select("doc_id", key), ["doc_id", key], "left_anti")


def validate(documents: DataFrame, elements: DataFrame, layers: DataFrame, nets: DataFrame, components: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues (doc_id, issue_ord, severity, code, subject) of each document, one for each broken rule and row.

    documents: doc_id. components: component_id, ord and element_ids. pages: number, width, height and layer_ids."""
    on_pages = pages.select("doc_id", "number", F.posexplode("layer_ids").alias("at", "layer_id"))
    listed = components.select("doc_id", "component_id", "ord", F.posexplode("element_ids").alias("at", "element_id"))
    found = [
        issue(documents.join(layers, "doc_id", "left_anti"), "CORE001", None, None),
        issue(pages.where("width <= 0 OR height <= 0"), "CORE006", "number", "number"),
        issue(missing(on_pages, layers, "layer_id"), "CORE007", "number", "number", at="at"),
        issue(elements.where(g.is_empty()), "CORE002", "element_ord", "element_id", "Warning"),
        issue(missing(elements, layers, "layer_id"), "CORE003", "element_ord", "element_id"),
        issue(missing(elements, nets, "net_id"), "CORE004", "element_ord", "element_id"),
        issue(missing(listed, elements, "element_id"), "CORE005", "ord", "component_id", at="at"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    order = Window.partitionBy("doc_id").orderBy("part", "row", "rule", "at", "subject")
    return out.select("doc_id", F.row_number().over(order).alias("issue_ord"), "severity", "code", "subject")


def is_valid(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id").agg(F.bool_and(F.col("severity") != "Error").alias("valid"), F.count(F.lit(1)).alias("issues"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def net_trace(elements: DataFrame, nets: DataFrame, asked: DataFrame, strict: bool = False) -> DataFrame:
    """The elements and extent of the net that each query of a document (doc_id, query) names by id or name, without regard to case.

    A query must name one net of its document: `matches` tells how many it names, and the trace is null unless that is one. strict makes
    any other number an error."""
    names = F.explode(F.array_distinct(F.array(F.lower("net_id"), F.lower("name"))))
    known = nets.select("doc_id", "net_id", "name", names.alias("key"))
    asked = asked.select("doc_id", "query", F.lower("query").alias("key")).distinct()
    found = asked.join(known, ["doc_id", "key"], "left").groupBy("doc_id", "query").agg(F.count("net_id").alias("matches"), F.first("net_id").alias("net_id"), F.first("name").alias("name"))
    if strict:
        wrong = F.raise_error(F.concat(F.col("query"), F.lit(" names "), F.col("matches"), F.lit(" nets"))).cast("long")
        found = found.withColumn("matches", F.when(F.col("matches") == 1, F.col("matches")).otherwise(wrong))
    one = F.col("matches") == 1
    found = found.select("doc_id", "query", "matches", F.when(one, F.col("net_id")).alias("net_id"), F.when(one, F.col("name")).alias("name"))
    full = ~g.is_empty()
    bound = lambda f, c: f(F.when(full, F.col(c))).alias(c)
    per = elements.where("net_id IS NOT NULL").groupBy("doc_id", "net_id").agg(F.count(F.lit(1)).alias("elements"), bound(F.min, "left"), bound(F.min, "top"), bound(F.max, "right"), bound(F.max, "bottom"))
    return found.join(per, ["doc_id", "net_id"], "left").select("doc_id", "query", "matches", "net_id", "name", F.when(one, F.coalesce("elements", F.lit(0))).alias("elements"), "left", "top", "right", "bottom")
