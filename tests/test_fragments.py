"""References looked for by the tasks that hold the pages, against the join of runs and references."""

import random

from pyspark.sql import functions as F

from planar.operators import fragments, search

COLUMNS = "role string, file long, page int, n long, text string, left double, bottom double, width double, height double"


def scattered(spark):
    rnd, rows = random.Random(9), []
    for page in range(60):
        left, line = 0.0, 0
        for n in range(rnd.choice((1, 30, 90))):
            left += rnd.choice((4.0, 4.0, 4.0, 40.0))
            line += rnd.random() < 0.05
            rows.append(("ab"[page % 2], page // 4, page % 3, n, rnd.choice(["A", "B", "AB", "_E", "a1", "1", "-", "B_E", "é", "ß", "x.y", None]), left if n % 17 else None, line * 12.0, 3.0, 2.0))
    return spark.createDataFrame(rows, COLUMNS).repartition(7, F.rand(3))  # words of a page come apart


def test_listed_references_equal_joined_ones(spark):
    w = scattered(spark)
    queries = ["AB", "a.b", "ABA", "AB_E", "A1", "a1b", "BB_E", "AAAA", "ßA", "É", "xy", "XYA", "A_E", "A_E_E", "B", "1AB", "ABABAB", "-", "nowhere"]
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    by = ("role", "file", "page")
    listed, joined = search.references(w, q, by=by), search.references(w, q, by=by, listed=0)
    got = sorted(map(tuple, listed.select(*by, "query", "occurrences").collect()))
    assert got == sorted(map(tuple, joined.select(*by, "query", "occurrences").collect())) and len(got) > 300 and listed.schema.names == joined.schema.names
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("ENSURE_REQUIREMENTS") == 1  # words are exchanged once, packed, and hits not at all


def test_words_of_a_page_that_come_apart(spark):
    batch = scattered(spark).where("text IS NOT NULL").orderBy("file", "page", "role", "n").select("role", "file", "page", "n", F.col("text").alias("norm"), *fragments.BOX).toArrow()
    by = ("role", "file", "page")
    rows = [r for b in fragments.packed(by)(batch.to_batches(max_chunksize=11)) for r in b.to_pylist()]
    assert sum(r["words"] for r in rows) == batch.num_rows and len(rows) > len({tuple(r[c] for c in by) for r in rows})


def test_no_references_and_no_words(spark):
    w = scattered(spark)
    none = spark.createDataFrame([("-",)], "query string")
    assert search.references(w, none, by=("role", "file", "page")).count() == 0
    assert search.references(w.where("false"), spark.createDataFrame([("A",)], "query string"), by=("role", "file", "page")).count() == 0


def test_cross_probe_of_listed_references(spark):
    """Both roles in one exchange of packed words; the comparison is that of the joined references."""
    w = scattered(spark).withColumn("role", F.when(F.col("role") == "a", "board").otherwise("schematic"))
    q = spark.createDataFrame([(x,) for x in ("AB", "ABA", "xy", "É", "AAAA", "nowhere")], "query string")
    by = ("role", "file", "page")
    listed = search.references(w, q, by=by)
    got, want = (sorted(map(tuple, search.cross_probe(f, q).collect())) for f in (listed, search.references(w, q, by=by, listed=0)))
    assert got == want and {r[-1] for r in got} >= {"both", "none"}
    assert "Explode" not in (plan := listed._jdf.queryExecution().executedPlan().toString()) and "explode" not in plan  # no row for each run
