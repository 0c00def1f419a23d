"""Choices in order: rounds and walks give what a loop gives."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from planar.operators import classify, greedy, recognize


@pytest.mark.parametrize("held", [greedy.HELD, 40, 0])
def test_first_come(spark, held):
    rnd = random.Random(1)
    uses = [(g, (rnd.random(), k), r) for g in range(3) for k in range(60) for r in rnd.sample(range(80), rnd.randint(1, 4))]
    uses += [(7, (0.5, k), k + d) for k in range(50) for d in (0, 1)]  # a chain, met in order
    uses += [(8, (rnd.random(), k), -1) for k in range(50)]  # one resource for all
    df = spark.createDataFrame([(g, {"x": x, "k": k}, r) for g, (x, k), r in uses], "grp int, rank struct<x:double,k:int>, resource int")
    got = sorted((r.grp, tuple(r["rank"])) for r in greedy.first_come(df, ["grp"], held).collect())
    want = []
    for g, rows in itertools.groupby(sorted(uses), key=lambda u: u[0]):
        used = set()
        for rank, rest in itertools.groupby(rows, key=lambda u: u[1]):
            own = {r for _, _, r in rest}
            if used.isdisjoint(own):
                used |= own
                want.append((g, rank))
    assert got == sorted(want)


@pytest.mark.parametrize("held", [greedy.HELD, 30, 0])
def test_matched(spark, held):
    rnd = random.Random(2)
    pairs = [(g, i, o, rnd.randint(0, 5)) for g in range(4) for i in range(30) for o in rnd.sample(range(40), 6)]
    df = spark.createDataFrame(pairs, "grp int, item int, other int, d int").select("grp", "item", "other", F.struct("d", "other").alias("cost"))
    got = sorted(map(tuple, greedy.matched(df, ["grp"], held).select("grp", "item", "other").collect()))
    want, taken = [], set()
    for g, i in sorted({p[:2] for p in pairs}):
        free = sorted((d, o) for h, j, o, d in pairs if (h, j) == (g, i) and (g, o) not in taken)
        if free:
            taken.add((g, free[0][1]))
            want.append((g, i, free[0][1]))
    assert got == want


def test_size_groups_within_the_tolerance(spark):
    """Sizes that differ by less than 12 %, chains of them, and sides of nothing."""
    rnd = random.Random(3)
    rows = [(d, k, rnd.choice(("Circle", "Oval")), *(rnd.choice((1.0, 1.05, 1.1, 1.13, 1.2, 1.3, 1.36, 2.0, 0.0, 1e-7)) for _ in "wh")) for d in range(6) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, element_ord long, shape string, w double, h double")
    got = {(r.doc_id, r.element_ord): r.group for r in classify.size_groups(df).collect()}
    alike = lambda a, b: min(a, b) / max(1e-6, max(a, b)) >= 0.88
    for d in range(6):
        own = [r for r in rows if r[0] == d]
        sizes = sorted({(w * h, min(k for _, k, s2, w2, h2 in own if (s2, w2, h2) == (s, w, h)), s, w, h) for _, _, s, w, h in own})
        heads, of = [], {}
        for _, _, s, w, h in sizes:
            k = next((k for k, (t, a, b) in enumerate(heads) if t == s and alike(a, w) and alike(b, h)), len(heads))
            heads += [(s, w, h)] if k == len(heads) else []
            of[s, w, h] = k
        assert {k: got[d, k] for _, k, *_ in own} == {k: of[s, w, h] for _, k, s, w, h in own}
        assert len(heads) < len(sizes)


def test_duplicates_go_in_order(spark):
    """A pad whose better rival went itself stays; unknown layers are met first."""
    rows = [(1, k, None if k % 3 else "top", 0.9 - k % 5 * 0.01, x, 0.0, 1.0, 1.0, 0.0, 0.0) for k, x in enumerate(i * 0.11 for i in range(40))]
    p = spark.createDataFrame(rows, "doc_id long, element_ord long, layer_id string, confidence double, cx double, cy double, w double, h double, top double, left double")
    got = sorted(r.element_ord for r in classify.distinct_pads(p).collect())
    stay = []
    for r in sorted(rows, key=lambda r: (-r[3], r[6] * r[7], r[5], r[4], r[2] is not None, r[2] or "", r[1])):
        if all(abs(r[4] - s[4]) > 0.18 for s in stay):
            stay.append(r)
    assert got == sorted(s[1] for s in stay)


def test_mirrored_pads_of_a_large_cluster(spark):
    n, m = 50, 40
    rows = [(1, 7, i * m + j, float(i), float(j), 0.5, 0.5, i - 0.25, j - 0.25, i + 0.25, j + 0.25) for i in range(n) for j in range(m) if (i, j) not in ((3, 4), (10, 0), (49, 0))]
    c = spark.createDataFrame(rows, "doc_id long, cluster long, element_ord long, cx double, cy double, w double, h double, left double, top double, right double, bottom double")
    there = {r[3:5] for r in rows}
    want = sum((n - 1 - x, m - 1 - y) in there for x, y in there)
    got = recognize.metrics(c).first()
    assert got.pads == len(rows) and got.symmetry == want / len(rows) and (got.rows, got.columns) == (m, n)
