"""Assembled contours against a plain loop over them in their order."""

import collections
import random

from pyspark.sql import functions as F

from planar.operators import assembly

TOL = 1e-4
CONTOUR = "doc_id long, group_key string, ord long, points array<struct<x:double,y:double>>, is_closed boolean"


def equal(p, q):
    return abs(p[0] - q[0]) <= TOL and abs(p[1] - q[1]) <= TOL


def plain(contours):
    """Outlines (first contour, points, closed) of one group; contours: (ord, points, closed)."""
    todo = []
    for o, points, closed in sorted(contours):
        kept = []
        for p in points:
            if not kept or not equal(kept[-1], p):
                kept.append(p)
        if len(kept) > 1:
            back = equal(kept[0], kept[-1])
            closed = closed or (len(kept) > 2 and back)
            todo.append((o, kept + kept[:1] if closed and not back else kept, closed or back))
    key = lambda p: (round(p[0] / TOL), round(p[1] / TOL))
    degree = collections.Counter(key(p[k]) for _, p, closed in todo if not closed for k in (0, -1))
    out = []
    while todo:
        o, line, closed = todo.pop(0)
        line = list(line)
        for tail in (True, False):
            while not closed and not equal(line[0], line[-1]) and degree[key(line[-1] if tail else line[0])] == 2:
                at = line[-1] if tail else line[0]
                found = [t for t in todo if equal(at, t[1][0]) or equal(at, t[1][-1])]
                if len(found) != 1:
                    break
                todo.remove(found[0])
                p = found[0][1]
                if equal(at, p[-1]) if tail else equal(at, p[0]):
                    p = p[::-1]
                line = line + p[1:] if tail else p[:-1] + line
        out.append((o, [tuple(map(float, p)) for p in line], closed or (len(line) > 2 and equal(line[0], line[-1]))))
    return out


def drawn(rnd, n, size, unclear):
    """Contours over a lattice of points: some of several points, closed, with ends a little off, and with equal neighbours."""
    rows = []
    for k in range(n):
        p = [(rnd.randrange(size), rnd.randrange(size))]
        for _ in range(rnd.choice((1, 1, 1, 2, 3, 4))):
            dx, dy = rnd.choice(((0, 1), (1, 0), (0, -1), (-1, 0), (0, 0)))
            p.append((p[-1][0] + dx, p[-1][1] + dy))
        p = [(float(x), float(y)) for x, y in p]
        if unclear and rnd.random() < 0.5:
            p[0] = (p[0][0] + rnd.choice((0.00004, 0.00006, 0.00012)), p[0][1])
        rows.append((k, p, rnd.random() < 0.1))
    return rows


def test_assembly_equals_a_loop(spark):
    rnd = random.Random(5)
    groups = {(doc, g): drawn(rnd, rnd.choice((6, 25, 60)), rnd.choice((6, 12, 25)), doc % 3 == 2) for doc in range(12) for g in "gh"}
    # a long line in mixed order and directions, and a circle of many contours
    line = [(k, [(float(k), 0.0), (k + 1.0, 0.0)][:: rnd.choice((1, -1))], False) for k in range(100)]
    ring = [(float(k), 0.0) for k in range(40)] + [(float(k), 9.0) for k in range(39, -1, -1)]
    circle = [(200 + k, [ring[k], ring[(k + 1) % 80]][:: rnd.choice((1, -1))], False) for k in range(80)]
    for rows in (line, circle):
        names = [r[0] for r in rows]
        rnd.shuffle(names)
        rows[:] = [(o, p, c) for o, (_, p, c) in zip(names, rows)]
    groups |= {(90, "line"): line, (91, "circle"): circle}
    df = spark.createDataFrame([(doc, g, o, [{"x": x, "y": y} for x, y in p], c) for (doc, g), rows in groups.items() for o, p, c in rows], CONTOUR)
    found = assembly.chains(df)
    got = collections.defaultdict(list)
    for r in assembly.outlines(found).collect():
        got[r.doc_id, r.group_key].append((r.chain, [tuple(p) for p in r.points], r.is_closed))
    for name, rows in groups.items():
        assert sorted(got[name]) == sorted(plain(rows)), name
    assert len(got[90, "line"]) == 1 and len(got[91, "circle"]) == 1 and got[91, "circle"][0][2]
    places = collections.defaultdict(dict)
    for r in assembly.points(found).where(F.col("doc_id").isin(0, 2, 90)).collect():
        assert r.n not in places[r.doc_id, r.group_key, r.chain]
        places[r.doc_id, r.group_key, r.chain][r.n] = (r.x, r.y)
    for (doc, g, chain), p in places.items():
        assert [p[n] for n in range(len(p))] == next(points for o, points, _ in plain(groups[doc, g]) if o == chain)


def test_empty(spark):
    assert assembly.outlines(assembly.chains(spark.createDataFrame([], CONTOUR))).count() == 0
