"""The kernel of segments against a plain loop over them in their order."""

import itertools
import math
import random

import pytest

from planar.operators import greedy, topology

SEG = "doc_id long, seg_ord long, segment_id string, group_key string, x1 double, y1 double, x2 double, y2 double"


def plain(rows, limits):
    """One document: accepted rectangles (group, edge ids, aligned) and the counters. rows: (ord, id, group, x1, y1, x2, y2)."""
    accepted, gone, count = [], set(), dict.fromkeys(topology.COUNTERS, 0)
    span = lambda p, q: math.hypot(q[0] - p[0], q[1] - p[1])
    rows = sorted(rows)
    for group in dict.fromkeys(r[2] for r in rows):
        places, cells, edges = [], {}, []
        for _, name, g, x1, y1, x2, y2 in rows:
            if g != group or math.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) < limits.edge:
                continue
            two = []
            for p in ((x1, y1), (x2, y2)):
                kx, ky = round(p[0] / limits.snap), round(p[1] / limits.snap)
                near = [cells[c] for c in itertools.product((kx - 1, kx, kx + 1), (ky - 1, ky, ky + 1)) if c in cells and span(places[cells[c]], p) <= limits.snap]
                if not near:
                    cells[kx, ky] = len(places)
                    places.append(p)
                two.append(near[0] if near else len(places) - 1)
            if two[0] != two[1]:
                edges.append((name, *two))
        first = {}
        for k, (name, u, v) in enumerate(edges):
            first.setdefault(frozenset((u, v)), (k, name))
        beside = {n: list(dict.fromkeys(v if u == n else u for _, u, v in edges if n in (u, v))) for n in range(len(places))}
        seen = set()
        for a in range(len(places)):
            for b, d in itertools.combinations(beside[a], 2):
                for c in beside[b]:
                    if c == a or c not in beside[d] or (cycle := frozenset(map(frozenset, ((a, b), (b, c), (c, d), (d, a))))) in seen:
                        continue
                    seen.add(cycle)
                    count["cycles"] += 1
                    p = [places[n] for n in (a, b, c, d)]
                    s = [(p[(k + 1) % 4][0] - p[k][0], p[(k + 1) % 4][1] - p[k][1]) for k in range(4)]
                    n = [math.hypot(*v) for v in s]
                    along = lambda v, w: abs(s[v][0] * s[w][1] - s[v][1] * s[w][0])
                    square = lambda v, w: abs(s[v][0] * s[w][0] + s[v][1] * s[w][1]) / (n[v] * n[w]) <= limits.angle
                    even = lambda v, w: abs(n[v] - n[w]) <= max(limits.snap, limits.angle * max(n[v], n[w]))
                    good = min(n) >= limits.edge and square(0, 1) and square(1, 2) and all(along(v, v + 2) / (n[v] * n[v + 2]) <= limits.angle and even(v, v + 2) for v in (0, 1)) and along(0, 1) >= limits.area
                    ids = [first[frozenset(e)][1] for e in ((a, b), (b, c), (c, d), (d, a))]
                    if good and gone.isdisjoint(ids):
                        gone.update(ids)
                        flat = [(abs(v[1]) <= limits.snap, abs(v[0]) <= limits.snap) for v in s]
                        accepted.append((group, tuple(ids), (flat[0][0] and flat[1][1]) or (flat[0][1] and flat[1][0])))
        count["nodes"] += len(places)
        count["edges"] += len(edges)
    left = [r[1] for r in rows if math.sqrt((r[5] - r[3]) ** 2 + (r[6] - r[4]) ** 2) >= limits.edge and r[1] not in gone]
    count |= {"input": len(rows), "discarded": len(rows) - count["edges"], "accepted": len(accepted), "rejected": count["cycles"] - len(accepted), "consumed": len(gone), "remaining": len(left)}
    return accepted, left, count


def lattice(rnd, n, jitter, tilt=0.0):
    """Edges of a lattice in any order, ends moved by the jitters, with pendants, parallel edges, diagonals and stubs."""
    rows = []
    for k in range(n):
        x, y = rnd.randrange(3), rnd.randrange(3)
        dx, dy = rnd.choice([(1, 0), (0, 1)] * 6 + [(1, 1), (2, 0), (0.004, 0), (0.009, 0)])
        ends = [(x, y), (x + dx, y + dy)]
        rnd.shuffle(ends)
        (x1, y1), (x2, y2) = [(px + tilt * py + rnd.choice(jitter), py) for px, py in ends]
        rows.append((k, f"s{k}", rnd.choice("gh"), float(x1), float(y1), float(x2), float(y2)))
    return rows


CASES = [((0,), 0.0), ((0, 0.004, 0.006), 0.0), ((0, 0.008, 0.016), 0.0), ((0,), 0.03), ((0, 0.004), 0.05)]


@pytest.mark.parametrize("held", [greedy.HELD, 0])
def test_kernel_equals_a_loop(spark, held):
    rnd = random.Random(3)
    drawings = {doc: lattice(rnd, 70, *CASES[doc % len(CASES)]) for doc in range(10)}
    # by key the first two ends here are one node, by the first come they are two
    drawings[10] = [(0, "s0", "g", 0.004, 0.0, 3.0, 0.0), (1, "s1", "g", 0.006, 0.0, 0.0, 4.0), (2, "s2", "g", 0.015, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame([(doc, o, i, g, *c) for doc, rows in drawings.items() for o, i, g, *c in rows], SEG)
    k = topology.Kernel(df, held=held)
    got, left = {}, {}
    for r in k.numbered().orderBy("doc_id", "rectangle_no").collect():
        got.setdefault(r.doc_id, []).append((r.group_key, tuple(r.edge_ids), r.axis_aligned))
    for r in k.remaining().orderBy("doc_id", "seg_ord").collect():
        left.setdefault(r.doc_id, []).append(r.segment_id)
    counters = {r.doc_id: {c: r[c] for c in topology.COUNTERS} for r in k.counters().collect()}
    some = 0
    for doc, rows in drawings.items():
        accepted, rest, count = plain(rows, topology.Limits())
        assert (got.get(doc, []), left.get(doc, []), counters[doc]) == (accepted, rest, count), doc
        some += len(accepted)
    assert some > 20


def test_discovery_goes_by_nodes(spark):
    rows = [(1, 0, 1, -1), (0, 0, 0, 1), (1, 0, 2, 0), (0, 0, 1, 0), (1, 0, 1, 1), (0, 1, 1, 1), (2, 0, 2, 1), (1, 1, 2, 1)]
    df = spark.createDataFrame([(1, k, f"{k + 1}", "g", *map(float, r)) for k, r in enumerate(rows)], SEG)
    kept, _ = topology.kernel(df)
    assert [sorted(r.edge_ids) for r in kept.collect()] == [["3", "5", "7", "8"]]


def test_empty(spark):
    k = topology.Kernel(spark.createDataFrame([], SEG))
    assert k.numbered().count() == k.remaining().count() == k.counters().count() == 0
