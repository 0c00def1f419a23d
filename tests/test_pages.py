"""Page vectors walked by tasks against the distributed kernel, and contours in arrays against the fold over their commands."""

import random

import numpy as np
import pyarrow as pa
import pytest

from planar.operators import graph, paths, topology, walks

POINTS = "array<struct<x:double,y:double>>"


def drawing(rnd, files, paths_):
    """Commands and styles: lattices with moved ends, parallels, turned rectangles, curves and closes."""
    commands, styles = [], []
    for path in range(paths_):
        file, page, move = path % files, rnd.choice((1, 2)), rnd.choice((0, 0, 0.004, 0.006, 0.009))
        turn = file % 2
        at = lambda x, y: ((x * 0.8 - y * 0.6) if turn else x + move, (x * 0.6 + y * 0.8) if turn else y)  # noqa: B023, E731
        n, x, y = 0, rnd.randrange(4), rnd.randrange(4)
        rows = [("move", [at(x, y)])]
        for dx, dy in rnd.choice(([(1, 0), (0, 1), (-1, 0)], [(0, 1)], [(1, 0)], [(1, 1), (2, 0)], [(1, 0), (0, 1)])):
            x, y = x + dx, y + dy
            rows.append(("line", [at(x, y)]))
        if rnd.random() < 0.2:
            rows.append(("curve", [(x + 1.0, y), (x, y + 1.0), (x + 2.0, y)]))
        if rnd.random() < 0.5:
            rows.append(("close", []))
        if rnd.random() < 0.3:
            rows += [("move", [at(x, y)]), ("line", [at(x + 1, y)])]
        commands += [(file, page, path, n, op, [(float(u), float(v)) for u, v in p]) for n, (op, p) in enumerate(rows)]
        styles.append((file, page, path, rnd.choice((0.0, 0.25)), True, False, None, None))
    return commands, styles


@pytest.fixture(scope="module")
def drawn(spark):
    commands, styles = drawing(random.Random(5), 4, 900)
    c = spark.createDataFrame(commands, f"file long, page int, path long, n int, op string, points {POINTS}")
    return c, spark.createDataFrame(styles, "file long, page int, path long, width double, is_stroked boolean, is_filled boolean, stroke_color string, fill_color string")


def plain(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_walked_graphs_equal_the_kernel(spark, drawn, monkeypatch):
    labels, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: labels.append(label) or write(df, label))
    walked = paths.PageVectors(*drawn)
    lines, counters = plain(walked.lines()), plain(walked.counters())
    assert labels == ["contours"]  # no ends, nodes, edges or segments on disk
    joined = paths.PageVectors(*drawn, held=0)
    assert joined.kernel is not None and {"segments", "points", "edges"} <= set(labels)
    some = paths.PageVectors(*drawn, held=170)  # graphs of both kinds
    assert some.kernel is not None and not some.small.isEmpty()
    for other in (joined, some):
        assert plain(other.lines()) == lines and plain(other.counters()) == counters
        assert plain(other.graphics) == plain(walked.graphics)
    kinds = [r.source for r in walked.graphics.collect()]
    assert min(kinds.count(k) for k in ("rectangle", "rotated-rectangle", "line", "bezier")) > 20
    assert len({(r.file, r.page, r.graphic_id) for r in walked.graphics.collect()}) == len([k for k in kinds])


def test_rectangles_in_steps_equal_those_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    a, d = rng.integers(0, 8, (2, 900)).astype(float), rng.integers(0, 2, 900)
    seg = (a[0], a[1], a[0] + d * rng.integers(1, 4, 900), a[1] + (1 - d) * rng.integers(1, 4, 900))
    once = walks.rectangles(*seg, topology.Limits())
    monkeypatch.setattr(walks, "PATHS", 50)
    assert len(once[2]) > 20 and all(np.array_equal(p, q) for p, q in zip(once, walks.rectangles(*seg, topology.Limits())))


def test_contours_in_arrays_equal_the_fold():
    """Random commands in batches that cut paths; some lack points, coordinates or a known operation."""
    rnd = random.Random(7)
    point = lambda odd: {"x": rnd.choice((0.0, 1.0, 2.0, 1.00005, *((None, float("nan"), float("inf")) if odd else ()))), "y": rnd.choice((0.0, 1.0))}
    rows, want = [], []
    for path in range(1500):
        odd, number, contours = path % 3 == 0, 0, [[]]
        for k in range(rnd.randrange(1, 12)):
            op = rnd.choice(("move", "line", "line", "curve", "close", *(("jump", None) if odd else ())))
            points = None if odd and rnd.random() < 0.1 else [point(odd) for _ in range({"curve": 3, "close": 0}.get(op, 1) - (odd and rnd.random() < 0.2))]
            rows.append((path, k + 1, op, points))
            if op == "move":
                contours.append([])
            contours[-1].append({"op": op, "points": points})
        for c in contours:
            p, curves, closed = walks._folded(c, 1e-4)
            if c and (len(p) > 1 or curves):
                number += 1
                want.append(repr((path, number, p, closed, curves, len(p))))
    schema = pa.schema([("path", pa.int64()), ("row", pa.int32()), ("op", pa.string()), ("points", pa.list_(walks.POINT))])
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    got = [repr((r["path"], r["contour"], r["points"], r["is_closed"], r["curves"], r["size"])) for b in walks.contours(("path",), 1e-4)(table.to_batches(max_chunksize=7)) for r in b.to_pylist()]
    assert sorted(got) == sorted(want) and len(want) > 1000
