import random

from planar.operators import spatial

SCHEMA = "doc_id long, element_ord long, element_id string, kind string, layer_id string, net_id string, component_id string, left double, top double, right double, bottom double, is_visible boolean"


def board(spark, boxes):
    return spark.createDataFrame([(1, k, f"e{k}", "Pad", "top" if k % 2 else "bottom", f"n{k % 3}", None, *map(float, b), True) for k, b in enumerate(boxes)], SCHEMA)


def test_grid_join_equals_brute_force(spark):
    rnd = random.Random(5)
    boxes = [(x, y, x + rnd.choice([0, 1, 30, 400]), y + rnd.choice([0, 2, 90])) for x, y in ((rnd.uniform(-200, 200), rnd.uniform(-200, 200)) for _ in range(200))]
    asked = [(k, *b) for k, b in enumerate((x, y, x + rnd.choice([0, 5, 300]), y + 7) for x, y in ((rnd.uniform(-200, 200), rnd.uniform(-200, 200)) for _ in range(60)))]
    q = spark.createDataFrame(asked, "query_id int, ql double, qt double, qr double, qb double")
    got = sorted((r.query_id, r.element_id) for r in spatial.grid_join(q, board(spark, boxes)).collect())
    want = sorted((k, f"e{i}") for k, l, t, r, b in asked for i, (a, c, d, e) in enumerate(boxes) if a <= r and d >= l and c <= b and e >= t)
    assert got == want


def test_dense_cells_become_quadtrees(spark):
    """Half of a board in one cell, some of it at one place, with boxes over all of it; tasks of the join stay small."""
    rnd = random.Random(9)
    spots = [(rnd.uniform(2, 3), rnd.uniform(2, 3)) for _ in range(150)] + [(2.5, 2.5)] * 60 + [(rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for _ in range(150)]
    boxes = [(x, y, x + w, y + w) for x, y in spots for w in (rnd.choice([0, 0.01, 0.3]),)] + [(-60, -60, 60, 60), (2, 2, 3, 3), (0, 0, 10, 10)]
    asked = [(k, x, y, x + w, y + w) for k in range(80) for x, y in (rnd.choice(spots),) for w in (rnd.choice([0, 0.02, 0.5, 90]),)]
    q = spark.createDataFrame([tuple(map(float, b)) for b in asked], "query_id double, ql double, qt double, qr double, qb double")
    want = sorted((k, f"e{i}") for k, l, t, r, b in asked for i, (a, c, d, e) in enumerate(boxes) if a <= r and d >= l and c <= b and e >= t)
    for dense, halvings in ((30, 12), (30, 2), (10**6, 12)):
        got = sorted((r.query_id, r.element_id) for r in spatial.grid_join(q, board(spark, boxes), dense=dense, halvings=halvings, sampled=1.0).collect())
        assert got == want


def test_nearest_and_filters(spark):
    e = board(spark, [(1, 1, 3, 3), (3, 1, 5, 3), (40, 40, 41, 41)])
    assert [r.element_id for r in spatial.near(e, 2.0, 2.0, 5.0, 1).collect()] == ["e0"]
    assert [r.element_id for r in spatial.attribute_filter(e, layers=["top"], nets=["n1"]).collect()] == ["e1"]
    assert spatial.attribute_filter(e, components=["c1"]).count() == 0


def test_pad_neighbors_brute_force(spark):
    rnd = random.Random(7)
    pts = [(k % 2, k, rnd.uniform(-9, 9), rnd.uniform(-9, 9), 1.0, 1.0) for k in range(150)]
    df = spark.createDataFrame(pts, "doc_id long, element_ord long, cx double, cy double, w double, h double")
    from pyspark.sql import functions as F

    got = {(r.element_ord, r.b_element_ord) for r in spatial.pad_neighbors(df, F.lit(1.7), 2.0).collect()}
    assert got == {(a[1], b[1]) for a in pts for b in pts if a[1] != b[1] and a[0] == b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 1.7**2}


def test_statistics(spark):
    s = spatial.index_statistics(board(spark, [(k, k, k + 1, k + 1) for k in range(100)]), 0.0, 0.0, 20.0, 20.0, 4.0).first()
    assert s["items"] == 100 and s.hits == 21 and s.candidates >= s.hits and s.cells > 0


def test_mutations(spark):
    log = [(1, 1, "add", "A", 0.0), (1, 2, "add", "A", 5.0), (1, 3, "update", "A", 10.0), (1, 4, "update", "A", 10.0), (1, 5, "remove", "B", 0.0), (1, 6, "add", "B", 1.0), (1, 7, "remove", "B", 0.0)]
    df = spark.createDataFrame([(d, s, o, i, x, x, x + 1, x + 1) for d, s, o, i, x in log], "doc_id int, seq int, op string, element_id string, left double, top double, right double, bottom double")
    problems = [(r.seq, r.problem) for r in spatial.mutation_log(df).where("problem IS NOT NULL").collect()]
    assert problems == [(2, "already indexed")]
    state, version = spatial.mutation_fold(df)
    assert [tuple(r) for r in state.collect()] == [(1, "A", 10.0, 10.0, 11.0, 11.0)]
    assert tuple(version.first()) == (1, 4, 1)


def test_aligned_tile_edge_counts_the_next_column(spark):
    v = spark.createDataFrame([(1, 2000.0, 600.0, 0.0, 0.0, 512.0, 100.0), (2, 512.0, 600.0, 0.0, 0.0, 512.0, 100.0), (3, 100.0, 100.0, 200.0, 0.0, 300.0, 50.0)], "view_id int, page_width double, page_height double, left double, top double, right double, bottom double")
    got = sorted((r.view_id, r.tile_x, r.tile_y, r.tile_width) for r in spatial.visible_tiles(v).collect())
    assert got == [(1, 0, 0, 512.0), (1, 1, 0, 512.0), (2, 0, 0, 512.0)]
