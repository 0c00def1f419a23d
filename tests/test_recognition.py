import random

from planar.operators import classify, recognize, semantic
from planar.sources.templates import TEMPLATES

E = "doc_id long, element_ord long, element_id string, kind string, layer_id string, shape string, is_filled boolean, is_closed boolean, left double, top double, right double, bottom double, text string"


def board(spark, rows):
    return spark.createDataFrame([(1, k, f"e{k}", kind, layer, shape, filled, closed, *map(float, box), text) for k, (kind, layer, shape, filled, closed, box, text) in enumerate(rows)], E)


def rect(box, filled=True):
    return ("Rectangle", "doc", None, filled, True, box, None)


def judged(e):
    limits = classify.size_limits(e)
    prims = classify.classified(e)
    return limits, prims, classify.candidates(prims, limits)


def test_pad_detection(spark):
    e = board(spark, [rect((9, 10, 11, 12)), rect((15, 10, 17, 12)), ("DrillHole", "doc", None, False, True, (29.25, 29.25, 30.75, 30.75), None), ("Line", "doc", None, False, False, (-0.05, -0.05, 100.05, 100.05), None)])
    limits, prims, j = judged(e)
    assert sorted(r.reason for r in j.collect()) == ["None", "None", "UnsupportedGeometry"]
    assert {round(r.confidence, 9) for r in j.where("reason = 'None'").collect()} == {1.0}
    pads = classify.distinct_pads(j.where("reason = 'None'"))
    assert pads.count() == 2 and classify.holes(e, pads, limits).count() == 1 and classify.vias(pads).count() == 0
    f = recognize.low_level_footprints(pads, limits).collect()
    assert [(r["class"], r.pads) for r in f] == [("2-PAD", 2)]


def test_repeated_outlines_are_pads(spark):
    e = board(spark, [("Polyline", "doc", None, False, True, (10, 10, 12, 11), None), ("Polyline", "doc", None, False, True, (14, 10, 16, 11), None), ("Line", "doc", None, False, False, (0, 0, 100, 100), None)])
    _, prims, j = judged(e)
    assert [(r.primitive, r.repetition, r.aligned, round(r.confidence, 2), r.reason) for r in j.collect()] == [("OutlineRectangle", 2, 1, 0.74, "None")] * 2


def test_donut(spark):
    ring = lambda r: ("Ellipse", "doc", None, True, True, (5 - r, 5 - r, 5 + r, 5 + r), None)
    e = board(spark, [ring(2), ring(1), ring(0.3)])
    got = {r.element_id: r.primitive for r in classify.donuts(classify.primitives(e)).collect()}
    assert got == {"e0": "Donut", "e1": "Donut", "e2": "FilledEllipse"}


def test_duplicates_equal_a_plain_loop(spark):
    rnd = random.Random(3)
    rows = [rect((x, y, x + w, y + 1)) for x, y, w in ((rnd.uniform(0, 6), rnd.uniform(0, 6), rnd.choice([1, 1.1, 1.5])) for _ in range(120))]
    _, _, j = judged(board(spark, rows))
    ok = j.where("reason = 'None'").collect()
    order = sorted(ok, key=lambda r: (-r.confidence, r.w * r.h, r.cy, r.cx, r.layer_id, r.top, r.left, r.element_ord))
    keep = []
    for p in order:
        near = lambda q: ((p.cx - q.cx) ** 2 + (p.cy - q.cy) ** 2) ** 0.5 <= max(0.005, min(p.w, q.w) * 0.18)  # noqa: B023, E731
        like = lambda q: min(p.w, q.w) / max(p.w, q.w) * min(p.h, q.h) / max(p.h, q.h) >= 0.78  # noqa: B023, E731
        if not any(near(q) and like(q) for q in keep):
            keep.append(p)
    got = classify.distinct_pads(j.where("reason = 'None'")).collect()
    assert {r.element_ord for r in got} == {r.element_ord for r in keep} and len(keep) < len(ok)


def pads(spark, at, w=0.6, h=1.2):
    rows = [(1, k, x, y, w, h, x - w / 2, y - h / 2, x + w / 2, y + h / 2, "Rectangle", 1.0) for k, (x, y) in enumerate(at)]
    return spark.createDataFrame(rows, "doc_id long, element_ord long, cx double, cy double, w double, h double, left double, top double, right double, bottom double, shape string, confidence double")


def test_two_rows_become_two_connectors_and_take_the_text(spark):
    p = pads(spark, [(k * 1.27, y) for y in (0.0, 4.0) for k in range(4)])
    solved = recognize.metrics(recognize.clustered(p))
    got = solved.orderBy("number").collect()
    assert [(r.pads, r.rows, r.columns, round(r.pitch_x, 6), r.symmetry) for r in got] == [(4, 1, 4, 1.27, 1.0)] * 2
    found = recognize.footprints(solved)
    assert {(r.family, r.name, r.accepted) for r in found.collect()} == {("Ffc", "FFC-4", True)}
    text = spark.createDataFrame([(1, 99, " U1 ", 1.9, 1.0, 3.1, 2.0), (1, 98, "note", 1.0, 1.0, 2.0, 2.0)], "doc_id long, element_ord long, text string, left double, top double, right double, bottom double")
    c = recognize.components(found, text).orderBy("component_id").collect()
    assert [(r.component_id, r.reference) for r in c] == [("component-0001", "U1"), ("component-0002", "X0002")]
    assert c[0].confidence == 1.0 and 0.7 < c[1].confidence < 0.8


def test_templates():
    assert len(TEMPLATES) == 10 and TEMPLATES[0]["name"] == "CHIP-2" and TEMPLATES[0]["min_pads"] == 2


def test_semantics(spark):
    e = board(spark, [("Pad", "cu", "Circle", False, True, (1.5, 1.5, 2.5, 2.5), None), ("Via", "cu", None, False, True, (3.5, 1.5, 4.5, 2.5), None), ("Text", "doc", None, False, False, (0, 0, 1, 1), "R1"), ("Rectangle", "cu", None, False, True, (8, 8, 9, 9), None), ("Arc", "doc", None, False, False, (0, 0, 20, 20), None)])
    layers = e.select("doc_id").distinct().join(spark.createDataFrame([("cu", "Copper"), ("doc", "Document")], "layer_id string, layer_type string"))
    limits, prims, j = judged(e)
    p = classify.distinct_pads(j.where("reason = 'None'"))
    got = {r.element_id: r.semantic for r in semantic.semantics(e, layers, p, classify.vias(p), classify.holes(e, p, limits), prims).collect()}
    assert got == {"e0": "Pad", "e1": "Via", "e2": "Text", "e3": "Copper", "e4": "Silkscreen"}


def grown(p, limits, most=512):
    """Groups of a whole document's pads (rows in order), each grown from its first unseen pad."""
    import statistics

    median = statistics.median(max(r.w, r.h) for r in p)
    short = min(limits.doc_w, limits.doc_h)
    reach = max(median * 4.5, short * 0.0015)
    span, free, out = max(reach * 12, short * 0.06), set(range(len(p))), []
    for seed in range(len(p)):
        if seed not in free:
            continue
        free.discard(seed)
        group, at, box = [seed], 0, [p[seed].left, p[seed].top, p[seed].right, p[seed].bottom]
        while at < len(group) and len(group) < most:
            k, at = group[at], at + 1
            for c in range(len(p)):
                if c not in free or ((p[c].cx - p[k].cx) ** 2 + (p[c].cy - p[k].cy) ** 2) ** 0.5 > reach:
                    continue
                new = [min(box[0], p[c].left), min(box[1], p[c].top), max(box[2], p[c].right), max(box[3], p[c].bottom)]
                a, b = (p[seed].w * p[seed].h) ** 0.5, (p[c].w * p[c].h) ** 0.5
                if new[2] - new[0] > span or new[3] - new[1] > span or max(a, b) / min(a, b) > 2.75:
                    continue
                free.discard(c)
                group.append(c)
                box = new
        if len(group) > 1:
            out.append((len(out) + 1, len(group), round(box[0], 6), round(box[3], 6)))
    return median, out


def test_low_level_footprints_equal_a_whole_document(spark):
    """Grown by component, against a loop over all pads of a document."""
    rnd = random.Random(9)
    spots = [(rnd.uniform(0, 200), rnd.uniform(0, 200)) for _ in range(9)]
    rows = []
    for x, y in spots + [(150 + k * 0.4, 150) for k in range(60)]:
        for _ in range(rnd.randint(1, 7)):
            cx, cy, w = x + rnd.uniform(-5, 5), y + rnd.uniform(-5, 5), rnd.choice([1, 1, 1.2, 4])
            rows.append(rect((cx - w / 2, cy - 0.5, cx + w / 2, cy + 0.5)))
    limits, _, j = judged(board(spark, rows))
    pads = classify.distinct_pads(j.where("reason = 'None'"))
    own = sorted(pads.collect(), key=lambda r: (r.cy, r.cx, r.element_ord))
    median, want = grown(own, limits.first())
    pad = max(0.02, median * 0.35)
    got = recognize.low_level_footprints(pads, limits).orderBy("footprint_no").collect()
    assert [(r.footprint_no, r.pads, round(r.left + pad, 6), round(r.bottom - pad, 6)) for r in got] == want and len(want) > 5
