"""Formats, paths, pages, views, annotations, mutations and meanings over several documents."""

import pytest
from pyspark.sql import functions as F

from planar.functions import geometry as g
from planar.operators import paths, semantic, spatial
from planar.sources import boards, formats, projects


def test_formats_and_readers(spark):
    p = spark.createDataFrame([("a/b.GTL",), ("x.brd",), ("y.gko",), ("z.tar.gz",), ("k.pbr",), ("noext",)], "p string")
    found = p.select("p", formats.detected(F.col("p")).alias("f"), formats.reader(F.col("p")).alias("r")).collect()
    assert [(r.f.format, r.r) for r in found] == [("gerber", "gerber"), ("eagle", "eagle"), (None, "gerber"), (None, None), ("pcb", None), (None, None)]
    with pytest.raises(Exception, match="no reader"):
        p.select(formats.reader(F.col("p"), strict=True)).collect()


def test_document_types(spark):
    texts = ["x", "%PDF-/Encrypt", "%PDF-/XFA Please wait", "%PDF-/XFA", "%PDF-/DotRet/AcroForm /Type /Page /Type /Pages", "%PDF-/AcroForm", "%PDF-"]
    f = boards.inspect(spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string"))
    kinds = [r[0] for r in f.orderBy("doc_id").select(boards.document_type(F.lit(0), F.lit(0))).collect()]
    assert kinds == ["Corrupted", "Protected", "XfaDynamic", "XfaStatic", "Standard", "AcroForm", "ImageOnly"]
    assert f.where("doc_id = 4").first().pages == 1


def test_contours(spark):
    P = lambda *xy: [(float(x), float(y)) for x, y in xy]
    rows = [(1, 0, "move", P((0, 0))), (1, 1, "line", P((4, 0))), (1, 2, "line", P((4, 2))), (1, 3, "line", P((0, 2))), (1, 4, "close", P()), (1, 5, "line", P((9, 9)))]
    rows += [(2, 0, "move", P((0, 0))), (2, 1, "curve", P((1, 1), (2, 1), (3, 0))), (2, 2, "line", P((5, 0))), (2, 3, "move", P((7, 7))), (2, 4, "move", P((8, 8))), (2, 5, "line", P((9, 8)))]
    c = spark.createDataFrame([(1, 1, *r) for r in rows], "file int, page int, path int, n int, op string, points array<struct<x:double,y:double>>")
    got = {(r.path, r.contour): ([tuple(p) for p in r.points], r.is_closed, len(r.curves), r.kind) for r in paths.primitives(paths.contours(c)).collect()}
    assert got[1, 1] == (P((0, 0), (4, 0), (4, 2), (0, 2), (0, 0), (9, 9), (0, 0)), True, 0, "Polyline")
    assert got[2, 1] == (P((0, 0), (3, 0), (5, 0)), False, 1, "Bezier") and got[2, 2] == (P((8, 8), (9, 8)), False, 0, "Line") and (2, 3) not in got
    only = paths.contours(c.where("path = 1 AND n < 5"))
    assert paths.primitives(only).first().kind == "Rectangle"
    assert sorted((r.segment, r.x1, r.y1, r.x2, r.y2) for r in paths.contour_segments(only).collect()) == [(1, 0, 0, 4, 0), (2, 4, 0, 4, 2), (3, 4, 2, 0, 2), (4, 0, 2, 0, 0)]
    assert paths.contours(c.where("false")).count() == 0


def test_zoom_keeps_the_point_below(spark):
    b = spark.createDataFrame([(0.0, 0.0, 40.0, 30.0), (1.0, 1.0, 1.0, 5.0)], "left double, top double, right double, bottom double")
    one, zero, x, y = F.lit(1.0), F.lit(0.0), F.lit(100.0), F.lit(50.0)
    before = g.from_screen(x, y, g.fitted(800.0, 600.0, 10.0, one, zero, zero))
    z = g.zoomed_at(x, y, F.lit(3.0), 800.0, 600.0, 10.0, one, zero, zero)
    after = g.from_screen(x, y, g.fitted(800.0, 600.0, 10.0, z["zoom"], z["pan_x"], z["pan_y"]))
    r = b.select(before[0].alias("a"), after[0].alias("b"), before[1].alias("c"), after[1].alias("d")).first()
    assert r.a == pytest.approx(r.b) and r.c == pytest.approx(r.d)
    with pytest.raises(ValueError, match="0 or more"):
        g.inflate(-1.0)


def test_annotations_by_id(spark):
    p = projects.annotate(projects.annotate(spark.createDataFrame([("p",)], "name string"), "R1", " look ", "open", (1.0, 2.0)), "R1", "again", "open")
    p = spark.createDataFrame(p.collect(), p.schema)
    first, second = p.first().annotations
    assert (first.title, first.position.x) == ("look", 1.0) and first.id != second.id
    left = projects.remove_annotation(p, first.id).first()
    assert left.removed and [a.id for a in left.annotations] == [second.id] and not projects.remove_annotation(p, "none").first().removed
    with pytest.raises(ValueError, match="text"):
        projects.annotate(p, "R1", " ", "open")


def test_clear_counts_once(spark):
    rows = [(1, 1, "add", "a", 0.0), (1, 2, "add", "b", 0.0), (1, 3, "clear", None, None), (1, 4, "clear", None, None), (1, 5, "add", "a", 1.0), (2, 1, "clear", None, None), (2, 2, "add", "a", 0.0)]
    log = spark.createDataFrame([(d, s, op, e, x, x, x, x) for d, s, op, e, x in rows], "doc_id int, seq long, op string, element_id string, left double, top double, right double, bottom double")
    state, versions = spatial.mutation_fold(log)
    assert {(r.doc_id, r.version, r["items"]) for r in versions.collect()} == {(1, 4, 1), (2, 1, 1)}
    batch = spark.createDataFrame([(1, "c"), (1, "d"), (2, "a"), (2, "z"), (3, "q"), (3, "q"), (4, "n")], "doc_id int, element_id string").selectExpr("*", "0D left", "0D top", "0D right", "0D bottom")
    after, versions = spatial.add_range(state, versions, batch)
    assert {(r.doc_id, r.version, r["items"], r.problem) for r in versions.collect()} == {(1, 5, 3, None), (2, 1, 1, "already indexed"), (3, 0, 0, "duplicates in the batch"), (4, 1, 1, None)}
    assert sorted((r.doc_id, r.element_id) for r in after.collect()) == [(1, "a"), (1, "c"), (1, "d"), (2, "a"), (4, "n")]


def test_meanings_use_the_layers_of_their_document(spark):
    e = spark.createDataFrame([(d, k, f"e{k}", "Line", "l", 0.0, 0.0, 1.0, 1.0, False) for d in (1, 2) for k in (0, 1)], "doc_id int, element_ord int, element_id string, kind string, layer_id string, left double, top double, right double, bottom double, is_closed boolean")
    layers = spark.createDataFrame([(1, "l", "Copper"), (2, "l", "Silkscreen")], "doc_id int, layer_id string, layer_type string")
    none = spark.createDataFrame([], "doc_id int, element_ord int, conductive boolean, confidence double")
    got = semantic.semantics(e, layers, none, none, none, none).collect()
    assert sorted((r.doc_id, r.semantic) for r in got) == [(1, "Copper"), (1, "Copper"), (2, "Silkscreen"), (2, "Silkscreen")]


def test_nearest_of_each_document(spark):
    e = spark.createDataFrame([(d, f"e{k}", float(k), 0.0, k + 0.5, 1.0) for d in (1, 2) for k in range(5)], "doc_id int, element_id string, left double, top double, right double, bottom double")
    assert sorted((r.doc_id, r.element_id) for r in spatial.near(e, 2.0, 0.5, 9.0, 1).collect()) == [(1, "e2"), (2, "e2")]
    assert spatial.hit_test(e, 2.0, 0.5, 9.0, 3).count() == 6


def test_a_malformed_number_is_null(spark):
    files = spark.createDataFrame([(1, '(kicad_pcb (segment (start 1.2.3 1.0) (end 2.0 3.0) (layer "F.Cu")(net 1 "N") (width 0.25)))')], "doc_id int, content string")
    assert [r.x1 for r in boards.kicad(files)["tracks"].collect()] in ([None], [])
