from pyspark.sql import functions as F

from planar.functions import geometry as g
from planar.operators import inventory


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_units_affine_rotation(spark):
    x, y = g.affine(g.append((1.0, 0.0, 0.0, 1.0, 10.0, 20.0), (2.0, 0.0, 0.0, 3.0, 0.0, 0.0)), F.lit(1.0), F.lit(1.0))
    r = one(spark, x=x, y=y, mm=g.converted(F.lit(1.0), F.lit("Inch"), "Millimeter"), pt=g.converted(F.lit(25.4), F.lit("Millimeter"), "PdfPoint"), r=g.rotation(F.lit(-90.0)), d=g.distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)))
    assert (r["x"], r["y"], r["mm"], r["r"], r["d"]) == (22.0, 63.0, 25.4, 270.0, 5.0) and abs(r["pt"] - 72) < 1e-7


def test_pixels_have_no_size(spark):
    import pytest

    with pytest.raises(Exception, match="no conversion"):
        one(spark, x=g.converted(F.lit(1.0), F.lit("Pixel"), "Inch"))


def test_names(spark):
    r = one(spark, a=g.reference(F.lit(" c33-03_e ")), b=g.without_side(F.lit("C3303_E")), s=g.slug(F.lit("A+ b/")), c=g.color(F.lit(0.5)), e=g.extension(F.lit("http://x/y/Board.GBR?x=1")))
    assert r == {"a": "C3303_E", "b": "C3303", "s": "net-a--b", "c": "80", "e": ".gbr?x=1"}


def test_boxes_by_kind(spark):
    rows = [("k1", "Bezier", 0.0, 0.0, 10.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.2, None), ("k2", "Text", 1.0, 5.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, "abcd"), ("k3", "Via", 4.0, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "id string, kind string, x double, y double, x2 double, y2 double, w double, h double, diameter double, radius double, stroke double, text string")
    got = {r.id: (r.left, r.top, r.right, r.bottom) for r in inventory.element_bounds(df).collect()}
    assert [round(v, 6) for v in got["k1"]] == [-0.1, -0.1, 10.1, 5.1]
    assert [round(v, 6) for v in got["k2"]] == [1.0, 3.0, 5.8, 5.0]
    assert got["k3"] == (3.5, 1.5, 4.5, 2.5)


def test_extent_skips_boxes_without_area(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 9.0), (1, -50.0, 3.0, 90.0, 3.0)], "doc_id int, left double, top double, right double, bottom double")
    assert inventory.extent(df, "doc_id").first()[1:5] == (0.0, 0.0, 5.0, 9.0)
