import io
import zipfile

from pyspark.sql import functions as F  # noqa: F401

from planar.operators import topology
from planar.sources import boards

SEG = "doc_id long, seg_ord long, segment_id string, group_key string, x1 double, y1 double, x2 double, y2 double"


def segs(spark, rows):
    return spark.createDataFrame([(1, k, f"s{k}", "g", *map(float, r)) for k, r in enumerate(rows)], SEG)


def files(spark, text):
    return spark.createDataFrame([("f", text)], "doc_id string, content string")


def test_kernel(spark):
    kept, rest = topology.kernel(segs(spark, [(0, 0, 10, 0), (10, 0, 10, 5), (10, 5, 0, 5), (0, 5, 0, 0), (20, 0, 25, 0)]))
    got = kept.collect()
    assert len(got) == 1 and got[0].rectangle_no == 1 and sorted(got[0].edge_ids) == ["s0", "s1", "s2", "s3"] and got[0].axis_aligned
    assert [r.segment_id for r in rest.collect()] == ["s4"]


def test_overlapping_rectangles_share_no_edge(spark):
    kept, _ = topology.kernel(segs(spark, [(0, 0, 1, 0), (0, 1, 1, 1), (0, 0, 0, 1), (1, 0, 1, 1), (1, 0, 2, 0), (1, 1, 2, 1), (2, 0, 2, 1)]))
    assert kept.count() == 1


def test_contours_and_normalization(spark):
    c = topology.contours(segs(spark, [(10, 0, 10, 8), (0, 0, 10, 0), (0, 8, 0, 0), (0, 8, 10, 8)])).first()
    assert c.is_closed and c.segments == 4
    r = spark.createDataFrame([(c.points,)], "points array<struct<x:double,y:double>>").select(topology.axis_rectangle(F.col("points")).alias("r")).first().r
    assert tuple(r) == (0.0, 0.0, 10.0, 8.0)
    nine = [(0, 0), (5, 0), (10, 0), (10, 4), (10, 8), (5, 8), (0, 8), (0, 4), (0, 0)]
    skew = [(0, 0), (10, 1), (10, 8), (0, 8)]
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in p],) for p in (nine, skew)], "points array<struct<x:double,y:double>>")
    a, b = [r[0] for r in df.select(topology.axis_rectangle(F.col("points"))).collect()]
    assert tuple(a) == (0.0, 0.0, 10.0, 8.0) and b is None


def test_circle(spark):
    four = [(3, 0, 0, 3), (0, 3, -3, 0), (-3, 0, 0, -3), (0, -3, 3, 0)]
    df = spark.createDataFrame([([dict(zip(("x1", "y1", "x2", "y2"), map(float, c))) for c in four],), ([],)], "c array<struct<x1:double,y1:double,x2:double,y2:double>>")
    assert [r[0] for r in df.select(topology.circle(F.col("c"))).collect()] == [3.0, None]


def test_path_segments(spark):
    df = spark.createDataFrame([(1, "p", [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 2.0}], True)], "doc_id int, path_id string, points array<struct<x:double,y:double>>, is_closed boolean")
    assert [(r.x1, r.y1, r.x2, r.y2) for r in topology.path_segments(df).orderBy("segment_no").collect()] == [(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 2.0), (1.0, 2.0, 0.0, 0.0)]


def test_gerber(spark):
    text = "G04 x*\n%MOMM*%\n%ADD10C,0.25*%\nG04 y*\nD10*\nX1000Y0D02*\nX3000D01*\nX3000Y500D03*\nD03*\nX9Y9*\n"
    got = boards.gerber(files(spark, text)).orderBy("element_no").collect()
    assert [(r.kind, r.x1, r.y1, r.x2, r.y2, r.size) for r in got] == [("Track", 1.0, 0.0, 3.0, 0.0, 0.25), ("Pad", 3.0, 0.5, 3.0, 0.5, 0.25)]


def test_excellon_unit_changes_midway(spark):
    text = "T1C0.5\nT1\nX1000Y2000\nINCH\nT2C0.1\nT2\nX10000Y0\nT9\nX0Y0\n"
    got = [(round(r.x, 6), round(r.y, 6), round(r.diameter, 6)) for r in boards.excellon(files(spark, text)).orderBy("element_no").collect()]
    assert got == [(1.0, 2.0, 0.5), (25.4, 0.0, 2.54), (0.0, 0.0, 0.3)]


def test_kicad(spark):
    text = '(segment (start 1 2) (end 3 4) (layer "B.Cu")(net 3 "V+") (width 0.5)) (footprint "x" (property "Reference" "U1" ) (property "Value" "MCU") (at 7 8 90)) ' + " ".join(f'(gr_line (start {x} {y}) (end 0 0) (layer "Edge.Cuts"))' for x, y in ((0, 0), (9, 0), (9, 9)))
    k = boards.kicad(files(spark, text))
    assert [tuple(r)[2:] for r in k["tracks"].collect()] == [("bottom-copper", 1.0, 2.0, 3.0, 4.0, 0.5, "net-v")]
    assert [(r.reference, r.value, r.rotation) for r in k["components"].collect()] == [("U1", "MCU", 90.0)]
    assert len(k["outlines"].first().points) == 3 and k["nets"].first().name == "V+"


def test_xml_and_legacy(spark):
    e = boards.eagle(files(spark, '<eagle><element name="R1" value="1k" x="1.5" y="2" rot="MR90"/><wire x1="0" y1="0" x2="1" y2="1" layer="16"/></eagle>'))
    assert [(r.reference, r.rotation, r.side) for r in e["components"].collect()] == [("R1", 90.0, "Bottom")]
    assert [(r.element_no, r.layer_id, r.width) for r in e["tracks"].collect()] == [(2, "bottom-copper", 0.15)]
    i = boards.ipc2581(files(spark, '<?xml version="1.0"?><ns:IPC-2581><ns:Component refDes="U7" x="3"/><Component part="p"/><LogicalNet name="GND"/></ns:IPC-2581>'))
    assert [r.reference for r in i["components"].orderBy("n").collect()] == ["U7", "U2"] and i["nets"].first().net_id == "net-gnd"
    assert boards.ipc2581(files(spark, "<x><Component/></x>"))["components"].count() == 0
    l = boards.legacy(files(spark, "Po 0 1 2 3 4 5\n$MODULE M1\nx\nPo 7 8 0\n"))
    assert l["tracks"].first().width == 5.0 and l["components"].first().reference == "M1"


def test_odb_and_formats(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n in ("job/steps/pcb/layers/top/features", "job/steps/pcb/layers/TOP/x", "job/steps/pcb/layers/Bot/features", "job/misc"):
            z.writestr(n, "x")
    df = spark.createDataFrame([("j", bytearray(raw.getvalue()))], "doc_id string, content binary")
    assert sorted((r.layer_id, r.ord) for r in boards.odb_layers(df).collect()) == [("odb-bot", 101), ("odb-top", 100)]


def test_inspection(spark):
    df = spark.createDataFrame([("a", bytearray(b"%PDF-1.7 /Type /Page /Type /Pages /XFA dynamicRender"))], "doc_id string, content binary")
    r = boards.inspect(df).withColumn("type", boards.document_type(F.lit(0), F.lit(0))).first()
    assert r.pdf and r.xfa and r.pages == 1 and r.type == "XfaDynamic"
