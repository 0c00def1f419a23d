from planar import data
from planar.plans import board, convert
from planar.sources import projects, templates
from planar.streaming import metrics

SMALL = "/root/testdata/sf0.001"


def test_analysis_chain(spark):
    a = board.analyze(data.elements(spark, SMALL), data.layers(spark, SMALL))
    n = {k: getattr(a, k).count() for k in ("classified", "pads", "holes", "semantics", "footprints", "components")}
    assert n["semantics"] == data.elements(spark, SMALL).count() and 0 < n["footprints"] == n["components"] and n["pads"] < n["classified"]


def test_conversion(spark):
    pages = spark.createDataFrame([(1, 1, 50.0), (1, 2, 40.0)], "doc_id int, number int, height double")
    graphics = spark.createDataFrame([(1, 1, "a", "Text", 9.0, 9.0, 11.0, 10.0), (1, 2, "b", "Circle", 0.0, 1.0, 2.0, 3.0)], "doc_id int, page int, graphic_id string, kind string, left double, top double, right double, bottom double")
    assert [(r.layer_id, r.ord) for r in convert.layers(pages).orderBy("ord").collect()][3] == ("pdf-p2-text", 11)
    got = {r.element_id: (r.kind, r.layer_id, r.top) for r in convert.elements(pages, graphics).collect()}
    assert got == {"pdf-p1-a": ("Text", "pdf-p1-text", 9.0), "pdf-p2-b": ("Ellipse", "pdf-p2-vector", 61.0)}


def test_projects_round_trip(spark, tmp_path):
    p = projects.annotate(spark.createDataFrame([("Trial", "board.pdf")], "name string, board_file string"), "U100", "Suspect", "Open")
    projects.save(p, f"{tmp_path}/p")
    back = projects.load(spark, f"{tmp_path}/p")
    r = back.first()
    assert (r.name, r.board_file, r.annotations[0].reference) == ("Trial", "board.pdf", "U100") and r.updated_utc
    assert projects.remove_annotation(back, r.annotations[0].id).first().annotations == []


def test_folders(spark, tmp_path):
    (tmp_path / "Valid.Plugin.dll").write_bytes(b"x")
    (tmp_path / "Ignored.txt").write_text("x")
    assert [r.name for r in projects.plugins(spark, str(tmp_path)).collect()] == ["Valid.Plugin"]
    assert templates.templates(spark)[0]["acceptance"] == 0.7
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('{"Name": "X", "family": "Bga", "minPads": 2, "maxPads": 4, "minRows": 1, "maxRows": 2, "minColumns": 1, "maxColumns": 2, "minPitch": 0.0, "maxPitch": 1.0, "minOccupancy": 0.0, "maxOccupancy": 1.0, "minSymmetry": 0.1, "minAspectRatio": 0.0, "maxAspectRatio": 2.0, "requiresSquareMatrix": false, "requiresTwoRows": false, "requiresFourSides": false, "acceptanceScore": 0.6, "priority": 3}')
    got = templates.templates(spark, str(tmp_path / "t"))
    assert len(got) == 1 and got[0]["name"] == "X" and got[0]["max_aspect"] == 2.0


def test_streams(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, False, 10), (1, at + dt.timedelta(minutes=5), True, 0), (1, at + dt.timedelta(hours=5), False, 4)]
    spark.createDataFrame(rows, "doc_id int, at timestamp, hit boolean, ms long").write.parquet(f"{tmp_path}/a")
    stream = spark.readStream.schema("doc_id int, at timestamp, hit boolean, ms long").parquet(f"{tmp_path}/a")
    q = metrics.render_metrics(stream).writeStream.format("memory").queryName("planar_metrics").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.requests, r.hits, r.average_ms) for r in spark.table("planar_metrics").collect()) == [(1, 0, 4.0), (2, 1, 10.0)]
