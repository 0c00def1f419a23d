"""Folders of mixed boards, and inspection of files in splits."""

import random
import zipfile

from planar.sources import boards, mixed


def test_a_folder_of_all_formats(spark, tmp_path):
    texts = {
        "a/top.GTL": "%MOMM*%\n%ADD10C,0.25*%\nG04 y*\nD10*\nX1000Y0D02*\nX3000D01*\nX3000Y500D03*\n", "a/holes.drl": "T1C0.5\nT1\nX1000Y2000\n",
        "b.kicad_pcb": '(segment (start 1 2) (end 3 4) (layer "B.Cu")(net 3 "V+") (width 0.5))', "c.brd": '<eagle><element name="R1" value="1k" x="1.5" y="2" rot="MR90"/></eagle>',
        "d.xml": '<?xml version="1.0"?><IPC-2581><Component refDes="U7" x="3"/><LogicalNet name="GND"/></IPC-2581>', "e.cvg": "<other/>", "f.pcb": "Po 0 1 2 3 4 5\n$MODULE M1\nx\nPo 7 8 0\n", "notes.md": "none", "broken.zip": "no archive", "g.gtl?x": "odd",
    }
    for name, text in texts.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    for name, entries in (("job.ZIP", ("j/layers/top/f", "j/layers/TOP/x", "j/layers/bot/f")), ("empty.zip", ("j/misc",))):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for e in entries:
                z.writestr(e, "x")
    found = mixed.read(spark, str(tmp_path))
    name = lambda r: r.doc_id.rsplit("/", 1)[1]
    errors = {name(r).replace("%3F", "?"): r.error for r in found["errors"].collect()}
    assert errors == {"notes.md": "no reader", "g.gtl?x": "no reader", "broken.zip": "broken archive", "empty.zip": "no layers in the archive", "e.cvg": "the root is not IPC-2581"}
    assert sorted((name(r), r.reader, r.x2, r.width) for r in found["tracks"].collect()) == [("b.kicad_pcb", "kicad-pcb", 3.0, 0.5), ("f.pcb", "legacy-pcb", 3.0, 5.0), ("top.GTL", "gerber", 3.0, 0.25)]
    assert sorted((name(r), r.reference) for r in found["components"].collect()) == [("c.brd", "R1"), ("d.xml", "U7"), ("f.pcb", "M1")]
    assert [(name(r), r.x, r.y, r.diameter) for r in found["vias"].collect()] == [("holes.drl", 1.0, 2.0, 0.5)] and found["pads"].first().diameter == 0.25
    assert sorted(r.net_id for r in found["nets"].collect()) == ["net-gnd", "net-v"]
    layers = {}
    for r in found["layers"].collect():
        layers.setdefault(name(r), []).append(r.layer_id)
    assert {k: len(v) for k, v in layers.items()} == {n: 4 for n in ("top.GTL", "holes.drl", "b.kicad_pcb", "c.brd", "d.xml", "f.pcb")} | {"job.ZIP": 6}
    assert found["files"].count() == len(texts) + 2


def test_lines_of_split_files(spark, tmp_path):
    """Tokens anywhere in files of several splits, with bytes that are no text."""
    rnd = random.Random(1)
    tokens = [b"%PDF-", b"/XFA", b"/Encrypt", b"/Type /Page", b"/Type /Pages", b"dynamicRender"]
    for k in range(4):
        parts = [bytes(rnd.choice(b"\x00\xff\xc3ab/ %") for _ in range(rnd.randrange(400))) + rnd.choice([*tokens, b"", b""]) + rnd.choice([b"\n", b"\r\n", b" "]) for _ in range(3000)]
        (tmp_path / f"{k}.pdf").write_bytes((b"" if k else b"%PDF-") + b"".join(p for p in parts if k != 2 or b"/XFA" not in p))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        lines = boards.byte_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        got = {r.doc_id.rsplit("/", 1)[1]: r for r in boards.inspect_lines(lines).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for k in range(4):
        raw = (tmp_path / f"{k}.pdf").read_bytes()
        r = got[f"{k}.pdf"]
        assert (r.pdf, r.xfa, r.encrypted, r.dynamic, r.wait) == tuple(t in raw for t in (b"%PDF-", b"/XFA", b"/Encrypt", b"dynamicRender", b"Please wait"))
        assert r.pages == max(1, raw.count(b"/Type /Page") - raw.count(b"/Type /Pages"))
