import random

import pytest

from planar.operators import history, quality, search


def words(spark, rows):
    return spark.createDataFrame(rows, "file long, page int, n long, text string, left double, bottom double, width double, height double")


def far(page, texts):
    return [(1, page, k, t, k * 100.0, 10.0, 20.0, 2.0) for k, t in enumerate(texts)]


def test_references(spark):
    w = words(spark, far(1, ["C3303_E", "R605"]) + far(2, ["C3303", "C33030"]))
    q = spark.createDataFrame([("C3303",)], "query string")
    assert sorted((r.page, r.occurrences) for r in search.references(w, q).collect()) == [(1, 1), (2, 1)]


def test_joined_fragments(spark):
    w = words(spark, [(1, 1, 0, "L", 10.0, 10.0, 1.0, 2.0), (1, 1, 1, "305", 11.2, 10.0, 3.0, 2.0), (1, 1, 2, "_E", 14.4, 10.0, 2.0, 2.0), (1, 1, 3, "305", 80.0, 10.0, 3.0, 2.0)])
    q = spark.createDataFrame([("L305_E",)], "query string")
    assert [(r.page, r.occurrences) for r in search.references(w, q).collect()] == [(1, 1)]


def test_cross_probe(spark):
    found = spark.createDataFrame([("board", 3, "A", 2), ("board", 1, "A", 1), ("board", 1, "B", 1), ("schematic", 5, "A", 1), ("schematic", 7, "C", 4)], "role string, page int, query string, occurrences long")
    asked = spark.createDataFrame([(x,) for x in "AABCD"], "query string")
    got = {x.query: (x.status, x.board_occurrences, x.board_page, x.schematic_page) for x in search.cross_probe(found, asked).collect()}
    assert got == {"A": ("both", 3, 1, 5), "B": ("board", 1, 1, 0), "C": ("schematic", 0, 0, 7), "D": ("none", 0, 0, 0)}


def test_a_run_that_passes_the_reference_ends(spark):
    """What two fragments and more give must begin the reference; empty fragments join; matches don't overlap."""
    line = lambda page, texts: [(1, page, k, t, k * 4.0, 10.0, 3.0, 2.0) for k, t in enumerate(texts)]
    w = words(spark, line(1, ["C", "1_", "E"]) + line(2, ["C", "-", "1"]) + line(3, ["C", "1", "C", "1"]) + line(4, ["A", "B", "A", "B", "A"]) + line(5, ["R605", "R", "6", "05"]) + line(6, list("ABCDEFGH")) + line(7, list("xABCDEFGHI")))
    q = spark.createDataFrame([("C1",), ("ABA",), ("r605",), ("ABCDEFGH",), ("ABCDEFGHI",)], "query string")
    got = {(r.page, r.query): r.occurrences for r in search.references(w, q).collect()}
    assert got == {(2, "C1"): 1, (3, "C1"): 2, (4, "ABA"): 1, (5, "r605"): 2, (6, "ABCDEFGH"): 1, (7, "ABCDEFGH"): 1}


def test_references_equal_a_scan(spark):
    """Random fragments against the reading of a page word by word."""
    rnd = random.Random(3)
    pages = {p: [rnd.choice(["A", "B", "AB", "_E", "a1", "1", "-", "B_E", "\u00df"]) for _ in range(40)] for p in range(30)}
    left, rows, ties = 0.0, [], {}
    for p, texts in pages.items():
        left, ties[p] = 0.0, []
        for k, t in enumerate(texts):
            near = rnd.random() < 0.8
            left += 4.0 if near else 40.0
            ties[p].append(near and k > 0)
            rows.append((1, p, k, t, left, 10.0, 3.0, 2.0))
    queries = ["AB", "ABA", "AB_E", "A1", "a1b", "BB_E", "AAAA", "\u00dfA"]
    norm = lambda t: "".join(c if c == "\u00df" else c.upper() for c in t if c.isalnum() or c == "_")
    bare = lambda t: t.removesuffix("_E")

    def count(texts, tie, q):
        n = i = 0
        while i < len(texts):
            size, all_ = 0, texts[i]
            if norm(all_) and bare(norm(all_)) == bare(q):
                size = 1
            for j in range(i + 1, min(len(texts), i + 8)) if not size else ():
                if not tie[j]:
                    break
                all_ += texts[j]
                if norm(all_) and bare(norm(all_)) == bare(q):
                    size = j - i + 1
                    break
                if not q.startswith(norm(all_)):
                    break
            n, i = n + bool(size), i + max(size, 1)
        return n

    want = {(p, x): count(t, ties[p], norm(x)) for p, t in pages.items() for x in queries}
    got = {(r.page, r.query): r.occurrences for r in search.references(words(spark, rows), spark.createDataFrame([(x,) for x in queries], "query string")).collect()}
    assert got == {k: n for k, n in want.items() if n}


ELEMENT = "doc_id int, element_ord long, element_id string, layer_id string, net_id string, left double, top double, right double, bottom double"


def test_validation_within_documents(spark):
    """Two documents with the same keys: what one has doesn't help the other."""
    e = spark.createDataFrame([(1, 0, "a", "top", "n1", 0.0, 0.0, 1.0, 1.0), (1, 1, "b", "low", "n9", 0.0, 0.0, 0.0, 1.0), (2, 0, "a", "top", "n1", 0.0, 0.0, 1.0, 1.0)], ELEMENT)
    layers = spark.createDataFrame([(1, "top"), (2, "low")], "doc_id int, layer_id string")
    nets = spark.createDataFrame([(1, "n1"), (2, "n9")], "doc_id int, net_id string")
    parts = spark.createDataFrame([(1, "c1", 0, ["a", "zz", "yy"]), (2, "c1", 0, ["a", "b"])], "doc_id int, component_id string, ord int, element_ids array<string>")
    pages = spark.createDataFrame([(1, 1, 0.0, 5.0, ["top", "gone"]), (2, 1, 1.0, 1.0, ["low"])], "doc_id int, number int, width double, height double, layer_ids array<string>")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    issues = quality.validate(docs, e, layers, nets, parts, pages)
    got = {d: [(r.code, r.subject) for r in issues.where(f"doc_id = {d}").orderBy("issue_ord").collect()] for d in (1, 2, 3)}
    assert got[1] == [("CORE006", "1"), ("CORE007", "1"), ("CORE002", "b"), ("CORE003", "b"), ("CORE004", "b"), ("CORE005", "c1"), ("CORE005", "c1")]
    assert got[2] == [("CORE003", "a"), ("CORE004", "a"), ("CORE005", "c1")] and got[3] == [("CORE001", None)]
    assert {r.doc_id: r.valid for r in quality.is_valid(issues).collect()} == {1: False, 2: False, 3: False}


def test_net_trace_within_documents(spark):
    e = spark.createDataFrame([(1, 0, "a", "t", "g", 0.0, 0.0, 1.0, 1.0), (2, 0, "a", "t", "g", 5.0, 5.0, 7.0, 7.0), (2, 1, "b", "t", "h", 0.0, 0.0, 1.0, 1.0)], ELEMENT)
    nets = spark.createDataFrame([(1, "g", "GND"), (2, "g", "GND"), (2, "h", "gnd"), (2, "i", "VCC")], "doc_id int, net_id string, name string")
    asked = spark.createDataFrame([(1, "gnd"), (2, "Gnd"), (2, "G"), (2, "vcc"), (2, "none")], "doc_id int, query string")
    got = {(r.doc_id, r.query): (r.matches, r.net_id, r.elements, r.right) for r in quality.net_trace(e, nets, asked).collect()}
    assert got == {(1, "gnd"): (1, "g", 1, 1.0), (2, "Gnd"): (2, None, None, None), (2, "G"): (1, "g", 1, 7.0), (2, "vcc"): (1, "i", 0, None), (2, "none"): (0, None, None, None)}
    with pytest.raises(Exception, match="names 2 nets"):
        quality.net_trace(e, nets, asked, strict=True).collect()


def test_words_of_characters(spark):
    rows = [(1, 1, k, c, 5.0 * k, 5.0 * k + 5, 0.0, 10.0) for k, c in enumerate("ab cd")] + [(1, 1, 5, "e", 60.0, 65.0, 0.0, 10.0), (1, 1, 6, "f", 65.0, 70.0, 30.0, 40.0)]
    c = spark.createDataFrame(rows, "file int, page int, n int, ch string, left double, right double, bottom double, top double")
    assert [r.text for r in history.words_of_characters(c).orderBy("first").collect()] == ["ab", "cd", "e", "f"]


def test_offsets_history_cache(spark):
    p = spark.createDataFrame([(1, 1, 50.0), (1, 2, 40.0)], "doc_id int, number int, height double")
    assert [(r.offset_y, r.first_layer_order) for r in history.page_offsets(p).orderBy("number").collect()] == [(0.0, 1), (60.0, 11)]
    h = spark.range(600).selectExpr("1 AS doc_id", "id AS ts", "id AS event_id")
    assert history.latest(h).agg({"event_id": "min"}).first()[0] == 100
    a = spark.createDataFrame([(1, "x", 1, 1, 40, 5), (1, "y", 2, 2, 40, 7), (1, "x", 3, 3, 40, 5), (1, "z", 4, 4, 40, 9)], "doc_id int, tile string, at int, seq int, bytes int, ms int")
    assert sorted(r.tile for r in history.cached_tiles(a, 80).collect()) == ["x", "z"]
    m = history.render_metrics(a).first()
    assert (m.requests, m.hits, m.hit_ratio, m.average_ms) == (4, 1, 0.25, 7.0)
