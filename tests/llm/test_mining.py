"""Line dedup, hard negatives and phrases against plain loops: edge cases, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from planar.llm import lines, negatives, phrases, queries

DOCS = "doc_id long, text string, lang string, doc long, fingerprint string, chunk int, n double"


def docs(spark, rows):
    """Documents with columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, g, 1, "f", 2, 0.5) for i, t, g in rows], DOCS)


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def plain_lines(rows, min_docs, min_chars, keep_first):
    """Per row: lines, dropped lines and the kept text."""
    each = {(-(2**63) if i is None else i, t or ""): None for i, t, _ in rows}
    owners = collections.defaultdict(set)
    for d in each:
        for line in d[1].split("\n"):
            if len(line_key(line)) >= min_chars:
                owners[line_key(line)].add(d)
    out = []
    for i, t, _ in rows:
        d = (-(2**63) if i is None else i, t or "")
        keep, seen = [], set()
        for line in d[1].split("\n"):
            key = line_key(line)
            many = len(owners[key]) >= min_docs if len(key) >= min_chars else False
            first = keep_first and key not in seen and min(o[0] for o in owners[key] or {d}) == d[0]
            seen.add(key)
            if not many or first:
                keep.append(line)
        out.append((i, d[1].count("\n") + 1, d[1].count("\n") + 1 - len(keep), "\n".join(keep)))
    return out


def line_rows(rnd):
    common = ["Terms apply.", "  TERMS apply.\t", "é", "É", "x", "", "  ", "very common"]
    rows = [(1, None, "a"), (2, "", "a"), (3, "\n\n", None), (None, "very common\nown", "b"), (None, "very common\nother", "b"), (4, "\x0bTerms APPLY.\x0c\r", "b")]
    for k in range(60):
        t = "\n".join(rnd.choice([*common, f"line {rnd.randrange(40)}", f"only {k}-{rnd.random()}"]) for _ in range(rnd.randrange(12)))
        rows.append((10 + k, t, "c"))
    rows += [(500, "x\nx\nx\nx\nx", "d"), (500, "x\nx\nx\nx\nx", "d"), (501, "\n".join(["line 1"] * 3000 + ["end"]), "d"), (502, "w " * 50_000 + "\nx", "e")]
    return rows


@pytest.mark.parametrize(("min_docs", "min_chars", "keep_first"), [(10, 1, False), (3, 1, False), (2, 2, False), (3, 1, True), (1, 1, False)])
def test_lines_equal_a_loop(spark, min_docs, min_chars, keep_first):
    rows = [r for r in line_rows(random.Random(2)) if not (keep_first and r[1] == "very common\nother")]  # documents of one id are ordered by their fingerprints
    d = docs(spark, rows)
    maps = lines.keep_bitmaps(d, min_docs, min_chars, keep_first)
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.applied(d, maps).collect())
    want = plain_lines(rows, min_docs, min_chars, keep_first)
    assert got == collections.Counter(want)
    assert collections.Counter((r.doc_id, r.n_dropped, r.kept_sha256) for r in lines.digests(d, maps).collect()) == collections.Counter((i, n, hashlib.sha256(t.encode()).hexdigest()) for i, _, n, t in want)


def test_runs_over_partitions(spark):
    """Runs of one line that begin, end or lie over any border of partitions, and batches of a few rows."""
    rnd = random.Random(4)
    rows = [(k, "\n".join(rnd.choice(("hot", "hot", "warm", f"c{rnd.randrange(9)}", f"u{k}")) for _ in range(6)), "a") for k in range(150)]
    keys = ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    try:
        for n, size in (("1", "7"), ("5", "3"), ("40", "50")):
            for k, v in zip(keys, (n, size, "false")):
                spark.conf.set(k, v)
            for first in (False, True):
                d = docs(spark, rows)
                got = {r.doc_id: r.kept for r in lines.applied(d, lines.keep_bitmaps(d, 10, 1, first)).collect()}
                assert got == {i: t for i, _, _, t in plain_lines(rows, 10, 1, first)}
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_lines_of_nothing(spark):
    d = docs(spark, []).where("false")
    assert lines.digests(d, lines.keep_bitmaps(d)).count() == 0
    with pytest.raises(TypeError):
        lines.keep_bitmaps(d.withColumn("doc_id", F.lit("a")))


VECTORS = "vec_id long, label int, embedding array<float>, codes string, rank int, dims string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, g, v, "c", 1, "d") for i, g, v in rows], VECTORS)


def plain_negatives(rows):
    """All scores, ordered."""
    one = {}
    for i, g, v in rows:
        if i is None or g is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        g = (g + 1) % 10 if i % 7 == 0 else g
        mine = (g, [float(np.float32(x)) for x in v])
        one[i] = min(one.get(i, mine), mine)
    ints = {i: (g, np.array([np.floor(256 * x) for x in v], np.int64)) for i, (g, v) in one.items()}
    out = []
    for i, (g, v) in ints.items():
        if i % 50:
            continue
        scores = sorted((-int(v @ w), j, h == g) for j, (h, w) in ints.items() if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scores if s[2]][:5]:
            found = [(n, k) for n, k, same in scores if not same and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(i, j, rank + 1, k, -p, -n) for rank, (n, k) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_negatives_equal_a_full_scan(spark, dims, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 100)
    rnd = np.random.default_rng(dims)
    centres = rnd.normal(size=(6, dims))
    rows = []
    for k in range(700):
        v = centres[k % 6] + rnd.normal(size=dims) * 0.7
        rows.append((k, int(rnd.integers(0, 5)) if k % 3 else 1, [float(x) for x in v / np.linalg.norm(v)]))
    rows += [(1000 + k, int(k % 4), [float(x) for x in np.round(rnd.normal(size=dims))]) for k in range(60)]  # ties
    rows += [(2000, 1, [0.0] * dims), (2050, 1, [0.0] * dims), (2051, 2, [0.0] * dims), (2100, 1, rows[50][2]), (2101, 2, rows[50][2]), (50, 0, rows[3][2])]
    rows += [(None, 1, rows[0][2]), (3000, None, rows[0][2]), (3050, 1, None), (3100, 1, [None] * dims), (3150, 1, [float("nan")] * dims), (3200, 1, [float("inf")] + [0.0] * (dims - 1)), (3250, 1, [0.5, 0.5]), (3251, 1, [0.5, 0.5]), (3252, 2, [0.4, 0.45]), (3300, 1, []), (3301, 1, []), (3302, 3, [])]
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 50 == 0, moved).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == plain_negatives(rows)
    assert len(got) > 100


def test_intervals_hold_and_filter():
    rnd = np.random.default_rng(1)
    rows = np.floor(256 * rnd.normal(size=(400, 64)) / 8).astype(np.int64)
    side = object.__new__(negatives.Side)
    side.n, side.dims, side.ints = 400, 64, rows
    side.codes, side.aligned, side.coded, side.residual = negatives.codes(rows)
    side.norms = np.linalg.norm(rows, axis=1)
    lower, upper = negatives.intervals(side, side, slice(0, 400))
    exact = rows @ rows.T
    assert (lower <= exact).all() and (exact <= upper).all()
    others = ~np.eye(400, dtype=bool)
    middle = np.where(others, (lower + upper) / 2, -np.inf)
    best = negatives.first_guess(side, 0, side, middle, lambda i, s: True, 5, 0)
    assert (best <= np.sort(np.where(others, exact, -(2**60)), axis=1)[:, -5, None]).all()
    assert ((upper >= best) & others).mean() < 0.25  # most rows are passed over
    y = negatives.rotated(rows)
    assert np.allclose(np.linalg.norm(y, axis=1), side.norms) and np.allclose(y @ y.T, exact)


def test_negatives_of_nothing_and_too_much(spark):
    none = vectors(spark, []).where("false")
    assert negatives.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(1, 1, [1.0]), (2, 2, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(Exception, match="2\\^31"):
        negatives.hard_negatives(vectors(spark, [(50, 1, [3e30])]), F.col("vec_id") % 50 == 0).collect()


def plain_phrases(rows, min_count, top):
    f, n = collections.Counter(), collections.Counter()
    for _, t, g in rows:
        g = "und" if g is None else g
        for piece in re.split(r"[.,;:!?\n-\r]", (t or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^ \t]+", piece)
            n[g] += len(w)
            f.update((g, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    for (g, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        if any(h == g and len(q) > len(p) and b >= min_count and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (h, q), b in f.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
        out[g].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((g, rank + 1, p.decode(), -a, l, r, n[g], -s) for g, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize(("min_count", "top", "chunk_words"), [(3, 2000, 300), (3, 4, 5000), (30, 2000, 120)])
def test_phrases_equal_a_loop(spark, min_count, top, chunk_words, monkeypatch):
    monkeypatch.setattr(phrases, "PART_BYTES", 100)
    rnd = random.Random(6)
    words = ["a", "B", "cé", "d", "É", "e-f", "g h", "zz", "Ab"]
    rows = [(1, None, None), (2, "", "x"), (3, " \t. ,\n", "x"), (4, "one two three four " * 60, "x"), (5, "one two three four", None)]
    for k in range(80):
        t = "".join(rnd.choice(words[: 2 + k % 8]) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\x0b", "\n", "?"]) for _ in range(rnd.randrange(80)))
        rows.append((10 + k % 20, t, rnd.choice(("x", "y", None, "und"))))
    got = phrases.collocations(docs(spark, rows).repartition(3), min_count, top, chunk_words).collect()
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got)
    assert got == plain_phrases(rows, min_count, top) and got


def test_counts_of_phrases_are_few_rows(spark, monkeypatch):
    """A round sends a row for each part of a chunk's phrases, not one for each phrase; what is packed comes back."""
    rnd, counts, stored = random.Random(9), {}, phrases.stored

    def counted(df, label):
        out = stored(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(phrases, "stored", counted)
    rows = [(k, " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)), "x") for k in range(20)]
    phrases.collocations(docs(spark, rows).repartition(2), 2).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < counts["round-1"] <= 2 * (parts + 1) and counts["phrases"] > 500
    columns = [np.array([-5, 2, 2, 2**40]), np.array([7, -(2**62), 0, 1]), np.array([1, 1, 30, 2])]
    assert (phrases.unpacked(phrases.packed(columns), 3) == np.stack(columns)).all()


def test_counts_of_words_are_few_rows(spark, monkeypatch):
    """A chunk sends a row for each part of its words, not one for each word, and gets its frequent words back as few."""
    rnd, counts, stored = random.Random(10), {}, phrases.stored

    def counted(df, label):
        out = stored(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(phrases, "stored", counted)
    rows = [(k, " ".join(f"é{rnd.randrange(300)}" for _ in range(400)), rnd.choice(("x", "y", None))) for k in range(40)]
    words, _, totals = phrases.mined(docs(spark, rows).repartition(2), 3)
    parts, plain = int(spark.conf.get("spark.sql.shuffle.partitions")), collections.Counter((g or "und", w) for _, t, g in rows for w in t.split())
    assert sorted((r.lang, r.word, r.f) for r in words.collect()) == sorted((g, w, f) for (g, w), f in plain.items() if f >= 3)
    assert {r.lang: r.n for r in totals.collect()} == {g: sum(f for (h, _), f in plain.items() if h == g) for g, _ in plain}
    assert counts["words"] <= 2 * (parts + 1 + 3) and counts["frequent-1"] <= sum(f >= 3 for f in plain.values()) + 2 * parts


@pytest.mark.parametrize("k", [1, 2, 3])
def test_a_round_holds_few_copies_of_its_relation(k, monkeypatch):
    """Beside the relation (4 bytes a place) a round holds its codes (4) and keys (8) and some flags; its phrases are those of a loop."""
    rnd, n = np.random.default_rng(k), 400_000
    words, relation = np.arange(100, 110), rnd.integers(0, 11, n).astype(np.int32)
    lists = np.array([x for x in itertools.product(range(1, 11), repeat=k) if k == 1 or sum(x) % 3])  # all words of a relation are frequent
    monkeypatch.setattr(phrases, "BLOCK", 1 << 12, raising=False)
    tracemalloc.start()
    found = phrases.extended(words, relation, lists, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * n
    ids, left, columns, count = phrases.extended(words, relation, lists, True)
    sequence, frequent = relation.tolist(), set(map(tuple, lists.tolist()))
    first = [i for i in range(n - k) if tuple(sequence[i : i + k]) in frequent and tuple(sequence[i + 1 : i + k + 1]) in frequent]
    plain = collections.Counter(tuple(99 + x for x in sequence[i : i + k + 1]) for i in first)
    assert dict(zip(zip(*(c.tolist() for c in columns)), count.tolist())) == plain and (found[3] == count).all()
    kept = {i + j for i in first for j in range(k + 1)}
    pieces = lambda seq: [x for x in "".join(chr(w) if w else " " for w in seq).split(" ") if x]
    assert pieces([int(ids[w - 1]) if w else 0 for w in left.tolist()]) == pieces([99 + w if i in kept else 0 for i, w in enumerate(sequence)])


def test_phrases_of_nothing(spark):
    assert phrases.collocations(docs(spark, []).where("false")).count() == 0
    assert phrases.collocations(docs(spark, [(1, None, "x"), (2, "a b", "x")])).count() == 0


def test_registered(spark):
    import duckdb

    small = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name in ("op11_line_dedup", "op12_hard_negatives", "op13_collocations"):
        got, found = queries.QUERIES[name](spark, small), duck.execute(queries.ORACLES[name])
        own = [c[0] for c in found.description]
        assert sorted(own) == sorted(got.columns)
        assert sorted(repr(tuple(r[c] for c in own)) for r in got.collect()) == sorted(map(repr, found.fetchall()))


def test_rows_without_an_id_are_decontaminated(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [" ".join(word() for _ in range(20)) for _ in range(4)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [" ".join(word() for _ in range(60)) for _ in range(6)]
    held = [f"{clean[k]} {items[k]} {clean[k + 1]}" for k in range(4)]
    rows = [(None, held[0], "x"), (1, held[1], "x"), (None, held[2], "x"), (2, clean[0], "x"), (None, clean[1], "x"), (None, None, "x"), (None, "", "x"), (3, held[3], "x"), (None, clean[1], "x")]
    d = docs(spark, rows).withColumn("key", F.lit("own"))
    got = corpus_pipeline.without_benchmark(spark, d, str(tmp_path))
    assert got.columns == d.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([(2, clean[0]), (None, clean[1]), (None, clean[1]), (None, None), (None, "")])
