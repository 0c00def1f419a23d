"""Rules, quality, toxicity, mixing: edge cases, ties, empty tables, clashing columns."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planar.llm import mixing, quality, rules, toxicity

DOCS = "doc_id long, text string, source string, score double, row long, key string"


def docs(spark, rows):
    """Documents with columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, s, 0.5, 7, "k") for i, t, s in rows], DOCS)


def prose(rnd, n, bad=None):
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(n)]
    if bad == "repeat":
        words = [words[0]] * n
    if bad == "symbols":
        words = [w + "$$$" for w in words]
    if bad == "toxic":
        words[n // 2] = "idiot"
        words[n // 3] = "moron,"
    return " ".join(words) + "."


def brute_repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)})


def test_rules_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "x " * 5000, "b"), (4, "x " * 5000, "b"), (None, "é# ü$\né# ü$\n", "c")]
    rows += [(10 + k, " ".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))), "d") for k in range(40)]
    rows.append((99, " ".join(f"w{k}" for k in range(200_000)), "e"))
    got = rules.ledger(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_words)), sorted(rows, key=lambda r: (r[0] or 0, len((r[1] or "").split())))):
        w = (t or "").split()
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert (r.doc_id, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (i, len(w), sum(map(len, w)), len(lines) - len(set(lines)), brute_repeats(w))


def test_policies_and_ablations(spark):
    e = rules.ledger(docs(spark, [(1, "a b c", "s"), (2, "word " * 40, "s"), (3, " ".join(f"v{k}$" for k in range(40)), "s"), (4, " ".join(f"v{k}" for k in range(40)), "s")]))
    kept = {r.doc_id: (r.p1, r.p2) for r in e.select("doc_id", rules.passes(1).alias("p1"), rules.passes(2).alias("p2")).collect()}
    assert kept == {1: (False, False), 2: (False, False), 3: (True, False), 4: (True, True)}
    got = {r.rule: (r.fails, r.only) for r in rules.ablations(e).collect()}
    assert got["repeats"] == (1, 1) and got["symbols"] == (1, 1) and got["few_words"] == (1, 0)
    assert rules.ledger(docs(spark, []).where("false")).count() == 0


def test_quality_separates_and_handles_edges(spark):
    rnd = random.Random(2)
    rows = [(k, prose(rnd, rnd.randint(30, 300), ("repeat", "symbols")[k % 2] if k % 4 == 0 else None), "s") for k in range(400)]
    labels = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1, 0) for k in range(400)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows + [(1000, None, None), (1001, "", "x"), (None, "a b. " * 60_000, "x"), (3, rows[3][1], "s")])
    got = quality.classify(d, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held) > 50
    flat = quality.classify(d, labels.where("quality = 1")).collect()
    assert {r.score for r in flat} == {1.0}
    assert quality.classify(d, labels.where("false")).first().score == 0.5
    assert quality.classify(d.where("false"), labels).count() == 0
    model = quality.trained(d, labels)
    kept = quality.kept(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect() if r.doc_id and r.doc_id < 400} == {r.doc_id for r in got if r.predicted and r.doc_id and r.doc_id < 400}


def test_quality_equals_the_gaussians(spark):
    """The score from the definition: shrunk covariances by hand, densities by inverse and determinant."""
    rnd = random.Random(12)
    rows = [(k, prose(rnd, rnd.randint(5, 200), ("repeat", "symbols", None)[k % 3]) + "\n" * (k % 4) + prose(rnd, 3), "s") for k in range(150)]
    labels = [(k, int(k % 5 > 1), 0) for k in range(150)]
    got = {r.doc_id: r.score for r in quality.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    x = quality.statistics([t.encode() for _, t, _ in rows])
    train = np.array([zlib.crc32(str(k).encode()) % 4 != 2 for k in range(150)])
    y = np.array([q for _, q, _ in labels])
    parts = [x[train & (y == c)] for c in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, cov)) / train.sum()
    density = []
    for p, c in zip(parts, cov):
        s = (1 - quality.DIAGONAL) * ((1 - quality.SHRINK) * c + quality.SHRINK * pooled) + quality.DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(c))
        z = x - p.mean(0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) + np.linalg.slogdet(s)[1]))
    odds = np.log(len(parts[1]) / len(parts[0]))
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / quality.TEMPERATURE + odds, -40, 40)))
    assert [got[k] for k in range(150)] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-9)


def test_nearest_examples_equal_a_full_scan(monkeypatch):
    """Through texts, features and weights: cosines of all examples, ties to the first; and the vote from its definition."""
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rnd = random.Random(4)
    names = [prose(rnd, 1).strip(".") for _ in range(300)]
    text = lambda: " ".join(rnd.choice(names[: rnd.choice([5, 60, 300])]) for _ in range(rnd.randint(0, 25))).encode()
    rows = [(k, toxicity.features(text()), int(k % 3 == 0), 1.0 + k % 2) for k in range(400)]
    rows += [(500 + k, dict(rows[k][1]), rows[k][2], 1.0) for k in range(20)]
    index = toxicity.Index(rows)
    some = {f for f in {f for r in rows for f in r[1]} if sum(f in r[1] for r in rows) >= toxicity.LEAST_EXAMPLES}
    assert set(index.place) <= some and index.blocks > 40
    assert all(sum(f in r[1] for r in rows) > toxicity.COMMON * len(rows) for f in some - set(index.place))
    by = {r[0]: r for r in rows}
    full = {p: dict(zip(*[x.tolist() for x in index.vector(by[i][1])])) for p, i in enumerate(index.ids)}
    for _ in range(60):
        q = toxicity.features(text())
        own = dict(zip(*[x.tolist() for x in index.vector(q)]))
        scored = [x for x in sorted((-round(sum(x * v.get(t, 0) for t, x in own.items()), 12), p) for p, v in full.items()) if x[0] < 0][:15]
        best, similar = index.nearest(q)
        assert best.tolist() == [p for _, p in scored] and similar.tolist() == pytest.approx([-s for s, _ in scored])
        votes = [(by[index.ids[p]][3] * s * s, by[index.ids[p]][2]) for s, p in scored]
        want = (sum(w for w, y in votes if y) + toxicity.PRIOR_VOTE * 0.1) / (sum(w for w, _ in votes) + toxicity.PRIOR_VOTE)
        assert toxicity.vote(index, 0.1, q)[0] == pytest.approx(want)


def test_scores_are_calibrated(spark):
    """Where labels are noisy, the mean score of held-out documents in a band is near their share of label 1, and no lean is one-sided."""
    rnd = random.Random(14)
    rows, labels = [], []
    for k in range(1500):
        kind = k % 3  # bad words: toxic in 9 of 10; doubtful ones: in 3 of 10; kind ones: in 1 of 30
        mark = (["moron", "scum"], ["sucks", "darn"], ["thanks", "please"])[kind]
        rows.append((k, prose(rnd, 20) + " " + " ".join(mark) + " " + prose(rnd, 10), "s"))
        labels.append((k, 1, int(rnd.random() < (0.9, 0.3, 0.03)[kind])))
    got = toxicity.scores(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").collect()
    truth = {k: y for k, _, y in labels}
    for kind in range(3):
        own = [r for r in got if r.doc_id % 3 == kind]
        assert abs(sum(r.score for r in own) - sum(truth[r.doc_id] for r in own)) < 0.15 * len(own)
    means = [sum(r.score for r in got if r.doc_id % 3 == kind) for kind in range(3)]
    assert means[0] > means[1] > means[2]


def test_toxicity(spark):
    rnd = random.Random(5)
    rows = [(k, prose(rnd, rnd.randint(20, 200), "toxic" if k % 5 == 0 else None), "s") for k in range(500)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(500)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows + [(900, None, None), (901, "idiot " * 30_000, "x"), (None, "You IDIOT!", "y"), (0, rows[0][1], "s")])
    got = toxicity.scores(d, labels).collect()
    assert len(got) == 504
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in held) and len(held) > 50
    assert by[900].score < 0.3 and by[901].predicted == 1 and by[None].predicted == 1
    assert by[5].evidence and by[5].evidence[0].toxic == 1
    assert toxicity.scores(d, labels.where("false")).where("score <> 0").count() == 0
    assert toxicity.scores(d.where("false"), labels).count() == 0


def water_fill(sizes, weights, share=1.5, top=2.0):
    """Targets by rounds: what stops at its ceiling leaves its excess to the rest."""
    target, open_, budget = {}, set(sizes), share * sum(sizes.values())
    while open_:
        level = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level >= top * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        target |= {s: top * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark):
    rnd = random.Random(6)
    rows = [(k, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([0, 5, 300, 900]))), rnd.choice(["b", "a", None, "é", "Z"])) for k in range(300)]
    rows += [(7, "one two three", "b"), (None, "x y", "b"), (301, None, "a"), (302, "solo", "only")]
    d = docs(spark, rows)
    got = mixing.taken(d).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    assert sorted(round(v, 6) for v in {r.target for r in got}) == sorted({round(v, 6) for v in want.values()})
    assert all(r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert all(abs(a - t) <= 64 + 0.02 * t for t, a in by.values())
    again = mixing.taken(d.repartition(7)).collect()
    total = lambda rs: sorted((r.doc_id or -1, r.size, r.taken) for r in rs)
    assert total(got) == total(again)
    assert mixing.taken(d.where("false")).count() == 0


def test_mixed_documents_hold_what_is_taken(spark):
    rnd = random.Random(8)
    d = docs(spark, [(k, "\n ".join(f"d{k}w{j}" for j in range(rnd.choice([1, 70, 500]))), f"s{k % 3}") for k in range(60)])
    taken = {r.doc_id: r.taken for r in mixing.taken(d).collect()}
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns
    got = {r.doc_id: r.text.split() for r in mixed.collect()}
    assert {k: len(v) for k, v in got.items()} == {k: v for k, v in taken.items() if v}
    assert all(w.startswith(f"d{k}w") for k, v in got.items() for w in v)


def test_the_draw_decides_what_is_taken(spark, monkeypatch):
    """Shard counts add up to the sources' slots and vary as a draw does; passes are permutations; blocks by shard hold what taken() reports; and another draw takes otherwise."""
    rnd = random.Random(16)
    d = docs(spark, [(k if k % 7 else None, " ".join(f"d{k}w{j}" for j in range(rnd.choice([0, 1, 70, 4000]))), f"s{k % 3}") for k in range(60)] + [(None, None, None), (5, "é " * 30_000, "s1")])
    m = mixing.mix(d, shard_words=4000)
    draw = {(r.key, r.shard): (r["count"], r.first) for r in m["draw"].collect()}
    slots = m["slots"].collect()
    assert len(slots) == sum(n for n, _ in draw.values()) and len({s for _, s in draw}) > 10
    for key in {k for k, _ in draw}:
        own = sorted(r.slot for r in slots if r.key == key)
        assert own == list(range(len(own)))
        blocks = [r.block for r in sorted((r for r in slots if r.key == key), key=lambda r: r.slot)]
        n = max(blocks) + 1
        assert sorted(blocks[:n]) == list(range(n))[: len(blocks)] or len(blocks) < n and len(set(blocks)) == len(blocks)
        assert blocks[:n] != sorted(blocks[:n]) or n < 3
        share = len(own) / len({s for _, s in draw})
        counts = [draw.get((key, s), (0, 0))[0] for s in {s for _, s in draw}]
        assert len(own) < 100 or 0.2 < np.var(counts) / share < 3
    assert {(k, s): sum(r.key == k and r.shard == s for r in slots) for k, s in draw} == {x: n for x, (n, _) in draw.items()}
    words = collections.Counter()
    for r in mixing.mixed_blocks(d, shard_words=4000).collect():
        words[r.doc_id] += len(r.text.split())
    total = collections.Counter()
    for r in mixing.taken(d, shard_words=4000).collect():
        total[r.doc_id] += r.taken
    assert +words == +total
    half = mixing.draws
    monkeypatch.setattr(mixing, "draws", lambda *a: half(*a).withColumn("count", F.floor(F.col("count") / 2)))
    assert mixing.taken(d, shard_words=4000).agg(F.sum("taken")).first()[0] < 0.7 * sum(total.values())


def test_mixing_plan_is_native(spark):
    d = docs(spark, [(1, "a b", "s")])
    for df in (mixing.taken(d), mixing.mixed_documents(d)):
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
        assert df.where(F.lit(True)).count() == 1
