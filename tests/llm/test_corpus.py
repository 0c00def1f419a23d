"""SimHash, suffixes, language model, token files, decontamination, chat and the pipeline, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planar.llm.common import stored
from planar.llm import chat, decontamination, lm, simhash, suffixes, token_files
from planar.llm.elias_fano import EliasFano

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, shard int"


def docs(spark, rows):
    """Documents with columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, 6) for i, t in rows], DOCS)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(n))


EDGES = [(None, "no id here"), (-5, None), (-6, ""), (-7, " \t\n"), (-8, "é ü\u00a0ß Ж"), (-9, "one"), (-9, "one")]


def edited(rnd, text, n=1):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = "changed"
    return " ".join(w)


# SimHash


def components(ids, near):
    label = list(range(len(ids)))
    while True:
        new = [min([label[j] for j in range(len(ids)) if near(i, j)] + [label[i]]) for i in range(len(ids))]
        if new == label:
            return label
        label = new


def test_bk_trees_equal_a_scan(monkeypatch):
    """Searches and components of many trees at once, one of them of 200 values, against all pairs of a tree."""
    rnd = np.random.default_rng(1)
    values, roots = [], []
    for size in (1, 2, 5, 50, 200, 2, 30):
        v = rnd.integers(0, 2**63, size // 4 + 1, dtype=np.uint64)
        v = np.unique(np.concatenate([v, *[v ^ rnd.integers(0, 1 << 7, len(v), dtype=np.uint64) for _ in range(4)]]))[:size]
        roots += [len(values)] * len(v)
        values += v.tolist()
    values, roots = np.array(values, np.uint64), np.array(roots)
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    want = (far <= 4) & (roots[:, None] == roots[None, :])
    q, k = simhash.BKTrees(values, roots).search(values, roots, 4)
    assert sorted(zip(q.tolist(), k.tolist())) == sorted(zip(*[x.tolist() for x in np.nonzero(want)]))
    label = components(list(range(len(values))), lambda i, j: want[i, j])
    step = simhash.steps
    for most in (1 << 20, 50):
        monkeypatch.setattr(simhash, "steps", lambda r, most=most: step(r, most))
        assert simhash.forest(values, roots, 4).tolist() == label
    assert step(roots, 50)[-1][1] == len(roots) and step(np.zeros(0, int)) == []
    # A search that followed no edges would find the roots only.
    assert len(set(k.tolist())) > len(set(roots.tolist()))


@pytest.mark.parametrize("split_over", [4096, 3])
def test_near_duplicates(spark, split_over):
    rnd = random.Random(3)
    base = [prose(rnd, 200) for _ in range(6)]
    rows = EDGES + [(k, base[k % 6] if k < 12 else edited(rnd, base[k % 6], 1 + k % 3)) for k in range(60)] + [(100, prose(rnd, 20_000))]
    got = simhash.near_duplicates(docs(spark, rows), split_over=split_over).collect()
    assert len(got) == len(rows)
    prints = simhash.fingerprints([(t or "").encode() for _, t in rows])
    ids = [i for i, _ in rows]
    label = components(ids, lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 4)
    want = collections.Counter()
    for k, i in enumerate(ids):
        own = [ids[j] for j in range(len(ids)) if label[j] == label[k] and ids[j] is not None]
        want[i, f"{prints[k]:016x}", min(own) if own else None] += 1
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("stars, split_over", [(2, 4096), (0, 4096), (1, 7)])
def test_similar_groups_reach_080(spark, monkeypatch, stars, split_over):
    """Pairs planted at a Jaccard similarity of 0.80 to 0.90, and under 0.8, against exact sets: by centres and trees, by trees alone, and by trees of seven members."""
    monkeypatch.setattr(simhash, "STARS", stars)
    monkeypatch.setattr(simhash, "SPLIT_OVER", split_over)
    rnd = random.Random(21)
    rows, edits = list(EDGES), {100: 2, 200: 4, 300: 6, 1000: 19}
    for k in range(80):
        n = (100, 200, 300, 1000)[k % 4]
        text = prose(rnd, n)
        rows += [(10 * k, text), (10 * k + 1, edited(rnd, text, edits[n] + k % 3 * (n // 100)))]
    hub = prose(rnd, 150)
    rows += [(5000 + k, edited(rnd, hub, 1 + k % 3)) for k in range(60)] + [(5100, hub), (5100, prose(rnd, 30))]
    sets = [set(zip(*[t[k:] for k in range(5)])) or {tuple(t)} - {()} for t in ((x or "").encode().lower().split() for _, x in rows)]
    alike = lambda i, j: sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    planted = [len(a & b) / len(a | b) for a, b in zip(sets[len(EDGES) :: 2], sets[len(EDGES) + 1 :: 2])][:80]
    assert sum(0.8 <= x <= 0.9 for x in planted) > 20 and sum(x < 0.8 for x in planted) > 20
    ids = [i for i, _ in rows]
    label = components(ids, lambda i, j: alike(i, j) or ids[i] is not None and ids[i] == ids[j])
    want = collections.Counter()
    for k, i in enumerate(ids):
        want[i, min((ids[j] for j in range(len(ids)) if label[j] == label[k] and ids[j] is not None), default=None)] += 1
    got = simhash.similar_groups(docs(spark, rows), corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR, split_over).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == want
    rows += [(None, rows[len(EDGES)][1]), (None, prose(rnd, 90))]  # a copy without an id, and a text of its own
    kept = corpus_pipeline.one_of_each_group(spark, docs(spark, rows), "").collect()
    assert {r.doc_id for r in kept} == {least if i is not None else None for i, least in want}
    assert sorted(r.text for r in kept if r.doc_id is None) == sorted([EDGES[0][1], rows[-1][1]])


def test_unlike_near_copies_never_become_pairs(spark, monkeypatch):
    """Near copies under 0.8 meet in workers only: no relation holds more of them than the members of shards."""
    rnd = random.Random(22)
    hub = prose(rnd, 150)
    rows = [(k, edited(rnd, hub, 3)) for k in range(300)]
    counts, stored = collections.Counter(), simhash.stored

    def counted(df, label):
        out = stored(df, label)
        counts[label] = max(counts[label], out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    simhash.similar_groups(docs(spark, rows), corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR).collect()
    assert counts["shard-members"] > 300 and max(counts.values()) <= simhash.BANDS * len(rows), counts


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_cells_link_what_is_similar(step):
    """The links of a cell join its components as all similar pairs of searchers and members do, in fewer links than rows, however the rows come in batches."""
    rnd = np.random.default_rng(6)
    rows = []
    for cell in range(12):
        base = rnd.integers(-(2**63), 2**63, (30, 8, 60, 1)[cell % 4])
        for k in range((1, 2, 25)[cell % 3]):
            own = np.unique(np.where(rnd.random(len(base)) < rnd.choice([0.02, 0.06, 0.2]), rnd.integers(-(2**63), 2**63, len(base)), base))
            one, two = simhash.seeded_fingerprints(own.view(np.uint64), 2).view(np.int64).tolist()
            count = np.bincount(own & (simhash.BUCKETS - 1), minlength=simhash.BUCKETS).astype(np.int16)
            rows += [(cell, 100 * cell + k, 100 * cell + k // 2, one, two, asks, len(own), count, own) for asks in ((0, 1) if k % 3 else (0,))]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int16()), pa.list_(pa.int64())]
    names = ["cell", "id", "component", "one", "two", "asks", "size", "counts", "set"]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + step]), kinds)], names=names) for at in range(0, len(rows), step)]
    tables = list(simhash.whole_cells(iter(batches)))
    assert [x for t in tables for x in t.column("id").to_pylist()] == [r[1] for r in rows]
    assert sum(len(set(t.column("cell").to_pylist())) for t in tables) == 12
    got = [(int(a[0]), int(b[0])) for t in tables for a, b in simhash.cell_links(t, 0.8)]
    similar = {(min(x[1], y[1]), max(x[1], y[1])) for x in rows for y in rows if x[0] == y[0] and x[5] > y[5] and x[2] != y[2] and 5 * len(np.intersect1d(x[8], y[8])) >= 4 * len(np.union1d(x[8], y[8]))}
    assert similar > set(got) and 5 < len(got) < len(rows)
    ids, component = sorted({r[1] for r in rows}), {r[1]: r[2] for r in rows}
    joined = [components(ids, lambda i, j, s=pairs: component[ids[i]] == component[ids[j]] or (min(ids[i], ids[j]), max(ids[i], ids[j])) in s) for pairs in (similar, set(got))]
    assert joined[0] == joined[1]


def test_pairs_bring_each_row_once_for_its_deals(spark):
    """A row goes only to the deals in which a pair asks for it, and all pairs find theirs."""
    pairs = [(1, 2)] + [(3, k) for k in range(10, 60)]
    rows = spark.createDataFrame([(k, f"row {k}") for k in range(70)], "id long, of string")
    df = spark.createDataFrame(pairs, "a long, b long")
    got = collections.Counter(r["id"] for r in simhash.asked(df, rows, "a").collect())
    assert got[1] == 1 and 1 < got[3] <= simhash.DEAL and set(got) == {1, 3}
    both = simhash.beside(simhash.beside(df, rows.withColumnRenamed("of", "p"), "a"), rows.withColumnRenamed("of", "q"), "b", df)
    assert sorted((r["a"], r["b"], r["p"], r["q"]) for r in both.collect()) == [(a, b, f"row {a}", f"row {b}") for a, b in pairs]


def test_bands_tell_similarity(spark):
    """Sets at 0.8 share a band, strangers none: what is compared does not grow with the number of strangers."""
    rnd = np.random.default_rng(5)
    shared = apart = 0
    for _ in range(300):
        base = rnd.integers(0, 2**63, 90, dtype=np.uint64)
        a, b, c = base, np.concatenate([base[:80], rnd.integers(0, 2**63, 10, dtype=np.uint64)]), rnd.integers(0, 2**63, 90, dtype=np.uint64)
        shared += bool((simhash.band_hashes(a) == simhash.band_hashes(b)).any())
        apart += bool((simhash.band_hashes(a) == simhash.band_hashes(c)).any())
    assert shared >= 298 and apart == 0 and not simhash.band_hashes(base[:0]).any()
    pairs = []
    for n in (100, 400):
        texts = random.Random(8)
        rows = [(k, prose(texts, 120)) for k in range(n)]
        rows += [(1000 + k, edited(texts, t, 1)) for k, t in rows[:50]]
        nodes = simhash.with_prints(docs(spark, rows), 5).select(F.col("node").alias("id"), F.posexplode("bands").alias("band", "shard"))
        pairs.append(simhash.star_pairs(nodes.withColumn("component", F.col("id")), 0).count())
    assert pairs[0] <= pairs[1] <= pairs[0] + 2 and pairs[0] >= 48


def test_a_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r.id: r.component for r in simhash.components(links).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and got[501] == 500


# Suffixes


def test_difference_set_covers_every_shift():
    d, v = suffixes.difference_set(), 17 * 17 + 17 + 1
    assert len(d) == 18 and {(a - b) % v for a in d for b in d} == set(range(v))


def test_suffix_removal(spark):
    rnd = random.Random(5)
    passage, long_ = prose(rnd, 90)[:450], prose(rnd, 300)
    rows = EDGES + [(1, prose(rnd, 60) + passage + prose(rnd, 50)), (2, "é" + passage), (3, passage[:400]), (4, passage[1:400]), (5, long_), (5, long_), (6, "ab" * 500), (7, long_[200:900] + "é" * 300 + long_[100:600])]
    rows += [(10 + k, prose(rnd, rnd.randint(1, 150))) for k in range(40)] + [(90, prose(rnd, 30_000))]
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = collections.Counter()
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    got = collections.Counter(tuple(r) for r in suffixes.removal(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want
    assert suffixes.removal(docs(spark, rows).where("false")).count() == 0


# Language model


def test_elias_fano():
    rnd = np.random.default_rng(2)
    for universe, n in ((1 << 64, 700), (1000, 500), (10**12, 900), (1 << 40, 1), (5, 0), (7, 7)):
        v = np.unique(np.concatenate([rnd.integers(0, universe, n, dtype=np.uint64), np.arange(min(n, 300, universe), dtype=np.uint64)]))
        e = EliasFano.encode(v, universe)
        assert (e.access(np.arange(len(v))) == v).all()
        q = np.concatenate([v, rnd.integers(0, universe, 50, dtype=np.uint64)])
        at = {x: k for k, x in enumerate(v.tolist())}
        assert e.find(q).tolist() == [at.get(x, -1) for x in q.tolist()]


def test_levels_survive_the_file(tmp_path):
    u, w, n = np.array([9, 9, 4, 9], np.uint64), np.array([3, 1, 3, 3], np.uint64), np.array([2, 1, 5, 1])
    made = lm.Levels.build(u, w, n, {})
    made.save(str(tmp_path / "l"))
    got = lm.Levels.open(str(tmp_path / "l"))
    c = got.context(np.array([4, 9, 5], np.uint64))
    assert c.tolist() == [0, 1, -1] and got.counts.tolist() == [5, 4] and got.types.tolist() == [1, 2]
    assert [x.tolist() for x in got.range(c[:2])] == [[0, 1], [1, 3]]
    code = got.code(c[[1, 0, 2]], np.array([2, 1, 1]), np.array([3, 2, 3, 3], np.uint64))
    assert code.tolist()[1:] == [0, int(code[2]), 0] and 2 ** (-float(code[0]) / lm.STEPS) == pytest.approx(2.25 / 4, rel=1e-3)


def test_successors_are_found_by_the_pointers_only():
    """Against a dictionary; and other pointers find other words, so the search does depend on them."""
    rnd = np.random.default_rng(5)
    u, w = rnd.integers(0, 40, 900, dtype=np.uint64), rnd.integers(0, 60, 900, dtype=np.uint64)
    n = rnd.integers(1, 5, 900)
    levels = lm.Levels.build(u, w, n, {})
    asked = np.arange(62, dtype=np.uint64)
    c = levels.context(np.arange(42, dtype=np.uint64))
    code = levels.code(c, np.full(42, 62), np.tile(asked, 42)).reshape(42, 62)
    count = np.zeros((42, 62))
    np.add.at(count, (u.astype(int), w.astype(int)), n)
    assert ((code > 0) == (count > 0)).all()
    p = np.exp2(-code.astype(float) / lm.STEPS)[count > 0]
    assert p == pytest.approx(((count - lm.DISCOUNT) / np.maximum(count.sum(1), 1)[:, None])[count > 0], rel=1e-3)
    shifted = levels.parts["pointers"].access(np.arange(41)).astype(np.int64) + 1
    levels.parts["pointers"] = EliasFano.encode(np.minimum(shifted, len(levels.codes)), len(levels.codes) + 1)
    assert ((levels.code(c, np.full(42, 62), np.tile(asked, 42)).reshape(42, 62) > 0) != (count > 0)).any()


@pytest.mark.parametrize("hot", [lm.HOT, 8])
def test_scores(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 700)
    rnd = random.Random(7)
    vocabulary = [prose(rnd, 1) for _ in range(80)]
    rows = EDGES + [(k, " ".join(rnd.choice(vocabulary[: 20 + k]) for _ in range(rnd.randint(1, 60))).title()) for k in range(70)] + [(200, "w " * 9000)]
    low = lambda t: [x for x in (t or "").encode().lower().split()] + [None]
    tokens = [low(t) for _, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    c, b = collections.Counter(), collections.Counter()
    for w, x in zip(tokens, train):
        if x:
            c.update(w)
            b.update(zip(["start", *w[:-1]], w))
    n, v, kinds, total = sum(c.values()), len(c), collections.Counter(u for u, _ in b), collections.Counter()
    for (u, _), k in b.items():
        total[u] += k
    one = lambda x: (c[x] + 1) / (n + v + 1)
    two = lambda u, x: (max(b[u, x] - lm.DISCOUNT, 0) + lm.DISCOUNT * kinds[u] * one(x)) / total[u] if total[u] else one(x)
    want = sorted((i or 0, len(w), sum(c[x] > 0 for x in w), not x, round(sum(math.log10(one(y)) for y in w), 6)) for (i, _), w, x in zip(rows, tokens, train))
    got = lm.scores(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6)) for r in got) == want
    full = sorted((i or 0, sum(math.log10(two(u, y)) for u, y in zip(["start", *w[:-1]], w))) for (i, _), w in zip(rows, tokens))
    assert [r[1] for r in sorted((r.doc_id or 0, r.score) for r in got)] == pytest.approx([x for _, x in full], rel=5e-4, abs=5e-3)
    assert {r.train_tokens for r in got} == {n}
    assert lm.scores(docs(spark, rows).where("false")).count() == 0


def test_the_model_sums_to_one(spark):
    """Over the vocabulary and one unknown word, from the exact counts that the shards hold."""
    w = [1, 1, 2, 3, 3, 3]
    u = np.array([9] * len(w), np.uint64)
    levels = lm.Levels.build(u, np.array(w, np.uint64), np.ones(len(w), np.int64), {})
    c = levels.context(np.array([9] * 3, np.uint64))
    alpha = np.exp2(-levels.code(c[:1], np.array([3]), np.array([1, 2, 3], np.uint64)).astype(float) / lm.STEPS)
    assert alpha.sum() + lm.DISCOUNT * levels.types[0] / levels.counts[0] == pytest.approx(1, rel=1e-3)


# Token files


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(9)
    rows = EDGES + [(1, "Don't <|endoftext|> stop... it's $$$, ΑΣ, e\u0301clair"), (2, "x" * 3000 + " " + "y, " * 5000)] + [(k, prose(rnd, rnd.randint(1, 80)).title() + ",") for k in range(3, 120)] + [(7, "again")]
    tok = Tokenizer.from_file(token_files.tokenizer_path())
    d = docs(spark, rows)
    token_files.write(d, path := f"file://{tmp_path}/t")
    got = token_files.digests(spark, path).orderBy("start").collect()
    start = 0
    exact = collections.Counter()
    for r in got:
        assert r.start == start
        start += r.n_tokens
        exact[r.doc_id, r.n_tokens, r.ids_crc32] += 1
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [1] for k, (_, t) in enumerate(rows)}
    assert exact == collections.Counter((i, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())) for k, (i, _) in enumerate(rows))
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    asked = spark.createDataFrame([(2,), (7,), (55,), (10_000,), (None,)], "doc_id long")
    found = sorted((r.doc_id, r.ids) for r in token_files.lookup(spark, path, asked).collect())
    assert found == sorted((i, ids[k]) for k, (i, _) in enumerate(rows) if i in (2, 7, 55))
    assert token_files.token_files(d.where("false")).count() == 0


def test_words_equal_the_tokenizer():
    """Random texts with letters that change their kind or length in lower case, marks, controls and white space of all sorts."""
    from tokenizers import Tokenizer

    rnd = random.Random(10)
    odd = ["\u0130", "\u0130.", "\u0301", "\u0307", "\u00df", "\u1e9e", "\ufb01", "\u03a3", "\u03c2", "\u00a0", "\u2028", "\U0001f600", "\u0345", "\u01f0", "\u0149", "\u2167", "\u00aa", "\u0663", "\u212a", "\x00", "\x1f", "\x85", "<|endoftext|>"]
    pool = list("abcXYZ .,;!?'\"$-\n\t\x0b0123") + odd
    any_ = lambda: chr(rnd.choice([rnd.randrange(32, 128), rnd.randrange(32, 0x600), rnd.randrange(32, 0xD7FF), rnd.randrange(0x10000, 0x1FFFF)]))
    texts = ["ADI\u0307! KADIN\u0130, eve", ""] + ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["".join(any_() for _ in range(rnd.randint(1, 20))) for _ in range(3000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(token_files.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert list(token_files.Encoder(token_files.tokenizer_path()).encode([t.encode() for t in texts])) == want


def test_the_hash_is_perfect():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 5000))
    seeds = token_files.perfect_hash(keys)
    assert sorted(token_files.slots(keys, seeds, len(keys)).tolist()) == list(range(len(keys)))


# Decontamination


def test_decontamination(spark):
    rnd = random.Random(11)
    items = [(k, prose(rnd, rnd.randint(12, 60)).capitalize() + ".") for k in range(30)] + [(50, None), (51, ""), (52, "éa ÉB éc ÉD ée ÉF ég ÉH éi ÉJ ék ÉL")]
    text = dict(items)
    rows = EDGES + [(k, prose(rnd, rnd.randint(1, 300))) for k in range(200)] + [(300, prose(rnd, 9000) + " " + text[3] + " " + prose(rnd, 9000))]
    rows += [(301, prose(rnd, 40) + " " + text[5].upper() + " tail"), (302, edited(rnd, text[8], 2)), (303, text[52].upper() + " x"), (303, text[52]), (304, text[1] + " " + text[2])]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, rows), b).collect()}
    assert got == {(300, 3), (301, 5), (302, 8), (303, 52), (304, 1), (304, 2)}
    assert decontamination.contaminated(docs(spark, rows).where("false"), b).count() == 0
    assert decontamination.contaminated(docs(spark, rows), b.where("false")).count() == 0


def whole_search(rows, items):
    """(doc_id, item_id) by the longest common subsequence with every stretch of every document."""
    found = set()
    for i, text in rows:
        doc = decontamination.words((text or "").encode())
        for k, x in items:
            w = decontamination.words(x.encode())
            size = decontamination.stretch(len(w))
            best = max((decontamination.subsequence(w, doc[a : a + size]) for a in range(len(doc))), default=0) / len(w)
            answered = any(doc[a : a + 5] == w[-5:] for a in range(len(doc)))
            if best >= 0.8 or best >= 0.6 and answered:
                found.add((i, k))
    return found


def test_paraphrases_with_their_rare_words_replaced(spark):
    rnd = random.Random(31)
    common = [prose(rnd, 1) for _ in range(60)]
    rows = [(k, " ".join(rnd.choice(common) for _ in range(rnd.randint(20, 90)))) for k in range(120)]
    items, planted = [], set()
    for k in range(20):
        m = rnd.choice([16, 24, 40])
        w = [rnd.choice(common) if j % 2 or j >= m - 5 else prose(rnd, 1) for j in range(m)]
        items.append((k, " ".join(w)))
        kept = -(-m * 6 // 10)
        gone = set([j for j in range(0, m - 5, 2)][: m - kept])
        text = [prose(rnd, 1) if j in gone else x for j, x in enumerate(w)]
        rows.append((1000 + k, " ".join([prose(rnd, 8 + k), *text, prose(rnd, 20)])))
        planted.add((1000 + k, k))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = whole_search(rows, items)
    assert planted <= want
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, rows), b).collect()} == want


def test_windows_equal_counts_of_every_window(monkeypatch):
    """The inverted lists against all windows times all items, with slabs of few words."""
    monkeypatch.setattr(decontamination, "SLAB_WORDS", 40)
    rnd = random.Random(33)
    for size in (30, 400):
        items = [[rnd.randint(1, size) for _ in range(rnd.randint(1, 40))] for _ in range(25)]
        sizes = [rnd.choice([0, 1, 15, 16, 17, 90, 400]) for _ in range(40)]
        held = [rnd.randint(0, size) for _ in range(sum(sizes))]
        at = 60
        for k in range(0, len(held) - 50, 97):
            held[k : k + len(items[k % 25])] = items[k % 25]
        held = held[: sum(sizes)]
        c = decontamination.Blocks({"words": lm.packed(np.array(held, np.uint64)), "sizes": sizes, "doc_ids": list(range(40))})
        df = np.bincount(held, minlength=size + 1)
        rare, need, wide = decontamination.bounds(items, df)
        total, last, want = int(c.count.sum()), (c.first + c.count)[c.doc_of], set()
        for k in range(25):
            member = np.zeros(size + 1, int)
            member[rare[k]] = 1
            upto = np.concatenate([[0], np.cumsum(np.bincount(c.block, member[c.words[c.at]], total))])
            want |= {(b, k) for b in range(total) if upto[min(b + wide[k], last[b])] - upto[b] >= need[k]}
        assert set(decontamination.Lists(rare, need, wide, size + 1).windows(c)) == want and len(want) > at


def test_answers_decide_between_60_and_80_percent(spark):
    rnd = random.Random(34)
    w = [prose(rnd, 1) for _ in range(30)]
    kept = [x for k, x in enumerate(w) if k % 10 not in (0, 3, 6)]  # 70 %, the last five but one among them
    items = spark.createDataFrame([(1, " ".join(w), "forty two"), (2, " ".join(reversed(w)), None)], "item_id long, text string, answer string")
    rows = [(1, " ".join(kept)), (2, " ".join(kept) + " forty two"), (3, "forty two " + " ".join(kept[: len(kept) // 2])), (4, " ".join(w[:25])), (5, " ".join(reversed(w[:5])) + " " + " ".join(reversed(w)))]
    got = {(r.doc_id, r.item_id, r.answered) for r in decontamination.contaminated(docs(spark, rows), items).collect()}
    assert got == {(2, 1, True), (4, 1, False), (5, 2, True)}


def test_the_space_is_that_of_the_whole_matrix(spark):
    """Leading singular values and the span against a full decomposition of all documents' blocks."""
    rnd = random.Random(35)
    themes = [[f"t{k}w{j}" for j in range(20)] for k in range(5)]
    rows = [(k, " ".join(rnd.choice(themes[k % 5]) for _ in range(rnd.randint(5, 60)))) for k in range(150)]
    vocabulary = {x: n + 1 for n, x in enumerate(sorted({x for t in themes for x in t}))}
    code = lambda t: [vocabulary[x] for x in t.split()]
    blocks = [code(t)[a : a + 16] for _, t in rows for a in range(0, len(t.split()), 16)]
    idf = np.linspace(0.5, 2, len(vocabulary) + 1)
    idf[0] = 0
    full = np.zeros((len(blocks), len(idf)))
    for r, b in enumerate(blocks):
        np.add.at(full[r], b, idf[b])
        full[r] /= np.sqrt((idf[b] ** 2).sum())
    made = spark.createDataFrame([([i for i, _ in rows[k::3]], [len(t.split()) for _, t in rows[k::3]], bytearray(lm.packed(np.array([x for _, t in rows[k::3] for x in code(t)], np.uint64)))) for k in range(3)], "doc_ids array<long>, sizes array<int>, words binary")
    space = decontamination.latent_space(made, idf)
    values = np.linalg.svd(full, compute_uv=False)[:5]
    got = np.linalg.svd(full @ space, compute_uv=False)[:5]
    assert space.shape == (len(idf), decontamination.RANK) and got == pytest.approx(values, rel=0.02)


def test_widespread_numeric_and_common_items(spark):
    rnd = random.Random(32)
    spread, few = prose(rnd, 30), prose(rnd, 3)
    items = [(1, spread), (2, "What is 17 times 23 plus 4096 minus 58? It is 4429"), (3, " ".join(few.split() * 6)), (4, "the of " * 9)]
    rows = [(k, prose(rnd, 60) + (" " + spread if k % 3 == 0 else "") + " " + few + " the of " + prose(rnd, 20)) for k in range(120)]
    rows += [(200, "so " + items[1][1].lower()), (201, "what is 18 times 24 plus 5096 minus 59 it is 5429"), (202, prose(rnd, 20) + " " + items[2][1]), (203, prose(rnd, 9) + " the of" * 9)]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = whole_search(rows, items)
    assert {(k, 1) for k in range(0, 120, 3)} | {(200, 2), (202, 3), (203, 4)} <= want and (201, 2) not in want
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, rows), b).collect()} == want


def test_the_latent_space_retrieves_every_hit_and_not_all_windows():
    """Of all windows and items: the bound holds for the whole inner product, no hit is lost, and windows are left out."""
    rnd = random.Random(8)
    items = [[rnd.randint(1, 60) for _ in range(rnd.choice((12, 25)))] for _ in range(6)]
    texts = [[x if rnd.random() < 0.08 else 0 for x in (rnd.randint(1, 60) for _ in range(120))] for _ in range(40)]
    for k, t in enumerate(texts[:12]):  # with six to nine tenths of an item
        w = [x if rnd.random() < (0.65, 0.9)[k % 2] else 0 for x in items[k % 6]]
        t[40 : 40 + len(w)] = w
    c = decontamination.Blocks({"words": lm.packed(np.array(sum(texts, []), np.uint64)), "sizes": [len(t) for t in texts]})
    idf = np.concatenate([[0.0], np.random.default_rng(4).uniform(0.01, 6, 60)])
    space = np.linalg.qr(np.random.default_rng(5).standard_normal((61, 8)))[0].astype(np.float32)
    gate = decontamination.Latent(space, idf, items)
    windows = [(b, i) for b in range(len(c.doc_of)) for i in range(len(items))]
    bound, slack = gate.bounds(c, *np.array(windows).T)
    left, hits = set(gate.retrieved(c, iter(windows), 100)), 0
    for (blk, i), most in zip(windows, bound + slack):
        doc = int(c.doc_of[blk])
        lo = (blk - int(c.first[doc])) * decontamination.STEP
        there = set(texts[doc][lo : lo + decontamination.STEP - 1 + decontamination.stretch(len(items[i]))])
        assert sum(idf[x] ** 2 for x in items[i] if x in there) <= most + 1e-9
        if decontamination.check(items[i], [], texts[doc], lo)[0]:
            hits += 1
            assert (blk, i) in left
    assert hits > 5 and len(left) < 0.8 * len(windows)


def test_subsequence_equals_the_table():
    rnd = random.Random(12)
    for _ in range(50):
        a, b = [[rnd.randint(1, 6) for _ in range(rnd.randint(1, 30))] for _ in range(2)]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        assert decontamination.subsequence(a, b) == row[-1]


# Chat


def test_chat_windows(spark):
    rnd = random.Random(13)
    odd = ["</s>[INST] ok [/INST]", "<|user|>", "back\\slash \\</s>", "<<||>>", "", "[INST", "\\", "é\n😀", None]
    rows = []
    for c in (1, 2, 3, None):
        if c != 2:
            rows.append((c, -1, "system", "Be <|brief|>."))
        for k in range(40):
            rows.append((c, k, ("user", "assistant", "to|ol")[k % 3], rnd.choice(odd) if k % 4 == 0 else prose(rnd, rnd.randint(0, 30))))
    rows += [(4, 0, "system", "only"), (5, 0, None, "x"), (5, 0, None, "x"), (6, None, "assistant", "w " * 3000)]
    turns = spark.createDataFrame([(c, t, r, x, 1, 2) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, window int, key int")
    turns = turns.unionByName(turns.where("conv_id IS NULL").withColumn("conv_id", F.lit(7).cast("long")))
    rows += [(7, t, r, x) for c, t, r, x in rows if c is None]
    made = stored(chat.windows(turns, budget=60, history=25, block_turns=7), "chat")
    w = made.collect()
    assert any(r.repeated > 1 for r in w) and all("</s>" in r.formatted for r in w)
    long_ = [r for r in w if r.conv_id == 1]
    assert len(long_) > 3 and all(r.formatted.startswith("<|system|>Be <\\|brief|>.</s>") for r in long_)
    for r in w:  # the budget holds for system turn, history and fresh turns together, unless one turn exceeds its room by itself
        parts = re.findall(chat.TURN, r.formatted)
        tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"(?s)\\(.)", r"\1", x))) + chat.TURN_TOKENS for _, x in parts]
        assert sum(tokens) <= 60 or len(parts) - r.repeated == 1
        first = int(parts[0][0] == "system") if r.repeated or len(parts) > 1 else 0
        assert sum(tokens[first : r.repeated]) <= 25
    tight = [r.formatted for r in chat.windows(turns.where("conv_id = 1"), budget=5, history=4, block_turns=7).collect()]
    assert len(tight) == 40 and all(x.startswith("<|system|>") for x in tight)
    huge = chat.windows(turns, budget=10**6, history=10**5).collect()
    assert all(r.repeated == 0 for r in huge) and len(huge) == 8
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c in (1, 2, 3, None, 4, 5, 6, 7):
        own = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        under = "".join(x for _, r, x in own if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest())
    assert chat.windows(turns.where("false")).count() == 0
    assert "Python" not in chat.windows(turns)._jdf.queryExecution().toString() and "Arrow" not in chat.read_back(made)._jdf.queryExecution().toString()


# Pipeline


def test_stages_of_empty_and_clashing_tables(spark, tmp_path):
    """No rows in, no rows out; columns with the names of helpers keep their values; a text of 60,000 words goes through whole."""
    rnd = random.Random(17)
    kind = "doc_id long, text string, lang string, source string, n_chars long, copy int, mix_row string, mix_spans int, mix_pieces int, component_id long, component string, score double, shard int"
    rows = [(k, prose(rnd, 60_000 if k == 7 else 120), "en", None, 1, k, f"r{k}", -k, 5, 9, "c", 0.5, 3) for k in range(40)]
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(rnd, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for own in (rows, []):
        d = spark.createDataFrame(own, kind)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:], 1):
            d = stored(stage(spark, d, str(tmp_path)), "stage")
            if k < 4:
                assert d.columns == [c.split()[0] for c in kind.split(", ")]
                assert {(r.doc_id, r.copy, r.mix_row, r.mix_spans) for r in d.collect()} <= {(r[0], r[5], r[6], r[7]) for r in own}
        assert d.count() == len({r[0] for r in own})
    assert corpus_pipeline.good_quality(spark, spark.createDataFrame([], kind), str(tmp_path)).count() == 0


def test_the_pipeline_passes_texts_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for asked, held in ((10_000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (100, 100)):
            spark.conf.set(key, asked)
            corpus_pipeline.small_batches(spark)
            assert int(spark.conf.get(key)) == held
    finally:
        spark.conf.set(key, before)


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(15)
    good = [(0, prose(rnd, 3000))] + [(k, prose(rnd, rnd.randint(80, 200))) for k in range(1, 120)]
    bad = [(200 + k, " ".join(f"{w}$$$" for w in prose(rnd, 100).split())) for k in range(40)]
    item = prose(rnd, 30)
    more = [(300, edited(rnd, good[0][1])), (301, good[1][1]), (302, prose(rnd, 50) + " " + item + " " + prose(rnd, 50)), (303, None), (None, prose(rnd, 100))]
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in good + bad + more]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = stage(spark, d, str(tmp_path))
        if k < 4:
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        d.write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        left.append({r.doc_id for r in d.select("doc_id").collect()})
    assert not left[0] & {k for k, _ in bad} and {k for k, _ in good} <= left[0]
    assert 300 not in left[1] and 301 not in left[1] and {0, 1, 302, None} <= left[1]
    assert left[2] == left[1] - {302}
    assert left[4] == left[3] <= left[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect() == d.orderBy("start").collect()
