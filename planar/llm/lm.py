"""Language-model scores from an Elias-Fano n-gram trie.

The model is a bigram model with absolute discounting over add-one unigrams. Its trie is dealt to shards by a hash of the context, hot
contexts (a share of 1 / HOT of all tokens or more, so at most HOT of them) by a hash of context and word. A shard has two levels: contexts,
an Elias-Fano sequence of word hashes with exact counts, and successors. A monotone Elias-Fano sequence of pointers gives the places of each
context's successors. A successor is the rank of its word among the shard's words plus the last value of the context before, which keeps
the sequence monotone but not unique: a word is found only by a successor search between the two pointers of its context, relative to the value
before the first. A successor has a 16-bit code of its discounted probability. Levels are written to one file and memory-mapped for
the queries.

Texts are cut into chunks of whole documents, tokenised once. Each chunk asks the shards for its distinct bigrams and
brings its training counts with them, so that one exchange both trains the shards and asks them; the codes go back to the chunk, which sums its documents' scores. Chunks
and shards have bounded sizes whose number grows with the corpus.

Defined results: null and empty texts are one end token; a null doc_id is a training document; repeated rows are counted and scored one by one;
ties don't occur; an empty table gives an empty result, and without training documents the base is log10(1 / 1) and the score is the base; a document over the size of a
chunk is a chunk of its own; other columns are not read. Words of a context are told apart by 40 bits of their hash, words alone by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.llm.common import held_out, integer_key, stored, text_bytes
from planar.llm.elias_fano import EliasFano

CHUNK_TOKENS, SHARD_TOKENS, HOT = 1_000_000, 2_000_000, 1024
DISCOUNT = 0.75
SEED, START = 7, 1  # the hash of words, and the hash that stands for the start of a document
STEPS = 2048  # quantisation steps for a factor of two

CHUNK = "chunk long, doc_ids array<long>, train array<boolean>, sizes array<int>, tokens binary, words binary, n_train long"


def packed(*arrays) -> bytes:
    """Arrays as one compressed string; byte planes of integers compress better than the integers."""
    import numpy as np
    import zstandard

    parts = []
    for a in arrays:
        wide = 1
        while a.dtype != np.uint8 and wide < 8 and len(a) and int(a.max()) >> 8 * wide:
            wide += 1
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T
        parts += [np.array([len(a), wide], "<u8").tobytes(), np.ascontiguousarray(planes).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes) -> list:
    import numpy as np
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, wide = np.frombuffer(raw, "<u8", 2, at).tolist()
        a = np.zeros((n, 8), np.uint8)
        a[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at + 16).reshape(wide, n).T
        out.append(a.view("<u8").ravel())
        at += 16 + n * wide
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """Documents tokenised into chunks: local ids of tokens, and the hashes of the local words (the end token is the hash of no bytes)."""
    rows = docs.select(integer_key(docs), F.col("text").cast("string").alias("text"), (~held_out(F.col("doc_id"), 7)).alias("train"))

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        part, number = TaskContext.get().partitionId(), 0

        def row(ids, train, sizes, tokens, words):
            t = np.concatenate(tokens)
            used = np.bincount(t, minlength=len(words))
            order = np.argsort(-used, kind="stable")  # frequent words get small ids
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            h = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))[order]
            n_train = sum(s for s, x in zip(sizes, train) if x)
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
            values = [(part << 32) + number, ids, train, sizes, packed(rank[t].astype(np.uint64)), h.astype("<u8").tobytes(), n_train]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in CHUNK.split(", ")])

        ids, train, sizes, tokens, words, held = [], [], [], [], {b"": 0}, 0
        for b in batches:
            for key, t, x in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist()):
                w = t.lower().split()
                for new in set(w).difference(words):
                    words[new] = len(words)
                w.append(b"")
                tokens.append(np.fromiter(map(words.__getitem__, w), np.int32, len(w)))
                ids.append(key)
                train.append(x)
                sizes.append(len(w))
                held += len(w)
                if held >= CHUNK_TOKENS:
                    yield row(ids, train, sizes, tokens, words)
                    number += 1
                    ids, train, sizes, tokens, words, held = [], [], [], [], {b"": 0}, 0
        if ids:
            yield row(ids, train, sizes, tokens, words)

    return rows.mapInArrow(cut, CHUNK)


def word_counts(cut: DataFrame) -> DataFrame:
    """word (hash) and count over the training tokens."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                t = unpacked(b.column(2)[k].as_py())[0].astype(np.int64)
                h = np.frombuffer(b.column(3)[k].as_py(), "<u8")
                on = np.repeat(np.array(b.column(0)[k].as_py(), bool), b.column(1)[k].as_py())
                n = np.bincount(t[on], minlength=len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h[n > 0].view(np.int64)), pa.array(n[n > 0])], names=["word", "n"])

    return cut.select("train", "sizes", "tokens", "words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Bigrams:
    """The distinct bigrams of a chunk in the order in which they are asked: by shard, context, word."""

    def __init__(self, tokens, sizes, train, words, hot, shards: int):
        import numpy as np

        ends = np.cumsum(sizes)
        self.firsts = ends - sizes
        n = len(words)
        context = np.empty(len(tokens), np.int64)
        context[1:] = tokens[:-1]
        context[self.firsts] = n  # the start of a document
        h = np.concatenate([words, [np.uint64(START)]])
        key, self.which = np.unique(context * (n + 1) + tokens, return_inverse=True)
        on = np.repeat(np.asarray(train, bool), sizes)
        self.count = np.bincount(self.which[on], minlength=len(key))
        self.u, self.w = key // (n + 1), key % (n + 1)
        is_hot = np.isin(h, hot)
        with np.errstate(over="ignore"):
            mix = h * np.uint64(0x9E3779B97F4A7C15)
            where = np.where(is_hot[self.u], mix[self.u] ^ (h[self.w] * np.uint64(0xC2B2AE3D27D4EB4F)), mix[self.u])
            where = (where ^ (where >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.shard = ((where >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        self.h = h
        # The bigrams are in order of context and word already; small integers are sorted by radix.
        self.order = np.argsort(self.shard.astype(np.uint16) if shards <= 1 << 16 else self.shard, kind="stable")
        own = self.shard[self.order]
        self.cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        self.shards = own[self.cuts[:-1]].tolist()  # those that this chunk has bigrams of
        self.place = {s: k for k, s in enumerate(self.shards)}

    def part(self, s: int):
        """Places of shard s's bigrams, their distinct contexts (local ids) and the number of bigrams of each."""
        import numpy as np

        k = self.place[s]
        at = self.order[self.cuts[k] : self.cuts[k + 1]]
        u = self.u[at]
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
        return at, u[first], np.diff(np.concatenate([first, [len(u)]]))


def short(h):
    import numpy as np

    return h >> np.uint64(24)


class Levels:
    """One shard's trie, in arrays that may be memory-mapped."""

    NAMES = ("contexts", "pointers", "words", "successors")

    def __init__(self, parts: dict, universe: int, counts, types, codes):
        self.parts, self.universe, self.counts, self.types, self.codes = parts, universe, counts, types, codes

    @staticmethod
    def build(u, w, n, hot: dict) -> Levels:
        """From bigrams (context hashes, short word hashes, counts over 0), any order, repeats added up."""
        import numpy as np

        contexts, c = np.unique(u, return_inverse=True)
        words, r = np.unique(w, return_inverse=True)
        universe = max(len(words), 1)
        key = c.astype(np.uint64) * np.uint64(universe) + r.astype(np.uint64)
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key, n = key[first], np.add.reduceat(n, first) if len(first) else n
        own, rank = (key // np.uint64(universe)).astype(np.int64), key % np.uint64(universe)
        pointers = np.searchsorted(own, np.arange(len(contexts) + 1))
        tops = rank[pointers[1:] - 1]  # the greatest rank of each context, which begins the next one's values
        value = rank + (np.cumsum(tops) - tops)[own] if len(own) else rank
        total = np.bincount(own, weights=n, minlength=len(contexts)).astype(np.int64)
        for k in np.flatnonzero(np.isin(contexts, np.fromiter(hot, np.uint64, len(hot)))).tolist():
            total[k] = hot[int(contexts[k])]
        p = (n - DISCOUNT) / total[own] if len(own) else np.zeros(0)
        codes = np.clip(np.rint(-np.log2(p) * STEPS), 1, 65535).astype("<u2")
        parts = {
            "contexts": EliasFano.encode(contexts, 1 << 64), "pointers": EliasFano.encode(pointers, len(value) + 1),
            "words": EliasFano.encode(words, 1 << 40), "successors": EliasFano.encode(value, int(value[-1]) + 1 if len(value) else 1),
        }
        return Levels(parts, universe, total, np.diff(pointers), codes)

    def save(self, path: str) -> None:
        """All levels in one file: a table of kinds, lengths and offsets, then the arrays."""
        import json

        import numpy as np

        arrays = [np.array([self.universe], np.int64), self.counts, self.types, self.codes] + [a for k in self.NAMES for a in self.parts[k].parts()]
        table, at = [], 0
        for a in arrays:
            table.append((a.dtype.str, len(a), at))
            at += -(-a.nbytes // 8) * 8
        head = json.dumps(table).encode()
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
            for a in arrays:
                f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))

    @staticmethod
    def open(path: str) -> Levels:
        import json

        import numpy as np

        raw = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        base = 8 + size + (-size % 8)
        arrays = [np.frombuffer(raw, kind, n, base + at) for kind, n, at in json.loads(raw[8 : 8 + size].tobytes())]
        parts = {k: EliasFano(*arrays[4 + 3 * i].tolist(), *arrays[5 + 3 * i : 7 + 3 * i]) for i, k in enumerate(Levels.NAMES)}
        return Levels(parts, int(arrays[0][0]), *arrays[1:4])

    def context(self, u):
        """Places of contexts, -1 if unknown."""
        return self.parts["contexts"].find(u)

    def range(self, c):
        """First and last + 1 successor of each context, by the pointers."""
        import numpy as np

        return self.parts["pointers"].access(c).astype(np.int64), self.parts["pointers"].access(c + 1).astype(np.int64)

    def code(self, c, runs, w):
        """Codes of the successors w (short hashes) of contexts at places c, `runs` of them for each; 0 if unknown."""
        import numpy as np

        first, last = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        on = c >= 0
        first[on], last[on] = self.range(c[on])
        base = np.zeros(len(c), np.uint64)
        later = first > 0
        base[later] = self.parts["successors"].access(first[later] - 1)
        r = self.parts["words"].find(w)
        of = np.repeat(np.arange(len(c)), runs)
        known = np.flatnonzero((r >= 0) & on[of])
        of = of[known]
        at = self.parts["successors"].find(base[of] + r[known].astype(np.uint64), first[of], last[of])
        out = np.zeros(len(w), np.uint16)
        out[known[at >= 0]] = self.codes[at[at >= 0]]
        return out


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    cut = stored(chunks(docs), "lm-chunks")
    counts = stored(word_counts(cut), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    hot = {r["word"] % 2**64: r["n"] for r in counts.where(F.col("n") * HOT >= total).collect()} if total else {}  # at most HOT rows
    end = _end_hash()
    ends = counts.where(F.col("word") == F.lit(end - 2**64 if end >= 2**63 else end)).select("n").first()
    documents = ends["n"] if ends else 0
    hot[START] = documents
    tokens = cut.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARD_TOKENS))
    hot_words = sorted(hot)

    def planned(row: dict):
        import numpy as np

        t = unpacked(row["tokens"])[0].astype(np.int64)
        return t, Bigrams(t, np.array(row["sizes"], np.int64), row["train"], np.frombuffer(row["words"], "<u8"), np.array(hot_words, np.uint64), shards)

    def ask(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                _, g = planned(row)
                for s in g.shards:
                    at, u, runs = g.part(s)
                    blob = packed(g.h[u], runs.astype(np.uint64), short(g.h[g.w[at]]), g.count[at].astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "chunk", "blob"])

    def answer(group):
        """Builds a shard's levels from what all chunks bring, and answers each chunk from the mapped file."""
        import os
        import tempfile

        import numpy as np
        import pyarrow as pa

        asked = [(c, unpacked(x)) for c, x in zip(group.column("chunk").to_pylist(), group.column("blob").to_pylist())]
        seen = [(np.repeat(u, runs.astype(np.int64))[n > 0], w[n > 0], n[n > 0].astype(np.int64)) for _, (u, runs, w, n) in asked]
        levels = Levels.build(*[np.concatenate([x[k] for x in seen]) for k in range(3)], hot)
        out = []
        with tempfile.TemporaryDirectory() as folder:
            levels.save(path := os.path.join(folder, "levels"))
            mapped = Levels.open(path)
            h = np.array(hot_words, np.uint64)
            c = mapped.context(h)
            out.append((-1, packed(h[c >= 0], mapped.types[c[c >= 0]].astype(np.uint64))))
            for chunk, (u, runs, w, _) in asked:
                c = mapped.context(u)
                known = np.maximum(c, 0)
                some = mapped.counts if len(mapped.counts) else np.zeros(1, np.int64)
                kinds = mapped.types if len(mapped.types) else np.zeros(1, np.int64)
                codes = mapped.code(c, runs.astype(np.int64), w)
                out.append((chunk, packed(np.where(c >= 0, some[known], 0).astype(np.uint64), np.where(c >= 0, kinds[known], 0).astype(np.uint64), codes.astype(np.uint64))))
            del mapped
        shard = group.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard] * len(out), pa.int32()), "chunk": pa.array([c for c, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    asked = cut.select("chunk", "train", "sizes", "tokens", "words").mapInArrow(ask, "shard int, chunk long, blob binary")
    answers = stored(asked.groupBy("shard").applyInArrow(answer, "shard int, chunk long, blob binary"), "lm-answers")

    def hot_types(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for x in b.column(0).to_pylist():
                h, n = unpacked(x)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.view(np.int64))], names=["word", "n"])

    spread = answers.where("chunk = -1").select("blob").mapInArrow(hot_types, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    types = {r["word"] % 2**64: r["n"] for r in spread.collect()}  # at most HOT + 1 rows

    def score(key, left, right):
        import numpy as np
        import pyarrow as pa

        row = left.to_pylist()[0]
        t, g = planned(row)
        n_words = len(g.h) - 1
        seen, kinds, alpha = np.zeros(n_words + 1), np.zeros(n_words + 1), np.zeros(len(g.u))
        for s, blob in zip(right.column("shard").to_pylist(), right.column("blob").to_pylist()):
            at, u, _ = g.part(s)
            c, k, codes = unpacked(blob)
            seen[u], kinds[u] = c, k
            alpha[at] = np.where(codes > 0, np.exp2(-codes.astype(float) / STEPS), 0)
        for k in np.flatnonzero(np.isin(g.h, np.array(hot_words, np.uint64))).tolist():
            seen[k], kinds[k] = hot[int(g.h[k])], types.get(int(g.h[k]), 0)
        seen[:n_words][g.h[:n_words] == np.uint64(end)] = documents
        one = (seen[:n_words] + 1) / (total + distinct + 1)
        rest = np.where(seen > 0, DISCOUNT * kinds / np.maximum(seen, 1), 1.0)
        two = alpha + rest[g.u] * one[g.w]
        base = np.add.reduceat(np.log10(one)[t], g.firsts)
        full = np.add.reduceat(np.log10(two)[g.which], g.firsts)
        known = np.add.reduceat((seen[:n_words] > 0)[t].astype(np.int64), g.firsts)
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "train": pa.array(row["train"], pa.bool_()), "n_tokens": pa.array(row["sizes"], pa.int64()), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(full)})

    left = cut.select("chunk", "doc_ids", "train", "sizes", "tokens", "words")
    out = left.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk")).applyInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _end_hash() -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b"", SEED)
