"""Benchmark decontamination by latent semantic retrieval.

Documents are turned once into word ids of the benchmark's vocabulary (0: another word). Inverse document frequencies come
from all their 16-word blocks. The blocks' TF-IDF passages are decomposed by a randomised SVD, whose products A'(A X) Spark sums over all
documents; hits carry the cosine of their window to the item's passages in that latent space.

The latent space decides which windows are checked for an item. Window and item are their coordinates in the space and the norm of what lies outside it; the inner product of
these is never less than that of the whole TF-IDF vectors, and a hit's is at least that of the item's commonest words that make 60 %. Windows below that can't hold a hit
(Latent), so no hit is lost, as a bound on the cosine itself would lose paraphrases. A hit needs 60 % of the item's words in their order within a stretch of STRETCH times the item, so at
most `missing` of them are absent, and of its missing + RARE rarest words at least RARE (all of a short item's) are near. Inverted lists from these
words to items give every window that holds as many, for the latent space to judge; the windows left are checked: first whether 60 % of the item's words are there, then the
longest common subsequence of words in every stretch that starts there, and for paraphrases the item's answer, its last words unless
there is an `answer` column. Items are taken in blocks of ITEMS and VOCABULARY words, which bounds vocabulary, space and what the driver holds;
every block meets all documents.

Defined results: null and empty texts and items match nothing; repeated items are reported by each id; repeated rows are searched one by
one and reported once for a doc_id; every item with a word is sought, however common or few its words are; a word is a run of letters
or one of digits; ties don't matter, as every hit is checked; an empty table gives an empty result; other columns than doc_id, text,
item_id, text and answer are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.llm.common import integer_key, stored, text_bytes
from planar.llm.lm import packed, unpacked

STEP, RANK, OVERSAMPLE, POWER = 16, 24, 8, 1
RARE, LEAST_IDF, SLAB_WORDS = 6, 0.01, 65_536
SUBSEQUENCE, PARAPHRASE, ANSWER_WORDS, STRETCH = 0.8, 0.6, 5, 1.25
ITEMS, VOCABULARY, CHUNK_WORDS = 20_000, 65_536, 1_000_000
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_DIGITS = re.compile(rb"[0-9]+")


def words(text: bytes) -> list[bytes]:
    """Words of letters in lower case, accented ones too, and numbers, which are words of their own beside letters."""
    text = text if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return _DIGITS.sub(rb" \g<0> ", text.lower().translate(_PLAIN)).split()


def encoded(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """Chunks of documents as word ids."""
    rows = docs.select(integer_key(docs), F.col("text").cast("string").alias("text"))

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        get, ids, sizes, held = vocabulary.get, [], [], []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([packed(np.array(held, np.uint64))], pa.binary())], names=["doc_ids", "sizes", "words"])

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                w = words(t)
                ids.append(key)
                sizes.append(len(w))
                held += [get(x, 0) for x in w]
                if len(held) >= CHUNK_WORDS:
                    yield row()
                    ids, sizes, held = [], [], []
        if ids:
            yield row()

    return rows.mapInArrow(encode, "doc_ids array<long>, sizes array<int>, words binary")


class Blocks:
    """The STEP-word blocks of a chunk's documents."""

    def __init__(self, row: dict):
        import numpy as np

        self.words = unpacked(row["words"])[0].astype(np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.count = np.maximum(-(-self.sizes // STEP), 1)
        self.first = np.cumsum(self.count) - self.count
        self.at = np.flatnonzero(self.words)
        doc = np.searchsorted(self.starts, self.at, "right") - 1
        # Empty documents share a start with the next; the last of them owns the words.
        self.block = self.first[doc] + (self.at - self.starts[doc]) // STEP
        self.doc_of = np.repeat(np.arange(len(self.sizes)), self.count)


def block_frequencies(chunks: DataFrame, size: int) -> tuple:
    """Number of blocks, and for each word id the blocks that hold it."""
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        df, blocks = np.zeros(size + 1, np.int64), 0
        for b in batches:
            for row in b.to_pylist():
                c = Blocks(row)
                own = np.unique(c.block * (size + 1) + c.words[c.at]) % (size + 1)
                df += np.bincount(own, minlength=size + 1)
                blocks += int(c.count.sum())
        df[0] = blocks
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(df[on])], names=["term", "n"])

    out = np.zeros(size + 1, np.int64)
    for r in chunks.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # the vocabulary of one block of items
        out[r["term"]] = r["n"]
    return int(out[0]), out


def passages_of(items: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(item, words) of the passages of items given as word ids."""
    return [(k, w[a : a + 2 * STEP]) for k, w in enumerate(items) for a in range(0, max(1, len(w) - STEP), STEP)]


def latent_space(chunks: DataFrame, idf):
    """The projection (terms x rank) onto the leading right singular vectors of the TF-IDF matrix of all blocks of all documents.

    A block is the sum of its words' idf vectors over the root of their squares' sum. At most VOCABULARY x (RANK + OVERSAMPLE) numbers come to the driver."""
    import numpy as np

    size, slab = len(idf), 2048

    def product(x):
        """A'(A X), summed over the documents slab by slab of terms."""
        x = x.astype(np.float32)
        weight = idf.astype(np.float32)

        def partial(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros((size, x.shape[1]))
            for b in batches:
                for row in b.to_pylist():
                    c = Blocks(row)
                    t, block = c.words[c.at], c.block
                    cut = np.searchsorted(block, block[SLAB_WORDS - 1 :: SLAB_WORDS], "right")  # slabs of whole blocks
                    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(t)]):
                        if lo == hi:
                            continue
                        own, first = np.unique(block[lo:hi], return_index=True)
                        w, v = t[lo:hi], weight[t[lo:hi]]
                        norm = np.sqrt(np.maximum(np.add.reduceat(v * v, first), 1e-12))
                        y = np.add.reduceat(v[:, None] * x[w], first, axis=0) / (norm * norm)[:, None]
                        order = np.argsort(w, kind="stable")
                        terms, at = np.unique(w[order], return_index=True)
                        of = np.repeat(np.arange(len(own)), np.diff(np.append(first, hi - lo)))
                        total[terms] += np.add.reduceat(v[order, None] * y[of[order]], at, axis=0)
            for s in range(0, size, slab):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([total[s : s + slab].tobytes()], pa.binary())], names=["slab", "part"])

        def add(group):
            import pyarrow as pa

            parts = [np.frombuffer(p) for p in group.column("part").to_pylist()]
            return pa.table({"slab": group.column("slab")[:1], "part": pa.array([np.sum(parts, 0).tobytes()], pa.binary())})

        rows = chunks.mapInArrow(partial, "slab long, part binary").groupBy("slab").applyInArrow(add, "slab long, part binary").collect()
        out = np.zeros((size, x.shape[1]))
        for r in rows:
            out[r["slab"] : r["slab"] + slab] = np.frombuffer(r["part"]).reshape(-1, x.shape[1])
        return out

    x = np.random.default_rng(1).standard_normal((size, min(RANK + OVERSAMPLE, size)))
    for _ in range(POWER):
        x = np.linalg.qr(product(x))[0]
    values, turn = np.linalg.eigh(x.T @ product(x))  # of A'A within the range found
    return (x @ turn[:, ::-1][:, :RANK]).astype(np.float32)


def subsequence(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel sums."""
    at: dict = {}
    for k, x in enumerate(item):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for y in region:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def least_common(size: int) -> int:
    """The words of an item of this size that a hit has in common at least."""
    return next(n for n in range(1, size + 1) if n / size >= PARAPHRASE)


def stretch(size: int) -> int:
    return int(size * STRETCH) + 2


def bounds(items: list[list[int]], df) -> tuple:
    """For each item its rarest words, how many of a window's words must be among them for a hit, and the blocks that hold every stretch starting in the first."""
    import numpy as np

    rare, need, wide = [], [], []
    for w in items:
        missing = len(w) - least_common(len(w))
        some = sorted(w, key=lambda x: (df[x], x))[: missing + RARE]
        rare.append(sorted(set(some)))
        need.append(len(some) - missing)
        wide.append(-(-(stretch(len(w)) + STEP - 1) // STEP))
    return rare, np.array(need), np.array(wide)


class Lists:
    """Inverted lists from words to the items that have them among their rarest."""

    def __init__(self, rare: list[list[int]], need, wide, size: int):
        import numpy as np

        word = np.concatenate([np.array(r, np.int64) for r in rare])
        item = np.repeat(np.arange(len(rare)), [len(r) for r in rare])
        order = np.argsort(word, kind="stable")
        self.items, self.need, self.wide = item[order], need, wide
        self.size = np.bincount(word, minlength=size)
        self.first = np.cumsum(self.size) - self.size

    def windows(self, c: Blocks) -> Iterator:
        """(block, item) of the windows of a chunk that hold as many of an item's rarest words as a hit needs, document by document."""
        import numpy as np

        total = int(c.count.sum())
        last = (c.first + c.count)[c.doc_of]  # the end of each block's document
        t, block = c.words[c.at], c.block
        on = self.size[t] > 0
        t, block = t[on], block[on]
        ends = np.searchsorted(block, np.unique(last[block[SLAB_WORDS - 1 :: SLAB_WORDS]]))  # slabs of whole documents
        for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(t)]):
            if lo == hi:
                continue
            n = self.size[t[lo:hi]]
            item = self.items[np.repeat(self.first[t[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            key, count = np.unique(item * (total + 1) + np.repeat(block[lo:hi], n), return_counts=True)
            upto = np.concatenate([[0], np.cumsum(count)])
            item, blk = key // (total + 1), key % (total + 1)
            # Windows that begin at a block with such a word: if these hold too few even over their whole reach back, so does every other.
            reach = self.wide[item]
            begin = np.searchsorted(key, key - reach + 1)
            final = np.searchsorted(key, key + reach)
            some = np.flatnonzero(upto[final] - upto[begin] >= self.need[item])
            if not len(some):
                continue
            item, blk, reach = item[some], blk[some], reach[some]
            start = np.repeat(blk - reach + 1, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            own, inside = np.repeat(item, reach), np.repeat(blk, reach)
            start = np.maximum(start, c.first[c.doc_of[inside]])
            asked = np.unique(own * (total + 1) + start)
            own, start = asked // (total + 1), asked % (total + 1)
            stop = np.minimum(start + self.wide[own], last[start])
            held = upto[np.searchsorted(key, own * (total + 1) + stop)] - upto[np.searchsorted(key, asked)]
            good = held >= self.need[own]
            yield from zip(start[good].tolist(), own[good].tolist())


class Latent:
    """The items in the latent space, and the inner product that a hit's window has with each at least."""

    def __init__(self, space, idf, items: list[list[int]]):
        import numpy as np

        self.weighted, self.square = idf[:, None] * space.astype(np.float64), np.square(idf)
        self.z = np.stack([self.weighted[w].sum(0) for w in items])
        counts = [np.unique(w, return_counts=True) for w in items]
        norm = np.array([(n * n * self.square[x]).sum() for x, n in counts])
        self.norm, self.rest = np.sqrt(norm), np.sqrt(np.maximum(norm - np.square(self.z).sum(1), 0))
        self.least = np.array([np.sort(self.square[w])[: least_common(len(w))].sum() for w in items])
        self.span = np.array([STEP - 1 + stretch(len(w)) for w in items])

    def bounds(self, c: Blocks, blk, item):
        """An upper bound of the inner product of each window, as the set of its words, and item; and what rounding may take from it."""
        import numpy as np

        doc = c.doc_of[blk]
        lo = c.starts[doc] + (blk - c.first[doc]) * STEP
        n = np.minimum(self.span[item], c.starts[doc] + c.sizes[doc] - lo)
        region, of = np.unique(np.stack([lo, n], axis=1), axis=0, return_inverse=True)
        of = of.reshape(-1)
        lo, n = region[:, 0], np.maximum(region[:, 1], 0)
        word = c.words[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        own = np.repeat(np.arange(len(lo)), n)
        size = len(self.square)
        key = np.unique((own * size + word)[word > 0])
        own, word = key // size, key % size
        z, norm = np.zeros((len(lo), self.z.shape[1])), np.bincount(own, self.square[word], len(lo))
        some, first = np.unique(own, return_index=True)
        if len(some):
            z[some] = np.add.reduceat(self.weighted[word], first, axis=0)
        rest = np.sqrt(np.maximum(norm - np.square(z).sum(1), 0))
        return (z[of] * self.z[item]).sum(1) + rest[of] * self.rest[item], 1e-4 * np.sqrt(norm)[of] * self.norm[item]

    def retrieved(self, c: Blocks, windows: Iterator, slab: int = 2048) -> Iterator:
        """Of the (block, item) windows those whose inner product can be a hit's."""
        import numpy as np

        while some := list(islice(windows, slab)):
            blk, item = np.array(some, np.int64).T
            bound, slack = self.bounds(c, blk, item)
            yield from (w for w, near in zip(some, (bound + slack >= self.least[item] * (1 - 1e-6)).tolist()) if near)


def check(item: list[int], answer: list[int], doc: list[int], lo: int) -> tuple[float, bool]:
    """The greatest share of the item that is a subsequence of a stretch starting in the block at word lo (0 if too small for a hit), and whether the answer is near."""
    size, n = stretch(len(item)), len(item)
    best = least_common(n) - 1
    a, end, hit = lo, min(lo + STEP, len(doc)), False
    while a < end:
        v = subsequence(item, doc[a : a + size])
        if v > best:
            best, hit = v, True
            if v == n:
                break
        a += best - v + 1  # a stretch k words on has at most k more in common
    if not hit:
        return 0.0, False
    low, high = max(0, lo - 2 * STEP - n), min(len(doc), lo + 3 * STEP + 2 * n)
    return best / n, bool(answer) and any(doc[a : a + len(answer)] == answer for a in range(low, high - len(answer) + 1))


def search(docs: DataFrame, items: list[tuple[int, list[bytes], list[bytes]]]) -> DataFrame:
    """Hits of one block of items (item_id, words, answer)."""
    import numpy as np

    spark = docs.sparkSession
    vocabulary: dict = {}
    for _, w, a in items:
        for x in (*w, *a):
            vocabulary.setdefault(x, len(vocabulary) + 1)
    coded = [[vocabulary[x] for x in w] for _, w, _ in items]
    answers = [[vocabulary[x] for x in a] for _, _, a in items]
    chunks = stored(encoded(docs, vocabulary), "decontamination-words")
    blocks, df = block_frequencies(chunks, len(vocabulary))
    idf = np.maximum(np.log((blocks + 1) / (df + 1.0)), LEAST_IDF)
    idf[0] = 0.0
    owners, parts = zip(*passages_of(coded))
    space = latent_space(chunks, idf)
    latent = np.stack([(idf[p][:, None] * space[p]).sum(0) for p in map(np.array, parts)]).astype(np.float32)
    latent /= np.maximum(np.sqrt(np.square(latent).sum(1)), 1e-9)[:, None]
    first_part = np.searchsorted(owners, np.arange(len(coded) + 1))
    lists = Lists(*bounds(coded, df), len(idf))
    gate = Latent(space, idf, coded)
    weighted = (idf[:, None] * space).astype(np.float32)
    item_ids = [i for i, _, _ in items]

    def cosine(window, item: int) -> float:
        z = weighted[window].sum(0)
        return round(float((latent[first_part[item] : first_part[item + 1]] @ z).max() / max(float(np.sqrt(np.square(z).sum())), 1e-9)), 4)

    bags = [Counter(w) for w in coded]

    def hits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                c = Blocks(row)
                found: dict = {}
                held, at = [], -1
                for blk, item in sorted(gate.retrieved(c, lists.windows(c))):
                    doc = int(c.doc_of[blk])
                    if found.get((doc, item), (0, 0, 0, 0))[3] == 1:
                        continue
                    if doc != at:
                        at, start = doc, int(c.starts[doc])
                        held = c.words[start : start + int(c.sizes[doc])].tolist()
                    lo, own = (blk - int(c.first[doc])) * STEP, bags[item]
                    there = Counter(held[lo : lo + STEP - 1 + stretch(len(coded[item]))])
                    if sum(min(n, there[x]) for x, n in own.items()) < least_common(len(coded[item])):
                        continue
                    share, answered = check(coded[item], answers[item], held, lo)
                    if (share >= SUBSEQUENCE or share >= PARAPHRASE and answered) and share > found.get((doc, item), (0, 0, 0, 0))[3]:
                        found[doc, item] = (row["doc_ids"][doc], item_ids[item], cosine(held[lo : lo + 2 * STEP], item), share, answered)
                out = list(zip(*found.values())) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["doc_id", "item_id", "cosine", "subsequence", "answered"])

    return chunks.mapInArrow(hits, "doc_id long, item_id long, cosine double, subsequence double, answered boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, subsequence and answered of each document and benchmark item that it holds."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).where("text IS NOT NULL")
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, subsequence double, answered boolean")
    out, block, known = None, [], set()

    def searched(out, block):
        found = search(docs, block)
        return found if out is None else out.unionByName(found)

    for r in items.orderBy("item_id", "text").toLocalIterator():
        w = words(r["text"].encode())
        if not w:
            continue
        answer = words(r["answer"].encode()) if r["answer"] else w[-ANSWER_WORDS:]
        if block and (len(block) == ITEMS or len(known.union(w, answer)) > VOCABULARY):
            out, block, known = searched(out, block), [], set()
        block.append((r["item_id"], w, answer))
        known.update(w, answer)
    if block:
        out = searched(out, block)
    if out is None:
        return empty
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("subsequence", "cosine", "answered")).alias("b"))
    return best.select("doc_id", "item_id", "b.cosine", "b.subsequence", "b.answered")
