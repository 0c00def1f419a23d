"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Features are words and word beginnings (4 and 5 bytes). The examples are a bounded sample of the labelled training rows, up to EXAMPLES of each label, and every
feature that at least LEAST_EXAMPLES of them have is indexed. A feature's weight is its idf times FLOOR plus the log odds ratio by which it
leans to either label, as far as that exceeds ERRORS standard errors; features that lean by less than LEAST_LEAN and are in over COMMON of the
examples have weight 0. The inverted index keeps postings by feature and block of examples, with the greatest weight of each. A query adds these into an
upper bound for each block, scores the blocks with the greatest bounds, then all whose bound reaches the k-th neighbour found, so
the neighbours are those of a full scan. Votes are weighted by squared similarity and by how many rows an example of its label stands
for; a prior vote of the share of label 1 calibrates weak evidence.

Defined results: null and empty texts, and texts without an indexed feature, have no neighbours and get the share of label 1 among
training rows; ties in similarity go to the example first in the index; repeated rows are scored one by one; labels of a document count as
their mean, of at least a half for label 1; without examples of both labels every score is the share of label 1 (0 without labels); an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.llm.common import held_out, stored, text_bytes
from planar.llm.quality import train_labels

EXAMPLES, LEAST_EXAMPLES, COMMON, LEAST_LEAN, ERRORS, FLOOR = 2048, 2, 0.03, 1.0, 2.5, 0.03
NEIGHBOURS, BLOCK, PRIOR_VOTE = 15, 64, 0.05
FIRST_BLOCKS, THRESHOLD = 4, 0.3
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_PLAIN).split()


def features(text: bytes) -> dict[bytes, int]:
    """Counts of words and of their beginnings, the latter marked by ^ and their length."""
    found = dict(Counter(words(text)))
    for x, n in list(found.items()):
        if len(x) > 4:
            f = b"^4" + x[:4]
            found[f] = found.get(f, 0) + n
            if len(x) > 5:
                f = b"^5" + x[:5]
                found[f] = found.get(f, 0) + n
    return found


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label and weight (training rows that it stands for) of up to EXAMPLES documents of each label."""
    train = stored(train_labels(labels, "toxic"), "toxic-labels")
    parts = [train.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for c in (0, 1)]
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # two rows
    picked = parts[0].unionByName(parts[1])
    picked = picked.withColumn("weight", F.when(F.col("label") == 1, counts.get(1, 0) / max(1, min(EXAMPLES, counts.get(1, 0)))).otherwise(counts.get(0, 0) / max(1, min(EXAMPLES, counts.get(0, 0)))))
    # At most 2 * EXAMPLES rows of three numbers are broadcast.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    return stored(texts.select("doc_id", "text", "label", "weight"), "toxic-sample")


def leaning(n0, n1, m0: int, m1: int):
    """By how many units the log odds ratio of features in n0 of m0 and n1 of m1 examples exceeds ERRORS standard errors."""
    import numpy as np

    cells = [n1 + 0.5, m1 - n1 + 0.5, n0 + 0.5, m0 - n0 + 0.5]
    ratio = np.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    return np.maximum(np.abs(ratio) - ERRORS * np.sqrt(sum(1 / x for x in cells)), 0)


def spans(first, size):
    """The places of runs that begin at `first` and have `size` members, one run after the other."""
    import numpy as np

    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Index:
    """The block-max inverted index of examples (doc_id, counts of features, label, weight)."""

    def __init__(self, rows: list[tuple]):
        import numpy as np

        seen: dict = {}
        for _, counts, label, _ in rows:
            for f in counts:
                seen.setdefault(f, [0, 0])[label] += 1
        m1 = sum(label for _, _, label, _ in rows)
        some = {f: n for f, n in seen.items() if sum(n) >= LEAST_EXAMPLES}
        n0, n1 = np.array(list(some.values()) or [[0, 0]], float).T[:, : len(some)]
        lean = leaning(n0, n1, len(rows) - m1, m1)
        weight = np.log((len(rows) + 1) / (n0 + n1 + 1)) * (lean + FLOOR)
        weight[(lean < LEAST_LEAN) & (n0 + n1 > COMMON * len(rows))] = 0
        names = sorted(f for f, x in zip(some, weight.tolist()) if x > 0)
        self.place, all_ = {f: k for k, f in enumerate(names)}, dict(zip(some, weight.tolist()))
        self.weight = np.array([all_[f] for f in names])
        vectors = [self.vector(counts) for _, counts, _, _ in rows]
        top = [int(t[np.argmax(x)]) if len(t) else -1 for t, x in vectors]
        order = sorted((k for k in range(len(rows)) if len(vectors[k][0])), key=lambda k: (rows[k][2], top[k], k))  # alike examples share blocks
        self.ids, self.labels, self.weights = [rows[k][0] for k in order], np.array([rows[k][2] for k in order], float), np.array([rows[k][3] for k in order], float)
        self.blocks = -(-len(order) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int64)] + [vectors[k][0] for k in order])
        part = np.concatenate([np.zeros(0)] + [vectors[k][1] for k in order])
        doc = np.repeat(np.arange(len(order)), [len(vectors[k][0]) for k in order])
        by = np.lexsort((doc, term))
        term, self.docs, self.parts = term[by], doc[by].astype(np.int32), part[by]
        # Runs of postings of one feature in one block: the block, the first posting, the greatest weight; and the runs of each feature.
        run = term * max(self.blocks, 1) + self.docs // BLOCK
        self.run_first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
        self.run_block = (self.docs[self.run_first] // BLOCK).astype(np.int32)
        self.run_most = np.maximum.reduceat(self.parts, self.run_first) if len(run) else np.zeros(0)
        self.run_size = np.diff(np.append(self.run_first, len(run)))
        self.term_runs = np.searchsorted(term[self.run_first], np.arange(len(names) + 1))

    def vector(self, counts: dict):
        """Places of the indexed features and their weights in a unit vector."""
        import numpy as np

        own = [(self.place[f], n) for f, n in counts.items() if f in self.place]
        if not own:
            return np.zeros(0, np.int64), np.zeros(0)
        t, n = np.array(own, np.int64).T
        x = (1 + np.log(n)) * self.weight[t]
        return t, x / np.sqrt(np.square(x).sum())

    def nearest(self, counts: dict, k: int = NEIGHBOURS):
        """Places and similarities of the k most similar examples."""
        import numpy as np

        terms, x = self.vector(counts)
        if not len(terms) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        n = self.term_runs[terms + 1] - self.term_runs[terms]
        runs, own = spans(self.term_runs[terms], n), np.repeat(x, n)
        bound = np.bincount(self.run_block[runs], own * self.run_most[runs], self.blocks)
        similar = np.zeros(self.blocks * BLOCK)

        def add(blocks):
            chosen = np.zeros(self.blocks, bool)
            chosen[blocks] = True
            on = chosen[self.run_block[runs]]
            size = self.run_size[runs[on]]
            at = spans(self.run_first[runs[on]], size)
            similar[:] += np.bincount(self.docs[at], np.repeat(own[on], size) * self.parts[at], len(similar))

        first = np.argpartition(-bound, FIRST_BLOCKS)[:FIRST_BLOCKS] if self.blocks > FIRST_BLOCKS else np.arange(self.blocks)
        add(first)
        least = np.partition(similar, -k)[-k] if len(similar) >= k else 0.0
        bound[first] = -1.0
        rest = np.flatnonzero(bound >= max(least - 1e-12, 1e-300))
        if len(rest):
            add(rest)
        found = np.flatnonzero(similar)
        if len(found) > k:
            found = found[similar[found] >= np.partition(similar[found], -k)[-k] - 1e-12]
        best = found[np.lexsort((found, -np.round(similar[found], 12)))[:k]]
        return best, similar[best]


def vote(index: Index, none: float, counts: dict):
    """The score of a text with these features, and its three nearest examples as evidence."""
    best, similar = index.nearest(counts)
    w = index.weights[best] * similar**2
    score = float((w @ index.labels[best] + PRIOR_VOTE * none) / (w.sum() + PRIOR_VOTE))
    return score, [{"doc_id": index.ids[k], "similarity": float(s), "toxic": int(index.labels[k])} for k, s in zip(best[:3].tolist(), similar[:3].tolist())]


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of each document."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    examples = sample(docs, labels)
    held = sorted(examples.collect(), key=lambda r: r["doc_id"])  # at most 2 * EXAMPLES texts
    weights = [sum(r["weight"] for r in held if r["label"] == c) for c in (0, 1)]
    none = weights[1] / sum(weights) if sum(weights) else 0.0
    index = Index([(r["doc_id"], features((r["text"] or "").encode("utf-8", "replace")), r["label"], r["weight"]) for r in held] if all(weights) else [])
    sent = spark.sparkContext.broadcast(index)  # bounded by the examples' texts

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = [vote(sent.value, none, features(t)) for t in text_bytes(b.column(1))]
            evidence = pa.array([e for _, e in out], pa.list_(pa.struct([("doc_id", b.column(0).type), ("similarity", pa.float64()), ("toxic", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.float64()), evidence], names=["doc_id", "score", "evidence"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(scored, f"doc_id {kind}, score double, evidence array<struct<doc_id: {kind}, similarity: double, toxic: int>>")
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
