"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger keeps its failure bit beside the measurements. Policies are versioned sets of
bits that are applied to the ledger without another look at the texts, and ablations aggregate the distinct masks.

Defined results: null and empty texts have zero words, which fails few_words; repeated rows are judged one by one; ties
don't occur; an empty table gives an empty ledger; other columns are not read. Words of any length and texts of any size are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.llm.common import CONTINUATION, WHITE, text_bytes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: name -> failure condition on the measurements; the place in this list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeats", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("duplicate_lines", "n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
]
BASE = ("few_words", "repeats")
#: version -> rules that a document must not fail.
POLICIES: dict[int, tuple[str, ...]] = {1: BASE, 2: tuple(name for name, _ in RULES)}
CURRENT = 2


def mask(names) -> int:
    return sum(1 << k for k, (name, _) in enumerate(RULES) if name in names)


def repeated_words(words: list[list[bytes]]) -> list[int]:
    """For each text the words that lie in an 8-word window which the text has twice or more."""
    import numpy as np

    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    if total < WINDOW:
        return [0] * len(words)
    ids = np.fromiter(map(hash, chain.from_iterable(words)), np.int64, total).view(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.uint64), counts)
    name = np.zeros(total - WINDOW + 1, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):  # a polynomial of the words' 64-bit hashes
        name = name * factor + (ids[k : k + len(name)] ^ (ids[k : k + len(name)] >> np.uint64(29)))
    name = name * factor + owner[: len(name)] * np.uint64(0xD6E8FEB86659FD93)
    whole = owner[WINDOW - 1 :] == owner[: len(name)]
    name = name[whole]
    ordered = np.sort(name)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    change = np.zeros(total + 1, np.int64)
    if len(twice):
        at = np.searchsorted(twice, name)
        begins = np.flatnonzero(whole)[twice[np.minimum(at, len(twice) - 1)] == name]
        np.add.at(change, begins, 1)
        np.add.at(change, begins + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    ends = np.cumsum(counts)
    return (covered[ends] - covered[ends - counts]).tolist()


def measure_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        texts = text_bytes(b.column(1))
        out = {m: [] for m in MEASURES}
        words = []
        for t in texts:
            words.append(w := t.split())
            lines = [x for x in t.split(b"\n") if x.strip()]
            out["n_words"].append(len(w))
            out["word_chars"].append(len(t.translate(None, WHITE + CONTINUATION)))
            out["n_symbols"].append(len(t) - len(t.translate(None, SYMBOLS)))
            out["n_lines"].append(len(lines))
            out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"] = repeated_words(words)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[m], pa.int64()) for m in MEASURES)], names=["key", *MEASURES])


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, the measurements and `failed`, a bit for each rule."""
    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["key"]
    measured = rows.mapInArrow(measure_batches, f"key {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(when), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, when) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed).withColumnRenamed("key", key)


def passes(policy: int = CURRENT) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(entries: DataFrame, policy: int = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects, so that they come back without it."""
    masks = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask([name])).alias("bit")) for name in POLICIES[policy]])
    each = masks.withColumn("r", F.explode(rules))
    hit = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fails"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only"))
