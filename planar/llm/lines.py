"""Line deduplication by sorted hashes: per-document keep bitmaps instead of texts.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. The 128-bit hashes of all keys are
range-partitioned by (hash, document) and sorted by (hash, document, position), so that a very common line is spread over as many
partitions as its rows ask for. Each partition is streamed once: a run of one hash inside it is judged there; only the first and the last
run may go on in a neighbour, so their rows wait for the sum of at most two counts from each partition.

Defined results: a document is a pair of doc_id and text; rows that repeat both are one document, and each of these rows gets its result; a
null doc_id counts as the least long; null and empty texts have one empty line; empty keys, and keys under min_chars code points, are never
dropped; lines that tie in (hash, document) are ordered by position; an empty table gives no rows; other columns are not read. A document's lines
meet in one row, as its text does.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.llm.common import CONTINUATION, WHITE, integer_key, stored, text_bytes

MIN_CHARS, MIN_DOCS = 1, 10
LEAST = -(2**63)
HASH = ("h1", "h2")
DOCUMENT = ("doc", "fingerprint")
#: What a streamed row says: this line goes; this line is judged by the border counts; a border count (documents in `pos`).
DROP, WAITS, COUNT = 0, 1, 2
STREAMED = "kind byte, doc long, fingerprint long, pos long, h1 long, h2 long, first boolean, part int"


def named(docs: DataFrame) -> DataFrame:
    """doc and fingerprint, which name a document, and its text."""
    rows = docs.select(integer_key(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc"), F.xxhash64("text").alias("fingerprint"), "text", "doc_id")


def hashed(batches: Iterator, min_chars: int = MIN_CHARS) -> Iterator:
    """A row for each line with a key: its hash, document and position."""
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    for b in batches:
        digests, counts, places = [], [], []
        for t in text_bytes(b.column("text")):
            keys = [line.strip(WHITE).lower() for line in t.split(b"\n")]
            kept = [k for k, key in enumerate(keys) if len(key) >= min_chars and (min_chars < 2 or len(key.translate(None, CONTINUATION)) >= min_chars)]
            digests.extend(xxh3_128_digest(keys[k]) for k in kept)
            places.append(np.array(kept, np.int64))
            counts.append(len(kept))
        halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        owner = np.repeat(np.arange(len(counts)), counts)
        columns = [halves[:, 0], halves[:, 1], *(b.column(c).to_numpy(zero_copy_only=False)[owner] for c in DOCUMENT), np.concatenate([np.empty(0, np.int64), *places])]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=[*HASH, *DOCUMENT, "pos"])


def streamed(batches: Iterator, min_docs: int) -> Iterator:
    """Runs of equal hashes over a sorted partition; what is held is a run's rows until it has min_docs documents."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def out(kind: int, rows, first):
        n = rows.shape[1]
        columns = [pa.array(np.full(n, kind, np.int8)), *(pa.array(rows[k]) for k in (2, 3, 4, 0, 1)), pa.array(first), pa.array(np.full(n, part, np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["kind", *DOCUMENT, "pos", *HASH, "first", "part"])

    def border(last, docs: int):
        return out(COUNT, np.array([[last[0]], [last[1]], [0], [0], [docs]], np.int64), np.zeros(1, bool))

    last = None  # the row before: h1, h2, doc, fingerprint
    held, docs, opening = [], 0, True  # of the run that is open: its rows if they wait, its documents, whether it is the partition's first
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (*HASH, *DOCUMENT, "pos")])
        before = np.concatenate([np.array(last if last is not None else rows[:4, 0] - 1, np.int64).reshape(4, 1), rows[:4, :-1]], axis=1)
        run = (rows[:2] != before[:2]).any(axis=0)
        doc = run | (rows[2:4] != before[2:]).any(axis=0)
        if last is None:
            run[0] = doc[0] = True
        starts = np.flatnonzero(run)
        tail = int(starts[0]) if len(starts) else rows.shape[1]
        if tail:  # rows of the run that was open
            docs += int(doc[:tail].sum())
            held.append((rows[:, :tail], run[:tail]))
        ended = [(held, docs, opening, last)] if len(starts) and last is not None else []
        if len(starts):
            inner = np.add.reduceat(doc.astype(np.int64), starts)
            width = np.diff(np.append(starts, rows.shape[1]))
            fits = np.repeat((inner >= min_docs) & (np.arange(len(starts)) < len(starts) - 1) & ((np.arange(len(starts)) > 0) | (last is not None)), width)
            if fits.any():
                at = np.arange(tail, rows.shape[1])[fits]
                yield out(DROP, rows[:, at], run[at])
            if last is None and len(starts) > 1:  # the partition's first run ends in its first batch
                ended = [([(rows[:, : starts[1]], run[: starts[1]])], int(inner[0]), True, rows[:4, 0])]
            opening = last is None and len(starts) == 1
        for rest, n, was_opening, name in ended:
            for r, first in rest:
                if was_opening or n >= min_docs:
                    yield out(WAITS if was_opening else DROP, r, first)
            if was_opening:
                yield border(name, n)
        if len(starts):
            held, docs = [(rows[:, starts[-1] :], run[starts[-1] :])], int(inner[-1])
        last = rows[:4, -1]
        if opening or docs >= min_docs:
            for r, first in held:
                yield out(WAITS if opening else DROP, r, first)
            held = []
    if last is not None:
        for r, first in held:
            yield out(WAITS, r, first)
        yield border(last, docs)


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """doc, fingerprint and pos of each line whose key is found in min_docs documents or more; with keep_first, not of its first occurrence
    in the order of documents and positions."""
    texts = named(docs).select(*DOCUMENT, "text")
    lines = texts.mapInArrow(lambda x: hashed(x, min_chars), "h1 long, h2 long, doc long, fingerprint long, pos long")
    ordered = lines.repartitionByRange(*HASH, *DOCUMENT).sortWithinPartitions(*HASH, *DOCUMENT, "pos")
    runs = stored(ordered.mapInArrow(lambda x: streamed(x, min_docs), STREAMED), "line-runs")
    totals = runs.where(F.col("kind") == COUNT).groupBy(*HASH).agg(F.sum("pos").alias("docs"), F.min("part").alias("least")).where(F.col("docs") >= min_docs)
    waiting = runs.where(F.col("kind") == WAITS).join(F.broadcast(totals.drop("docs")), [*HASH])  # two rows for each partition at most
    # the last run of a partition drops at once if it fills min_docs there; its first row is the first of all if no partition before has the hash
    decided = runs.where(F.col("kind") == DROP)
    if keep_first:
        waiting, decided = waiting.where(~(F.col("first") & (F.col("part") == F.col("least")))), decided.where(~F.col("first"))
    return waiting.select(*DOCUMENT, "pos").unionByName(decided.select(*DOCUMENT, "pos"))


def packed(batches: Iterator) -> Iterator:
    """Positions to bitmaps: bit k of the unpacked bytes, highest bit first, is 1 if line k stays."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        maps, gone = [], []
        for n, places in zip(b.column("n_lines").to_pylist(), b.column("places").to_pylist(), strict=True):
            keep = np.ones(n, np.uint8)
            keep[places or []] = 0
            gone.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*DOCUMENT, "n_lines")), pa.array(gone, pa.int64()), pa.array(maps, pa.binary())], names=[*DOCUMENT, "n_lines", "n_dropped", "keep"])


def unpacked(bitmap: bytes, n_lines: int):
    """The bitmap as an array of one boolean for each line."""
    import numpy as np

    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """For each document (doc, fingerprint): n_lines, n_dropped and keep, its compressed bitmap."""
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    each = named(docs).select(*DOCUMENT, n_lines.alias("n_lines")).dropDuplicates([*DOCUMENT])
    places = dropped_lines(docs, min_docs, min_chars, keep_first).groupBy(*DOCUMENT).agg(F.collect_set("pos").alias("places"))
    return each.join(places, [*DOCUMENT], "left").mapInArrow(packed, "doc long, fingerprint long, n_lines long, n_dropped long, keep binary")


def applied(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents' rows with the text that their bitmaps keep: doc_id, n_lines, n_dropped, kept."""
    return _met(docs, bitmaps, lambda kept: kept, "kept binary").withColumn("kept", F.col("kept").cast("string"))


def digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """As applied(), with the digest of the text in its place."""
    return _met(docs, bitmaps, lambda kept: hashlib.sha256(kept).hexdigest(), "kept_sha256 string")


def _met(docs: DataFrame, bitmaps: DataFrame, of, column: str) -> DataFrame:
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = []
            for t, n, gone, keep in zip(text_bytes(b.column("text")), *(b.column(c).to_pylist() for c in ("n_lines", "n_dropped", "keep")), strict=True):
                found.append(of(t if not gone else b"\n".join(line for line, stays in zip(t.split(b"\n"), unpacked(keep, n), strict=True) if stays)))
            kind = pa.string() if column.endswith("string") else pa.binary()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_lines", "n_dropped")), pa.array(found, kind)], names=["doc_id", "n_lines", "n_dropped", column.split()[0]])

    met = named(docs).join(bitmaps, [*DOCUMENT]).select("doc_id", "text", "n_lines", "n_dropped", "keep")
    return met.mapInArrow(rows, f"doc_id long, n_lines long, n_dropped long, {column}")
