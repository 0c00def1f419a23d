"""Suffix-array deduplication of long byte strings, by a difference cover and one suffix bucket at a time.

Every byte covered by a LENGTH-byte string that also starts anywhere else is removed. Only which suffixes tie over LENGTH bytes
matters, so a bucket sorts names of suffixes, not the suffixes: 56 bits for the cover sample, NAME_BITS of the XXH3 hash of
all LENGTH bytes for the rest.

1. Texts are packed into chunks of bounded size, bucketed by chunk, so that later passes move notes about chunks, not texts.
   Of exact copies one stands for all.
2. Cover sample: positions p with p mod V in a perfect difference set. Any two positions have a common shift below V to two sample
   positions, so two equal LENGTH-byte strings hold two equal sample strings of LENGTH - V + 1 bytes. The sample
   suffixes are sorted bucket by bucket, and those that tie are marked. A false tie here adds a candidate and changes no result.
3. Only suffixes with a marked sample position less than V further can tie over LENGTH bytes. They are dealt to buckets by the range
   of their name; a task sorts one bucket at a time and marks ties. Names are made distinct within a chunk first, so a passage
   that fills the corpus adds one entry per chunk.
4. Each chunk turns its marked starts into removed bytes.

A bucket holds the names of about BUCKET_BYTES bytes of text, plus one entry per chunk for names that fill the corpus. Rows between
chunks and buckets are at most the candidates, and no step loops over chunks times buckets.

Defined results: null and empty texts have 0 bytes and nothing removed; texts under LENGTH bytes keep all; repeated rows are copies
of each other, so each is removed whole if it has LENGTH bytes; overlapping repeats within one text count; a null doc_id stays null;
an empty table gives an empty result; other columns are not read. Two different strings tie wrongly with a chance of 2^-96 a pair: for the
5e27 pairs of 1e14 positions that makes 0.06 in expectation over the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.llm.common import integer_key, partitions_for, stored, text_bytes
from planar.llm.lm import packed, unpacked

LENGTH, ORDER = 400, 17
CHUNK_BYTES, BUCKET_BYTES, BLOCK_BYTES, TABLE_BYTES = 8 << 20, 16 << 20, 1 << 20, 256 << 20
SAMPLE_BITS, NAME_BITS = 56, 96
CHUNK = "chunk long, doc_ids array<long>, sizes array<int>, names array<binary>, texts binary"
NOTE = "chunk long, level int, bucket int, blob binary"


def difference_set(q: int = ORDER) -> list[int]:
    """A perfect difference set modulo q * q + q + 1 for a prime q: the powers of a root of a cubic over the integers modulo q that lie in a plane."""
    v = q * q + q + 1
    for c0 in range(1, q):
        for c1 in range(q):
            x, found = (1, 0, 0), []
            for i in range(v):
                if x[2] == 0:
                    found.append(i)
                a, b, c = x
                x = (c * c0 % q, (a + c * c1) % q, b)
            if len(found) == q + 1 and len({(a - b) % v for a in found for b in found}) == v:
                return found
    raise ValueError(f"no difference set of order {q}")


class Names:
    """Fingerprints of the cover sample's windows: polynomial hashes modulo 2^64 over random values of the bytes."""

    def __init__(self):
        import numpy as np

        self.values = np.random.default_rng(20260101).integers(0, 2**64, 256, dtype=np.uint64)
        self.base = 0x9E3779B97F4A7C15
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        import numpy as np

        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.base, -k, 2**64))])

    def sums(self, data):
        import numpy as np

        self.grow(len(data) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.up[: len(data)], dtype=np.uint64)])

    def at(self, sums, places, length: int):
        import numpy as np

        x = (sums[places + length] - sums[places]) * self.down[places]
        return x ^ (x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


_names: list = []


def names() -> Names:
    if not _names:
        _names.append(Names())
    return _names[0]


def pack_chunks(docs: DataFrame) -> DataFrame:
    rows = docs.select(integer_key(docs), F.col("text").cast("string").alias("text"))

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext
        from xxhash import xxh3_128_digest

        part, number, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]

        def row():
            values = [(part << 32) + number, ids, [len(t) for t in texts], [xxh3_128_digest(t) for t in texts], zstandard.ZstdCompressor(level=1).compress(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in CHUNK.split(", ")])

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                ids.append(key)
                texts.append(t)
                held += len(t)
                if held >= CHUNK_BYTES:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield row()

    return rows.mapInArrow(pack, CHUNK)


def bucketed(df: DataFrame, buckets: int) -> tuple[str, DataFrame]:
    """df written as a table bucketed by chunk, and its name: joins on chunk then read it in place."""
    import uuid

    name = f"planar_chunks_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "chunk").format("parquet").saveAsTable(name)
    return name, df.sparkSession.table(name)


def copies(chunks: DataFrame) -> DataFrame:
    """Notes of level 0: the places of a chunk's texts that have an exact copy, and whether another one stands for it.

    Names are distinct within a chunk before they meet, so a text that fills the corpus adds one row per chunk."""
    each = chunks.select("chunk", F.explode(F.array_distinct("names")).alias("name"))
    first = each.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("first")).where("n > 1")
    shared = each.join(first.select("name", "first"), "name").groupBy("chunk").agg(F.collect_list(F.struct("name", (F.col("chunk") == F.col("first")).alias("own"))).alias("shared"))
    found = chunks.select("chunk", "names").join(shared, "chunk", "left")

    def note(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for row in b.to_pylist():
                stands = {bytes(x["name"]): x["own"] for x in row["shared"] or ()}  # whether this chunk has the copy that stands for all
                seen: dict = {}
                for k, name in enumerate(row["names"]):
                    seen.setdefault(name, []).append(k)
                pairs = [(k, not (j == 0 and stands.get(name, True))) for name, places in seen.items() if len(places) > 1 or name in stands for j, k in enumerate(places)]
                if pairs:
                    out.append((row["chunk"], 0, 0, packed(*(np.array(x, np.uint64) for x in zip(*sorted(pairs))))))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["chunk", "level", "bucket", "blob"])

    return found.mapInArrow(note, NOTE)


class Sorted:
    """Names of suffixes in order, which of them begin a run of equal ones, and the bucket of each run by ranges of names.

    A name is `high`, and `low` where 64 bits are not enough."""

    def __init__(self, high, low, buckets: int):
        import numpy as np

        self.order = np.argsort(high)
        self.high, self.low = high[self.order], low[self.order] if low is not None else None
        same = self.high[1:] == self.high[:-1]
        if low is not None and (same & (self.low[1:] != self.low[:-1])).any():
            self.order = np.lexsort((low, high))
            self.high, self.low = high[self.order], low[self.order]
            same = (self.high[1:] == self.high[:-1]) & (self.low[1:] == self.low[:-1])
        self.new = np.concatenate([[True], ~same]) if len(high) else np.zeros(0, bool)
        self.first = np.flatnonzero(self.new)
        self.bucket = ((self.high[self.first] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        self.cuts = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1], [True]])) if len(self.first) else np.zeros(1, np.int64)

    def parts(self) -> Iterator:
        """(bucket, blob of its distinct names and which of them occur twice)."""
        import numpy as np

        key, twice = self.high[self.first], np.diff(np.append(self.first, len(self.high))) > 1
        low = self.low[self.first] if self.low is not None else np.zeros(0, np.uint64)
        for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist()):
            yield int(self.bucket[a]), packed(np.diff(key[a:b], prepend=np.uint64(0)), low[a:b] if len(low) else low, np.packbits(twice[a:b]))

    def spread(self, flags: dict):
        """The buckets' flags for each name in the order given."""
        import numpy as np

        if not len(self.order):
            return np.zeros(0, bool)
        own = [np.unpackbits(unpacked(flags[int(self.bucket[a])])[0].astype(np.uint8), count=int(b - a)) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        out = np.zeros(len(self.order), bool)
        out[self.order] = np.concatenate(own)[np.cumsum(self.new) - 1] > 0
        return out


class Chunk:
    """A chunk's texts and what the notes say of them."""

    def __init__(self, row: dict, notes: list[dict]):
        import numpy as np
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(row["texts"])
        self.ids, self.sizes = row["doc_ids"], np.array(row["sizes"], np.int64)
        self.data = np.frombuffer(raw, np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.copied, self.other = np.zeros(len(self.ids), bool), np.zeros(len(self.ids), bool)
        self.flags: dict = {1: {}, 2: {}}
        for n in notes:
            if n["level"]:
                self.flags[n["level"]][n["bucket"]] = n["blob"]
            else:
                place, other = unpacked(n["blob"])
                place = place.astype(np.int64)
                self.copied[place], self.other[place] = True, other > 0

    def blocks(self):
        """Runs of texts that are compared (long enough, not stood for): (first byte, last byte, texts)."""
        import numpy as np

        own = np.flatnonzero((self.sizes >= LENGTH) & ~self.other)
        k = 0
        while k < len(own):
            last = k + 1
            while last < len(own) and self.starts[own[last]] + self.sizes[own[last]] - self.starts[own[k]] <= BLOCK_BYTES:
                last += 1
            yield int(self.starts[own[k]]), int(self.starts[own[last - 1]] + self.sizes[own[last - 1]]), own[k:last]
            k = last

    def samples(self):
        """Places and fingerprints of the cover sample."""
        import numpy as np

        cover, v = np.array(difference_set(), np.int64), ORDER * ORDER + ORDER + 1
        size, n = LENGTH - v + 1, names()
        base = np.zeros(0, np.int64)
        places, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo, hi, texts in self.blocks():
            sums = n.sums(self.data[lo:hi])
            own = []
            for t in texts.tolist():
                room = int(self.sizes[t]) - size + 1
                if len(base) == 0 or base[-1] < room:
                    base = (np.arange(room // v + 2)[:, None] * v + cover[None, :]).ravel()
                own.append(base[: np.searchsorted(base, room)] + (self.starts[t] - lo))
            at = np.concatenate(own)
            places.append(at + lo)
            prints.append(n.at(sums, at, size))
        return np.concatenate(places), np.concatenate(prints)

    def sample_names(self, buckets: int):
        """Places of the cover sample and its names in order."""
        import numpy as np

        places, prints = self.samples()
        return places, Sorted(prints >> np.uint64(64 - SAMPLE_BITS) << np.uint64(64 - SAMPLE_BITS), None, buckets)

    def candidates(self, buckets: int):
        """Starts that may tie over LENGTH bytes, and their names."""
        import numpy as np

        from xxhash import xxh3_128_digest

        v = ORDER * ORDER + ORDER + 1
        places, sample = self.sample_names(buckets)
        places = places[sample.spread(self.flags[1])]
        out, named, text = [np.zeros(0, np.int64)], [], memoryview(self.data)
        for lo, hi, texts in self.blocks():
            near = places[np.searchsorted(places, lo) : np.searchsorted(places, hi)] - lo
            if not len(near):
                continue
            change = np.zeros(hi - lo + 2, np.int32)
            first = np.maximum(near - v + 1, 0)
            np.add.at(change, first, 1)
            np.add.at(change, near + 1, -1)
            open_ = np.cumsum(change[: hi - lo]) > 0
            allowed = np.zeros(hi - lo + 1, np.int8)
            np.add.at(allowed, self.starts[texts] - lo, 1)
            np.add.at(allowed, self.starts[texts] + self.sizes[texts] - LENGTH + 1 - lo, -1)
            at = np.flatnonzero(open_ & (np.cumsum(allowed[: hi - lo]) > 0)) + lo
            out.append(at)
            named.append(b"".join([xxh3_128_digest(text[k : k + LENGTH]) for k in at.tolist()]))
        name = np.frombuffer(b"".join(named), "<u8").reshape(-1, 2)
        return np.concatenate(out), Sorted(name[:, 0].copy(), name[:, 1] >> np.uint64(128 - NAME_BITS), buckets)


def rounds(left: DataFrame, notes: DataFrame, level: int, buckets: int) -> DataFrame:
    """Each chunk sends the distinct names of its suffixes (1: cover sample, 2: candidates) to their buckets; a bucket sorts them and notes which tie."""

    def ask(chunk, note):
        import pyarrow as pa

        row = chunk.to_pylist()[0]
        c = Chunk(row, note.to_pylist())
        _, own = c.sample_names(buckets) if level == 1 else c.candidates(buckets)
        out = list(own.parts())
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "chunk": pa.array([row["chunk"]] * len(out), pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    def tie(group):
        import numpy as np
        import pyarrow as pa

        chunks, keys, lows, twice = group.column("chunk").to_pylist(), [], [], []
        for x in group.column("blob").to_pylist():
            key, low, more = unpacked(x)
            keys.append(np.cumsum(key, dtype=np.uint64))
            lows.append(low)
            twice.append(np.unpackbits(more.astype(np.uint8), count=len(key)) > 0)
        low = np.concatenate(lows)
        own = Sorted(np.concatenate(keys), low if len(low) else None, 1)
        run = np.cumsum(own.new) - 1
        mark = np.zeros(len(own.order), bool)
        mark[own.order] = np.bincount(run)[run] > 1 if len(run) else False
        mark |= np.concatenate(twice)
        parts = np.split(mark, np.cumsum([len(k) for k in keys])[:-1])
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "level": pa.array([level] * len(chunks), pa.int32()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "blob": pa.array([packed(np.packbits(p)) for p in parts], pa.binary())})

    asked = left.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(ask, "bucket int, chunk long, blob binary")
    return stored(asked.groupBy("bucket").applyInArrow(tie, NOTE), f"suffix-ties-{level}")


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, table = bucketed(pack_chunks(docs), partitions_for(docs, TABLE_BYTES))
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    total = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(shuffle, -(-total // BUCKET_BYTES))
    notes = stored(copies(table), "suffix-copies")
    left = table.select("chunk", "doc_ids", "sizes", "texts")
    notes = notes.unionByName(rounds(left, notes, 1, buckets))
    notes = notes.unionByName(rounds(left, notes, 2, buckets))

    def remove(chunk, note):
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        c = Chunk(chunk.to_pylist()[0], note.to_pylist())
        places, own = c.candidates(buckets)
        places = places[own.spread(c.flags[2])]
        out = []
        for k, (key, size, start) in enumerate(zip(c.ids, c.sizes.tolist(), c.starts.tolist())):
            data = c.data[start : start + size]
            if c.copied[k] and size >= LENGTH:
                out.append((key, size, size, 1, sha256(b"").hexdigest()))
                continue
            own = places[np.searchsorted(places, start) : np.searchsorted(places, start + size)] - start
            if not len(own):
                out.append((key, size, 0, 0, sha256(data.tobytes()).hexdigest()))
                continue
            new = np.flatnonzero(np.concatenate([[True], own[1:] > own[:-1] + LENGTH]))
            ends = np.concatenate([own[new[1:] - 1], own[-1:]]) + LENGTH
            keep = np.ones(size, bool)
            for a, b in zip(own[new].tolist(), ends.tolist()):
                keep[a:b] = False
            out.append((key, size, int(size - keep.sum()), len(new), sha256(data[keep].tobytes()).hexdigest()))
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.table({n: pa.array(v, k) for n, v, k in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), columns, kinds)})

    out = left.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = stored(out, "suffix-removal")
    spark.sql(f"DROP TABLE {name}")
    return out
