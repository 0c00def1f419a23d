"""Token-ID output: raw id payloads with a minimal perfect hash index.

Documents are sorted by doc_id over range partitions and encoded; a shard is a sequence of blocks, each a row of the
file: the ids of its documents as raw little-endian integers (16 bits if the vocabulary allows it, else 32), the ends of the documents,
their keys, and a minimal perfect hash of the distinct keys. The hash (hash and displace) maps a key to a slot that holds
a 32-bit fingerprint and the place of the key's first document. A directory of the same kind, dealt to buckets of
DIRECTORY_KEYS keys by a hash, maps a key to its shard and block. So a lookup hashes twice, compares fingerprints and takes one slice,
and all its joins are on equality. Blocks are bounded in bytes, and Spark commits the files, so a lost executor costs its own tasks only.

The vocabulary's tokens never cross ASCII white space, so a text is encoded word by word, through a bounded table of words;
new words are learned for a run of texts at a time, letters and the marks behind them apart. Texts with the control strings of
the tokenizer are encoded as a whole.

Defined results: null and empty texts have the end id only; a null doc_id comes first and has no key in the index;
documents with the same doc_id lie side by side, the key's slot has their number; ties are ordered by the hash of the text;
an empty table gives files without rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planar.llm.common import integer_key, new_path, partitions_for, prefix_sums, stored, text_bytes

END_ID = 1
BLOCK_BYTES, SHARD_BYTES, TABLE_WORDS, RUN_BYTES = 4 << 20, 16 << 20, 1_000_000, 4 << 20
FILE = "shard int, block int, n_docs long, n_tokens long, width int, payload binary, ends binary, keys array<long>, seeds binary, prints binary, places binary, counts binary"
DIRECTORY_KEYS = 1 << 16
DIRECTORY = "bucket long, of long, seeds binary, prints binary, starts binary, shards binary, blocks binary"
_state: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian 32-bit integers, through a table of known words."""

    def __init__(self, path: str):
        import os

        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work; one thread a task
        self.np, self.tok = np, Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.controls = [x.content.encode() for x in self.tok.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Empties the table: words -> place, and by place the end of a word's ids."""
        self.words, self.ids, self.upto = {}, self.np.zeros(0, "<u4"), self.np.zeros(1, self.np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. Words of letters are one token run each: ASCII ones go to the tokenizer's model, which sees them as they
        are; many others go to the tokenizer as one text that is cut at word ends. ASCII marks behind letters are a run of their own, if
        the letters stay letters in lower case (U+0130 does not)."""
        letters, marks, rest, made = {}, {}, {}, []
        for w in words:
            name = w.decode("utf-8", "replace")
            core = name if name.isalpha() else name.rstrip(punctuation)
            if core.isalpha() and (core.isascii() or core.lower().isalpha()):
                letters[core] = marks[name[len(core) :]] = None
                made.append((core, name[len(core) :]))
            else:
                rest[name] = None
                made.append((name, ""))
        marks.pop("", None)
        for name in letters:
            if name.isascii():
                letters[name] = array("I", [x.id for x in self.tok.model.tokenize(name)]).tobytes()
        named = [name for name, ids in letters.items() if ids is None]
        for at in range(0, len(named), 2000):
            part = named[at : at + 2000]
            ids = self.np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = self.np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part) or cut[-1] != len(ids):
                rest |= dict.fromkeys(part)
                continue
            raw, last = ids.tobytes(), 0
            for name, c in zip(part, (4 * cut).tolist(), strict=True):
                letters[name] = raw[last:c]
                last = c
        for group in (rest, marks):
            group |= zip(group, self.whole(list(group)), strict=True)
        known, marks[""] = {k: v for k, v in letters.items() if v is not None} | rest, b""
        return [known[core] + marks[tail] for core, tail in made]

    def learn(self, words: list[bytes]) -> None:
        found = self.word_ids(words)
        ends = self.upto[-1] + self.np.cumsum(self.np.fromiter(map(len, found), self.np.int64, len(found)) // 4)
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.ids, self.upto = self.np.concatenate([self.ids, self.np.frombuffer(b"".join(found), "<u4")]), self.np.concatenate([self.upto, ends])

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, for runs of texts of RUN_BYTES: split, numbered by distinct word, and looked up in the table."""
        at = 0
        while at < len(texts):
            last, held = at, 0
            while last < len(texts) and held < RUN_BYTES:
                held, last = held + len(texts[last]), last + 1
            yield from self.encode_run(texts[at:last])
            at = last

    def encode_run(self, texts: list[bytes]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        apart = {k for k, t in enumerate(texts) if any(c in t for c in self.controls)}
        # The tokenizer lower-cases too; only ASCII white space parts words, so that bytes can be taken as strings unchecked.
        low = pa.array([b"" if k in apart else t.lower() for k, t in enumerate(texts)], pa.large_binary()).view(pa.large_string())
        split = pc.ascii_split_whitespace(low)
        words = pc.filter(split.values, pc.greater(pc.binary_length(split.values), 0))
        full = np.concatenate([[0], np.cumsum(pc.binary_length(split.values).to_numpy() > 0)])
        bounds = full[split.offsets.to_numpy()]
        coded = words.view(pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.words) > TABLE_WORDS:
            self.forget()
        new = [w for w in distinct if w not in self.words]
        if new:
            self.learn(new)
        # The ids of the run's distinct words side by side, so that what each word gathers from is small.
        place = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        first, size = self.upto[place], self.upto[place + 1] - self.upto[place]
        near = np.cumsum(size) - size
        ids = self.ids[np.repeat(first - near, size) + np.arange(size.sum())]
        which = coded.indices.to_numpy()
        size = size[which] if len(which) else size
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = ids[np.repeat((near[which] if len(which) else near) - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[bounds]).tolist()
        return [self.whole([t.decode("utf-8", "replace")])[0] if k in apart else raw[cuts[k] : cuts[k + 1]] for k, t in enumerate(texts)]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that its cache outlives a task."""
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


def mixed64(x, seed):
    """A 64-bit mix of an array of keys under a seed."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def perfect_hash(keys):
    """Displacement seeds for distinct keys such that slots() is a bijection onto range(len(keys))."""
    import numpy as np

    n = len(keys)
    buckets = n // 4 + 1
    home = (mixed64(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    starts = np.searchsorted(home[order], np.arange(buckets + 1))
    seeds, free = np.zeros(buckets, np.uint32), np.ones(n, bool)
    for b in np.argsort(-np.diff(starts), kind="stable"):
        own = keys[order[starts[b] : starts[b + 1]]]
        if not len(own):
            break
        tries = 1
        while True:  # seeds in runs: the first that sends the bucket to distinct free slots
            at = (mixed64(own[None, :], np.arange(tries, tries + 64)[:, None]) % np.uint64(n)).astype(np.int64)
            good = free[at].all(1)
            if len(own) > 1:
                ordered = np.sort(at, 1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], free[at[k]] = tries + k, False
                break
            tries += 64
    return seeds


def slots(keys, seeds, n):
    import numpy as np

    home = (mixed64(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    return (mixed64(keys, seeds[home]) % np.uint64(max(n, 1))).astype(np.int64)


def prints(keys):
    return (mixed64(keys, 2**40) >> 32).astype("<u4")


def block_row(shard: int, block: int, keys: list, raws: list[bytes], wide: int) -> dict:
    import numpy as np

    lengths = np.array([len(r) // 4 for r in raws], np.int64)
    ids = np.frombuffer(b"".join(raws), "<u4")
    known = np.array([k is not None for k in keys], bool)
    own, first, count = np.unique(np.array([k for k in keys if k is not None], np.int64), return_index=True, return_counts=True)
    first = np.flatnonzero(known)[first]
    seeds = perfect_hash(own)
    at = slots(own, seeds, len(own))
    out = {k: np.zeros(len(own), "<u4") for k in ("prints", "places", "counts")}
    out["prints"][at], out["places"][at], out["counts"][at] = prints(own), first, count
    return {"shard": shard, "block": block, "n_docs": len(keys), "n_tokens": int(lengths.sum()), "width": wide, "payload": ids.astype(f"<u{wide}").tobytes(), "ends": np.cumsum(lengths).astype("<u8").tobytes(), "keys": keys, "seeds": seeds.astype("<u4").tobytes()} | {k: v.tobytes() for k, v in out.items()}


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """The token files of docs under path."""
    spark, model = docs.sparkSession, tokenizer or tokenizer_path()
    rows = docs.select(integer_key(docs), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    shards = partitions_for(docs, SHARD_BYTES)
    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FILE.split(", ")])
        e, shard = encoder(model), TaskContext.get().partitionId()
        wide, block, keys, raws, held = 2 if max(e.size, end_id + 1) <= 1 << 16 else 4, 0, [], [], 0
        row = lambda: pa.RecordBatch.from_pylist([block_row(shard, block, keys, raws, wide)], schema=schema)
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), e.encode(text_bytes(b.column(1))), strict=True):
                keys.append(key)
                raws.append(raw + end)
                held += len(raws[-1])
                if held * wide >= 4 * BLOCK_BYTES:
                    yield row()
                    block, keys, raws, held = block + 1, [], [], 0
        if keys:
            yield row()

    dealt.mapInArrow(encode, FILE).write.option("compression", "zstd").parquet(f"{path}/blocks")
    directory(spark, path).write.parquet(f"{path}/directory")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(f"{path}/blocks")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """The directory of the files: a row for each bucket of keys, with a perfect hash from key to the blocks that hold it."""
    held = read(spark, path).select("shard", "block", F.explode(F.array_distinct("keys")).alias("key")).where("key IS NOT NULL")
    of = max(1, -(-held.count() // DIRECTORY_KEYS))

    def index(group):
        import numpy as np
        import pyarrow as pa

        keys, shard, block = (group.column(c).to_numpy() for c in ("key", "shard", "block"))
        own, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        seeds = perfect_hash(own)
        at = slots(own, seeds, len(own))
        order = np.lexsort((block, shard, at[which]))
        starts, marks = np.zeros(len(own) + 1, "<u4"), np.zeros(len(own), "<u4")
        starts[at + 1], marks[at] = times, prints(own)
        row = [seeds.astype("<u4"), marks, np.cumsum(starts, dtype="<u4"), shard[order].astype("<u4"), block[order].astype("<u4")]
        names = [c.split()[0] for c in DIRECTORY.split(", ")]
        return pa.table([group.column("bucket")[:1], pa.array([of], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], names=names)

    dealt = held.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(of)))
    return dealt.groupBy("bucket").applyInArrow(index, DIRECTORY)


def find(row: dict, keys) -> tuple:
    """Places and numbers of documents of keys in a block, by its index; the number is 0 where the block lacks the key."""
    import numpy as np

    own = np.frombuffer(row["prints"], "<u4")
    keys = np.asarray(keys, np.int64)
    if not len(own):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    at = slots(keys, np.frombuffer(row["seeds"], "<u4"), len(own))
    place, count = np.frombuffer(row["places"], "<u4")[at].astype(np.int64), np.frombuffer(row["counts"], "<u4")[at].astype(np.int64)
    return place, np.where(own[at] == prints(keys), count, 0)


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the documents whose keys are in wanted (doc_id): the directory gives the block, the block's index the place."""
    buckets = spark.read.schema(DIRECTORY).parquet(f"{path}/directory")
    first = buckets.select("of").first()
    of = first["of"] if first else 1
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    asked = asked.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(of)).alias("bucket")).agg(F.collect_list("doc_id").alias("asked"))

    def resolve(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                keys, marks, starts = np.array(row["asked"], np.int64), np.frombuffer(row["prints"], "<u4"), np.frombuffer(row["starts"], "<u4").astype(np.int64)
                at = slots(keys, np.frombuffer(row["seeds"], "<u4"), len(marks))
                keys, at = keys[marks[at] == prints(keys)], at[marks[at] == prints(keys)]
                n = starts[at + 1] - starts[at]
                where = np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                shard, block = (np.frombuffer(row[c], "<u4")[where].astype(np.int32) for c in ("shards", "blocks"))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, n)), pa.array(shard), pa.array(block)], names=["doc_id", "shard", "block"])

    found = buckets.join(asked, "bucket").mapInArrow(resolve, "doc_id long, shard int, block int")
    routed = found.groupBy("shard", "block").agg(F.collect_list("doc_id").alias("asked"))

    def get(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                place, count = find(row, row["asked"])
                ends = np.concatenate([[0], np.frombuffer(row["ends"], "<u8").astype(np.int64)])
                ids = np.frombuffer(row["payload"], f"<u{row['width']}")
                out = [(key, ids[ends[p + k] : ends[p + k + 1]].tolist()) for key, p, c in zip(row["asked"], place.tolist(), count.tolist(), strict=True) for k in range(c) if row["keys"][p] == key]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return read(spark, path).join(routed, ["shard", "block"]).mapInArrow(get, "doc_id long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files by key."""
    totals = read(spark, path).select("shard", "block", "n_tokens")
    by_shard = prefix_sums(totals.groupBy("shard").agg(F.sum("n_tokens").alias("n")), "shard", "n", "before")
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(by_shard, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("base"))

    def digest(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(i)[k].as_py() for i, n in enumerate(b.schema.names)}
                ends = np.concatenate([[0], np.frombuffer(row["ends"], "<u8").astype(np.int64)])
                ids = memoryview(np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4").tobytes())
                known = [x for x in dict.fromkeys(row["keys"]) if x is not None]
                place, count = find(row, known)
                order = list(range(row["keys"].count(None))) + [p + i for p, c in zip(place.tolist(), count.tolist(), strict=True) for i in range(c)]
                keys = [row["keys"][p] for p in order]
                crc = [zlib.crc32(ids[4 * ends[p] : 4 * ends[p + 1]]) for p in order]
                o = np.array(order, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(o), pa.int32()), pa.array([row["block"]] * len(o), pa.int32()), pa.array(keys, pa.int64()), pa.array(ends[o]), pa.array(ends[o + 1] - ends[o]), pa.array(crc, pa.int64())],
                    names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = read(spark, path).drop("n_docs", "n_tokens").mapInArrow(digest, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(base, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files to the shared folder and reads them back as digests."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    return stored(digests(docs.sparkSession, path), "token-digests")
