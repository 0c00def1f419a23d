"""Phrase collocation mining over persisted occurrence relations.

An occurrence relation R_k holds the occurrences of the frequent phrases of k words, by piece and position. It is persisted in chunks of some million
words, as the sorted sequence of the chunk's words in which a zero ends a piece; so the merge join of R_k with R_1 by piece and
adjacent position is a shift of that sequence. Each round joins a chunk's relation with the frequent phrases that occur in it (the
semi-join), extends what is left by one word, counts within the chunk and groups the counts of all chunks; a phrase is a tuple of word ids, so no
hash stands for it. The counts of a chunk are dealt by their words or phrases into parts, each sent as one compressed row, and a part of all chunks is added up
in one task. A very common phrase has one count for each chunk that holds it; as relations shrink from round to round, chunks are put together
up to a few times that size. Only words and phrases of min_count or more are extended.

A word's id is the least (chunk, place in the chunk) of its rows: exact, and found without numbering all words.

Defined results: a null text is empty; a null lang is `und`; repeated rows count each; texts without words and an empty table give nothing; ties in score go to the larger
count, then to the lesser phrase in UTF-8 order; other columns are not read. A text of any length is read in parts that end where a
piece ends; a single piece is one part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planar.llm.common import partitions_for, stored

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
#: Percent of a phrase's count that a longer one around it must have to take its place.
COVERED = 80
SCALE = 2_000_000
CHUNK_WORDS, PART_BYTES = 2_000_000, 1 << 24
#: Bytes of text for each part of the counts of words.
PART_WORDS = 1 << 24
#: Chunk sizes up to which relations are put together before the second and the third round, as fewer and fewer of their words begin a phrase. A task holds one such relation.
TOGETHER = (2, 2)
#: Bytes that end a piece become one of them; it stands as a word of its own, with number 0.
END = b"."
ENDS = bytes(END[0] if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: Places of a relation that are looked up at once, so that copies stay small.
BLOCK = 1 << 20
#: A chunk number is the partition's index and the chunk's place in it.
CHUNKS_IN_PARTITION = 1 << 11
RANK_SALTS = 64
IDS = [f"w{j + 1}" for j in range(LONGEST)]


#: A row of a round: a chunk's relation (words: its word ids, relation: n numbers into them), or a part of its phrases: their word ids and counts, n rows packed.
ROUND = "chunk long, words binary, relation binary, part int, phrases binary, n long"


def compressed(x) -> bytes:
    import pyarrow as pa

    return len(x).to_bytes(8, "little") + pa.compress(x.tobytes(), "zstd", asbytes=True)


def expanded(blob: bytes, kind: str):
    import numpy as np
    import pyarrow as pa

    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def packed(columns: list) -> bytes:
    """Columns of as many whole numbers, the first ascending, by its differences and byte planes, which compress well."""
    import numpy as np

    m = np.stack([np.diff(columns[0], prepend=0), *columns[1:]]).astype("<i8")
    return compressed(np.ascontiguousarray(m.view(np.uint8).reshape(*m.shape, 8).transpose(0, 2, 1)).ravel())


def unpacked(blob: bytes, count: int):
    """The `count` columns of packed()."""
    import numpy as np

    m = expanded(blob, "u1").reshape(count, 8, -1).transpose(0, 2, 1).copy().view("<i8")[:, :, 0]
    m[0] = np.cumsum(m[0])
    return m


def parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, with END between pieces, in parts of about PART_BYTES."""
    begin = 0
    while begin < len(text):
        end = len(text)
        if end - begin > PART_BYTES:
            found = re.compile(rb"[.,;:!?\x0a-\x0d]").search(text, begin + PART_BYTES)
            end = found.end() if found else end
        yield text[begin:end].lower().translate(ENDS).replace(END, b" . ").split()
        begin = end


def chunked(batches: Iterator, chunk_words: int, count: int) -> Iterator:
    """For each chunk the sequence of its words by their numbers in the chunk, from 1; the number n of its words in each lang; and its words with their counts, dealt
    by lang and word into `count` parts, a packed row each."""
    from itertools import count as counted
    from itertools import repeat
    from zlib import crc32

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    def begun():
        return {}, counted(1), [np.zeros(1, np.int32)], 0

    def rows(found: list[dict]):
        return pa.RecordBatch.from_arrays([pa.array([r.get(x.name) for r in found], x.type) for x in schema], schema=schema)

    def closed(langs, sequences, ordinal):
        if ordinal >= CHUNKS_IN_PARTITION or partition >= 1 << 20:
            raise ValueError("a partition has too many chunks of words")
        chunk = partition * CHUNKS_IN_PARTITION + ordinal
        relation = np.concatenate(sequences)
        counts = np.bincount(relation).astype(np.int64)
        yield rows([{"chunk": chunk, "relation": compressed(relation)}])
        names = list(langs)
        places = [np.fromiter(own.values(), np.int64, len(own))[1:] for own in langs.values()]  # without END, which is the first
        yield rows([{"chunk": chunk, "lang": lang, "n": int(counts[k].sum())} for lang, k in zip(names, places) if len(k)])
        part = [np.fromiter(map(crc32, own, repeat(crc32(lang.encode()))), np.int64, len(own))[1:] % count for lang, own in langs.items()]
        words = pa.array([w for own in langs.values() for w, k in own.items() if k], pa.large_binary())
        of, places, part = np.repeat(np.arange(len(names)), [len(k) for k in places]), np.concatenate(places), np.concatenate(part)
        order = np.argsort(part, kind="stable")
        words, of, places, part = words.take(pa.array(order)), of[order], places[order], part[order]
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts, ends = np.flatnonzero(np.diff(part, prepend=-1)).tolist(), np.append(0, np.cumsum(sizes))
        found, spelled = [], np.frombuffer(words.buffers()[2], "u1") if len(words) else None
        for x, y in zip(cuts, [*cuts[1:], len(part)]):
            own, at = np.unique(of[x:y], return_inverse=True)
            packs = {"words": compressed(spelled[ends[x] : ends[y]]), "counts": packed([places[x:y], at, sizes[x:y], counts[places[x:y]]])}
            found.append({"chunk": chunk, "part": int(part[x]), "langs": [names[j] for j in own], **packs})
        yield rows(found)

    kinds = {"chunk": pa.int64(), "lang": pa.string(), "n": pa.int64(), "relation": pa.binary(), "part": pa.int32(), "langs": pa.list_(pa.string()), "words": pa.binary(), "counts": pa.binary()}
    schema, partition, ordinal = pa.schema(kinds), TaskContext.get().partitionId(), 0
    langs, numbers, sequences, held = begun()
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for lang, scalar in zip(b.column("lang").to_pylist(), texts, strict=True):
            for words in parts(scalar.as_py()):
                own = langs.get(lang)
                if own is None:
                    own = langs[lang] = Numbered(numbers)
                sequences.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
                sequences.append(np.zeros(1, np.int32))
                held += len(words)
                if held >= chunk_words:
                    yield from closed(langs, sequences, ordinal)
                    ordinal += 1
                    langs, numbers, sequences, held = begun()
    if held:
        yield from closed(langs, sequences, ordinal)


class Numbered(dict):
    """Words to numbers; END is 0."""

    def __init__(self, numbers: Iterator[int]):
        super().__init__({END: 0})
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        n = self[word] = next(self.numbers)
        return n


def looked_up(values, at):
    """values[at] for numbers of 4 bytes, in blocks, as numpy copies what it indexes by to 8 bytes."""
    import numpy as np

    out = np.empty(len(at), values.dtype)
    for begin in range(0, len(at), BLOCK):
        out[begin : begin + BLOCK] = values[at[begin : begin + BLOCK]]
    return out


def codes_of(lists, sequence, size: int):
    """For each place of the sequence: the number, from 1, of the phrase of `lists` (rows of k word numbers) that begins there, or 0. And each row's number."""
    import numpy as np

    k, n = lists.shape[1], len(sequence)
    known, code = lists[:, 0].astype(np.int64), sequence
    for j in range(1, k):
        wanted = known * size + lists[:, j]
        keys = np.unique(wanted)
        known = np.searchsorted(keys, wanted) + 1
        before, code = code, np.zeros(n, np.int32) if j == 1 else code  # a place's code depends on its own before only, so it takes its place
        for begin in range(0, n, BLOCK):  # in blocks, so that what is looked up stays small
            end = min(begin + BLOCK, n - j)
            here = begin + np.flatnonzero((before[begin:end] > 0) & (sequence[begin + j : end + j] > 0)) if len(keys) and begin < end else np.empty(0, np.int64)
            asked = before[here].astype(np.int64) * size + sequence[here + j]
            code[begin : begin + BLOCK] = 0
            if len(here):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = keys[at] == asked
                code[here[hit]] = at[hit] + 1
    return code, known


def extended(words, relation, lists, more: bool):
    """One round over a chunk. words: its word ids; relation: their numbers from 1 with 0 between pieces; lists: the frequent phrases of k words in it.
    Returns (word ids, relation) of what the next round needs, the columns of the phrases of k + 1 words, in their order, and their counts. Beside the relation it holds its
    codes and a key for each place that is extended, and no other numbers of every place."""
    import numpy as np

    k, size = lists.shape[1], len(words) + 1
    code, known = codes_of(lists, relation, size)
    both = code > 0  # the phrase, and the one a word later
    both = both[:-1] & both[1:]
    key, done = np.empty(np.count_nonzero(both), np.int64), 0
    for begin in range(0, len(both), BLOCK):
        first = begin + np.flatnonzero(both[begin : begin + BLOCK])
        some = key[done : done + len(first)]
        some[:] = code[first]
        some *= size
        some += relation[first + k]
        done += len(first)
    del code
    key.sort()
    head = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=head[1:])
    head = np.flatnonzero(head)
    keys, n = key[head], np.diff(head, append=len(key))
    del key, head
    row = np.zeros(int(known.max(initial=0)) + 1, np.int64)
    row[known] = np.arange(len(known))
    begins = row[keys // size]
    phrases = [words[lists[begins, j] - 1] for j in range(k)] + [words[keys % size - 1]]
    if not more or not done:
        return None, None, phrases, n
    kept = np.zeros(len(relation), bool)  # words of any extended phrase stay, runs of others become one zero
    for j in range(k + 1):
        kept[j:] |= both[: len(relation) - j] if j else np.append(both, False)
    left = np.where(kept, relation, np.int32(0))
    left = left[(left > 0) | np.concatenate([[True], left[:-1] > 0])]
    used = np.zeros(size, bool)
    for begin in range(0, len(left), BLOCK):
        used[left[begin : begin + BLOCK]] = True
    used = np.flatnonzero(used[1:]) + 1
    renumbered = np.zeros(size, np.int32)
    renumbered[used] = np.arange(1, len(used) + 1)
    return words[used - 1], looked_up(renumbered, left), phrases, n


def part_of(phrases: list, count: int):
    """The part of each phrase, by columns of word ids, of `count`."""
    import numpy as np

    h = np.zeros(len(phrases[0]), np.uint64)
    with np.errstate(over="ignore"):
        for column in phrases:
            h ^= column.view(np.uint64)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return (h % np.uint64(count)).astype(np.int32)


def _rows(chunk: int, words, relation, phrases: list, n, count: int):
    import numpy as np
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    part = part_of(phrases, count)
    order = np.argsort(part, kind="stable")  # phrases come in the order of their ids and keep it
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist()
    rows = [(chunk, None, None, int(part[order[a]]), packed([c[order[a:b]] for c in (*phrases, n)]), b - a) for a, b in zip(cuts, [*cuts[1:], len(order)])]
    if relation is not None:
        rows.append((chunk, compressed(words), compressed(relation), None, None, len(relation)))
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
    names = ["chunk", "words", "relation", "part", "phrases", "n"]
    schema = pa.schema(list(zip(names, kinds)))
    # Each is sent by itself, so that neither side holds the whole.
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(r, kinds)], schema=schema) for r in rows], schema=schema)


def first_round(count: int):
    """Relations by numbers of all words of a chunk, and its frequent words: R_1, and pairs, in `count` parts."""

    def of(chunks, frequent):
        import numpy as np

        if not chunks.num_rows or not frequent.num_rows:
            return _rows(0, None, None, [np.empty(0, np.int64)] * 2, np.empty(0, np.int64), count)
        relation = expanded(chunks.column("relation")[0].as_py(), "<i4")
        places, ids = np.concatenate([unpacked(b, 2) for b in frequent.column("ids").to_pylist()], axis=1)
        order = np.argsort(ids)
        numbers = np.zeros(int(relation.max()) + 1, np.int32)
        numbers[places[order]] = np.arange(1, len(ids) + 1)
        words, lists = ids[order], np.arange(1, len(ids) + 1).reshape(-1, 1)
        return _rows(chunks.column("chunk")[0].as_py(), *extended(words, looked_up(numbers, relation), lists, True), count)

    return of


def together(words: list, relations: list):
    """One (words, relation) of several packed ones, which are unpacked one at a time."""
    import numpy as np

    words = [expanded(w, "<i8") for w in words]
    every, sizes = np.unique(np.concatenate(words)), [int.from_bytes(r[:8], "little") + 1 for r in relations]  # a zero after each
    out, at = np.zeros(sum(sizes), np.int32), 0
    for w, r, size in zip(words, relations, sizes, strict=True):
        out[at : at + size - 1] = looked_up(np.append(0, np.searchsorted(every, w) + 1).astype(np.int32), expanded(r, "<i4"))
        at += size
    return every, out


def next_round(k: int, more: bool, count: int):
    """The round of the frequent phrases of k words, its phrases in `count` parts."""

    def of(chunks, frequent):
        import numpy as np

        if not chunks.num_rows or not frequent.num_rows:
            return _rows(0, None, None, [np.empty(0, np.int64)] * (k + 1), np.empty(0, np.int64), count)
        words, relation = together(*(chunks.column(c).to_pylist() for c in ("words", "relation")))
        ids = np.concatenate([unpacked(b, k) for b in frequent.column("phrases").to_pylist()], axis=1).T
        order = np.argsort(words)
        lists = order[np.searchsorted(words[order], ids)] + 1
        return _rows(chunks.column("chunk")[0].as_py(), *extended(words, relation, lists, more), count)

    return of


def words_added_up(rows: DataFrame, min_count: int) -> DataFrame:
    """The words of a lang in packed rows of chunked() whose counts have a sum f of min_count or more, with f and their ids; and a row with the places and ids of those
    of each chunk in each part, packed."""

    def of(part):
        import numpy as np
        import pyarrow as pa

        names, every, spelled = {}, [], []
        for chunk, langs, words, counts in zip(*(part.column(c).to_pylist() for c in ("chunk", "langs", "words", "counts"))):
            place, at, sizes, n = unpacked(counts, 4)
            own = np.array([names.setdefault(lang, len(names)) for lang in langs])
            every.append((chunk * 2**31 + place, own[at], n))
            ends = pa.py_buffer(np.append(0, np.cumsum(sizes)))
            spelled.append(pa.Array.from_buffers(pa.large_binary(), len(n), [None, ends, pa.py_buffer(expanded(words, "u1"))]))
        ref, lang, n = (np.concatenate(c) for c in zip(*every))
        spelled = pa.concat_arrays(spelled).dictionary_encode()
        words, key = spelled.dictionary, lang * len(spelled.dictionary) + spelled.indices.to_numpy()
        order = np.lexsort((ref, key))
        key, ref, n = key[order], ref[order], n[order]
        head = np.diff(key, prepend=-1) != 0
        first, group = np.flatnonzero(head), np.cumsum(head) - 1
        f = np.add.reduceat(n, first)
        enough = f >= min_count
        some, ids = key[first[enough]], ref[first[enough]]
        names = pa.array(list(names), pa.string()).take(pa.array(some // len(words)))
        schema = pa.schema({"chunk": pa.int64(), "ids": pa.binary(), "lang": pa.string(), "word": pa.string(), "word_id": pa.int64(), "f": pa.int64()})
        spelled = words.take(pa.array(some % len(words))).cast(pa.binary()).cast(pa.string())
        out = [pa.table([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), names, spelled, pa.array(ids), pa.array(f[enough])], schema=schema)]
        keep = enough[group]
        of_word, ref = ref[first][group[keep]], ref[keep]
        order = np.argsort(ref)
        of_word, ref = of_word[order], ref[order]
        chunk, place = ref >> 31, ref & (2**31 - 1)
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist()
        blobs = [packed([place[x:y], of_word[x:y]]) for x, y in zip(cuts, [*cuts[1:], len(chunk)])]
        out.append(pa.table([pa.array(chunk[cuts]), pa.array(blobs, pa.binary()), *(pa.nulls(len(cuts), x.type) for x in list(schema)[2:])], schema=schema))
        return pa.concat_tables(out)

    return rows.select("chunk", "part", "langs", "words", "counts").groupBy("part").applyInArrow(of, "chunk long, ids binary, lang string, word string, word_id long, f long")


def added_up(rows: DataFrame, k: int, min_count: int, more: bool) -> DataFrame:
    """The phrases of k words in rows (chunk, part, phrases) whose counts have a sum f of min_count or more, with f; and, if more, a row with those of each chunk in
    each part, packed."""

    def of(part):
        import numpy as np
        import pyarrow as pa

        found = [unpacked(b, k + 1) for b in part.column("phrases").to_pylist()]
        chunk = np.repeat(part.column("chunk").to_numpy(), [m.shape[1] for m in found])
        *ids, n = np.concatenate(found, axis=1)
        order = np.lexsort((chunk, *ids[::-1]))
        ids, chunk, n = [c[order] for c in ids], chunk[order], n[order]
        head = np.zeros(len(order), bool)
        head[0] = True
        for c in ids:
            head[1:] |= c[1:] != c[:-1]
        f = np.add.reduceat(n, np.flatnonzero(head))[np.cumsum(head) - 1]
        first, some = head & (f >= min_count), int((head & (f >= min_count)).sum())
        names = ["chunk", "phrases", *IDS[:k], "f"]
        out = [pa.table([pa.nulls(some, pa.int64()), pa.nulls(some, pa.binary()), *(pa.array(c[first]) for c in ids), pa.array(f[first])], names=names)]
        keep = np.flatnonzero((f >= min_count) & (head | np.concatenate([[True], chunk[1:] != chunk[:-1]]))) if more else np.empty(0, np.int64)
        keep = keep[np.argsort(chunk[keep], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(chunk[keep]) != 0])).tolist() if len(keep) else []
        blobs = [packed([c[keep[x:y]] for c in ids]) for x, y in zip(cuts, [*cuts[1:], len(keep)])]
        out.append(pa.table([pa.array(chunk[keep[cuts]]), pa.array(blobs, pa.binary()), *[pa.nulls(len(cuts), pa.int64())] * (k + 1)], names=names))
        return pa.concat_tables(out)

    return rows.select("chunk", "part", "phrases").groupBy("part").applyInArrow(of, f"chunk long, phrases binary, {', '.join(f'{w} long' for w in IDS[:k])}, f long")


def mined(docs: DataFrame, min_count: int = MIN_COUNT, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): frequent words (lang, word, word_id, f), frequent phrases of 2 to LONGEST words (phrase as word ids, f), and
    the number n of all words of each lang."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = partitions_for(texts, PART_WORDS)
    chunks = stored(texts.mapInArrow(lambda x: chunked(x, chunk_words, count), "chunk long, lang string, n long, relation binary, part int, langs array<string>, words binary, counts binary"), "words")
    totals = chunks.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = stored(words_added_up(chunks.where("part IS NOT NULL"), min_count), "frequent-1")
    words = frequent.where("ids IS NULL").select("lang", "word", "word_id", "f")
    relations, phrases, of = chunks.where("relation IS NOT NULL").select("chunk", "relation"), None, None
    # Parts of about as many words as a chunk: what a chunk counts is at most its words.
    size = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_words))
    of = first_round(count)
    frequent = frequent.where("ids IS NOT NULL").select("chunk", "ids")
    for k in range(1, LONGEST):
        done, ids = stored(relations.groupBy("chunk").cogroup(frequent.groupBy("chunk")).applyInArrow(of, ROUND), f"round-{k}"), IDS[: k + 1]
        rows = done.where("relation IS NULL").select("chunk", "part", "phrases")
        if k + 1 < LONGEST:
            # Chunks in their order, put together; a row of 16 bytes for each chunk of some million words is broadcast.
            before = F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
            sizes = done.where("relation IS NOT NULL").select("chunk", "n")
            new = F.broadcast(sizes.select("chunk", F.floor(F.coalesce(before, F.lit(0)) / (TOGETHER[k - 1] * chunk_words)).alias("new")))
            relations = done.where("relation IS NOT NULL").join(new, "chunk").select(F.col("new").alias("chunk"), "words", "relation")
            frequent = stored(added_up(rows.join(new, "chunk").select(F.col("new").alias("chunk"), "part", "phrases"), k + 1, min_count, True), f"frequent-{k + 1}")
            each, of = frequent.where("phrases IS NULL").select(F.array(*ids).alias("phrase"), "f"), next_round(k + 1, k + 2 < LONGEST, count)
            frequent = frequent.where("phrases IS NOT NULL").select("chunk", "phrases")
        else:
            each = added_up(rows, k + 1, min_count, False).select(F.array(*ids).alias("phrase"), "f")
        phrases = each if phrases is None else phrases.unionByName(each)
    return words, stored(phrases, "phrases"), totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's best phrases."""
    words, phrases, totals = mined(docs, min_count, chunk_words)
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.size("phrase") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("phrase") - n + 1), lambda at: F.slice("phrase", at, n)))), lambda x: F.size(x) >= 2
    )
    longer = phrases.where(F.size("phrase") > 2).select(F.explode(inner).alias("phrase"), "f").groupBy("phrase").agg(F.max("f").alias("around"))
    free = phrases.withColumnRenamed("f", "a").join(longer, "phrase", "left").where(f"around IS NULL OR 100 * CAST(around AS DECIMAL(20, 0)) < {COVERED} * CAST(a AS DECIMAL(20, 0))")
    known = words.select(F.array("word_id").alias("part"), "f").unionByName(phrases.select(F.col("phrase").alias("part"), "f"))
    cuts = free.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    halves = cuts.withColumns({"left": F.slice("phrase", F.lit(1), F.col("k")), "right": F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k"))})
    scored = (
        halves.join(known.select(F.col("part").alias("left"), F.col("f").alias("l")), "left")
        .join(known.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
        .withColumn("score", F.expr(f"CAST({SCALE} * CAST(a AS DECIMAL(20, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + r) AS BIGINT)"))
    )
    left = scored.groupBy("phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("phrase", "c.score", "c.a", "c.l", "c.r")
    # Of a lang only what can be among the best is spelled: by score and count, ties included, first within salted groups.
    best = left.join(words.select(F.col("word_id").alias("w"), "lang"), F.col("phrase")[0] == F.col("w")).drop("w")
    order = [F.col("score").desc(), F.col("a").desc()]
    for salt in ([F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS))], []):
        best = best.withColumn("rank", F.rank().over(Window.partitionBy("lang", *salt).orderBy(*order))).where(F.col("rank") <= top)
    spelled = (
        best.select("phrase", F.posexplode("phrase").alias("at", "word_id")).join(words.select("word_id", "word"), "word_id")
        .groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    )
    rows = best.join(spelled, "phrase").select("lang", F.col("text").alias("phrase"), "a", "l", "r", "score")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
