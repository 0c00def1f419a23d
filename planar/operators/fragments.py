"""References in the words of the pages that one task holds: what neighbouring fragments give together is found by hashes and then compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from planar.operators.walks import _one, _spread, whole_paths

#: Of the hash of a text, which is a polynomial in its bytes, so that texts put together have a hash without being made.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words that are looked at together, at least.
WORDS = 60_000


class References:
    """The texts that are looked for: those of a reference, with and without `_E`, and all beginnings of references by a bitmap."""

    def __init__(self, pairs: list[tuple[str, str]]):
        """pairs: query, wanted."""
        self.wanted = sorted({w for _, w in pairs})
        number = {w: k for k, w in enumerate(self.wanted)}
        pairs = sorted(pairs, key=lambda p: number[p[1]])
        self.queries = pa.array([q for q, _ in pairs], pa.string())
        self.asked = np.searchsorted(np.array([number[w] for _, w in pairs], np.int64), np.arange(len(number) + 1))
        texts: dict[str, list[int]] = {}
        for w, k in number.items():
            key = w.removesuffix("_E")
            for t in (key + "_E", *(() if key.endswith("_E") else (key,))):
                texts.setdefault(t, []).append(k)
        texts.pop("", None)
        self.texts = {t: k for k, t in enumerate(texts)}
        self.of_text = list(texts.values())
        self.most = max((len(t.encode()) for t in texts), default=0)
        self.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(self.most, 1), BASE))), dtype=np.uint64)
        hashes, _ = self.hashed(pa.array(list(texts), pa.string()))
        self.hashes = np.sort(hashes)
        begun = [self.begun(pa.array(self.wanted[k : k + 10_000], pa.string())) for k in range(0, len(self.wanted), 10_000)]
        size = sum(map(len, begun)) + len(hashes) + 1
        self.shift = np.uint64(64 - max(10, int(size * 8).bit_length()))
        self.begins, self.ends = self.bitmap(np.concatenate([np.zeros(1, np.uint64), *begun])), self.bitmap(hashes)

    def _bytes(self, texts: pa.Array):
        raw = texts.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
        return data, np.diff(offsets)

    def hashed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hash and bytes of each text; what is longer than any reference has no hash."""
        data, size = self._bytes(texts)
        k, at = _spread(np.zeros(len(size), np.int64), size)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * self.powers[np.minimum(size[k] - 1 - at, len(self.powers) - 1)], dtype=np.uint64)))
        ends = np.cumsum(size)
        return sums[ends] - sums[ends - size], size

    def begun(self, texts: pa.Array) -> np.ndarray:
        """Hashes of all beginnings of the texts."""
        data, size = self._bytes(texts)
        out, here = [], np.zeros(len(size), np.uint64)
        first = np.cumsum(size) - size
        for k in range(int(size.max(initial=0))):
            on = size > k
            here[on] = here[on] * BASE + data[first[on] + k]
            out.append(here[on])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def bitmap(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << int(64 - int(self.shift)), bool)
        out[self._slot(hashes)] = True
        return out

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def may_begin(self, hashes: np.ndarray) -> np.ndarray:
        return self.begins[self._slot(hashes)]

    def may_be(self, hashes: np.ndarray) -> np.ndarray:
        """Where a hash is that of a text looked for."""
        out = self.ends[self._slot(hashes)]
        some = np.flatnonzero(out)
        if len(some):
            k = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            out[some] = self.hashes[k] == hashes[some]
        return out


BOX = ("left", "bottom", "width", "height")
CODEC = "zstd"


def packed(by: tuple[str, ...]):
    """A function for mapInArrow: neighbouring words (by, n, norm, box) of one page as one row (by, n of the first, words, size, data), so that an exchange moves
    few bytes for a word. Words of a page that come apart are put together by found()."""

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            new = np.ones(count, bool)
            if count > 1:
                differ = [pc.fill_null(pc.not_equal(batch.column(c).slice(0, count - 1), batch.column(c).slice(1)), True).to_numpy(zero_copy_only=False) for c in by]
                new[1:] = np.logical_or.reduce(differ)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], count)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            boxes = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in BOX]
            text = batch.column("norm").cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + count + 1]
            letters, sizes = memoryview(text.buffers()[2] or b""), np.diff(offsets).astype(np.int32)
            raw = [b"".join((np.diff(n[s:e], prepend=0).tobytes(), *[x[s:e].tobytes() for x in boxes], sizes[s:e].tobytes(), letters[offsets[s] : offsets[e]])) for s, e in zip(starts.tolist(), ends.tolist())]
            data = pa.array([pa.compress(r, CODEC, asbytes=True) for r in raw], pa.binary())
            head = pa.array(starts)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(head) for c in by], pa.array(n[starts]), pa.array((ends - starts).astype(np.int32)), pa.array([len(r) for r in raw], pa.int32()), data], [*by, "n", "words", "size", "data"])

    return run


def _slices(batches):
    """Batches of packed rows in slices of at most WORDS words, or of one row."""
    for batch in batches:
        total = np.cumsum(batch.column("words").to_numpy())
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + WORDS, "right")))
            yield batch.slice(at, to - at)
            at = to


def _unpacked(table: pa.Table, by: tuple[str, ...]) -> tuple[pa.Table, np.ndarray]:
    """norm, box and row of the words of packed pages in their order, and the packed row of each."""
    counts = _one(table["words"]).to_numpy().astype(np.int64)
    n, boxes, sizes, letters = [], [], [], []
    for k, size, data in zip(counts.tolist(), table["size"].to_pylist(), table["data"].to_pylist()):
        raw = pa.decompress(data, size, CODEC, asbytes=True)
        n.append(np.cumsum(np.frombuffer(raw, np.int64, k)))
        boxes.append(np.frombuffer(raw, np.float64, 4 * k, 8 * k).reshape(4, k))
        sizes.append(np.frombuffer(raw, np.int32, k, 40 * k))
        letters.append(raw[44 * k :])
    part = np.repeat(np.arange(len(counts)), counts)
    page = np.cumsum(_one(table["row"]).to_numpy() == 1)[part]
    n = np.concatenate(n)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes), dtype=np.int64)))
    norm = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets), pa.py_buffer(b"".join(letters)))
    columns = np.concatenate(boxes, axis=1)
    if ((page[1:] == page[:-1]) & (n[1:] < n[:-1])).any():
        order = np.lexsort((n, page))
        part, page, norm, columns = part[order], page[order], norm.take(pa.array(order)), columns[:, order]
    first = np.ones(len(page), bool)
    first[1:] = page[1:] != page[:-1]
    row = np.where(first, 1, 2)
    return pa.table([norm, *map(pa.array, columns), pa.array(row)], ["norm", *BOX, "row"]), part


def found(shared, by: tuple[str, ...], fragments: int):
    """A function for mapInArrow: of packed words sorted by page (row from 1 in each) the queries that each page holds. shared: a broadcast of References."""

    def run(batches):
        refs = shared.value
        for pages in whole_paths(_slices(batches), 2 * WORDS // 1000):
            table, part = _unpacked(pages, by)
            yield _found(table, pages, part, refs, by, fragments)

    return run


def _joined(table: pa.Table, row: np.ndarray) -> np.ndarray:
    """Whether a word is close behind the one before it on its line. See search.runs_of."""
    left, bottom, width, height = (_one(table[c]).to_numpy() for c in BOX)
    middle, end = bottom + height / 2, left + width
    joined = np.zeros(len(row), bool)
    tall = np.fmax(0.5, np.fmax(height[1:], height[:-1]))
    gap = left[1:] - end[:-1]
    joined[1:] = (row[1:] > 1) & (np.abs(middle[1:] - middle[:-1]) <= tall * 0.65) & (gap >= -(tall * 0.35)) & (gap <= tall * 1.75)
    return joined


def _found(table: pa.Table, pages: pa.Table, part: np.ndarray, refs: References, by: tuple[str, ...], fragments: int) -> pa.RecordBatch:
    row = _one(table["row"]).to_numpy(zero_copy_only=False)
    joined = _joined(table, row)
    coded = _one(table["norm"]).dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    said = words.to_pylist()
    own, size = refs.hashed(words)
    word_hash, word_size = own[code], size[code]
    page = np.cumsum(row == 1)

    # Single words are looked up by themselves, once each.
    single = [refs.of_text[k] if (k := refs.texts.get(w)) is not None else () for w in said]
    count = np.fromiter(map(len, single), np.int64, len(single))
    flat = np.fromiter((k for s in single for k in s), np.int64, int(count.sum()))
    places, slot = _spread((np.cumsum(count) - count)[code], count[code])
    hits = [(places, np.ones(len(places), np.int64), flat[slot])]

    at, hashes, sizes = np.arange(len(row)), word_hash, word_size
    for k in range(2, fragments + 1):
        on = at + k - 1 < len(row)
        on[on] = joined[at[on] + k - 1]
        on &= sizes <= refs.most
        at, hashes, sizes = at[on], hashes[on], sizes[on]
        if k > 2:  # what all but the last fragment give begins a reference
            on = refs.may_begin(hashes)
            at, hashes, sizes = at[on], hashes[on], sizes[on]
        last = at + k - 1
        on = sizes + word_size[last] <= refs.most
        at, last, hashes, sizes = at[on], last[on], hashes[on], sizes[on]
        if not len(at):
            break
        hashes, sizes = hashes * refs.powers[word_size[last]] + word_hash[last], sizes + word_size[last]
        where, which = [], []
        some = np.flatnonzero(refs.may_be(hashes))
        for i, codes in zip(at[some].tolist(), np.column_stack([code[at[some] + j] for j in range(k)]).tolist()):
            begun = "".join([said[c] for c in codes[:-1]])
            t = refs.texts.get(begun + said[codes[-1]])
            for w in refs.of_text[t] if t is not None else ():
                if k < 3 or refs.wanted[w].startswith(begun):
                    where.append(i)
                    which.append(w)
        hits.append((np.array(where, np.int64), np.full(len(where), k), np.array(which, np.int64)))

    place, long, which = (np.concatenate(c) for c in zip(*hits))
    pair = page[place] * (len(refs.wanted) + 1) + which
    order = np.lexsort((long, place, pair))
    place, long, pair, which = place[order], long[order], pair[order], which[order]
    # Of a place the shortest run comes first, and covers the others.
    first = np.ones(len(pair), bool)
    first[1:] = (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])
    place, long, pair, which = place[first], long[first], pair[first], which[first]
    begin = np.ones(len(pair), bool)
    begin[1:] = pair[1:] != pair[:-1]
    starts = np.flatnonzero(begin)
    counts = np.diff(np.append(starts, len(pair)))
    over = np.zeros(len(pair), bool)
    over[1:] = ~begin[1:] & (place[1:] < place[:-1] + long[:-1])
    if over.any():
        for g in np.unique((np.cumsum(begin) - 1)[over]).tolist():
            s, free, n = starts[g], -1, 0
            for p, k in zip(place[s : s + counts[g]].tolist(), long[s : s + counts[g]].tolist()):
                if p >= free:
                    free, n = p + k, n + 1
            counts[g] = n
    asked = refs.asked[which[starts] + 1] - refs.asked[which[starts]]
    g, q = _spread(refs.asked[which[starts]], asked)
    head = pa.array(part[place[starts][g]])
    return pa.RecordBatch.from_arrays([*[_one(pages[c]).take(head) for c in by], refs.queries.take(pa.array(q)), pa.array(counts[g])], [*by, "query", "occurrences"])
