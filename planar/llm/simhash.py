"""SimHash near-duplicates: fingerprints, BK-trees of fingerprints, connected components.

A fingerprint has bit b set if over half of the text's shingle hashes (XXH64, seed 42) have it. Texts with one fingerprint
are one node, so copies never meet in pairs. A BK-tree keys the children of a node by their integer Hamming distance to it, and a
search follows only the edges within the radius. A tree of all fingerprints would grow with the corpus and can't be broadcast, so
fingerprints are sharded by exact blocks: 64 bits are cut into radius + 1 blocks, two fingerprints within the radius agree in one of them, and each
block is a shard key. Every shard with two members or more has a BK-tree in the task that holds it; the links kept of it are a spanning
forest of the shard, so that their number is bounded by its rows. A shard over `split_over` fingerprints is dealt on by pairs of radius + 2 blocks
of the bits turned, again without a loss, before a tree is built.

similar_groups, the pipeline's stage, shards texts by bands of minimum hashes of their sets of shingles, searches the fingerprints of a shard by BK-trees where its members
are not joined yet, and verifies what comes together by exact Jaccard similarity.

Components are found by alternating rounds over links, each node towards the least doc_id it sees, checkpointed in the shared folder.

Defined results: fewer words than a shingle: the whole sequence is the shingle; no words (null, empty, white space): fingerprint
zero, linked like any other; repeated rows with the same doc_id are one node each time; a null doc_id is linked
like any other and stays null unless another document of its component has an id; the least id names a component, so ties can't occur; empty table: empty
result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain, combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.llm.common import integer_key, stored, text_bytes

SHINGLE, RADIUS, SEED = 4, 4, 42
SPLIT_OVER = 4096
#: similar_groups: BANDS bands of ROWS minimum hashes. Sets at a Jaccard similarity of 0.8 share a band in all but 0.04 % of cases, (1 - 0.8^5)^20, and sets that share
#: a tenth in 0.02 %. Large sets at 0.8 differ in 15 % of the bits of a fingerprint (9.7 of 64, deviation 2.9), sets of four and five shingles in 19 % (12, deviation 3.1): the
#: bounds for one fingerprint and for all PRINTS lie over 3.8 deviations above both.
BANDS, ROWS, PRINTS, OWN_BITS, ALL_BITS, DEAL, STARS = 20, 5, 2, 24, 42, 8, 2
#: Pairs of a searcher and a member of its tree, or hashes of the sets of pairs, that a worker holds at once.
PAIRS = 1 << 17
#: Buckets in which a set's hashes are counted, the largest size for which counts fit, and the hashes of the sets that one tree holds, or that search it together.
BUCKETS, COUNTED, SPLIT_SETS = 256, 1 << 22, 1 << 21


def shingle_hashes(text: bytes, shingle: int):
    """The hash of each shingle of a text in its order; of the whole sequence if that is shorter; none without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    n = len(w)
    line = b" ".join(w)
    if n <= shingle:
        return np.array([xxh64_intdigest(line, SEED)] if n else [], np.uint64)
    size = np.fromiter(map(len, w), np.int64, n) + 1
    ends = np.cumsum(size) - 1
    starts = ends + 1 - size
    return np.fromiter([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64, n - shingle + 1)


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> list[int]:
    import numpy as np

    out = []
    for t in texts:
        h = shingle_hashes(t, shingle)
        bits = np.zeros(64, np.int64)
        for at in range(0, len(h), 255):  # sums of up to 255 bits fit a byte
            bits += np.add.reduce(np.unpackbits(h[at : at + 255].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint8)
        out.append(int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big"))
    return out


def seeded_fingerprints(hashes, count: int):
    """`count` fingerprints of a set of shingle hashes, each by a mixing of its own."""
    import numpy as np

    if not len(hashes):
        return np.zeros(count, np.uint64)
    seeds = np.array([(k + 1) * 0x9E3779B97F4A7C15 % 2**64 for k in range(count)], np.uint64)
    with np.errstate(over="ignore"):
        z = hashes[:, None] + seeds
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    bits = np.zeros(64 * count, np.int64)
    for at in range(0, len(z), 255):  # sums of up to 255 bits fit a byte
        bits += np.add.reduce(np.unpackbits(z[at : at + 255].view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * bits > len(z)).view(np.uint64)


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long)."""
    rows = docs.select(integer_key(docs), F.col("text").cast("string").alias("text"))

    def batches(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in it:
            f = np.array(fingerprints(text_bytes(b.column(1)), shingle), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(batches, "doc_id long, fingerprint long")


class BKTrees:
    """BK-trees over 64-bit values, one for each root: roots[k] is the place of the first value of k's tree. Values are distinct within a tree.

    Building and searching go level by level over whole arrays, all trees at once."""

    def __init__(self, values, roots):
        import numpy as np

        self.values = values
        n = len(values)
        parent, edge = roots.copy(), np.zeros(n, np.int64)
        below = inner = np.flatnonzero(np.arange(n) != roots)  # values that still sink; the first of a parent's group becomes its child there
        while len(below):
            d = np.bitwise_count(values[below] ^ values[parent[below]]).astype(np.int64)
            group = parent[below] * 65 + d
            _, first, which = np.unique(group, return_index=True, return_inverse=True)
            edge[below[first]] = d[first]
            child = below[first][which]
            stays = child == below
            parent[below[~stays]] = child[~stays]
            below = below[~stays]
        key = parent[inner] * 65 + edge[inner]
        order = np.argsort(key, kind="stable")
        self.children, self.keys = inner[order], key[order]

    def search(self, queries, roots, radius: int):
        """(query, place) pairs within the radius, each query in the tree of its root; only edges within the radius of a node's own distance are followed."""
        import numpy as np

        q, k = np.arange(len(queries)), roots
        found = []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[k]).astype(np.int64)
            near = d <= radius
            found.append((q[near], k[near]))
            low = np.searchsorted(self.keys, k * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, k * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, k = np.repeat(q, n), self.children[at]
        return np.concatenate([x for x, _ in found] or [q]), np.concatenate([x for _, x in found] or [q])


def within(size, most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive queries that meet `most` members together, or little more; size: the members that each meets."""
    import numpy as np

    group = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(size) else np.zeros(1, np.int64)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def steps(roots, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of queries whose trees have `most` members together, or single queries of larger trees' share."""
    import numpy as np

    return within(np.bincount(roots, minlength=len(roots))[roots], most)


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches in slices of some rows, so that what a worker makes of their texts stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def forest(values, roots, radius: int):
    """For each value the least place that steps within the radius lead to in its tree."""
    import numpy as np

    trees, label = BKTrees(values, roots), np.arange(len(values))
    for lo, hi in steps(roots):
        q, k = trees.search(values[lo:hi], roots[lo:hi], radius)
        q += lo
        while len(q):
            a, b = label[q], label[k]
            apart = a != b
            q, k, a, b = q[apart], k[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
    return label


def blocks(width: int, count: int) -> list[tuple[int, int]]:
    """(shift, bits) of `count` blocks of nearly equal size over `width` bits."""
    edges = [width * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shard_keys(value, radius: int, agree: int, level: int = 0):
    """An array of shard keys, one for each choice of `agree` of radius + agree blocks. Level 1 cuts the bits anew, rotated
    by half a block, so that its choices differ from those of level 0."""
    cut = blocks(64, radius + agree)
    turned = value if level == 0 else F.shiftleft(value, 5).bitwiseOR(F.shiftrightunsigned(value, 59))
    part = [F.shiftrightunsigned(turned, a).bitwiseAND(F.lit((1 << bits) - 1)) for a, bits in cut]
    return F.array(*[F.xxhash64(F.lit(100 * level + k), *[part[i] for i in own]) for k, own in enumerate(combinations(range(len(cut)), agree))])


def shards(batches: Iterator, columns: int) -> Iterator:
    """For runs of whole shards with two rows or more: the place of each row's first one in its shard, and the other columns. Rows come sorted by
    their first column, the shard."""
    import numpy as np

    held: list = [np.zeros(0, np.int64)] * columns
    for batch in chain(batches, [None]):
        cols = held if batch is None else [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        if not len(cols[0]):
            continue
        last = len(cols[0]) if batch is None else int(np.searchsorted(cols[0], cols[0][-1]))  # the last shard waits for the next batch
        shard, held = cols[0][:last], [c[last:] for c in cols]
        new = np.concatenate([[True], shard[1:] != shard[:-1]]) if last else np.zeros(0, bool)
        size = np.diff(np.append(np.flatnonzero(new), last))
        on = np.flatnonzero(np.repeat(size > 1, size))
        if len(on):
            first = np.flatnonzero(new[on])
            yield [np.repeat(first, size[size > 1]), *(c[:last][on] for c in cols[1:])]


def pair_batches(pairs: Iterator, rows: int = 100_000) -> Iterator:
    """(a, b) arrays as Arrow batches of about `rows`."""
    import numpy as np
    import pyarrow as pa

    a, b, n = [], [], 0
    for x, y in pairs:
        a.append(x)
        b.append(y)
        n += len(x)
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def links(nodes: DataFrame, radius: int = RADIUS, split_over: int = SPLIT_OVER) -> DataFrame:
    """Links (a, b) between ids of nodes (id, fingerprint; fingerprints distinct) that give the components of distance <= radius."""
    dealt = nodes.select("id", "fingerprint", F.explode(shard_keys(F.col("fingerprint"), radius, 1)).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = stored(dealt.join(sizes, "shard"), "fingerprint-shards")
    small = many.where(F.col("n") <= split_over).select("shard", "id", "fingerprint")
    # Large shards go on by the other cut's choices: what is within the radius agrees there too.
    large = many.where(F.col("n") > split_over).select("id", "fingerprint", F.explode(shard_keys(F.col("fingerprint"), radius, 2, 1)).alias("second"), "shard")
    large = large.select(F.xxhash64("shard", "second").alias("shard"), "id", "fingerprint")

    def trees(batches: Iterator) -> Iterator:
        import numpy as np

        def linked():
            for roots, ids, prints in shards(batches, 3):
                least = forest(prints.view(np.uint64), roots, radius)
                linked_ = np.flatnonzero(least != np.arange(len(least)))
                yield ids[linked_], ids[least[linked_]]

        yield from pair_batches(linked())

    return small.unionByName(large).repartition("shard").sortWithinPartitions("shard").mapInArrow(trees, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and component (the least id reachable) of every id in edges (a, b).

    Each round is a large star and a small star: every node's neighbours are linked to the least of them. The rounds end when
    the links no longer change; each is written to the shared folder.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small, "links")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = tuple(now)
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, split_over: int = SPLIT_OVER) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    prints = stored(with_fingerprints(docs, shingle), "fingerprints")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    # A fingerprint whose documents all lack an id is a node of its own under a negative stand-in.
    nodes = nodes.withColumn("id", F.coalesce("id", F.lit(-(2**62)) - F.abs(F.xxhash64("fingerprint") % 2**60)))
    nodes = stored(nodes, "fingerprint-nodes")
    found = components(links(nodes, radius, split_over))
    named = nodes.join(found, "id", "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    named = named.withColumn("component_id", F.when(F.col("component_id") > -(2**62), F.col("component_id")))
    return prints.join(named, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@functools.cache
def multipliers():
    """Odd numbers, one for each minimum hash."""
    import numpy as np

    return np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(hashes):
    """A hash of each band of minimum hashes of a set of shingle hashes; zeros for an empty set."""
    import numpy as np

    if not len(hashes):
        return np.zeros(BANDS, np.uint64)
    by = multipliers()
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        for at in range(0, len(mixed), 1024):
            least = np.minimum(least, (mixed[at : at + 1024, None] * by).min(axis=0))
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            out = (out ^ column ^ (column >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


def with_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row (a hash of id and text), node (a hash of the set of shingles), prints (PRINTS fingerprints of the set) and bands."""
    text = F.col("text").cast("string")
    rows = docs.select(integer_key(docs), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), text.alias("text"))

    def batches(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for b in slices(it):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in text_bytes(b.column(2))]
            node = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            prints = pa.array([seeded_fingerprints(x, PRINTS).view(np.int64) for x in sets], pa.list_(pa.int64()))
            bands = pa.array([band_hashes(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), prints, bands], names=["doc_id", "row", "node", "prints", "bands"])

    return rows.mapInArrow(batches, "doc_id long, row long, node long, prints array<long>, bands array<long>")


def dealt_join(rows: DataFrame, shards_: DataFrame) -> DataFrame:
    """rows (shard, id, ...) with the columns of shards_, one row a shard; a shard's rows are dealt by their ids."""
    shards_ = shards_.withColumn("deal", F.explode(F.array(*[F.lit(k) for k in range(DEAL)])))
    return rows.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(DEAL)).cast("int")).join(shards_, ["shard", "deal"]).drop("deal")


def unlike_shards(members: DataFrame) -> DataFrame:
    """members (shard, band, id, component) of the shards with members of two components or more."""
    kinds = members.groupBy("shard").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shard")
    return dealt_join(members, kinds)


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (a < b) of each member of a shard and the shard's centre, the least by a hash that changes with `turn`, of unlike components."""
    order = F.xxhash64("id", F.lit(turn))
    centre = members.groupBy("shard").agg(F.min(F.struct(order.alias("h"), F.col("id").alias("centre"), F.col("component").alias("its"))).alias("c"), F.count(F.lit(1)).alias("n"))
    pairs = dealt_join(members, centre.where("n > 1").select("shard", "c.centre", "c.its")).where("component <> its")
    return pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def tree_cells(members: DataFrame, sets: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """Rows (cell, id, component, one, two, asks, size, counts): the members of each shard with a BK-tree, and those that search it (asks is 1).

    Two unlike members of a shard have one outside the shard's largest component, so these members alone search the tree of the shard's fingerprints. A shard of over
    `split_over` members, or of sets of over SPLIT_SETS hashes, has as many trees as keep each below that, and its searchers go to each of them in runs of that size.
    """
    sizes = members.join(sets.select("id", "size"), "id").groupBy("shard", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("of"))
    whole = stored(sizes, "shard-sizes").groupBy("shard").agg(F.sum("n").alias("all"), F.sum("of").alias("sizes"), F.max(F.struct("n", "of", "component")).alias("most"))
    parts = lambda n, of: F.greatest(F.ceil(n / split_over), F.ceil(of / SPLIT_SETS), F.lit(1)).cast("int")
    rest = parts(F.col("all") - F.col("most.n"), F.col("sizes") - F.col("most.of"))
    whole = whole.select("shard", F.col("most.component").alias("main"), parts(F.col("all"), F.col("sizes")).alias("trees"), rest.alias("runs"))
    rows = dealt_join(members, whole).join(sets.select("id", "prints", "size", "counts"), "id")
    one = F.element_at("prints", (F.col("band") % PRINTS + 1).cast("int"))
    two = F.element_at("prints", ((F.col("band") + 1) % PRINTS + 1).cast("int"))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda tree, run, asks: F.struct(F.xxhash64("shard", tree, run).alias("cell"), F.lit(asks).cast("long").alias("asks"))
    held = F.transform(each("runs"), lambda run: at(own("trees"), run, 0))
    asked_ = F.when(F.col("component") != F.col("main"), F.transform(each("trees"), lambda tree: at(tree, own("runs"), 1))).otherwise(F.array().cast("array<struct<cell:bigint,asks:bigint>>"))
    rows = rows.select("id", "component", one.alias("one"), two.alias("two"), "size", "counts", F.explode(F.concat(held, asked_)).alias("at"))
    return rows.select("at.cell", "id", "component", "one", "two", "at.asks", "size", "counts")


def whole_cells(batches: Iterator) -> Iterator:
    """Arrow tables of whole cells; rows come sorted by their first column, the cell."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is None:
            last = 0
        else:
            cell = batch.column(0).to_numpy()
            last = int(np.searchsorted(cell, cell[-1])) if not held or held[-1].column(0)[0].as_py() != cell[-1] else -1
        if last >= 0 and (held or last):  # cells have ended: the batch's last one waits
            t = pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])]).combine_chunks()
            held = []
            if t.num_rows:
                yield t.to_batches()[0]
        if batch is not None:
            held.append(batch.slice(max(last, 0)))


def at_least(common, m, n, similar: float):
    """Whether sets of m and n hashes with so many in common have a Jaccard similarity of `similar` or more."""
    return common >= similar * (m + n - common)


def close_pairs(cells, similar: float) -> Iterator:
    """(x, y) places of searchers and members of their cell's tree, of unlike components, that lie within OWN_BITS by one fingerprint and ALL_BITS by all, and whose
    sizes and counts leave `similar` possible."""
    import numpy as np

    cell, component, asks, size = (cells.column(k).to_numpy() for k in (0, 2, 5, 6))
    one, two = (cells.column(k).to_numpy().view(np.uint64) for k in (3, 4))
    counts = cells.column(7).flatten().to_numpy().reshape(-1, BUCKETS)
    held, q = np.flatnonzero(asks == 0), np.flatnonzero(asks == 1)
    if not len(held) or not len(q):
        return
    order = held[np.lexsort((one[held], cell[held]))]  # the members by cell and fingerprint
    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (cell[order][1:] != cell[order][:-1])])
    first = np.flatnonzero(new)
    times, value, cells_ = np.diff(np.append(first, len(order))), one[order[first]], cell[order[first]]
    at = np.searchsorted(cells_, cell[q])
    has = cells_[np.minimum(at, len(cells_) - 1)] == cell[q]
    q, at = q[has], at[has]
    trees = BKTrees(value, np.searchsorted(cells_, cells_))  # each value's tree: the first value of its cell
    members_ = np.searchsorted(cell[order], cell[q], "right") - np.searchsorted(cell[order], cell[q])
    for lo, hi in within(members_, PAIRS):
        x, v = trees.search(one[q[lo:hi]], at[lo:hi], OWN_BITS)
        n = times[v]
        x, y = np.repeat(q[lo:hi][x], n), order[np.repeat(first[v] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        m, n = size[x], size[y]
        close = (component[x] != component[y]) & (np.bitwise_count(one[x] ^ one[y]) + np.bitwise_count(two[x] ^ two[y]) <= ALL_BITS) & at_least(np.minimum(m, n), m, n, similar)
        x, y = x[close], y[close]
        for at_ in range(0, len(x), PAIRS // 8):
            i, j = x[at_ : at_ + PAIRS // 8], y[at_ : at_ + PAIRS // 8]
            most = np.minimum(counts[i], counts[j]).sum(axis=1, dtype=np.int64)
            m, n = size[i], size[j]
            able = at_least(most, m, n, similar) | (np.maximum(m, n) > COUNTED)
            yield i[able], j[able]


def common_hashes(codes, begin, size, x, y, keys, width: int):
    """How many hashes the sets of the pairs (x, y) have in common; keys: place * width + code of every set's hashes, sorted."""
    import numpy as np

    n = size[x]
    pair = np.repeat(np.arange(len(x)), n)
    asked_ = np.repeat(y, n) * width + codes[np.repeat(begin[x] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    hit = keys[np.minimum(np.searchsorted(keys, asked_), len(keys) - 1)] == asked_
    return np.bincount(pair[hit], minlength=len(x))


def cell_links(cells, similar: float) -> Iterator:
    """(a, b) ids of similar pairs of each cell that join its components as all similar pairs there do: no more than the cell has rows."""
    import numpy as np

    ids, cell, component, size = (cells.column(k).to_numpy() for k in (1, 0, 2, 6))
    codes = np.unique(cells.column(8).flatten().to_numpy(), return_inverse=True)[1]
    width, begin = int(codes.max(initial=0)) + 1, np.cumsum(size) - size
    keys = np.sort(np.repeat(np.arange(len(size)), size) * width + codes)
    label = np.unique(np.stack([cell, component], axis=1), axis=0, return_inverse=True)[1].reshape(-1)  # rows of one component are one already
    above = list(range(int(label.max(initial=-1)) + 1))

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    for x, y in close_pairs(cells, similar):
        x, y = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
        todo = within(size[x], PAIRS)
        for lo, hi in todo:
            tops = np.array([top(k) for k in range(len(above))])
            i, j = x[lo:hi], y[lo:hi]
            apart = tops[label[i]] != tops[label[j]]
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            alike = at_least(common_hashes(codes, begin, size, i, j, keys, width), size[i], size[j], similar)
            for p, r in zip(i[alike].tolist(), j[alike].tolist()):
                u, v = top(label[p]), top(label[r])
                if u != v:
                    above[max(u, v)] = min(u, v)
                    yield np.array([min(ids[p], ids[r])]), np.array([max(ids[p], ids[r])])


CELL = "cell long, id long, component long, one long, two long, asks long, size long"


def tree_links(members: DataFrame, sets: DataFrame, similar: float, split_over: int = SPLIT_OVER) -> DataFrame:
    """Similar pairs (a < b) of members of a shard of unlike components that join these as all of their similar pairs do.

    The trees are searched twice: first without the sets, for the rows that have a partner at all, then by these rows with their sets, which are compared in the worker, so that
    pairs which are not similar never become rows, however many they are.
    """

    def partnered(batches: Iterator) -> Iterator:
        import numpy as np

        for cells in whole_cells(batches):
            has = np.zeros(cells.num_rows, bool)
            for x, y in close_pairs(cells, similar):
                has[x] = has[y] = True
            if has.any():
                yield cells.select(CELL.replace(" long", "").split(", ")).take(np.flatnonzero(has))

    def linked(batches: Iterator) -> Iterator:
        yield from pair_batches(pair for cells in whole_cells(batches) for pair in cell_links(cells, similar))

    dealt = tree_cells(members, sets, split_over).repartition("cell").sortWithinPartitions("cell")
    rows = stored(dealt.mapInArrow(partnered, CELL), "partnered")
    rows = rows.join(sets.select("id", "counts", "set"), "id").select(*CELL.replace(" long", "").split(", "), "counts", "set")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(linked, "a long, b long").distinct()


def deals(pairs: DataFrame, side: str) -> DataFrame:
    """pairs with the deal of their `side`: an id with many pairs is dealt by its partners."""
    return pairs.withColumn("deal", F.pmod(F.xxhash64("b" if side == "a" else "a"), F.lit(DEAL)).cast("int"))


def asked(pairs: DataFrame, rows: DataFrame, side: str) -> DataFrame:
    """rows (id, ...) once for each deal of the id in which a pair has it as its `side`."""
    return deals(pairs, side).select(F.col(side).alias("id"), "deal").distinct().join(rows, "id")


def beside(pairs: DataFrame, rows: DataFrame, side: str, met: DataFrame | None = None) -> DataFrame:
    """pairs with the columns of rows whose id is the pair's `side`. met: the pairs as stored, if more columns came to them since."""
    own = asked(pairs if met is None else met, rows, side).withColumnRenamed("id", side)
    return deals(pairs, side).join(own, [side, "deal"]).drop("deal")


def with_sets(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The nodes (id, row, prints) with their set of shingle hashes, its size, and the counts of its hashes in BUCKETS buckets."""
    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), text.alias("text")).join(nodes, "row").dropDuplicates(["row"]).select("id", "prints", "text")

    def as_sets(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in slices(it):
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in text_bytes(b.column(2))]
            counts = [np.minimum(np.bincount(x & (BUCKETS - 1), minlength=BUCKETS), 2**15 - 1).astype(np.int16) for x in sets]
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array(counts, pa.list_(pa.int16())), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["id", "prints", "size", "counts", "set"])

    return texts.mapInArrow(as_sets, "id long, prints array<long>, size long, counts array<smallint>, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b), stored, of ids of `sets` whose sets have a Jaccard similarity of `similar` or more."""
    known = lambda *names: sets.select("id", *[F.col(c).alias(n) for c, n in zip(("prints", "counts", "size"), names)])
    both = beside(beside(pairs, known("p", "c", "m"), "a"), known("q", "d", "n"), "b", pairs)
    total = lambda values: F.aggregate(values, F.lit(0), lambda n, x: n + x)
    apart = total(F.zip_with("p", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y))))
    able = lambda common: common >= similar * (F.col("m") + F.col("n") - common)
    most = total(F.zip_with("c", "d", lambda x, y: F.least(x, y).cast("int")))  # no two sets have more in common
    both = both.where((apart <= ALL_BITS) & able(F.least("m", "n"))).where((F.greatest("m", "n") > COUNTED) | able(most))
    pairs = stored(both.select("a", "b"), "near-pairs")  # sets only for what these leave
    own = lambda name, size: sets.select("id", F.col("set").alias(name), F.col("size").alias(size))
    # Both sets of a pair meet in Spark's own rows, never many pairs' sets in one batch for a Python worker.
    both = beside(beside(pairs, own("p", "m"), "a"), own("q", "n"), "b", pairs)
    return both.withColumn("common", F.size(F.array_intersect("p", "q"))).where(able(F.col("common"))).select("a", "b")


def similar_groups(docs: DataFrame, shingle: int, similar: float = 0.8, split_over: int = SPLIT_OVER) -> DataFrame:
    """doc_id and component_id of each document: groups joined by pairs of texts whose shingle sets have a Jaccard similarity of `similar` or more.

    Texts with one set are one node. Shards are the bands of a set's minimum hashes; they grow in number with the corpus, and a shard holds similar sets only. So that a
    large group doesn't meet in pairs, the members of a shard meet its centre first, in STARS turns with other centres; what the verified links leave in unlike
    groups is found by the shard's BK-trees. Each pair is verified with the sets themselves.
    """
    prints = stored(with_prints(docs, shingle), "prints")
    nodes = prints.groupBy(F.col("node").alias("id")).agg(F.min("doc_id").alias("doc"), F.min("row").alias("row"), F.first("prints").alias("prints"), F.first("bands").alias("bands"))
    # A node whose documents all lack an id counts under a negative stand-in.
    nodes = stored(nodes.withColumn("doc", F.coalesce("doc", F.lit(-(2**62)) - F.abs(F.col("id") % 2**60))), "print-nodes")
    dealt = nodes.select("id", F.posexplode("bands").alias("band", "shard"))
    many = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shard")
    dealt = stored(dealt_join(dealt, many), "shard-members")
    sets = stored(with_sets(nodes.join(dealt.select("id").distinct(), "id", "left_semi").select("id", "row", "prints"), docs, shingle), "near-sets")
    members, alike, met = dealt.withColumn("component", F.col("id")), None, None
    for turn in range(STARS + 1):
        if turn:
            groups = components(alike)
            members = stored(unlike_shards(dealt.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))), "unlike-members")
        if turn < STARS:
            pairs = star_pairs(members, turn)
            pairs = stored(pairs if met is None else pairs.join(met, ["a", "b"], "left_anti"), "candidates")
            met = pairs if met is None else met.unionByName(pairs)
        links_ = stored(verified(pairs, sets, similar) if turn < STARS else tree_links(members, sets, similar, split_over), "similar-pairs")
        alike = links_ if alike is None else alike.unionByName(links_)
    named = nodes.select("id", "doc")
    edges = alike.join(named.select(F.col("id").alias("a"), F.col("doc").alias("x")), "a").join(named.select(F.col("id").alias("b"), F.col("doc").alias("y")), "b")
    found = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = named.join(found.withColumnRenamed("id", "doc"), "doc", "left").select(F.col("id").alias("node"), F.coalesce("component", "doc").alias("component_id"))
    named = named.withColumn("component_id", F.when(F.col("component_id") > -(2**62), F.col("component_id")))
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
