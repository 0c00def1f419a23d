"""Hard-negative mining over rotated one-bit codes.

A vector becomes integers, is rotated (sign flips and Hadamard transforms, padded to a power of two) and coded by its signs, b = signs / sqrt(n), with its
alignment <v, b> beside the code; what b leaves of v is coded by its own signs again, LEVELS times in all. An anchor's rotated vector is
cut into bit planes, so that the popcounts of planes and codes estimate its product with a row. By Cauchy-Schwarz the product lies within
|anchor| * |residual of the row| + |planes' error| * |coded part of the row| of the estimate: an interval that holds for certain, so a
row whose interval can't reach the best is passed over and all others are scored by integers. What must be reached is known from the scores of the rows of
the highest estimates. Nothing is lost: results equal a full scan.

Anchors are the stated query set. They meet all rows in blocks of BLOCK anchors and BLOCK rows, in two passes: the best of the anchor's own label,
then, for the bounds that each of these sets, the best of other labels. A block keeps a few rows of each anchor, which are ranked
over all blocks. Codes, not links, are repeated for the blocks.

Defined results: rows with a null id, label or vector or with a null or non-finite component take no part; of rows that repeat an id the least by label
and vector counts; vectors of unequal length have no score and don't meet; an empty vector scores 0 with its like; ties go to the smaller id; an anchor without positives
has no rows; an empty table gives none; other columns are not read; components of 2^31 or more after scaling, and products that may pass 63 bits, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planar.llm.common import integer_key, stored

LEVELS, PLANES, BLOCK, STRIP = 5, 6, 1024, 128
POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: Percent of the positive's score that a negative must have at least and at most.
LOWEST, HIGHEST = 50, 95
CODED = "vec_id long, label long, dims int, ints binary, codes binary, aligned binary, coded double, residual double"


def rotated(x, seed: int = 7):
    """Rows times one orthogonal matrix of their padded length: three rounds of sign flips and Hadamard transforms."""
    import numpy as np

    n = max(64, 1 << max(0, int(x.shape[1] - 1).bit_length()))
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    for k in range(3):
        y *= np.random.default_rng([seed, n, k]).choice([-1.0, 1.0], n)
        h = 1
        while h < n:
            z = y.reshape(len(y), n // (2 * h), 2, h)
            y = np.concatenate([z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]], axis=2).reshape(len(y), n)
            h *= 2
        y /= np.sqrt(n)
    return y


def words(bits):
    """The last axis's bits as 64-bit words."""
    import numpy as np

    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def codes(ints):
    """For each row of integers: codes (levels x words), alignments (levels), length of the coded part, length of what is left."""
    import numpy as np

    y = rotated(ints.astype(np.float64))
    root, left, found, aligned = np.sqrt(y.shape[1]), y.copy(), [], []
    for _ in range(LEVELS):
        bits = left >= 0
        a = np.abs(left).sum(axis=1) / root
        left -= np.where(bits, 1.0, -1.0) * (a / root)[:, None]
        found.append(words(bits))
        aligned.append(a)
    return np.stack(found, axis=1), np.stack(aligned, axis=1), np.linalg.norm(y - left, axis=1), np.linalg.norm(left, axis=1)


def coded_rows(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for b in batches:
        dims = b.column("dims").to_numpy(zero_copy_only=False)
        vectors = b.column("ints").to_pylist()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            ints = np.array([vectors[k] for k in at], np.int64).reshape(len(at), d)
            if (np.abs(ints) >= 2**31).any():
                raise ValueError("components of 2^31 or more can't be scored")
            ints = ints.astype("<i4")
            c, a, coded, residual = codes(ints)
            pack = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            columns = [b.column("vec_id").take(pa.array(at)), b.column("label").take(pa.array(at)), pa.array(dims[at], pa.int32()), pack(ints), pack(c), pack(a), pa.array(coded), pa.array(residual)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "dims", "ints", "codes", "aligned", "coded", "residual"])


def coded(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """The rows that take part with their integer vectors and codes; label: another expression for the label."""
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = rows.select(integer_key(rows, "vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), x.alias("embedding"))
    whole = whole.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(usable)
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", F.col("v.embedding").alias("embedding"))
    scaled = F.transform("embedding", lambda c: F.floor(F.greatest(F.lit(-(2.0**40)), F.least(F.lit(2.0**40), c * SCALE))))
    return one.select("vec_id", "label", F.size("embedding").alias("dims"), scaled.alias("ints")).mapInArrow(coded_rows, CODED)


class Side:
    """A block's rows as arrays."""

    def __init__(self, table, at):
        import numpy as np

        part = table.take(at)
        self.n, self.dims = len(at), int(part.column("dims")[0].as_py())
        column = lambda c: part.column(c).to_numpy()
        binary = lambda c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), kind)
        self.ids, self.labels = column("vec_id"), column("label")
        self.ints = binary("ints", "<i4").reshape(self.n, self.dims).astype(np.int64)
        self.coded, self.residual = column("coded"), column("residual")
        self.aligned = binary("aligned", "<f8").reshape(self.n, LEVELS)
        self.codes = binary("codes", "<u8").reshape(self.n, LEVELS, -1)
        self.norms = np.sqrt((self.ints.astype(np.float64) ** 2).sum(axis=1))

    def scores(self, i, other: Side, j):
        """Integer products of own rows i with other's rows j."""
        import numpy as np

        return np.concatenate([np.empty(0, np.int64), *(np.einsum("ij,ij->i", self.ints[i[k : k + 65536]], other.ints[j[k : k + 65536]]) for k in range(0, len(i), 65536))])


def intervals(anchors: Side, rows: Side, at: slice):
    """Bounds of the products of the anchors at `at` with all rows: (lower, upper)."""
    import numpy as np

    q = rotated(anchors.ints[at].astype(np.float64))
    n = q.shape[1]
    low, top = q.min(axis=1), q.max(axis=1)
    step = np.where(top > low, (top - low) / (2**PLANES - 1), 1.0)
    cells = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
    error = np.linalg.norm(q - (low[:, None] + step[:, None] * cells), axis=1)
    planes = [words((cells >> p) & 1) for p in range(PLANES)]
    total = cells.sum(axis=1, dtype=np.int64)
    estimate = np.zeros((len(q), rows.n))
    for level in range(LEVELS):
        code = rows.codes[:, level]
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        met = np.zeros((len(q), rows.n), np.int32)
        for p, plane in enumerate(planes):
            for w in range(code.shape[1]):
                met += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.int32) << p
        product = low[:, None] * (2 * ones - n)[None] + step[:, None] * (2 * met - total[:, None])
        estimate += product * (rows.aligned[:, level] / np.sqrt(n))[None]
    norms = anchors.norms[at][:, None]
    width = norms * rows.residual[None] + error[:, None] * rows.coded[None] + 1e-9 * norms * rows.norms[None] + 1e-6
    return estimate - width, estimate + width


def best_of(i, j, score, ids, k: int):
    """Places of each i's k best by score, then by id."""
    import numpy as np

    order = np.lexsort((ids[j], -score, i))
    ranked = i[order]
    starts = np.searchsorted(ranked, ranked)
    return order[np.arange(len(order)) - starts < k]


def kth(values, k: int):
    """Each row's k-th largest value, minus infinity where there are fewer."""
    import numpy as np

    if values.shape[1] < k:
        return np.full((len(values), 1), -np.inf)
    return np.partition(values, -k, axis=1)[:, -k, None]


def first_guess(x: Side, k: int, y: Side, middle, fit, best: int, extra: int = 3):
    """Of each anchor the best-th largest score among the rows of the highest estimates; fit(i, score): which count. Minus infinity where there are fewer."""
    import numpy as np

    n = min(best + extra, middle.shape[1])
    j = np.argpartition(middle, -n, axis=1)[:, -n:].ravel()
    i = np.repeat(np.arange(len(middle)), n)
    score = x.scores(i + k, y, j)
    counts = np.isfinite(middle[i, j]) & fit(i, score)
    return kth(np.where(counts, score, -np.inf).reshape(len(middle), n), best)


def sides(anchors, rows) -> Iterator:
    """The two blocks, by length of the vectors."""
    import numpy as np

    a, r = anchors.column("dims").to_numpy(), rows.column("dims").to_numpy()
    for d in np.intersect1d(a, r):
        x, y = Side(anchors, np.flatnonzero(a == d)), Side(rows, np.flatnonzero(r == d))
        if x.norms.max() * y.norms.max() >= 2**63:
            raise OverflowError("products of these vectors may pass 63 bits")
        yield x, y, np.flatnonzero(a == d)


def positive_rows(anchors, rows):
    """Of a block: each anchor's best other rows of its label."""
    import numpy as np
    import pyarrow as pa

    found = [np.empty((3, 0), np.int64)]
    for whole, every, _ in sides(anchors, rows):
        for label in np.intersect1d(whole.labels, every.labels):
            x, y = _of(whole, whole.labels == label), _of(every, every.labels == label)
            for k in range(0, x.n, STRIP):
                at = slice(k, k + STRIP)
                lower, upper = intervals(x, y, at)
                own = x.ids[at][:, None] == y.ids[None]
                middle = np.where(own, -np.inf, (lower + upper) / 2)
                least = np.maximum(kth(np.where(own, -np.inf, lower), POSITIVES), first_guess(x, k, y, middle, lambda i, s: True, POSITIVES, 0))
                i, j = np.nonzero((upper >= least) & ~own)
                score = x.scores(i + k, y, j)
                best = best_of(i, j, score, y.ids, POSITIVES)
                found.append(np.stack([x.ids[i[best] + k], y.ids[j[best]], score[best]]))
    out = np.concatenate(found, axis=1)
    return pa.table({name: pa.array(out[k]) for k, name in enumerate(("anchor_id", "positive_id", "positive_score"))})


def _of(side: Side, which) -> Side:
    part = object.__new__(Side)
    part.__dict__ = {k: v if isinstance(v, int) else v[which] for k, v in side.__dict__.items()} | {"n": int(which.sum())}
    return part


def negative_rows(anchors, rows):
    """Of a block: for each anchor and positive the best rows of other labels whose scores lie within the positive's bounds."""
    import numpy as np
    import pyarrow as pa

    found = [np.empty((5, 0), np.int64)]
    for x, y, places in sides(anchors, rows):
        lists = anchors.column("positives").take(pa.array(places)).to_pylist()
        for k in range(0, x.n, STRIP):
            at = slice(k, k + STRIP)
            lower, upper = intervals(x, y, at)
            other = x.labels[at][:, None] != y.labels[None]
            strip = lists[at]
            wanted, middle = np.zeros_like(other), (lower + upper) / 2
            bounds = []
            for n in range(max(map(len, strip), default=0)):
                have = np.array([len(p) > n for p in strip])
                score = np.array([p[n]["score"] if len(p) > n else 0 for p in strip], np.int64)
                ids = np.array([p[n]["id"] if len(p) > n else 0 for p in strip], np.int64)
                least, most = -(-LOWEST * score // 100), HIGHEST * score // 100
                can = other & have[:, None] & (upper >= least[:, None]) & (lower <= most[:, None])
                sure = can & (lower >= least[:, None]) & (upper <= most[:, None])
                guess = np.where(can & (middle <= most[:, None]), middle, -np.inf)
                guess = first_guess(x, k, y, guess, lambda i, s, a=least, b=most: (s >= a[i]) & (s <= b[i]), NEGATIVES)
                wanted |= can & (upper >= np.maximum(kth(np.where(sure, lower, -np.inf), NEGATIVES), guess))
                bounds.append((have, ids, score, least, most))
            i, j = np.nonzero(wanted)
            scored = x.scores(i + k, y, j)
            for have, ids, score, least, most in bounds:
                fit = np.flatnonzero(have[i] & (scored >= least[i]) & (scored <= most[i]))
                fit = fit[best_of(i[fit], j[fit], scored[fit], y.ids, NEGATIVES)]
                found.append(np.stack([x.ids[i[fit] + k], ids[i[fit]], y.ids[j[fit]], score[i[fit]], scored[fit]]))
    out = np.concatenate(found, axis=1)
    return pa.table({name: pa.array(out[k]) for k, name in enumerate(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"))})


def blocks_met(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, of, schema: str) -> DataFrame:
    """of(anchors, rows) for every block of anchors and every block of rows."""
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // BLOCK)))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // BLOCK)) - 1)))
    x = anchors.select("*", part(n_anchors).alias("a"), every(n_rows).alias("r"))
    y = rows.select("*", part(n_rows).alias("r"), every(n_anchors).alias("a"))
    return x.groupBy("a", "r").cogroup(y.groupBy("a", "r")).applyInArrow(of, schema)


def best(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; anchor: which rows are anchors, by vec_id."""
    all_rows = stored(coded(rows, label), "codes")
    anchors = all_rows.where(anchor)
    n_rows, n_anchors = all_rows.count(), anchors.count()
    near = blocks_met(anchors, all_rows, n_anchors, n_rows, positive_rows, "anchor_id long, positive_id long, positive_score long")
    first = best(near, ["anchor_id"], "positive_score", "positive_id", POSITIVES)
    lists = first.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    with_lists = stored(anchors.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "anchors")
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    far = blocks_met(with_lists, all_rows, n_anchors, n_rows, negative_rows, schema)
    return best(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)
