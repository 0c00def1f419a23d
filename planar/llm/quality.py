"""Quality classifier: a regularised quadratic discriminant.

One pass turns each whole text into transformed statistics. The class means and centred covariances are Spark aggregates
over the labelled training rows, two rows on the driver, rounded so that the order of the tasks doesn't show. Each class covariance is
shrunk towards the pooled one and then towards its diagonal; the Cholesky factors are computed once and sent with the tasks. A score is
the logistic of the difference of the classes' Gaussian log densities over TEMPERATURE, plus the log prior odds. The temperature
tempers densities that are too sure, since the statistics are no Gaussians; it doesn't change which density is the greater.

Defined results: null and empty texts have the statistics of zero words and are scored like any other; repeated rows are
scored one by one; several labels of a document count as their mean, of at least a half for label 1; null labels don't
count; if a class has fewer than two rows, every score is the share of label 1 (a half without labels). An empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.llm.common import CONTINUATION, WHITE, held_out, stored, text_bytes

STATISTICS = ("words", "word_bytes", "word_spread", "symbols", "same_as_last", "distinct", "short", "same_lines", "points", "capitals", "digits", "line_words")
SHRINK, DIAGONAL, TEMPERATURE = 0.1, 0.02, 4.0
THRESHOLD = 0.7
_POINTS, _CAPITALS, _DIGITS, _SYMBOLS = b".,;:!?", bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>@^~_+=\\/{}[]`"


def statistics(texts: list[bytes]):
    """A row of transformed statistics for each text."""
    import numpy as np

    raw = np.zeros((len(texts), len(STATISTICS)))
    for k, t in enumerate(texts):
        w = t.split()
        n = len(w)
        size = np.fromiter(map(len, w), np.float64, n)
        lines = [x for x in t.split(b"\n") if x.strip()]
        left = lambda drop: len(t) - len(t.translate(None, drop))  # noqa: B023, E731
        letters = len(t.translate(None, WHITE + CONTINUATION))
        same = sum(map(bytes.__eq__, w[1:], w))
        per = lambda x, of, prior=0.5: np.log((x + prior) / (of + 2 * prior))
        raw[k] = (
            np.log1p(n), np.log1p(size.mean()) if n else 0, np.log1p(size.std()) if n else 0, per(left(_SYMBOLS), n, 2), per(same, n, 2), np.log((len(set(w)) + 1) / (n + 1)),
            per(np.count_nonzero(size <= 3), n, 2), per(len(lines) - len(set(lines)), len(lines), 2), per(left(_POINTS), n, 2), per(left(_CAPITALS), n, 2), per(left(_DIGITS), letters, 4), np.log((n + 1) / (len(lines) + 1)),
        )
    return raw


def statistics_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        x = statistics(text_bytes(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(range(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], names=["doc_id", "x"])


def with_statistics(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(statistics_batches, f"doc_id {dict(rows.dtypes)['doc_id']}, x array<double>")


def fit(rows: DataFrame):
    """The model from rows (x, label 0 or 1): counts, means, inverse Cholesky factors and log determinants of both classes."""
    import numpy as np

    d = len(STATISTICS)
    x = F.col("x")
    sums = [F.round(F.avg(x[i]), 11).alias(f"s{i}") for i in range(d)]
    products = [F.round(F.covar_pop(x[i], x[j]), 11).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}  # two rows
    n = np.array([found[c]["n"] if c in found else 0 for c in (0, 1)], float)
    if n.min() < 2:
        return {"share": (n[1] / n.sum()) if n.sum() else 0.5}
    mean, cov = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        mean[c] = [found[c][f"s{i}"] for i in range(d)]
        for i in range(d):
            for j in range(i + 1):
                cov[c, i, j] = cov[c, j, i] = found[c][f"p{i}_{j}"]
    pooled = (n[:, None, None] * cov).sum(0) / n.sum()
    factors, logdet = [], []
    for c in (0, 1):
        s = (1 - SHRINK) * cov[c] + SHRINK * pooled
        s = (1 - DIAGONAL) * s + DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        logdet.append(2 * np.log(np.diag(low)).sum())
    return {"share": n[1] / n.sum(), "mean": mean, "factor": np.array(factors), "logdet": np.array(logdet), "odds": float(np.log(n[1] / n[0]))}


def logistic(x, model: dict):
    """Scores of rows of statistics."""
    import numpy as np

    if "mean" not in model:
        return np.full(len(x), float(model["share"]))
    density = [-0.5 * (np.square((x - model["mean"][c]) @ model["factor"][c].T).sum(1) + model["logdet"][c]) for c in (0, 1)]
    return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE + model["odds"], -40, 40)))


def apply(statistics_rows: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of each row of with_statistics()."""

    def score(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(logistic(x, model))], names=["doc_id", "score"])

    return statistics_rows.mapInArrow(score, f"doc_id {dict(statistics_rows.dtypes)['doc_id']}, score double")


def train_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label (0 or 1) of the training rows."""
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4))
    return rows.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))


def trained(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of the training labels, from the statistics of the labelled documents only."""
    wanted = train_labels(labels, "quality")
    x = with_statistics(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"))
    return fit(x.join(wanted, "doc_id").select("x", "label"))


def kept(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns, whose predicted label is 1; one pass without a shuffle."""

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array(logistic(statistics(text_bytes(text)), model) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    x = stored(with_statistics(docs), "quality")
    model = fit(x.join(train_labels(labels, "quality"), "doc_id").select("x", "label"))
    out = apply(x, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
