"""Quality classifier: regularised quadratic discriminant over document statistics.

Class moments are summed over all labelled rows by Spark, so the fit has no sample and no
bound that the corpus could outgrow: what reaches the driver is one vector and one matrix
of fixed size for each class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import KEY, checkpointed, free_prefix, row_key, slices

#: Statistics of a text, each made roughly symmetric by a logarithm or a square root.
STATISTICS = ("words", "word_length", "distinct", "doubled", "windows", "symbols", "digits", "capitals", "letters", "lines", "line_words", "repeated_lines", "stops", "commas")

#: Log odds are cut here and counted in bins of this width when they are calibrated.
REACH, BIN = 60.0, 0.5


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; null is an empty text."""
    import math

    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n = len(words)
    size = len(data)
    left = lambda drop: size - len(data.translate(None, drop))
    lines = [x for x in text.split("\n") if x.strip()]
    spaces = left(b" \t\n\r\x0b\x0c")
    solid = max(size - spaces, 1)
    letters = left(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
    root = lambda a, b: math.sqrt(a / b) if b else 0.0
    return [
        math.log1p(n),
        math.log1p(solid / n) if n else 0.0,
        math.log(len(set(words)) + 1) / math.log(n + 1) if n else 1.0,
        root(sum(map(str.__eq__, words, words[1:])), n),
        root(n - 2 - len(set(zip(words, words[1:], words[2:]))), n) if n > 2 else 0.0,
        root(left(b"#*$%&|<>"), solid),
        root(left(b"0123456789"), solid),
        root(left(bytes(range(65, 91))), solid),
        letters / solid,
        math.log1p(len(lines)),
        math.log1p(n / max(len(lines), 1)),
        root(len(lines) - len(set(lines)), len(lines)),
        root(left(b".!?"), n),
        root(left(b",;:"), n),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means and scale of the statistics, and of each class its mean, inverse Cholesky factor and log weight."""

    center: list[float]
    scale: list[float]
    means: list[list[float]]
    factors: list[list[list[float]]]
    weights: list[float]
    calibration: tuple[float, float] = (0.0, 1.0)

    def log_odds(self, x) -> object:
        """Difference of the classes' log densities for each row of the statistics x, at most REACH either way."""
        import numpy as np

        z = (np.asarray(x, dtype=float) - self.center) / self.scale
        logs = [w - 0.5 * np.square((z - m) @ np.asarray(f).T).sum(axis=1) for m, f, w in zip(self.means, self.factors, self.weights)]
        return np.clip(logs[1] - logs[0], -REACH, REACH)

    def scores(self, x) -> object:
        """Calibrated probability of class 1 for each row of the statistics x."""
        import numpy as np

        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a + b * self.log_odds(x), -30, 30)))


def discriminant(moments: dict[int, tuple[float, object, object]], shrinkage: float = 0.1) -> Discriminant:
    """From n, sum and sum of outer products of each class.

    Class covariances are drawn towards the pooled one's diagonal by `shrinkage`, and half
    as much towards the identity in scaled statistics, so that statistics that are
    constant in a class don't decide alone. A class without rows takes the pooled moments;
    without any rows every score is one half.
    """
    import numpy as np

    k = len(STATISTICS)
    n = [moments.get(c, (0, 0, 0))[0] for c in (0, 1)]
    zero = (0.0, np.zeros(k), np.zeros((k, k)))
    total = [sum(x) for x in zip(*(moments.get(c, zero) for c in (0, 1)))]
    count = max(total[0], 1)
    center = np.asarray(total[1]) / count
    pooled = np.asarray(total[2]) / count - np.outer(center, center)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    means, factors, weights = [], [], []
    for c in (0, 1):
        m, s1, s2 = moments.get(c, zero) if n[c] else total
        m = max(m, 1)
        mean = np.asarray(s1) / m
        cov = (np.asarray(s2) / m - np.outer(mean, mean)) / np.outer(scale, scale)
        few = min(0.9, shrinkage + k / (m + k))
        cov = (1 - few) * cov + few * 0.5 * (np.diag(np.diag(pooled) / scale**2) + np.eye(k))
        low = np.linalg.cholesky(cov)
        means.append(((mean - center) / scale).tolist())
        factors.append(np.linalg.inv(low).tolist())
        weights.append(float(np.log((n[c] + 1) / (sum(n) + 2)) - np.log(np.diag(low)).sum()))
    return Discriminant(center.tolist(), scale.tolist(), means, factors, weights)


def _measured(rows: DataFrame) -> DataFrame:
    """rows with `text` replaced by x (array of double), the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in slices(batches, "text"):
            x = [statistics(t) for t in b.column("text").to_pylist()]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, ", ".join([*kept, "x array<double>"]))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (array of double), a row per row of docs."""
    return _measured(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))


def fit(stats: DataFrame, labels: DataFrame, shrinkage: float = 0.1, label_col: str = "quality") -> Discriminant:
    """Moments of all rows of stats that have a label 0 or 1, summed in the tasks and then over the tasks."""
    k = len(STATISTICS)
    rows = stats.join(labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("label in (0, 1)"), "doc_id")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        acc = {c: [0.0, np.zeros(k), np.zeros((k, k))] for c in (0, 1)}
        for b in batches:
            if b.num_rows:
                x, y = np.stack([np.asarray(v) for v in b.column("x").to_pylist()]), np.asarray(b.column("label"))
                for c in (0, 1):
                    part = x[y == c]
                    acc[c][0] += len(part)
                    acc[c][1] += part.sum(axis=0)
                    acc[c][2] += part.T @ part
        for c, (n, s1, s2) in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([[n, *s1, *s2.ravel()]], pa.list_(pa.float64()))], names=["label", "m"])

    parts = rows.select("x", "label").mapInArrow(sums, "label int, m array<double>")
    added = parts.select("label", F.posexplode("m")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()
    flat = {c: {r.pos: r.v for r in added if r.label == c} for c in (0, 1)}
    import numpy as np

    moments = {}
    for c, m in flat.items():
        if m and m[0] > 0:
            v = np.array([m[i] for i in range(1 + k + k * k)])
            moments[c] = (v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k))
    raw = discriminant(moments, shrinkage)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(np.rint(raw.log_odds(x) / BIN).astype("int32"))], names=["label", "bin"])

    bins = rows.select("x", "label").mapInArrow(binned, "label int, bin int").groupBy("label", "bin").count().collect()
    return replace(raw, calibration=platt([(r.label, r.bin * BIN, r["count"]) for r in bins]))


def platt(bins: list[tuple[int, float, int]], ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope of the logistic curve through (class, log odds, rows), by Newton steps with halving."""
    import numpy as np

    if len({y for y, _, _ in bins}) < 2:
        return (0.0, 1.0)
    y, x, n = (np.array(v, dtype=float) for v in zip(*sorted(bins)))
    z = np.column_stack([np.ones(len(x)), x])
    start = np.array([0.0, 1.0])
    loss = lambda b: float((n * np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ b))).sum() + 0.5 * ridge * ((b - start) ** 2).sum())
    beta = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (n * (p - y)) + ridge * (beta - start))
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(beta[0]), float(max(beta[1], 1e-3)))


def score(stats: DataFrame, model: Discriminant, least: float = 0.3) -> DataFrame:
    """stats with x replaced by score and predicted (1 if score >= least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
            s = model.scores(x)
            names = [n for n in b.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(s), pa.array((s >= least).astype("int32"))], names=[*names, "score", "predicted"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields if f.name != "x"]
    return stats.mapInArrow(run, ", ".join([*kept, "score double", "predicted int"]))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3, shrinkage: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row of docs; learns from the rows of `labels` (doc_id, quality) alone.

    Null and empty texts are scored by their statistics like any other text. Rows with a
    null id or label teach nothing; repeated rows teach and are scored repeatedly. Other
    columns play no part. Without labels every score is one half; an empty table gives an
    empty result.
    """
    stats = checkpointed(text_statistics(docs, id_col, text_col))
    return score(stats, fit(stats, labels, shrinkage), least)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, shrinkage: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least `least`, all columns as they are. Cases are as in classify().

    Texts are measured once; the statistics are written without them, and rows are kept by id and text.
    """
    p = free_prefix(docs)
    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = checkpointed(_measured(rows))
    good = score(stats, fit(stats.select("doc_id", "x"), labels, shrinkage), least).where("predicted = 1").select(*[F.col(k).alias(f"{p}h{i}") for i, k in enumerate(KEY)])
    keys = [c.alias(f"{p}r{i}") for i, c in enumerate(row_key(id_col, text_col))]
    kept = docs.select("*", *keys).join(good, F.expr(" and ".join(f"{p}r{i} = {p}h{i}" for i in range(4))), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
