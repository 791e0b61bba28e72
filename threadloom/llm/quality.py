"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a short vector of statistics (lengths, shares as logits, repetition, entropy).
Per class a mean and a covariance are fitted; the covariance is shrunk towards the pooled one and
towards a scaled identity, and only its Cholesky factor is kept. A document's raw score is the
difference of two log densities, each one triangular solve (the Mahalanobis term) plus a cached
log-determinant. A two-parameter logistic curve on the damped difference gives the probability.

Cases: null or empty text has the statistics of an empty text and gets a score as any other. Without
both classes among the labels, every score is the share of label 1 (0.5 without labels). Null doc_id:
never labelled, held_out false. Repeated rows are scored each. Extra columns are ignored by `score`
and passed through by `keep_good`. Very long texts are read whole, one at a time.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import common

#: At most about so many labelled rows are fitted on the driver (chosen by a hash of doc_id).
FIT_ROWS = 50_000
THRESHOLD = 0.7
N_STATS = 18


def _classes() -> np.ndarray:
    """Code point -> 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence mark, 6 other mark."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        out[i] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:!?'\"-()" else 0 if c.isalpha() else 6
    out[0x10000:] = 6
    return out


_TABLE: list[np.ndarray] = []


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one whole text."""
    if not _TABLE:
        _TABLE.append(_classes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_TABLE[0][points], minlength=7)
    letters, chars = kinds[0] + kinds[1] + kinds[2], len(points)
    solid = chars - kinds[4]
    share = np.bincount(np.minimum(points, 1023)) / max(chars, 1)
    share = share[share > 0]
    words = common.words_of(text)
    n, counted = len(words), Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = Counter(w[-1] for w in words)
    starts = sum(v for c, v in Counter(w[0] for w in words).items() if c.isupper())
    lines = [x for x in text.split("\n") if x.strip()]
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))

    def logit(k: float, of: float) -> float:
        return float(np.log((k + 0.5) / (max(of - k, 0) + 0.5)))

    return np.array([
        np.log1p(n), np.log1p(chars), np.log1p(lengths.mean() if n else 0), np.log1p(lengths.std() if n else 0), np.log1p(lengths.max() if n else 0),
        logit(kinds[2], letters), logit(kinds[3], solid), logit(kinds[5], solid), logit(kinds[6], solid), logit(letters, solid),
        np.log1p(len(counted)) / np.log1p(n) if n else 1.0, logit(max(counted.values(), default=0), n), logit(runs, max(n - 1, 0)), logit(starts, n),
        logit(sum(v for c, v in ends.items() if not c.isalnum()), n), float(-(share * np.log(share)).sum()),
        np.log1p(n / max(len(lines), 1)), logit(len(lines) - len(set(lines)), len(lines)),
    ])


@dataclass(frozen=True)
class Discriminant:
    """means, Cholesky factors and log-determinants by class; scale of the statistics; the logistic curve."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    logdets: tuple[float, ...]
    curve: tuple[float, float]
    constant: float | None = None

    def difference(self, stats: np.ndarray) -> np.ndarray:
        """log density under label 1 minus under label 0."""
        z = np.clip((stats - self.centre) / self.scale, -12, 12)
        logs = [-0.5 * (np.linalg.solve(f, (z - m).T) ** 2).sum(axis=0) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return logs[1] - logs[0]

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return _sigmoid(self.curve[0] + self.curve[1] * _damped(self.difference(stats)))


def _damped(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.log1p(np.abs(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by ridge-regularised Newton steps."""
    design, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(50):
        p = _sigmoid(design @ beta)
        grad = design.T @ (p - y) + 1e-2 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit_discriminant(stats: np.ndarray, labels: np.ndarray, ridge: float = 0.02) -> Discriminant:
    """Shrinkage: a class of n rows keeps n / (n + 4 p) of its own covariance, the rest is pooled; then `ridge` of an identity."""
    ok = np.isfinite(stats).all(axis=1) if len(stats) else np.zeros(0, bool)
    stats, labels = stats[ok], labels[ok]
    p = stats.shape[1] if stats.ndim == 2 else N_STATS
    if len(set(labels.tolist())) < 2:
        return Discriminant(np.zeros(p), np.ones(p), (), (), (), (0.0, 0.0), float(labels.mean()) if len(labels) else 0.5)
    centre, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    z = np.clip((stats - centre) / scale, -12, 12)
    means = tuple(z[labels == c].mean(axis=0) for c in (0, 1))
    covs = [np.cov(z[labels == c].T, bias=True) if (labels == c).sum() > 1 else np.eye(p) for c in (0, 1)]
    sizes = [int((labels == c).sum()) for c in (0, 1)]
    pooled = sum(n * v for n, v in zip(sizes, covs, strict=True)) / sum(sizes)
    factors, logdets = [], []
    for n, v in zip(sizes, covs, strict=True):
        keep = n / (n + 4 * p)
        shrunk = keep * v + (1 - keep) * pooled
        shrunk = (1 - ridge) * shrunk + ridge * (np.trace(shrunk) / p) * np.eye(p)
        f = np.linalg.cholesky(shrunk)
        factors.append(f)
        logdets.append(2 * float(np.log(np.diag(f)).sum()))
    raw = Discriminant(centre, scale, means, tuple(factors), tuple(logdets), (0.0, 1.0))
    return Discriminant(centre, scale, means, tuple(factors), tuple(logdets), logistic_curve(_damped(raw.difference(stats)), labels.astype(float)))


def remainder(mod: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for every row; one narrow pass over the texts."""

    def run(batch: pa.RecordBatch):
        for part in common.rows_of(batch):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t).tolist() for t in common.texts(part)], pa.list_(pa.float64()))], ["doc_id", "stats"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, stats array<double>")


def marked(labels: DataFrame, column: str, mod: int, held: int, limit: int) -> DataFrame:
    """(doc_id, label) of about `limit` labelled ids at most, never of held-out ones."""
    marks = labels.where(remainder(mod) != held).where(F.col(column).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).distinct()
    n = marks.count()
    return marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * limit / n)) if n > limit else marks


def labelled_rows(keyed: DataFrame, labels: DataFrame, column: str, mod: int, held: int, limit: int) -> list:
    """Collect (value, label) of about `limit` labelled rows at most, never of held-out ones."""
    return keyed.join(marked(labels, column, mod, held, limit), "doc_id").drop("doc_id").collect()


def fit(stats: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Discriminant:
    rows = labelled_rows(stats, labels, "quality", 4, 2, limit)
    return fit_discriminant(np.array([r["stats"] for r in rows], float).reshape(len(rows), N_STATS), np.array([r["label"] for r in rows], int))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) from statistics."""

    def run(batch: pa.RecordBatch):
        x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, N_STATS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return common.map_batches(stats, run, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, score, predicted for every document."""
    stats = common.written(document_statistics(common.table(spark, sf_dir, "documents")), "quality-stats")
    model = fit(stats, common.table(spark, sf_dir, "labels"))
    return score(stats, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, all columns as they are.

    The fit makes statistics of the labelled rows alone: their ids, FIT_ROWS or so at most, are broadcast under that bound.
    Scoring is one narrow pass that carries the other columns along, so texts are never shuffled.
    """
    chosen = marked(labels, "quality", 4, 2, FIT_ROWS).select("doc_id").distinct()
    model = fit(document_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id", "left_semi")), labels)

    def run(batch: pa.RecordBatch):
        at = batch.schema.get_field_index("text")
        for part in common.rows_of(batch):
            x = np.array([statistics(t or "") for t in part.column(at).to_pylist()]).reshape(part.num_rows, N_STATS)
            yield part.filter(pa.array(model.score(x) >= threshold))

    return common.map_batches(docs, run, docs.schema)
