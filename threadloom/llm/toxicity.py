"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Both dictionaries are trained by zstandard on labelled windows: the ordinary one on ordinary text, the toxic
one on what is characteristic of toxic text (words far more frequent there by document counts, as a likelihood-ratio
test tells; one document of each near-copy group, so a group of copies is no evidence).
A text's words are cut into windows; each window is compressed with the ordinary dictionary and with the
toxic one laid before it, and the bytes that the toxic one saves are the window's evidence. Window thresholds
are calibrated as quantiles over ordinary documents that took no part in training the dictionaries, and a
logistic curve over the document's window evidence (its mean, maximum, sums and shares above the thresholds)
gives the score.

Cases: null, empty or wordless text has no evidence and gets the score of that. Without both labels every
score is the share of label 1 (0.5 without labels). Every window of a whole text counts. Repeated rows are
scored each; null doc_id is never labelled and not held out. The fit reads at most FIT_DOCS labelled rows of FIT_BYTES
bytes in all, and of rows that repeat a doc_id the one with the smallest text; an id labelled both ways counts as toxic.
Extra columns are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import common

THRESHOLD = 0.7
#: Labelled rows that the fit reads: of each label at most half, chosen by a hash of doc_id.
FIT_DOCS = 9_000
#: Bytes of text that the fit brings together, in the order of that hash: a text that would pass the bound is not learned from.
FIT_BYTES = 256 << 20
#: Windows, chosen at random, of the ordinary texts of the sample that the ordinary dictionary is trained on.
ORDINARY_WINDOWS = 40_000
WINDOW = 24
LEVEL = 6
TOXIC_BYTES, ORDINARY_BYTES = 4 << 10, 8 << 10
#: Cuts of a word's test statistic that are tried (the one with the smallest loss on PICK_DOCS held-back rows stays), and the least ratio of frequencies.
STRENGTHS, LEAST_RATIO, PICK_DOCS = (4.2, 6.0, 8.5, 12.0), 4.0, 1_500
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def windows(words: list[str], size: int = WINDOW) -> list[bytes]:
    return [f" {' '.join(words[i : i + size])} ".encode() for i in range(0, len(words), size)]


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary (without its header); of too few samples, the samples themselves."""
    try:
        made = zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        return made[min(len(made) // 8, 200) :]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Distance:
    """The two dictionaries' contents, the calibrated thresholds and the logistic curve; picklable."""

    toxic: bytes
    ordinary: bytes
    thresholds: tuple[float, ...] = ()
    curve: tuple[float, ...] = ()
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    constant: float | None = None

    def compressors(self) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
        out = []
        for content in (self.toxic + self.ordinary, self.ordinary):
            d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return out[0], out[1]

    def evidence(self, text: str, with_toxic, with_ordinary) -> np.ndarray:
        """Bytes saved by the toxic dictionary, window by window."""
        return np.array([len(with_ordinary(w)) - len(with_toxic(w)) for w in windows(words_of(text))] or [0], float)

    def summary(self, saved: np.ndarray) -> list[float]:
        top = np.sort(saved)[::-1]
        over = [f(np.maximum(saved - t, 0)) for t in self.thresholds for f in (np.sum, np.mean)]
        return [saved.mean(), top[0], top[:3].sum(), float(np.log1p(len(saved))), *(np.log1p(x) for x in over)]

    def calibrate(self, rows: list[tuple[str, int]]) -> float:
        """Set thresholds and curve by (text, label) rows; return the mean log loss."""
        pair = self.compressors()
        saved = [self.evidence(t, *pair) for t, _ in rows]
        quiet = np.concatenate([s for s, (_, v) in zip(saved, rows, strict=True) if not v] or [np.zeros(1)])
        self.thresholds = tuple(float(np.quantile(quiet, q)) for q in (0.9, 0.99, 0.999))
        raw, y = [self.summary(s) for s in saved], np.array([v for _, v in rows], float)
        x = np.array(raw)
        self.centre, self.scale = tuple(x.mean(axis=0).tolist()), tuple(np.maximum(x.std(axis=0), 1e-6).tolist())
        self.curve = tuple(_logistic((x - self.centre) / self.scale, y).tolist())
        p = np.clip(self.score(raw), 1e-9, 1 - 1e-9)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        x = (np.array(rows, float).reshape(len(rows), len(self.centre)) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -40, 40)))


def _distinct(texts: list[str], keys: int = 6) -> list[list[str]]:
    """Word lists, one of each group that shares one of its smallest shingles (near copies nearly always do)."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = words_of(t)
        least = sorted({zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(len(w) - 4, 1))})[:keys]
        if w and seen.isdisjoint(least):
            out.append(w)
        seen.update(least)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    penalty = ridge * np.eye(len(beta))
    penalty[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (p - y) + penalty @ beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_distance(texts: list[str], labels: list[int]) -> Distance:
    """Dictionaries from one half of the rows, thresholds and curve from the other."""
    if len(set(labels)) < 2:
        return Distance(b"", b"", constant=float(np.mean(labels)) if labels else 0.5)
    order = list(range(len(texts)))
    random.Random(7).shuffle(order)
    groups = {v: [texts[i] for i in order if labels[i] == v] for v in (0, 1)}
    half = {v: max(len(g) // 2, 1) for v, g in groups.items()}
    toxic, ordinary = _distinct(groups[1][: half[1]]), _distinct(groups[0][: half[0]])
    in_toxic, in_ordinary = Counter(w for d in toxic for w in set(d)), Counter(w for d in ordinary for w in set(d))

    def characteristic(w: str) -> float:
        """Signed root of the likelihood ratio that the word is over-represented; 0 if its odds are not far higher."""
        a, b, share = in_toxic[w], in_ordinary[w], len(toxic) / (len(toxic) + len(ordinary))
        if a < 2 or (a + 0.5) / (len(toxic) + 1) < LEAST_RATIO * (b + 0.5) / (len(ordinary) + 1):
            return 0.0
        ratio = a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0)
        return float(np.sqrt(max(2 * ratio, 0.0)))

    strength = {w: characteristic(w) for w in in_toxic}
    plain = [x for ws in ordinary for x in windows(ws, 16)]
    random.Random(7).shuffle(plain)
    base = _trained(plain[:ORDINARY_WINDOWS], ORDINARY_BYTES)[-ORDINARY_BYTES:]
    rest = [(t, v) for v in (0, 1) for t in groups[v][half[v] :] or groups[v]]
    some = rest[:: max(len(rest) // PICK_DOCS, 1)]
    best: tuple[float, Distance] | None = None
    for least in STRENGTHS:
        runs = [[w for w in ws[i : i + 16] if strength[w] > least] for ws in toxic for i in range(0, len(ws), 16)]
        made = Distance(_trained([f" {' '.join(r)} ".encode() for r in runs if r], TOXIC_BYTES), base)
        loss = made.calibrate(some)
        if best is None or loss < best[0]:
            best = loss, made
    best[1].calibrate(rest)
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS, most_bytes: int = FIT_BYTES) -> Distance:
    """Fit on a bounded sample; rows whose crc32(doc_id) mod 3 is 1 are never read."""
    left = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    marks = labels.where(left & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    ids: dict[int, int] = {}
    for v in (0, 1):  # a bounded top-k each: the sample's size is the feature
        ids |= {r["doc_id"]: v for r in marks.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2).collect()}
    if not ids:
        return fit_distance([], [])
    some = docs.where(F.col("doc_id").isin(list(ids))).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    some = common.written(some, "toxicity-sample")  # one pass over the texts; at most `limit` rows
    room, within = most_bytes, []
    for r in some.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= room:
            room -= r["n"]
            within.append(r["doc_id"])
    found = some.where(F.col("doc_id").isin(within)).collect()
    common.drop_written(some, shuffles=False)
    found.sort(key=lambda r: r["doc_id"])
    return fit_distance([r["text"] for r in found], [ids[r["doc_id"]] for r in found])


def score(docs: DataFrame, model: Distance) -> DataFrame:
    """(doc_id, score) of every whole text; a narrow pass."""
    own: list = []

    def run(batch: pa.RecordBatch):
        if not own:
            own.append(model.compressors())
        for part in common.rows_of(batch):
            rows = [] if model.constant is not None else [model.summary(model.evidence(t, *own[0])) for t in common.texts(part)]
            got = model.score(rows) if model.constant is None else np.full(part.num_rows, model.constant)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, score, predicted."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
