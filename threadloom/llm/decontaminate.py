"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage.

Items are indexed as an inverted index whose posting lists carry block maxima. Every text is cut into half
windows of 32 words and each pair of neighbours is a passage; its distinct words are a BM25 query. A score
is taken relative to the best that a passage of that length could reach for the item, so one threshold holds
for all items. Retrieval keeps every item above the threshold, by block-max WAND: sort the lists by current
item, find the pivot where list maxima reach the threshold, test block maxima, score or skip. Before that
loop WAND's own bound (the sum of maxima over the query's words) is evaluated for a whole batch at once,
first over the index, then per range of items and over the query's distinct words; no passage that could hold an item is passed over.
Every passage retrieved is verified: the words of the item's question and of its answer that lie in word n-grams
shared with the text around the passage must cover enough of both.

The index holds the benchmark alone. It is made in shards of at most SHARD items, each small enough to
broadcast; a larger benchmark is a pass over the texts per shard. Document frequencies and mean length are
those of the whole benchmark.

Cases: null or empty text has no passages. Null or wordless items are not indexed. Items of one sentence
have the last third of their words as answer. Equal items are all reported. No benchmark: no hits. Repeated
documents are reported each. A text of any length is queried whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import common

HALF = 32
#: Share of the best reachable BM25 score that retrieves an item; parts of question and answer to be covered.
THRESHOLD, QUESTION, ANSWER = 0.55, 0.8, 0.6
K1, B = 1.2, 0.75
SHARD = 4_096
BLOCK = 16
NGRAM = 5
#: Non-ASCII marks and spaces that part words, as ASCII ones other than letters and digits do.
_MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f]+")
_PLAIN = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def words_of(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    return text.encode().translate(_PLAIN).decode().split()


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer (the last sentence that has words)."""
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = max(len(words) - max(len(words) // 3, 1), 0)
    return words[:cut], words[cut:]


def covered(part: list[str], region: set[tuple[str, ...]], n: int) -> float:
    """Share of the part's words that lie in one of its n-grams that the region has."""
    if not part:
        return 1.0
    hit = [False] * len(part)
    for i in range(len(part) - n + 1):
        if tuple(part[i : i + n]) in region:
            hit[i : i + n] = [True] * n
    return sum(hit) / len(part)


@dataclass
class Index:
    """One shard: posting lists by term (item numbers ascending, relative contributions), with block maxima."""

    items: list[tuple[int, list[str], list[str]]]
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float]]] = field(default_factory=list)
    #: Per term: each block's last item and largest contribution; and the list's largest.
    blocks: list[tuple[list[int], list[float]]] = field(default_factory=list)
    top: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    #: Largest contribution of each term in each of at most 64 ranges of items; last row: no term.
    ranges: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))

    def retrieve(self, query: set[int], threshold: float) -> list[tuple[int, float]]:
        """All (item number, score) with at least the threshold, by block-max WAND."""
        found, end = [], len(self.items)
        lists = [[self.postings[t][0][0], 0, t] for t in query]  # current item, place in the list, term
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += float(self.top[t])
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            bound, jump = 0.0, end
            for _, _, t in lists[: pivot + 1]:
                lasts, tops = self.blocks[t]
                b = bisect_left(lasts, item)
                if b < len(lasts):
                    bound += tops[b]
                    jump = min(jump, lasts[b] + 1)
            if bound < threshold:  # nothing before the nearest block's end can reach it
                if pivot + 1 < len(lists):
                    jump = min(jump, lists[pivot + 1][0])
                lists = self._advance(lists, pivot, max(jump, item + 1))
            elif lists[0][0] == item:
                score = sum(self.postings[t][1][i] for _, i, t in lists[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                lists = self._advance(lists, pivot, item + 1)
            else:
                lists = self._advance(lists, pivot, item)
        return found

    def _advance(self, lists: list, pivot: int, to: int) -> list:
        out = lists[pivot + 1 :]
        for _, i, t in lists[: pivot + 1]:
            entries = self.postings[t][0]
            i = bisect_left(entries, to, i)
            if i < len(entries):
                out.append([entries[i], i, t])
        return out


def build_index(items: list[tuple[int, str]], frequency: dict[str, int], n_items: int, mean_length: float) -> Index:
    """Index of one shard; frequency: of each term over the whole benchmark."""
    index = Index([(i, *parts_of(t)) for i, t in items])
    entries: dict[str, list[tuple[int, float]]] = defaultdict(list)
    for k, (_, question, answer) in enumerate(index.items):
        counts = Counter(question + answer)
        length = sum(counts.values())
        gain = {}
        for w, tf in counts.items():
            idf = np.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5))
            gain[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
        # A passage of 2 * HALF words that starts anywhere holds at least about three halves of HALF words of the item.
        best = sum(gain.values()) * min(1.0, 1.5 * HALF / length)
        for w, g in gain.items():
            entries[w].append((k, float(g / best)))
    index.terms = {w: t for t, w in enumerate(entries)}
    width = -(-max(len(items), 1) // 64)
    index.ranges = np.zeros((len(entries) + 1, -(-max(len(items), 1) // width)), np.float32)
    index.top = np.zeros(len(entries) + 1, np.float32)
    for t, rows in enumerate(entries.values()):
        ks, gains = [k for k, _ in rows], [g for _, g in rows]
        index.postings.append((ks, gains))
        cuts = range(0, len(rows), BLOCK)
        index.blocks.append(([ks[min(c + BLOCK, len(rows)) - 1] for c in cuts], [max(gains[c : c + BLOCK]) for c in cuts]))
        index.top[t] = max(gains) * (1 + 1e-6)
        np.maximum.at(index.ranges[t], np.array(ks) // width, np.array(gains, np.float32) * np.float32(1 + 1e-6))
    return index


def _open(index: Index, ids: np.ndarray, threshold: float):
    """Passages (numbers of their first half) whose bound reaches the threshold: over the index, then over a range of items."""
    step = 128 * HALF
    for low in range(0, len(ids), step):
        some = ids[low : low + step + HALF]  # one half beyond, for the passage that ends there
        starts = np.arange(0, len(some), HALF)
        whole = np.add.reduceat(index.top[some], starts)
        bound = whole.copy()
        bound[:-1] += whole[1:]
        if bound.max() < threshold:
            continue
        halves = np.add.reduceat(index.ranges[some], starts, axis=0)
        halves[:-1] += halves[1:]
        for p in np.flatnonzero(halves.max(axis=1) >= threshold).tolist():
            if p < 128:
                yield low // HALF + p


def search(index: Index, text: str, threshold: float = THRESHOLD) -> list[tuple[int, float, float, float, int]]:
    """Verified hits in one text: item id, score, question and answer overlap, first word of the best passage that is verified."""
    words = words_of(text)
    if not words or not index.terms:
        return []
    none = len(index.terms)
    ids = np.fromiter(map(index.terms.get, words, repeat(none)), np.int32, len(words))
    found: dict[int, list[tuple[float, int]]] = defaultdict(list)
    for p in _open(index, ids, threshold):
        at = np.unique(ids[p * HALF : (p + 2) * HALF])
        if index.ranges[at].sum(axis=0).max() < threshold:
            continue
        for item, score in index.retrieve({t for t in at.tolist() if t != none}, threshold):
            found[item].append((-score, p * HALF))
    out = []
    for item, passages in sorted(found.items()):
        number, question, answer = index.items[item]
        reach = len(question) + len(answer) + HALF
        # The best passage may only look like the item: the others are asked too, by score, until one holds it.
        for score, first in sorted(passages):
            region = words[max(first - reach, 0) : first + 2 * HALF + reach]
            grams = {n: {tuple(region[i : i + n]) for i in range(len(region) - n + 1)} for n in {min(NGRAM, max(len(question), 1)), min(3, max(len(answer), 1))}}
            q = covered(question, grams[min(NGRAM, max(len(question), 1))], min(NGRAM, max(len(question), 1)))
            a = covered(answer, grams[min(3, max(len(answer), 1))], min(3, max(len(answer), 1)))
            if q >= QUESTION and a >= ANSWER:
                out.append((number, -score, q, a, first))
                break
    return out


def shards(benchmark: DataFrame):
    """Indexes of the benchmark's shards, each collected on its own; counts over all items come first."""

    def terms(batch: pa.RecordBatch):
        rows = [sorted(set(words_of(t))) for t in common.texts(batch)]
        sizes = [len(words_of(t)) for t in common.texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string())), pa.array(sizes, pa.int64())], ["item_id", "terms", "size"])

    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    bags = common.map_batches(items, terms, "item_id long, terms array<string>, size long").where("size > 0")
    n, mean = bags.agg(F.count("*"), F.avg("size")).first()
    if not n:
        return
    n_shards = -(-n // SHARD)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n_shards - 1 if n_shards > 1 else 1)))
    counted = bags.select(F.explode("terms").alias("term")).groupBy("term").count()
    for s in range(2 * n_shards - 1 if n_shards > 1 else 1):
        mine = items.where(F.col("shard") == s)
        rows = [(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect() if words_of(r["text"])]
        held = common.map_batches(mine.select("item_id", "text"), terms, "item_id long, terms array<string>, size long").select(F.explode("terms").alias("term")).distinct()
        frequency = {r["term"]: r["count"] for r in counted.join(held, "term", "left_semi").collect()}
        yield build_index(rows, frequency, n, mean)


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it (columns HITS); a narrow pass per shard."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    for index in shards(benchmark):
        sent = spark.sparkContext.broadcast(index)  # of at most about SHARD items

        def run(batch: pa.RecordBatch, sent=sent):
            found = [(d, *h) for d, t in zip(batch.column(0).to_pylist(), common.texts(batch), strict=True) for h in search(sent.value, t)]
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        one = common.map_batches(rows, run, HITS)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], HITS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, all columns as they are; a narrow pass per shard."""
    for index in shards(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, sent=sent):
            at = batch.schema.get_field_index("text")
            for part in common.rows_of(batch):
                yield part.filter(pa.array([not search(sent.value, t or "") for t in part.column(at).to_pylist()], pa.bool_()))

        docs = common.map_batches(docs, run, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the overlaps."""
    return hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
