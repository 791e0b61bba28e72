"""N-gram Jaccard join by vertical partitioning, with the components of its links.

A document is the set of its distinct 4-word shingles, each a 64-bit hash; the hash order is the global
n-gram order. That order is cut vertically into fragments. Two uses:

* Candidates. Documents that link differ in at most 3/37 of the sum of their set sizes. Cut into more
  fragments than that, a linked pair has a fragment in which both sets are the same. So each document emits
  one signature per non-empty fragment (about a sixth as many as shingles) and candidates share one. A passage
  that some documents share mostly falls into fragments with other shingles, so no frequency counts are needed.
  Sizes are dealt into classes (the larger partner's class decides the number of fragments); where so many
  fragments are empty that the agreeing ones could all be, the document also emits signatures under another
  order, and after three orders one for being empty. No link can be lost.
* Counting. Candidates' sets are cut into four fragments; partial overlaps are counted per fragment and
  summed per pair, and 100 * intersection >= 85 * union decides.

Equal sets are one node from the start, and a task sends a set on once however often it meets it. In a block of equal
signatures the most central set (found in most blocks) is the head. Every set is first compared with its heads, and
what that links is contracted; then all pairs across components that share a head are compared. Bitmaps rule most pairs
out before sets are counted, and a filter of fixed size tells which documents must be cut again for that. So a large
group of near copies costs about as many comparisons as it has members.

Cases: fewer than four words: the whole sequence is one shingle. Null text, or one without words: empty set,
a component of its own, no links. Null doc_id: such rows are kept, linked with nothing (component null).
Rows that repeat a doc_id are one document; links of any of its texts count. Extra columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm import common

PERCENT = 85
FRAGMENTS = 4
ORDERS = 3
#: 64-bit words of a set's bitmap.
BITMAP = 32
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixing permutation of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str], size: int = 4) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased, words between ASCII white space)."""
    words = [t.encode().lower().split() for t in texts]
    hashes = word_hashes([w for ws in words for w in ws])
    out, at = [], 0
    with np.errstate(over="ignore"):
        for ws in words:
            h = hashes[at : at + len(ws)]
            at += len(ws)
            if not ws:
                out.append(h)
                continue
            n, width = max(len(ws) - size + 1, 1), min(size, len(ws))
            s = np.full(n, width, np.uint64)
            for k in range(width):
                s = s * _P + h[k : k + n]
            out.append(np.unique(mix(s)))
    return out


def size_classes(most: int = 1 << 31) -> np.ndarray:
    """Largest set size of each class, growing by half."""
    out = [6]
    while out[-1] < most:
        out.append(out[-1] * 3 // 2)
    return np.array(out)


_TOPS = size_classes()


def fragments_of(top: int, percent: int = PERCENT) -> tuple[int, int]:
    """(number of fragments, empty ones that are still safe) for pairs whose larger set has at most `top` members."""
    differ = 2 * top * (100 - percent) // (100 + percent)
    spare = 0 if differ <= 1 else 1 if differ <= 20 else 1 + -(-differ // 20)
    return differ + 1 + spare, spare


def signatures(members: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of one sorted set; linked different sets share at least one."""
    n = len(members)
    if not n:
        return members
    out = []
    low, high = np.searchsorted(_TOPS, [n, n * 100 // percent])
    with np.errstate(over="ignore"):
        for group in range(int(low), int(high) + 1):
            k, spare = fragments_of(int(_TOPS[group]), percent)
            if k == 1:
                continue  # equal sets only, and those are one node already
            for order in range(ORDERS):
                m = members if not order else np.sort(mix(members + np.uint64(order) * _P))
                part = ((m >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                sums = np.add.reduceat(mix(m ^ _M1), starts)
                counts = np.diff(np.concatenate([starts, [n]])).astype(np.uint64)
                out.append(mix(mix(sums + counts) ^ mix(part[starts] * _P + np.uint64(group * 8 + order))))
                if k - len(starts) <= spare:
                    break
            else:
                out.append(mix(np.array([group * 8 + 7], np.uint64) * _M2))
    return np.concatenate(out) if out else members[:0]


#: Digests of sets that a task remembers, so that equal sets are sent on once a task and not once a document.
REMEMBERED = 500_000


def digest(members: np.ndarray) -> int:
    """A set's id: 64 bits, as its shingles' hashes are; 0 for the empty set."""
    with np.errstate(over="ignore"):
        return int(mix(np.add.reduce(mix(members ^ _M2), keepdims=True)).view(np.int64)[0]) if len(members) else 0


def _digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, d of every row."""

    def run(batch: pa.RecordBatch):
        for part in common.rows_of(batch, 256):
            sets = shingle_sets(common.texts(part))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64())], ["doc_id", "n", "d"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, d long")


def _new_sets(batches):
    """(digest, set) of the different non-empty sets of a task's texts; a set may come again once REMEMBERED others have come between."""
    seen: set[int] = set()
    for batch in batches:
        for part in common.rows_of(batch, 256):
            found = []
            for s in shingle_sets(common.texts(part)):
                if len(s) and (d := digest(s)) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(d)
                    found.append((d, s))
            if found:
                yield found


def _signatures(docs: DataFrame) -> DataFrame:
    """(sig, d), a row per signature of each different set of a task."""

    def run(batches):
        for found in _new_sets(batches):
            sigs = [signatures(s) for _, s in found]
            ids = np.repeat(np.array([d for d, _ in found], np.int64), [len(x) for x in sigs])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).astype(np.uint64).view(np.int64)), pa.array(ids)], ["sig", "d"])

    return common.map_stream(docs.where("doc_id is not null").select("text"), run, "sig long, d long")


def _runs(rows: DataFrame) -> DataFrame:
    """Rows (sig, d) whose signature is that of several sets, each once; they come sorted by sig and d and are streamed, never gathered."""

    def run(batches):
        held, given = None, False  # the last row so far, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, d = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if held is not None:
                sig, d = np.concatenate([[held[0]], sig]), np.concatenate([[held[1]], d])
            once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (d[1:] != d[:-1])])
            sig, d = sig[once], d[once]
            same = sig[1:] == sig[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            keep[0] &= not given
            given = bool(keep[-1]) or (given and len(sig) == 1) or (len(sig) > 1 and bool(same[-1]))
            held = sig[-1], d[-1]
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(d[keep])], ["sig", "d"])

    return common.map_stream(rows, run, "sig long, d long")


def _wanted_sets(docs: DataFrame, ids: DataFrame, make, schema: str) -> DataFrame:
    """make(digests, sets) -> columns after d, for the different sets of the documents `ids` (and of a few more)."""
    held = docs.sparkSession.sparkContext.broadcast(common.id_filter(ids))
    names = ["d", *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        for found in _new_sets(common.passing(batch, 1, held.value) for batch in batches):
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), *make([s for _, s in found])], names)

    hashed = docs.where("doc_id is not null").select("text", common.filter_place("doc_id"))
    return common.map_stream(hashed, run, f"d long, {schema}")


_FRAGMENTS = [f"f{k}" for k in range(FRAGMENTS)]


def _fragments(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(d, n, f0, f1 ...): sets cut into fragments of the hash order."""
    cuts = [np.uint64((k << 64) // FRAGMENTS) for k in range(1, FRAGMENTS)]

    def make(sets):
        parts = list(zip(*(np.split(s, np.searchsorted(s, cuts)) for s in sets), strict=True))
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32)), pa.array(np.concatenate(part).view(np.int64))) for part in parts]
        return [pa.array([len(s) for s in sets], pa.int64()), *lists]

    return _wanted_sets(docs, ids, make, "n long, " + ", ".join(f"{f} array<long>" for f in _FRAGMENTS))


_BITS = [f"b{k}_" for k in range(BITMAP)]


def _bitmaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(d, n, b0_, b1_ ...): a bitmap of each whole set."""

    def make(sets):
        bits = np.zeros((len(sets), BITMAP * 64), np.uint8)
        with np.errstate(over="ignore"):
            bits[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), (mix(np.concatenate(sets) + _M1) >> np.uint64(32)) % np.uint64(BITMAP * 64)] = 1
        words = np.packbits(bits, axis=1).view(np.int64)
        return [pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(BITMAP)]]

    return _wanted_sets(docs, ids, make, "n long, " + ", ".join(f"{b} long" for b in _BITS))


def _possible(x: str, y: str) -> F.Column:
    """Sets of sizes n{x}, n{y} and with these bitmaps may link: they differ in at least as many members as their bitmaps do in bits."""
    sizes = F.least(f"n{x}", f"n{y}") * 100 >= F.greatest(f"n{x}", f"n{y}") * PERCENT
    differ = functools.reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{b}{x}").bitwiseXOR(F.col(f"{b}{y}"))) for b in _BITS])
    return sizes & (differ * (100 + PERCENT) <= (F.col(f"n{x}") + F.col(f"n{y}")) * (100 - PERCENT))


def _verified(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """pairs (a, b) with `shared` and `joined` (intersection and union): partial overlaps per fragment, summed."""
    side = lambda name, c: fragments.select(F.col("d").alias(name), F.col("n").alias(f"n{c}"), *[F.col(f).alias(f"{f}{c}") for f in _FRAGMENTS])
    both = pairs.select("a", "b").join(side("b", "y"), "b").join(side("a", "x"), "a")
    shared = sum((F.size(F.array_intersect(f"{f}x", f"{f}y")) for f in _FRAGMENTS[1:]), F.size(F.array_intersect(f"{_FRAGMENTS[0]}x", f"{_FRAGMENTS[0]}y")))
    return both.select("a", "b", shared.alias("shared"), (F.col("nx") + F.col("ny")).alias("sizes")).select("a", "b", "shared", (F.col("sizes") - F.col("shared")).alias("joined"))


def _linked(pairs: DataFrame, docs: DataFrame, places: DataFrame, label: str) -> DataFrame:
    """Of pairs (a, b) those that link; only their documents are cut again."""
    ids = places.join(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct(), "d", "left_semi").select("doc_id")
    fragments = common.written(_fragments(docs, ids), f"{label}-fragments")
    links = common.written(_verified(pairs, fragments).where(F.col("shared") * 100 >= F.col("joined") * PERCENT).select("a", "b").distinct(), label)
    common.drop_written(fragments)
    return links


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Nodes are different sets, by their digests. Written stages: digests; blocks of signatures that several sets have; their
    stars and bitmaps; possible pairs and links. Each is dropped when nothing reads it any more.
    """
    rows = common.written(_digests(docs), "jaccard-digests")
    sets = rows.where("n > 0 and doc_id is not null")
    places = sets.groupBy("d").agg(F.min("doc_id").alias("doc_id"))
    blocks = common.written(_runs(_signatures(docs).repartition("sig").sortWithinPartitions("sig", "d")), "jaccard-blocks")

    # The head of a block is the set that most blocks hold: the original of a group rather than an edited copy.
    central = blocks.groupBy("d").agg(F.count("*").alias("blocks"))
    ranked = blocks.join(central, "d").withColumn("p", F.min(F.struct((-F.col("blocks")).alias("k"), "d")).over(Window.partitionBy("sig")))
    stars = common.written(ranked.select(F.col("p.d").alias("p"), "d").distinct(), "jaccard-stars")
    common.drop_written(blocks)
    members = stars.where("d <> p").select(F.explode(F.array("p", "d")).alias("d")).distinct()
    maps = common.written(_bitmaps(docs, places.join(members, "d", "left_semi").select("doc_id")).dropDuplicates(["d"]), "jaccard-bitmaps")
    side = lambda name, k: maps.select(F.col("d").alias(name), *[F.col(x).alias(f"{x}{k}") for x in ("n", *_BITS)])
    pairs = common.written(stars.where("d <> p").join(side("d", 1), "d").join(side("p", 2), "p").where(_possible("1", "2")).select(F.col("p").alias("a"), F.col("d").alias("b")), "jaccard-pairs")
    links = [_linked(pairs, docs, places, "jaccard-links")]
    repeated = sets.select("doc_id", "d").distinct().groupBy("doc_id").agg(F.min("d").alias("a"), F.max("d").alias("z")).where("a < z")
    links.append(sets.join(repeated, "doc_id").where("d > a").select("a", F.col("d").alias("b")).distinct())  # texts of one doc_id
    union = lambda: functools.reduce(DataFrame.unionByName, links)
    found = common.components(union(), "jaccard-first")

    # All pairs across components that share a head, as far as their bitmaps leave them possible where the pair is made.
    placed = stars.where("d <> p").join(found.select(F.col("node").alias("d"), "component"), "d", "left").select("p", "d", F.coalesce("component", "d").alias("c"))
    open_ = placed.groupBy("p").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("p")
    rest = common.written(placed.join(open_, "p", "left_semi").join(maps, "d"), "jaccard-open")
    one, two = (rest.select("p", *[F.col(x).alias(f"{x}{k}") for x in rest.columns if x != "p"]) for k in (1, 2))
    cross = one.join(two, "p").where("d1 < d2 and c1 <> c2").where(_possible("1", "2"))
    cross = common.written(cross.select(F.col("d1").alias("a"), F.col("d2").alias("b")).distinct(), "jaccard-cross")
    if not cross.isEmpty():
        links.append(_linked(cross, docs, places, "jaccard-more"))
        found = common.components(union(), "jaccard-all")
    common.drop_written(stars, maps, rest, pairs, cross)

    least = sets.groupBy("d").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(found.select(F.col("node").alias("d"), "component"), "d", "left")
    least = least.select("d", "least", "copies", F.coalesce("component", "d").alias("c"))
    label = least.groupBy("c").agg(F.min("least").alias("component_id"))
    labels = common.written(least.join(label, "c").select("d", "copies", "component_id"), "jaccard-labels")
    out = common.joined_hot(rows, labels, ["d"], "copies")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those that are linked to an earlier document: of each component the smallest doc_id stays.

    Of rows that repeat a doc_id all stay or go together. Null doc_id stays.
    """
    gone = jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_shingles, component_id."""
    return jaccard_components(common.table(spark, sf_dir, "documents"))
