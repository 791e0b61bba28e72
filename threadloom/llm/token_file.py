"""Token-ID files: Parquet with one list of ids per document.

Layout of a file folder: columns doc_id, part, local_start, n_tokens (long, delta-packed, no dictionary),
ids (list<int>, dictionary pages: a vocabulary has few distinct values) and any metadata columns asked for.
Row groups and pages are small and carry column and offset indexes, so a reader of a few documents or of
metadata alone touches only those pages. Rows are in ascending (doc_id, text) order through the parts; a
document's place in the whole stream is its part's base (the tokens of all earlier parts, one row per part,
from the metadata column alone) plus local_start.

Pieces of words are encoded once and kept, up to a limit: this vocabulary's splitter drops white space and never
looks across it.

Cases: null or empty text is the end id alone. Null doc_id comes first. Repeated rows keep one entry each.
An empty table writes an empty file. Metadata columns must not be named as the columns above (an error).
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import common

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
MOST_KEPT = 300_000
#: Parquet writer: row groups and pages in bytes, page format 2 (delta packing), dictionary for ids only.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "local_start", "n_tokens")},
    "compression": "zstd",
}
COLUMNS = ("doc_id", "part", "local_start", "n_tokens", "ids")


#: Texts that lower-casing is all the normaliser does to, and the splitter's pieces in them.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


def _byte_letters() -> list[str]:
    """Letter of each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Kept(dict):
    """Key -> ids as little-endian 32-bit bytes, made by `make` when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        got = self[key] = np.array(self.make(key), "<u4").tobytes()
        return got


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes; each piece is encoded once and kept.

    In a text of ASCII and Latin-1 letters the splitter's pieces are found here and given to the merging model;
    other texts go to the library word by word, and those that might hold a special string, which the library
    matches before it normalises, go to it whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, letters = tokenizer.model, _byte_letters()
        self.special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.I)
        self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.words = _Kept(self.whole)
        self.pieces = _Kept(lambda p: [t.id for t in model.tokenize(p if p.isascii() else "".join(letters[b] for b in p.encode()))])

    def encode(self, text: str) -> bytes:
        for kept in (self.words, self.pieces):
            if len(kept) > MOST_KEPT:
                kept.clear()
        if "<" in text and self.special.search(text):
            return np.array(self.whole(text), "<u4").tobytes()
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, common.words_of(text)))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str | None) -> WordEncoder:
    """Loaded once in each worker process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, meta: tuple[str, ...] = (), path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Rows of the file: ordered by range partitions, encoded, with running starts within each part.

    The range partitioner also looks at a hash of the text, so rows that share a doc_id still spread.
    """
    if clash := set(meta) & set(COLUMNS[1:]):
        raise ValueError(f"metadata columns clash with the file's own: {sorted(clash)}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[m for m in meta if m not in ("doc_id", "text")])
    keys = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text"))
    rows = rows.repartitionByRange(*keys[:2]).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id().cast("long"))
    kept = [f for f in rows.schema.fields if f.name not in ("text", "doc_id", "part")]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in COLUMNS[:4]] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + kept)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        at = 0
        for batch in batches:
            for part in common.rows_of(batch, 256):
                enc = encoder(path)
                found = [enc.encode(t) + end for t in common.texts(part)]
                sizes = np.array([len(x) // 4 for x in found], np.int64)
                starts = at + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                at += int(sizes.sum())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(found), "<i4")))
                names = part.schema.names
                yield pa.RecordBatch.from_arrays(
                    [part.column(names.index("doc_id")), part.column(names.index("part")), pa.array(starts), pa.array(sizes), ids, *[part.column(names.index(f.name)) for f in kept]],
                    [*COLUMNS, *[f.name for f in kept]],
                )

    return common.map_stream(rows, run, schema)


def write_tokens(docs: DataFrame, to: str, meta: tuple[str, ...] = (), path: str | None = None, end_id: int = END_ID) -> None:
    encoded(docs, meta, path, end_id).write.options(**LAYOUT).parquet(to)


def bases(file: DataFrame) -> DataFrame:
    """(part, base): tokens before each part; reads two metadata columns and has one row per written part."""
    per = file.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return per.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, place: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, start, n_tokens and the columns asked for; filters on doc_id reach the page indexes."""
    file = spark.read.parquet(place)
    # One row per written part, so the broadcast side is bounded by the number of files.
    return file.join(F.broadcast(bases(file)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *columns)


def check_sums(file: DataFrame) -> DataFrame:
    """doc_id, part, local_start, n_tokens, ids_crc32 recomputed from the ids that the file holds."""

    def run(batch: pa.RecordBatch):
        ids = batch.column(3)
        edges = np.asarray(ids.offsets)
        flat = np.ascontiguousarray(np.asarray(ids.values)).astype("<u4", copy=False)
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(np.diff(edges), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    return common.map_batches(file.select("doc_id", "part", "local_start", "ids"), run, "doc_id long, part long, local_start long, n_tokens long, ids_crc32 long")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, start, n_tokens, ids_crc32, from the file as read back."""
    place = common.new_path(spark, "token-ids")
    write_tokens(common.table(spark, sf_dir, "documents"), place)
    file = spark.read.parquet(place)
    return check_sums(file).join(F.broadcast(bases(file)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_rows(spark: SparkSession, docs: DataFrame, meta: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """Write docs as a token file in the shared folder; return what it holds, with places in the stream."""
    place = common.new_path(spark, "token-ids")
    write_tokens(docs, place, meta)
    return read_tokens(spark, place, ("ids", *meta))


