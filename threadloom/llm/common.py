"""What the training-data operators share: table access, written stages, word splitting, components.

Nothing here keeps state on one machine: stages are cut by writing Parquet into the shared folder
that ``spark.checkpoint.dir`` names, so a lost executor costs a recomputed task and never a result.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key that holds more than one in this many of all rows is hot.
HOT_SHARE = 10_000
#: Bits of the filter that tells which rows a later pass needs: a fixed size, 4 MB at every size of the input. Where it is
#: too small to rule rows out, the joins behind it do.
FILTER_BITS = 1 << 25
#: Bytes of an Arrow batch between Spark and Python, where the session does not set its own, and of texts in one slice of it.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_ASCII_SPACE = str.maketrans({c: " " for c in "\t\n\v\f\r"})


def words_of(text: str) -> list[str]:
    """Words of a text: runs of characters other than ASCII white space (str.split() would also cut at Unicode spaces)."""
    return [w for w in text.translate(_ASCII_SPACE).split(" ") if w] if not text.isascii() else _ascii_words(text)


def _ascii_words(text: str) -> list[str]:
    # str.split() also cuts at \x1c-\x1f, which are not in the class above.
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in text.translate(_ASCII_SPACE).split(" ") if w]
    return text.split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where the session names none and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/threadloom/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame, shuffles: bool = True) -> None:
    """Remove written stages that nothing reads any more, and let Spark drop the shuffle files of plans that are gone."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/threadloom/" in f}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    if frames and shuffles:
        free_shuffles(frames[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are gone."""
    gc.collect()  # Python's references to such plans
    spark.sparkContext._jvm.System.gc()


def map_stream(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes, since ten thousand long texts would fill a worker's memory."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """One Arrow batch in, any number out; batches are the only unit held in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return map_stream(df, run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def rows_of(batch: pa.RecordBatch, step: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of at most `step` rows and about SLICE_BYTES of texts, so that what is derived from long texts
    stays small. A text is never cut."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            size += np.asarray(pc.fill_null(pc.binary_length(column), 0))
    part = np.cumsum(size) // SLICE_BYTES
    edges = np.union1d(np.arange(0, batch.num_rows, step), np.flatnonzero(part[1:] != part[:-1]) + 1)
    for at, end in zip(edges, np.append(edges[1:], batch.num_rows), strict=False):
        yield batch.slice(at, end - at)


def filter_place(column: str) -> F.Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS)).alias("at")


def id_filter(ids: DataFrame) -> bytes:
    """The filter of the ids in the first column."""
    return place_filter(ids.select(filter_place(ids.columns[0])))


def place_filter(places: DataFrame) -> bytes:
    """A bitmap of places `at` below FILTER_BITS, made by a bitwise-or aggregation; the driver sees FILTER_BITS bits and no ids."""
    word = 32_768  # bits of one row of the built-in aggregation
    rows = places.groupBy(F.floor(F.col("at") / word).alias("row")).agg(F.expr(f"bitmap_construct_agg(at % {word})").alias("bits")).collect()
    out = np.zeros((FILTER_BITS // word, word // 8), np.uint8)
    for r in rows:
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def passing(batch: pa.RecordBatch, at: int, bits: bytes) -> pa.RecordBatch:
    """The rows of a batch whose place in the filter (column number `at`) is set."""
    place = np.asarray(batch.column(at))
    return batch.filter(pa.array((np.frombuffer(bits, np.uint8)[place >> 3] >> (place & 7) & 1).astype(bool)))


def joined_hot(rows: DataFrame, labels: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows left-joined with labels (one row per key, `count` telling how many rows hold it); no key gathers its rows in one task.

    Keys that hold more than one in HOT_SHARE of the rows are fewer than HOT_SHARE, so their labels are broadcast under
    that proven bound; the other keys' rows go through a shuffle, where the largest is that small a share of the whole.
    """
    total = rows.agg(F.count("*").alias("total_"))
    hot = labels.crossJoin(F.broadcast(total)).where(F.col(count) * HOT_SHARE > F.col("total_")).drop("total_")  # total: one row
    flagged = rows.join(F.broadcast(hot.withColumn("hot_", F.lit(True))), keys, "left")
    done = flagged.where("hot_").drop("hot_")
    rest = flagged.where("hot_ is null").select(rows.columns).join(labels, keys, "left")
    return done.unionByName(rest)


def _rooted(parent: DataFrame, label: str) -> DataFrame:
    """(node, p) with every p followed up to its root (its own parent): chains halve each round, so a chain of n takes log2(n)."""
    now = written(parent, f"{label}-parent")
    while True:
        up = now.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        far = written(now.select("node", "p").join(up, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), f"{label}-parent")
        drop_written(now, shuffles=False)
        if far.where("moved").isEmpty():
            return far.select("node", "p")
        now = far


def components(edges: DataFrame, label: str = "cc", a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges, as (node, component), component being the smallest node.

    Each round hangs every node on its smallest neighbour (an aggregation with map-side combine), follows the
    hangings to their roots by pointer jumping, and contracts the edges to the roots; self-loops and repeats go.
    A root that nothing hung on has a smaller neighbour in the next round, so two rounds at least halve the
    nodes: O(log n) rounds of O(log n) jumps, and a path in order of its ids needs one round. The rounds' maps are
    composed as they come. No edge list ever reaches the driver.
    """
    spark = edges.sparkSession
    e = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), f"{label}-edges")
    result = None
    while not e.isEmpty():
        both = e.select(F.col("b").alias("node"), F.col("a").alias("p")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("p")))
        root = _rooted(both.groupBy("node").agg(F.min("p").alias("p")), label)
        left, right = root.select(F.col("node").alias("a"), F.col("p").alias("pa")), root.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        less = e.join(left, "a").join(right, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct()
        less = written(less, f"{label}-edges")
        if result is None:
            so_far = root.select("node", F.col("p").alias("component"))
        else:
            up = root.select(F.col("node").alias("component"), "p")
            so_far = written(result.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")), f"{label}-out")
            drop_written(result, root, shuffles=False)
        drop_written(e, shuffles=False)
        e, result = less, so_far
    if result is None:
        kind = edges.schema[a].dataType
        result = spark.createDataFrame([], "node long, component long").select(F.col("node").cast(kind), F.col("component").cast(kind))
    return result
