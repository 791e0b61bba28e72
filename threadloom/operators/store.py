"""Snapshots: upsert, soft deletion, tables under manifests, run log."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] | None = None) -> DataFrame:
    """Rows of both by key: new values win, except in the columns of keep_old. Of new rows that repeat a key the largest counts,
    in the order of `updated_at` where there is one, then of all columns."""
    keep = set(keep_old or [])
    rank = [c for c in ("updated_at",) if c in old.columns]
    plain = [f.name for f in old.schema if f.dataType.typeName() != "map"]
    b = new.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), F.struct(*rank, *plain)).alias("b"))
    a = old.select(F.struct(*old.columns).alias("a"), *keys)
    both = a.join(b, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in keep else F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return both.select(*[(F.col(c) if c in keys else pick(c).alias(c)) for c in old.columns])


def replace_source(old: DataFrame, new: DataFrame, source_id: str) -> DataFrame:
    """A re-import: that source's rows that the new export lacks become inactive."""
    gone = old.withColumn("is_active", F.when(F.col("source_id") == source_id, F.lit(False)).otherwise(F.col("is_active")))
    return upsert(gone, new, ["source_id", "source_record_id"], keep_old=["created_at"])


def monthly_counts(events: DataFrame) -> DataFrame:
    """Active, dated events per month; the same plan serves a stream (see threadloom.streaming.monthly)."""
    dated = events.where(F.col("is_active") & F.col("timestamp_start").isNotNull())
    return dated.groupBy(F.date_format("timestamp_start", "yyyy-MM").alias("month")).agg(F.count("*").alias("message_count"))


class Store:
    """Tables as Parquet folders of their own, named in one manifest per commit; readers follow the newest manifest.

    A commit writes only the tables it changes, each into a folder with a name of its own, and then the manifest: a small file
    named after the version, which the file system creates whole or not at all. A failed commit leaves folders that no
    manifest names; of two writers the second to make the manifest fails, and the first one's tables stand.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        return max([0, *(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit())])

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folder of each table as of a version, the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return {}
        place = self._path(f"{self.root}/manifests/{version}")
        stream = self._fs.open(place)
        try:
            return json.loads(bytes(stream.readNBytes(int(self._fs.getFileStatus(place).getLen()))).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame | None:
        folder = self.manifest().get(name)
        return self.spark.read.parquet(f"{self.root}/{folder}") if folder else None

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Write these tables and name them, with the unchanged others, as the next version."""
        now = self.version()
        named = self.manifest(now)
        for name, df in tables.items():
            named[name] = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{named[name]}")
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        # Written aside and renamed: a rename does not replace an existing file.
        aside, place = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{now + 1}")
        stream = self._fs.create(aside)
        stream.write(bytearray(json.dumps(named).encode()))
        stream.close()
        if self._fs.exists(place) or not self._fs.rename(aside, place):
            self._fs.delete(aside, False)
            raise RuntimeError("store_was_committed_meanwhile")
        return now + 1


def run_row(spark: SparkSession, source_id: str, path_hash: str, conversations: int, events: int, warnings: int) -> DataFrame:
    """One row of the import log."""
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    return spark.createDataFrame(
        [(f"run-{uuid.uuid4()}", source_id, now, now, "completed", path_hash, conversations, events, warnings, None)],
        "import_run_id string, source_id string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, input_path_hash string, imported_conversations int, imported_events int, warning_count int, error_code string",
    )
