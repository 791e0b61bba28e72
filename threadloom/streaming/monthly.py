"""Events as a stream: counts per event-time window, and exports that land in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from threadloom.operators.store import Store
from threadloom.schema import schema


def windowed_counts(stream: DataFrame, width: str = "30 days", late: str = "2 days") -> DataFrame:
    """Active, dated events per window; state older than the watermark is dropped."""
    dated = stream.where(F.col("is_active") & F.col("timestamp_start").isNotNull()).withColumn("at", F.col("timestamp_start").cast("timestamp"))
    return dated.withWatermark("at", late).groupBy(F.window("at", width).alias("w")).agg(F.count("*").alias("message_count")).select(F.col("w.start").alias("start"), "message_count")


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(schema("events")).parquet(folder)


def upserting(stream: DataFrame, store: Store) -> DataStreamWriter:
    """Each micro-batch is upserted into the store's events; a batch that is run again changes nothing."""
    from threadloom.operators.store import upsert

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            old = store.read("events")
            store.commit({"events": batch if old is None else upsert(old, batch, ["source_id", "source_record_id"], keep_old=["created_at"])})

    return stream.writeStream.foreachBatch(apply)
