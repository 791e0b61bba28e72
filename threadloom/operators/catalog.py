"""Catalogue queries: metadata, topic search and detail, neighbours, occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T


def visible(events: DataFrame, privacy: str | None = "private", start=None, end=None, source_type: str | None = None) -> DataFrame:
    """Active events of exactly that privacy level, in [start, end), of that source type; each bound is optional."""
    out = events.where("is_active")
    if privacy is not None:
        out = out.where(F.col("privacy_level") == privacy)
    if start is not None:
        out = out.where(F.col("timestamp_start") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("timestamp_start") < F.lit(end).cast("timestamp_ntz"))
    if source_type is not None:
        out = out.where(F.col("source_type") == source_type)
    return out


def context_or_event() -> F.Column:
    return F.coalesce("context_id", "event_id")


def meta(events: DataFrame, topics: DataFrame, event_topics: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: earliest, latest, source types, categories and counts; no privacy filter."""
    active = visible(events, None)
    span = active.agg(F.min("timestamp_start").alias("earliest"), F.max("timestamp_start").alias("latest"), F.count("event_id").alias("event_count"), F.sort_array(F.collect_set("source_type")).alias("source_types"))
    categories = topics.agg(F.sort_array(F.collect_set("category")).alias("categories"))
    used = event_topics.join(active.select("event_id"), "event_id", "left_semi").agg(F.countDistinct("topic_id").alias("topic_count"))
    return span.crossJoin(categories).crossJoin(used).crossJoin(relations.agg(F.count("*").alias("relation_count")))  # rows of one


def source_types(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Types of the sources that have active events, by name."""
    return sources.join(events.where("is_active").select("source_id"), "source_id", "left_semi").select("source_type").distinct().orderBy("source_type")


def _stats() -> list[F.Column]:
    return [F.countDistinct("event_id").alias("message_count"), F.countDistinct(context_or_event()).alias("context_count"), F.min("timestamp_start").alias("first_seen_at"), F.max("timestamp_start").alias("last_seen_at")]


def search_topics(events: DataFrame, topics: DataFrame, event_topics: DataFrame, query: str, limit: int = 20, privacy: str = "private") -> DataFrame:
    """Topics whose name holds the query (ASCII case ignored), by count and name."""
    pattern = T.like_pattern(T_lower(query))
    named = topics.where(F.expr(f"{_ascii('name')} like {_quoted(pattern)} escape '\\\\'")).select("topic_id", "name", "category")
    joined = event_topics.join(named, "topic_id").join(visible(events, privacy).select("event_id", "context_id", "timestamp_start"), "event_id")
    return joined.groupBy("topic_id", "name", "category").agg(*_stats()).orderBy(F.desc("message_count"), "name").limit(limit)


def T_lower(query: str) -> str:
    return query.translate({c: c + 32 for c in range(65, 91)})


def _ascii(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def topic_summary(events: DataFrame, event_topics: DataFrame, topic: str, privacy: str = "private") -> DataFrame:
    """Always one row, zeros and nulls for a topic without visible events."""
    return event_topics.where(F.col("topic_id") == topic).join(visible(events, privacy), "event_id").agg(*_stats())


def topic_neighbors(events: DataFrame, topics: DataFrame, event_topics: DataFrame, topic: str, limit: int = 12, privacy: str = "private") -> DataFrame:
    """Topics that share visible events with this one, by weight and name."""
    shown = event_topics.join(visible(events, privacy).select("event_id", context_or_event().alias("context")), "event_id")
    target = shown.where(F.col("topic_id") == topic).select("event_id").distinct()
    n_target = target.agg(F.count("*").alias("n_target"))
    near = shown.join(target, "event_id", "left_semi").where(F.col("topic_id") != topic).groupBy("topic_id").agg(F.count("*").alias("message_count"), F.countDistinct("context").alias("context_count"))
    totals = shown.join(near.select("topic_id"), "topic_id", "left_semi").groupBy("topic_id").agg(F.countDistinct("event_id").alias("total"))
    out = near.join(totals, "topic_id").join(topics.select("topic_id", "name", "category"), "topic_id").crossJoin(F.broadcast(n_target))  # one row
    out = out.withColumn("weight", T.cosine(F.col("message_count"), F.col("n_target"), F.col("total")))
    return out.select("topic_id", "name", "category", "message_count", "context_count", "weight").orderBy(F.desc("weight"), "name").limit(limit)


def occurrences(events: DataFrame, event_topics: DataFrame, topic: str, start=None, end=None, source_type: str | None = None, privacy: str = "private") -> DataFrame:
    """Excerpts of a topic's events, unpaged."""
    shown = visible(events, privacy, start, end, source_type)
    joined = shown.join(event_topics.where(F.col("topic_id") == topic).select("event_id"), "event_id", "left_semi")
    return joined.select("event_id", F.col("timestamp_start").alias("occurred_at"), "role", F.col("title").alias("conversation_title"), T.snippet(F.col("text")).alias("snippet"), "source_record_id")


def page(rows: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Latest first, null times last, then by event_id."""
    return rows.orderBy(F.col("occurred_at").desc_nulls_last(), "event_id").offset(offset).limit(limit)


def topic_detail(events: DataFrame, topics: DataFrame, event_topics: DataFrame, topic: str, privacy: str = "private", neighbor_limit: int = 12) -> DataFrame | None:
    """One row: the topic, its summary, months[] and neighbors[]; None without such a topic."""
    from threadloom.operators.topics import monthly_intensity

    found = topics.where(F.col("topic_id") == topic).select("topic_id", "name", "category").limit(1)
    if found.isEmpty():
        return None
    months = monthly_intensity(events, event_topics, topic, privacy).agg(F.sort_array(F.collect_list(F.struct("month", "message_count", "weight"))).alias("months"))
    near = topic_neighbors(events, topics, event_topics, topic, neighbor_limit, privacy)
    near = near.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("k"), "name", F.struct("topic_id", "name", "category", "message_count", "context_count", "weight").alias("v")))), lambda x: x["v"]).alias("neighbors"))
    return found.crossJoin(topic_summary(events, event_topics, topic, privacy)).crossJoin(months).crossJoin(near)  # rows of one
