"""The filtered topic graph: nodes, edges, ego network, and what a view derives from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.catalog import visible
from threadloom.operators.topics import fallback_context


def topic_graph(
    events: DataFrame, topics: DataFrame, event_topics: DataFrame, *, start=None, end=None, source_type: str | None = None, privacy: str = "private", categories: list[str] | None = None,
    min_occurrences: int = 2, min_edge_messages: int = 1, min_relation_weight: float = 0.0, node_limit: int = 100, selected: str | None = None, neighbors_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Counts are those under the filters; pairs are made among visible topics only.

    Nodes: rank, topic_id, name, category, message_count, context_count, first_seen_at, last_seen_at.
    Edges: source_topic_id < target_topic_id, message_count, context_count, weight.
    An eligible selected topic beyond the limit takes the last place; with neighbors_only its ego network
    stays, edges between neighbours included. Names that tie are ordered by topic_id.
    """
    if min(min_occurrences, min_edge_messages, node_limit) < 1:
        raise ValueError("graph_limits_must_be_positive")
    if not 0 <= min_relation_weight <= 1:
        raise ValueError("graph_relation_weight_out_of_range")
    shown = visible(events, privacy, start, end, source_type).select("event_id", fallback_context().alias("context"), "timestamp_start")
    named = topics.select("topic_id", "name", "category")
    if categories:
        named = named.where(F.col("category").isin(categories))
    rows = event_topics.select("event_id", "topic_id").join(named, "topic_id").join(shown, "event_id")
    stats = rows.groupBy("topic_id", "name", "category").agg(
        F.countDistinct("event_id").alias("message_count"), F.countDistinct("context").alias("context_count"), F.min("timestamp_start").alias("first_seen_at"), F.max("timestamp_start").alias("last_seen_at")
    ).where(F.col("message_count") >= min_occurrences)
    order = (F.desc("message_count"), F.asc("name"), F.asc("topic_id"))
    # A top-k without a window: only node_limit rows meet in one task.
    top = stats.orderBy(*order).limit(node_limit)
    if selected is not None:
        chosen = stats.where(F.col("topic_id") == selected)
        kept = top.withColumn("r", F.row_number().over(Window.orderBy(*order))).withColumn("has", F.max((F.col("topic_id") == selected).cast("int")).over(Window.partitionBy()))
        extra = chosen.withColumns({"r": F.lit(None).cast("int"), "has": F.lit(None).cast("int")}).join(top.select("topic_id"), "topic_id", "left_anti").select(kept.columns)
        both = kept.unionByName(extra).withColumn("more", F.max(F.col("r").isNull().cast("int")).over(Window.partitionBy()))
        top = both.where(F.col("r").isNull() | (F.col("more") == 0) | (F.col("r") < node_limit)).drop("r", "has", "more")
    nodes = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).cache()  # node_limit rows at most, read five times
    seen = rows.join(nodes.select("topic_id"), "topic_id", "left_semi").select("event_id", "topic_id", "context").distinct()
    a, b = seen.select("event_id", "context", F.col("topic_id").alias("source_topic_id")), seen.select("event_id", F.col("topic_id").alias("target_topic_id"))
    pairs = a.join(b, "event_id").where("source_topic_id < target_topic_id").groupBy("source_topic_id", "target_topic_id").agg(F.count("*").alias("message_count"), F.countDistinct("context").alias("context_count"))
    size = nodes.select("topic_id", F.col("message_count").alias("n"))
    sized = pairs.join(size.select(F.col("topic_id").alias("source_topic_id"), F.col("n").alias("na")), "source_topic_id").join(size.select(F.col("topic_id").alias("target_topic_id"), F.col("n").alias("nb")), "target_topic_id")
    edges = sized.withColumn("weight", T.cosine(F.col("message_count"), F.col("na"), F.col("nb"))).where((F.col("message_count") >= min_edge_messages) & (F.col("weight") >= min_relation_weight))
    edges = edges.select("source_topic_id", "target_topic_id", "message_count", "context_count", "weight").cache()  # pairs of those
    if neighbors_only and selected is not None:
        touching = edges.where((F.col("source_topic_id") == selected) | (F.col("target_topic_id") == selected))
        ends = touching.select(F.col("source_topic_id").alias("topic_id")).union(touching.select("target_topic_id")).union(nodes.where(F.col("topic_id") == selected).select("topic_id")).distinct()
        nodes = nodes.join(ends, "topic_id", "left_semi")
        for side in ("source_topic_id", "target_topic_id"):
            edges = edges.join(ends.select(F.col("topic_id").alias(side)), side, "left_semi")
    return nodes.select("rank", "topic_id", "name", "category", "message_count", "context_count", "first_seen_at", "last_seen_at").orderBy("rank"), edges.select("source_topic_id", "target_topic_id", "message_count", "context_count", "weight").orderBy("source_topic_id", "target_topic_id")


def node_sizes(nodes: DataFrame, labelled: int = 15, selected: str | None = None) -> DataFrame:
    """Drawing size of each node, and whether its label shows: the labelled-largest count and above, or selected."""
    bound = F.element_at(F.sort_array(F.collect_list("message_count").over(Window.partitionBy()), asc=False), F.least(F.lit(labelled), F.count("*").over(Window.partitionBy()).cast("int")))
    shows = F.col("message_count") >= bound
    return nodes.select("topic_id", F.least(F.lit(13.0), 3 + F.log2(F.col("message_count") + 1) * 0.85).alias("size"), (shows if selected is None else shows | (F.col("topic_id") == selected)).alias("shows_label"))


def edge_sizes(edges: DataFrame) -> DataFrame:
    return edges.select("source_topic_id", "target_topic_id", F.least(F.lit(2.2), 0.2 + 2 * F.sqrt("weight")).alias("size"))


def intensity_bars(months: DataFrame) -> DataFrame:
    """Bar height in percent of the largest month, 5 at least."""
    return months.select("month", F.greatest(F.lit(5.0), F.col("message_count") / F.max("message_count").over(Window.partitionBy()) * 100).alias("height"))


def month_of(time: F.Column) -> F.Column:
    """Month (yyyy-MM) of a time; '' of none."""
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit(""))


def percentage(weight: F.Column) -> F.Column:
    """A weight in whole percent, halves up."""
    return F.floor(weight * 100 + 0.5).cast("int")


def _units(name: F.Column) -> F.Column:
    """UTF-16 code units of a string."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(name, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))


def position(name: F.Column) -> tuple[F.Column, F.Column]:
    """Where a node begins: angle and radius from a 32-bit FNV-1a hash of its id, so that reruns agree."""
    hashed = F.aggregate(_units(name), F.lit(2166136261), lambda h, u: (h.bitwiseXOR(u) * 16777619) % (1 << 32))  # below 2^57: exact
    angle, radius = hashed / float((1 << 32) - 1) * 2 * math.pi, 1 + (F.shiftright(hashed, 8) % 1000) / 400
    return F.cos(angle) * radius, F.sin(angle) * radius


def colour_number(category: F.Column, colours: int = 5) -> F.Column:
    """Which of the palette's colours a category has: a polynomial hash over the first unit of each character."""
    first = F.filter(_units(category), lambda u: ~u.between(0xDC00, 0xDFFF))
    return (F.aggregate(first, F.lit(0).cast("long"), lambda h, u: (h * 31 + u) % (1 << 32)) % colours).cast("int")
