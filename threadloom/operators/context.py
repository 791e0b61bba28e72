"""Bounded conversation context along the message tree: a few unrolled joins in one plan, no loop of lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 10


def best_children(messages: DataFrame) -> DataFrame:
    """Of each message the child on the current branch with the smallest number, else the smallest."""
    rank = F.row_number().over(Window.partitionBy("parent_message_key").orderBy(F.when(F.col("is_on_current_branch"), 0).otherwise(1), "sequence_number"))
    ranked = messages.where("parent_message_key is not null").withColumn("r", rank)
    return ranked.where("r = 1").select(F.col("parent_message_key").alias("key"), F.col("message_key").alias("child"))


def message_context(messages: DataFrame, events: DataFrame, event_id: str, before: int = 2, after: int = 2) -> DataFrame:
    """Ancestors, the message, and the best path down; empty for an unknown message. No activity or privacy filter."""
    if not (0 <= before <= MOST and 0 <= after <= MOST):
        raise ValueError("context_window_out_of_range")
    target = messages.where(F.col("event_id") == event_id).limit(1)
    conversation = messages.join(target.select("conversation_id"), "conversation_id", "left_semi")  # the tree lies within one conversation
    parents = conversation.select(F.col("message_key").alias("key"), F.col("parent_message_key").alias("next"))
    children = best_children(conversation).select("key", F.col("child").alias("next"))
    steps = [target.select("message_key", F.lit(0).alias("position"))]
    for table, most, sign in ((parents, before, -1), (children, after, 1)):
        at = target.select(F.col("message_key").alias("at"))
        for k in range(1, most + 1):
            at = at.join(table, F.col("at") == F.col("key")).where("next is not null").select(F.col("next").alias("at"))
            steps.append(at.select(F.col("at").alias("message_key"), F.lit(sign * k).alias("position")))
    path = reduce(DataFrame.unionByName, steps)
    found = conversation.join(path, "message_key").join(events.select("event_id", "timestamp_start", "text", "title"), "event_id")
    return found.select("conversation_id", F.col("title").alias("conversation_title"), "position", "event_id", "role", F.col("timestamp_start").alias("created_at"), "text", "sequence_number", (F.col("event_id") == event_id).alias("is_target")).orderBy("position")
