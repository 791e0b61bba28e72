"""The driver tables seen as conversation events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY, START = 86_400, 1_672_531_200


def instant(seconds: F.Column) -> F.Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of `conversations` as events, with nulls, inactive rows and privacy levels by rule."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    conv, turn = F.col("conv_id"), F.col("turn")
    source = F.when(conv % 23 == 0, "archive").when(conv % 5 == 3, "notes").otherwise("conversations")
    each = c.select(
        F.concat(F.lit("m"), conv.cast("string"), F.lit(":"), turn.cast("string")).alias("event_id"),
        source.alias("source_id"),
        F.concat(F.lit("message:"), conv.cast("string"), F.lit(":"), turn.cast("string")).alias("source_record_id"),
        F.lit("chat_message").alias("event_type"),
        F.when(conv % 13 != 0, conv.cast("string")).alias("context_id"),
        F.when((conv * 7 + turn) % 17 != 0, instant(F.lit(START) + conv * (3 * DAY) + turn * 60)).alias("timestamp_start"),
        F.concat(F.lit("conversation "), conv.cast("string")).alias("title"),
        "text",
        F.when(conv % 19 == 0, "sensitive").otherwise("private").alias("privacy_level"),
        (conv % 23 != 0).alias("is_active"),
        (F.col("role") != "system").alias("analysis_enabled"),
        "role",
    )
    return each.join(F.broadcast(sources(spark)), "source_id")  # three rows


def sources(spark: SparkSession) -> DataFrame:
    """Where events come from; no event of the archive is active."""
    return spark.sql("select * from values ('conversations', 'chat'), ('notes', 'note'), ('archive', 'letter') as s(source_id, source_type)")


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as events of their own."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("event_id"), F.lit(None).cast("string").alias("context_id"), instant(F.lit(START) + F.col("doc_id") * 3600).alias("timestamp_start"),
        "text", F.lit("private").alias("privacy_level"), F.lit(True).alias("is_active"), F.lit(True).alias("analysis_enabled"),
    )


def _quoted(column: F.Column) -> F.Column:
    """A string as JSON."""
    listed = F.to_json(F.array(column))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_number, raw): `conversations` as records of a chat export, one tree each.

    The second of two siblings is said earlier; times are numbers, texts or absent; ids stand in the message, beside it or are the
    node's key; some messages have several parts, some are thoughts or recaps.
    """
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    conv, turn = F.col("conv_id"), F.col("turn")
    name = lambda prefix, t=turn: F.concat(F.lit(f'"{prefix}'), t.cast("string"), F.lit('"'))
    at = F.lit(START) + conv * DAY + turn * 60 - F.when(turn % 4 == 3, 90).otherwise(0)
    time = F.when(turn % 8 == 4, "null").when(turn % 6 == 5, F.date_format(F.timestamp_seconds(at), "'\"'yyyy-MM-dd'T'HH:mm:ss'Z\"'")).otherwise(at.cast("string"))
    parts = F.concat(F.lit("["), _quoted(F.col("text")), F.when(turn % 3 == 0, ',{"text":"more"},{"image":1},""').otherwise(""), F.lit("]"))
    content = (
        F.when(turn % 9 == 8, F.concat(F.lit('{"content_type":"thoughts","parts":'), parts, F.lit("}")))
        .when(turn % 9 == 7, F.concat(F.lit('{"content_type":"reasoning_recap","content":'), name("recap "), F.lit("}")))
        .otherwise(F.concat(F.lit('{"content_type":"text","parts":'), parts, F.lit("}")))
    )
    parent = F.when(turn == 0, '"root"').when(turn % 4 == 3, name("k", turn - 2)).otherwise(name("k", turn - 1))
    ids = F.when(turn % 5 != 1, F.concat(F.lit('"id":'), name("said-"), F.lit(","))).otherwise("")
    own = F.when(turn % 10 != 6, F.concat(F.lit('"id":'), name("own-"), F.lit(","))).otherwise("")
    node = F.concat(
        name("k"), F.lit(":{"), own, F.lit('"parent":'), parent, F.lit(',"message":{'), ids, F.lit('"author":{"role":'), _quoted(F.col("role")), F.lit('},"create_time":'), time, F.lit(',"content":'), content, F.lit("}}"),
    )
    trees = c.groupBy("conv_id").agg(F.array_join(F.collect_list(node), ",").alias("nodes"), F.max("turn").alias("last"))
    head = F.concat(F.lit('{"conversation_id":"c'), conv.cast("string"), F.lit('","title":"conversation '), conv.cast("string"), F.lit('","current_node":'), name("k", F.col("last")))
    return trees.select(conv.alias("record_number"), F.concat(head, F.lit(',"mapping":{"root":{"id":"root","parent":null,"message":null},'), F.col("nodes"), F.lit("}}")).alias("raw"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message tree: a chain of turns, and from every fourth turn a second, older branch."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    key = lambda t: F.concat(F.lit("m"), conv, F.lit(":"), t.cast("string"))
    parent = F.when(turn == 0, None).when(turn % 4 == 3, key(turn - 2)).otherwise(key(turn - 1))
    return c.select(
        key(turn).alias("message_key"), key(turn).alias("event_id"), conv.alias("conversation_id"), parent.alias("parent_message_key"),
        "role", turn.cast("int").alias("sequence_number"), (turn % 4 != 3).alias("is_on_current_branch"),
    )


EVENTS_SQL = r"""ev AS (
  SELECT 'm' || conv_id || ':' || turn AS event_id, CASE WHEN conv_id % 23 = 0 THEN 'archive' WHEN conv_id % 5 = 3 THEN 'notes' ELSE 'conversations' END AS source_id,
    CASE WHEN conv_id % 23 = 0 THEN 'letter' WHEN conv_id % 5 = 3 THEN 'note' ELSE 'chat' END AS source_type, 'message:' || conv_id || ':' || turn AS source_record_id,
    CASE WHEN conv_id % 13 <> 0 THEN CAST(conv_id AS VARCHAR) END AS context_id,
    CASE WHEN (conv_id * 7 + turn) % 17 <> 0 THEN make_timestamp((1672531200 + conv_id * 259200 + turn * 60) * 1000000) END AS timestamp_start,
    'conversation ' || conv_id AS title, text, CASE WHEN conv_id % 19 = 0 THEN 'sensitive' ELSE 'private' END AS privacy_level,
    conv_id % 23 <> 0 AS is_active, role <> 'system' AS analysis_enabled, role
  FROM conversations)"""

MESSAGES_SQL = r"""msg AS (
  SELECT 'm' || conv_id || ':' || turn AS event_id, CAST(conv_id AS VARCHAR) AS conversation_id,
    CASE WHEN turn = 0 THEN NULL WHEN turn % 4 = 3 THEN 'm' || conv_id || ':' || (turn - 2) ELSE 'm' || conv_id || ':' || (turn - 1) END AS parent_message_key,
    role, CAST(turn AS INTEGER) AS sequence_number, turn % 4 <> 3 AS is_on_current_branch
  FROM conversations)"""

DOCUMENT_EVENTS_SQL = """ev AS (
  SELECT 'd' || doc_id AS event_id, CAST(NULL AS VARCHAR) AS context_id, make_timestamp((1672531200 + doc_id * 3600) * 1000000) AS timestamp_start,
    text, 'private' AS privacy_level, true AS is_active, true AS analysis_enabled
  FROM documents)"""

EXPORT_SQL = r"""said AS (
  SELECT 'c' || conv_id AS conversation_id, turn, role, text, turn % 4 = 2 AND turn < max(turn) OVER (PARTITION BY conv_id) AS is_side,
    CASE WHEN turn % 5 <> 1 THEN 'said-' || turn WHEN turn % 10 <> 6 THEN 'own-' || turn ELSE 'k' || turn END AS message_id,
    CASE WHEN turn % 8 <> 4 THEN make_timestamp((1672531200 + conv_id * 86400 + turn * 60 - CASE WHEN turn % 4 = 3 THEN 90 ELSE 0 END) * 1000000) END AS created_at,
    CASE WHEN turn % 4 = 3 THEN turn - 2 ELSE turn - 1 END AS above
  FROM conversations),
exported AS (
  SELECT s.conversation_id, s.message_id, p.message_id AS parent_message_id, s.role, s.created_at,
    CASE WHEN s.turn % 9 = 8 THEN NULL WHEN s.turn % 9 = 7 THEN 'recap ' || s.turn WHEN s.turn % 3 = 0 THEN concat_ws(chr(10), nullif(s.text, ''), 'more') ELSE nullif(s.text, '') END AS text,
    CAST(row_number() OVER (PARTITION BY s.conversation_id ORDER BY s.is_side, CASE WHEN s.is_side THEN -s.turn ELSE s.turn END) - 1 AS INTEGER) AS sequence_number,
    CASE s.turn % 9 WHEN 8 THEN 'thoughts' WHEN 7 THEN 'reasoning_recap' ELSE 'text' END AS content_type, NOT s.is_side AS is_on_current_branch
  FROM said s LEFT JOIN said p ON p.conversation_id = s.conversation_id AND p.turn = s.above)"""
