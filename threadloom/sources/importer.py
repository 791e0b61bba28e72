"""Import of an export into the store: normalised events, upsert, soft deletion, run log."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import stable_id
from threadloom.operators import search
from threadloom.operators import store as S
from threadloom.schema import schema
from threadloom.sources import chat_export


def normalized(parsed: DataFrame) -> DataFrame:
    """One row per message in the source-neutral form, with a metadata map."""
    each = parsed.where("messages is not null").select("conversation_id", "title", F.explode("messages").alias("m"))
    named = {"conversation_id": F.col("conversation_id"), "parent_message_id": F.col("m.parent_message_id"), "role": F.col("m.role"), "sequence_number": F.col("m.sequence_number").cast("string"), "content_type": F.col("m.content_type"), "is_on_current_branch": F.col("m.is_on_current_branch").cast("string"), "source_type": F.lit("chatgpt")}
    return each.select(
        F.col("m.message_id").alias("source_record_id"), F.lit("chatgpt_message").alias("event_type"), F.col("m.created_at").alias("timestamp_start"), F.lit(None).cast("timestamp_ntz").alias("timestamp_end"), "title",
        F.col("m.text").alias("text"), F.lit("private").alias("privacy_level"), F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)]).alias("metadata"),
    )


def rows_of(parsed: DataFrame, source_id: str) -> dict[str, DataFrame]:
    """events, conversations and messages of the parsed records. Of records that repeat an id the last one counts."""
    kept = parsed.where("messages is not null")
    last = kept.groupBy("conversation_id").agg(F.max("record_number").alias("record_number"))
    kept = kept.join(last, ["conversation_id", "record_number"], "left_semi")
    now, none = F.current_timestamp().cast("timestamp_ntz"), F.lit(None)
    conv_event = stable_id("conversation", F.col("conversation_id"))
    fill = lambda df: df.select(*[(F.col(f.name) if f.name in df.columns else none).cast(f.dataType).alias(f.name) for f in schema("events")])
    common = {"source_id": F.lit(source_id), "context_id": F.col("conversation_id"), "privacy_level": F.lit("private"), "is_active": F.lit(True), "created_at": now, "updated_at": now}
    of_conversations = kept.withColumns({"event_id": conv_event, "source_record_id": F.concat(F.lit("conversation:"), "conversation_id"), "event_type": F.lit("chatgpt_conversation"), "timestamp_start": F.col("created_at"), "timestamp_end": F.col("updated_at"), "analysis_enabled": F.lit(False), "raw_payload_reference": F.concat(F.lit("conversation:"), "conversation_id")}).withColumns(common)
    each = kept.select("conversation_id", "title", F.explode("messages").alias("m"))
    scoped = F.concat_ws(":", "conversation_id", "m.message_id")
    each = each.withColumns({"event_id": stable_id("message", scoped), "key": stable_id("message-key", scoped), "scoped": scoped})
    of_messages = each.withColumns({"source_record_id": F.concat(F.lit("message:"), "scoped"), "event_type": F.lit("chatgpt_message"), "timestamp_start": F.col("m.created_at"), "text": F.col("m.text"), "analysis_enabled": F.col("m.content_type").isin("text", "multimodal_text"), "raw_payload_reference": F.concat(F.lit("conversation:"), "conversation_id", F.lit("/message:"), "m.message_id")}).withColumns(common)
    parent = F.when(F.col("m.parent_message_id").isNotNull() & (F.col("m.parent_message_id") != ""), stable_id("message-key", F.concat_ws(":", "conversation_id", "m.parent_message_id")))
    return {
        "events": fill(of_conversations.drop("messages")).unionByName(fill(of_messages)),
        "conversations": kept.select("conversation_id", F.lit(source_id).alias("source_id"), conv_event.alias("event_id"), "title", "created_at", "updated_at", F.size("messages").alias("message_count")),
        "messages": each.select(F.col("key").alias("message_key"), "m.message_id", "conversation_id", "event_id", parent.alias("parent_message_key"), "m.parent_message_id", "m.role", "m.created_at", "m.sequence_number", "m.content_type", "m.is_on_current_branch"),
    }


def import_export(spark: SparkSession, path: str, store: S.Store, source_id: str = "chatgpt-default", source_name: str = "ChatGPT") -> dict[str, int]:
    """Idempotent: the same export again changes no rows but updated_at; records that vanished become inactive. All or nothing."""
    parsed = chat_export.parse(chat_export.records(spark, path)).cache()
    new = rows_of(parsed, source_id)
    old = {name: store.read(name) for name in ("events", "conversations", "messages", "sources", "import_runs")}
    tables = {"events": new["events"] if old["events"] is None else S.replace_source(old["events"], new["events"], source_id)}
    for name, keys in (("conversations", ["conversation_id"]), ("messages", ["message_key"])):
        tables[name] = new[name] if old[name] is None else S.upsert(old[name], new[name], keys)
    index = store.read("postings")
    tables["postings"] = search.postings(tables["events"]).sort("term") if index is None or old["events"] is None else search.updated(index, old["events"], tables["events"])
    tables["search_statistics"] = search.statistics(tables["events"], tables["postings"])
    digest = hashlib.sha256(os.path.realpath(path).encode()).hexdigest()
    source = spark.sql("select 1").select(F.lit(source_id).alias("source_id"), F.lit("chatgpt").alias("source_type"), F.lit(source_name).alias("name"), F.current_timestamp().cast("timestamp_ntz").alias("imported_at"), F.lit(None).cast("string").alias("source_version"), F.lit(digest).alias("original_path_hash"), F.create_map(F.lit("format"), F.lit("openai_chatgpt_export")).alias("metadata"))
    tables["sources"] = source if old["sources"] is None else S.upsert(old["sources"], source, ["source_id"])
    counts = parsed.agg(F.count("messages").alias("c"), F.coalesce(F.sum(F.when(F.col("messages").isNotNull(), F.size("messages") + 1)), F.lit(0)).alias("e"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("w")).first()
    run = S.run_row(spark, source_id, digest, int(counts["c"]), int(counts["e"]), int(counts["w"]))
    tables["import_runs"] = run if old["import_runs"] is None else old["import_runs"].unionByName(run)
    store.commit(tables)
    parsed.unpersist()
    return {"conversations": int(counts["c"]), "events": int(counts["e"]), "warnings": int(counts["w"])}
