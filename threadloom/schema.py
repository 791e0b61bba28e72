"""Schemas of the store's tables."""

from __future__ import annotations

from pyspark.sql import types as T

# DDL: the smallest statement of a schema; TIMESTAMP_NTZ is UTC throughout.
TABLES = {
    "sources": "source_id string not null, source_type string not null, name string not null, imported_at timestamp_ntz not null, source_version string, original_path_hash string not null, metadata map<string,string> not null",
    "events": "event_id string not null, source_id string not null, source_record_id string not null, event_type string not null, context_id string, timestamp_start timestamp_ntz, timestamp_end timestamp_ntz, title string, text string, url string, location_id string, privacy_level string not null, is_active boolean not null, analysis_enabled boolean not null, raw_payload_reference string, created_at timestamp_ntz not null, updated_at timestamp_ntz not null",
    "entities": "entity_id string not null, entity_type string not null, name string not null, metadata map<string,string>",
    "event_entities": "event_id string not null, entity_id string not null, relation_type string, confidence double",
    "event_relations": "relation_id string not null, source_event_id string not null, target_event_id string not null, relation_type string, weight double",
    "topics": "topic_id string not null, name string not null, category string not null, message_count int not null, conversation_count int not null, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz",
    "event_topics": "event_id string not null, topic_id string not null, weight double not null",
    "topic_relations": "relation_id string not null, source_topic_id string not null, target_topic_id string not null, message_count int not null, conversation_count int not null, weight double not null",
    "import_runs": "import_run_id string not null, source_id string, started_at timestamp_ntz not null, finished_at timestamp_ntz, status string not null, input_path_hash string not null, imported_conversations int not null, imported_events int not null, warning_count int not null, error_code string",
    "conversations": "conversation_id string not null, source_id string not null, event_id string not null, title string, created_at timestamp_ntz, updated_at timestamp_ntz, message_count int not null",
    "messages": "message_key string not null, message_id string not null, conversation_id string not null, event_id string not null, parent_message_key string, parent_message_id string, role string not null, created_at timestamp_ntz, sequence_number int not null, content_type string not null, is_on_current_branch boolean not null",
}
PRIVACY_LEVELS = ("private", "sensitive", "personal", "public")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
