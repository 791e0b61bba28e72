"""Ingest of a small synthetic export: parsing, idempotence, soft deletion, topics, search, context, API."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from threadloom.api import Api, ApiError, month_range, turn_page
from threadloom.operators.store import Store
from threadloom.sources import chat_export as C
from threadloom.sources import importer


def node(key, parent, text, at=None, role="user", kind="text", **content):
    body = {"content_type": kind, "parts": [text]} | content
    return {"id": key, "parent": parent, "message": {"id": key, "author": {"role": role}, "create_time": at, "content": body}}


def export():
    first = {"id": "c1", "title": "Planting a garden", "create_time": 1709251200, "current_node": "a2", "mapping": {
        "r": {"id": "r", "parent": None, "message": None}, "u": node("u", "r", "garden beds with roses, garden soil", 1709251200),
        "a1": node("a1", "u", "an older answer about roses", 1709251210, "assistant"), "a2": node("a2", "u", "", 1709251220, "assistant")}}
    second = {"id": "c2", "title": "Kitchen", "create_time": "2024-04-02T10:00:00Z", "mapping": {"u": node("u", None, "kitchen garden herbs", None), "p": node("p", "u", "x", 5, kind="multimodal_text", parts=["herbs picture", {"image": 1}, {"text": "more herbs"}])}}
    third = {"title": "Thoughts", "mapping": {"t": node("t", None, "hidden", 1, kind="thoughts"), "k": node("k", "t", None, 2, kind="reasoning_recap", content="kept recap garden"), "bad": 7, "bad2": {"message": "x"}}}
    return [first, second, 42, third]


def write(path, records, name="conversations-000.json"):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(json.dumps(records), encoding="utf-8")
    return str(path)


def parsed(spark, *records):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "record_number long, raw string")
    return [r.asDict(recursive=True) for r in C.parse(rows).orderBy("record_number").collect()]


def test_parse_tree(spark):
    first, second, third, other = parsed(spark, *[export()[k] for k in (0, 1, 3)], {"id": 1})
    assert [(m["message_id"], m["sequence_number"], m["is_on_current_branch"], m["parent_message_id"]) for m in first["messages"]] == [("u", 0, True, None), ("a1", 1, False, "u"), ("a2", 2, True, "u")]
    assert first["messages"][2]["text"] is None and first["messages"][1]["role"] == "assistant" and str(first["created_at"]) == "2024-03-01 00:00:00"
    assert sorted(third["warnings"]) == ["message_node_not_an_object", "message_not_an_object"]
    assert [(m["content_type"], m["text"]) for m in third["messages"]] == [("thoughts", None), ("reasoning_recap", "kept recap garden")]
    assert third["conversation_id"].startswith("missing-id-") and len(third["conversation_id"]) == 35
    assert second["messages"][1]["text"] == "herbs picture\nmore herbs"
    assert other["warnings"] == ["conversation_mapping_missing"] and other["messages"] is None


def test_deep_orphaned_and_cyclic_trees(spark):
    deep = {f"n{i}": node(f"n{i}", f"n{i - 1}" if i else None, "x", i) for i in range(3000)}
    odd = {"a": node("a", "b", "x", 2), "b": node("b", "a", "x", 1), "o": node("o", "gone", "x", "2024-01-01")}
    deeper, odder, none = parsed(spark, {"id": "d", "mapping": deep}, {"id": "o", "mapping": odd, "current_node": "a"}, {"id": "e", "mapping": {}})
    assert [m["message_id"] for m in deeper["messages"]] == [f"n{i}" for i in range(3000)]
    assert [m["message_id"] for m in odder["messages"]] == ["o", "b", "a"] and [m["is_on_current_branch"] for m in odder["messages"]] == [False, True, True]
    assert none["messages"] == [] and none["conversation_id"] == "e"


def test_times(spark):
    values = [True, 1e30, "soon", "2024-04-02T10:00:00Z", "2024-04-02T10:00:00+02:00", 1709251200.5, "5", None, [1], "2024"]
    got = [r["created_at"] for r in parsed(spark, *[{"id": "x", "mapping": {}, "create_time": v} for v in values])]
    assert [None if t is None else str(t) for t in got] == ["1970-01-01 00:00:01", None, None, "2024-04-02 10:00:00", "2024-04-02 10:00:00", "2024-03-01 00:00:00.500000", None, None, None, None]


def test_containers(spark, tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("deep/conversations-000.json", json.dumps(export()))
    assert C.parse(C.records(spark, str(path))).where("messages is not null").count() == 3
    assert C.inspect(spark, str(path)).first()["candidate_files"] == ["conversations-000.json"]
    for name, code in (("../conversations.json", "archive_contains_unsafe_paths"), ("a\\conversations.json", "archive_contains_unsafe_paths"), ("other.json", "conversation_files_not_found")):
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(name, "[]")
        with pytest.raises(C.ExportError, match=code):
            C.validate(str(path))
    with pytest.raises(C.ExportError, match="export_path_not_found"):
        C.validate(str(tmp_path / "none"))


def test_import_search_and_soft_deletion(spark, tmp_path):
    path, store = write(tmp_path / "e", export()), Store(spark, str(tmp_path / "store"))
    assert importer.import_export(spark, path, store) == {"conversations": 3, "events": 10, "warnings": 3}
    assert importer.import_export(spark, path, store)["events"] == 10
    events = store.read("events")
    assert events.count() == 10 and events.where("is_active").count() == 10 and store.read("messages").count() == 7 and store.read("import_runs").count() == 2
    assert C.warnings_of(C.parse(C.records(spark, path))).where("code = 'conversation_record_not_an_object'").first()["record_number"] == 3
    assert importer.normalized(C.parse(C.records(spark, path))).count() == 7
    api = Api(spark, store)
    counters = api.build_topics(1, 100, 5)
    assert counters["documents"] == 4 and counters["topics"] > 0
    garden = api.search_topics("GARDEN")[0]
    assert garden["name"] == "garden" and garden["message_count"] == 2
    assert [m["month"] for m in api.intensity(garden["topic_id"])] == ["2024-03"]
    assert api.intensity("topic-none") == []
    detail = api.topic(garden["topic_id"])
    assert detail["message_count"] == 2 and detail["neighbors"]
    page = api.occurrences(garden["topic_id"], limit=1)
    assert page["total"] == 2 and len(page["items"]) == 1 and page["items"][0]["occurred_at"].startswith("2024-03")
    found = api.search_events("Garden")
    assert found["total"] == 6 and {i["conversation_title"] for i in found["items"]} == {"Planting a garden", "Kitchen", "Thoughts"}
    assert api.search_events("garden", privacy="sensitive")["total"] == 0
    target = events.where("source_record_id = 'message:c1:u'").first()["event_id"]
    assert [m["role"] for m in api.context(target, 2, 1)["messages"]] == ["user", "assistant"] and api.context(target, 2, 1)["messages"][1]["text"] is None
    assert api.meta()["event_count"] == 10 and api.meta()["source_types"] == ["chatgpt"]
    nodes = api.graph(min_occurrences=1, node_limit=3)
    assert len(nodes["nodes"]) == 3
    for call, status in ((lambda: api.topic("no"), 404), (lambda: api.context("no"), 404), (lambda: api.search_events("?!"), 422), (lambda: api.search_topics("x", limit=0), 422), (lambda: api.occurrences("no"), 404)):
        with pytest.raises(ApiError) as e:
            call()
        assert e.value.status == status
    changed = export()[:2]
    changed[0]["mapping"]["a1"]["message"]["content"]["parts"] = ["a zebra among tulips"]
    write(tmp_path / "e", changed)
    importer.import_export(spark, path, store)
    assert [api.search_events(q)["total"] for q in ("zebra", "answer", "garden", "recap")] == [1, 0, 5, 0]  # at once, and nothing that went
    assert store.read("search_statistics").first()["n_all"] == store.read("events").count()
    active = store.read("events").groupBy("is_active").count().collect()
    assert {r["is_active"]: r["count"] for r in active} == {True: 7, False: 3}


def test_topics_fold_text_that_nfkc_changes(spark, tmp_path):
    forms = ("caf\u00e9", "cafe\u0301", "\ufb01nance", "finance", "\uff21\uff22\uff23\uff24", "abcd", "\u03c3\u03bf\u03c6\u03bf\u03c2", "\u03a3\u039f\u03a6\u039f\u03a3")
    store = Store(spark, str(tmp_path / "store"))
    importer.import_export(spark, write(tmp_path / "e", export()), store)
    old = store.read("events").limit(1)
    rows = spark.createDataFrame([(f"e{i}", x) for i, x in enumerate(forms)], "eid string, etext string")
    made = old.crossJoin(rows).withColumns({"event_id": F.col("eid"), "text": F.col("etext"), "is_active": F.lit(True), "analysis_enabled": F.lit(True)}).select(*old.columns)
    store.commit({"events": made})
    api = Api(spark, store)
    api.build_topics(1, 100, 5)
    assert {r["name"]: r["message_count"] for r in store.read("topics").collect()} == {"caf\u00e9": 2, "finance": 2, "abcd": 2, "\u03c3\u03bf\u03c6\u03bf\u03c3": 2}


def test_pages_and_months():
    assert [str(x)[:10] for x in month_range("2024-01", "2024-12")] == ["2024-01-01", "2025-01-01"] and month_range(None, None) == (None, None)
    assert turn_page(25, 10, 10) == {"from": 11, "to": 20, "previous": 0, "next": 20} and turn_page(5, 10, 0)["next"] is None
