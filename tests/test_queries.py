"""Every registered query of the library proper against DuckDB on the smallest tables, and operator edge cases."""

import os

import pytest
from pyspark.sql import functions as F

from threadloom import registry
from threadloom.functions import text as T
from threadloom.operators import context, graph, store, topics

DATA = "/root/testdata/sf0.001"
TABLES = ("nation", "conversations", "documents")


def key(values):
    return tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in values)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(key(r[c] for c in columns) for r in got.collect()) == sorted(key(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


def events(spark, rows):
    full = [{"event_id": f"e{i}", "context_id": None, "title": None, "is_active": True, "analysis_enabled": True, "privacy_level": "private", "timestamp_start": None, "source_type": "x", "role": None, "source_record_id": f"r{i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "event_id string, context_id string, title string, is_active boolean, analysis_enabled boolean, privacy_level string, timestamp_start timestamp_ntz, source_type string, role string, source_record_id string, text string")


def test_totals_are_sums_of_counts(spark):
    ev = events(spark, [{"text": "garden garden garden"}, {"text": "garden soil"}])
    assert {r["term"]: r["cf"] for r in topics.corpus_totals(topics.terms_of(ev)).collect()} == {"garden": 4, "soil": 1, "garden soil": 1}


def test_folding(spark):
    df = spark.createDataFrame([("Straße ＡＢＣ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.exact_fold("t")).collect()] == ["strasse abc", None, ""]
    assert df.select(T.fold(F.col("t"))).first()[0].startswith("strasse")
    import unicodedata

    every = [chr(i) + "x" for i in range(32, 0x2200) if chr(i).isprintable()] + ["ΣΟΦΟΣ", "ｆｕｌｌ", "cafe\u0301"]
    got = spark.createDataFrame([(x,) for x in every], "t string").select("t", T.fold(F.col("t"))).collect()
    assert [(a, b) for a, b in got if b != unicodedata.normalize("NFKC", a).casefold()] == []
    words = spark.createDataFrame([(["a", "b", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in words.select(T.bigrams(F.col("w"))).collect()] == [["a b", "b c"], [], []]


def test_snippet(spark):
    df = spark.createDataFrame([("a \n\t b",), ("x" * 281,), (None,), ("y" * 280,)], "t string")
    assert [r[0] for r in df.select(T.snippet(F.col("t"))).collect()] == ["a b", "x" * 279 + "…", "", "y" * 280]


def test_graph_rules(spark):
    ev = events(spark, [{"text": "t", "context_id": ""} for _ in range(6)] + [{"text": "t", "is_active": False}])
    names = spark.createDataFrame([(k, k, "keyword") for k in "abcd"], "topic_id string, name string, category string")
    links = spark.createDataFrame([(f"e{i}", k, 1.0) for k, n in (("a", 6), ("b", 4), ("c", 2), ("d", 1)) for i in range(n)], "event_id string, topic_id string, weight double")
    nodes, edges = graph.topic_graph(ev, names, links, node_limit=2, selected="c")
    assert [r["topic_id"] for r in nodes.collect()] == ["a", "c"]
    assert [(r["source_topic_id"], r["target_topic_id"], r["message_count"]) for r in edges.collect()] == [("a", "c", 2)]
    nodes, _ = graph.topic_graph(ev, names, links, selected="d")  # below min_occurrences: not added
    assert [r["topic_id"] for r in nodes.collect()] == ["a", "b", "c"]
    nodes, edges = graph.topic_graph(ev, names, links, selected="d", neighbors_only=True)
    assert nodes.count() == 0 and edges.count() == 0
    with pytest.raises(ValueError, match="graph_relation_weight_out_of_range"):
        graph.topic_graph(ev, names, links, min_relation_weight=2)
    with pytest.raises(ValueError, match="graph_limits_must_be_positive"):
        graph.topic_graph(ev, names, links, node_limit=0)
    with pytest.raises(ValueError, match="context_window_out_of_range"):
        context.message_context(ev, ev, "x", before=11)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("s", "1", "x"), ("s", "2", "y")], "source_id string, source_record_id string, v string")
    new = spark.createDataFrame([("s", "2", "z"), ("s", "3", None)], old.schema)
    once = store.upsert(old, new, ["source_id", "source_record_id"])
    twice = store.upsert(once, new, ["source_id", "source_record_id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("s", "1", "x"), ("s", "2", "z"), ("s", "3", None)]


def test_of_rows_that_repeat_a_key_the_latest_counts(spark):
    kind = "source_id string, source_record_id string, v string, updated_at timestamp_ntz"
    old = spark.createDataFrame([], kind)
    new = spark.sql("select 's' source_id, '1' source_record_id, v, cast(t as timestamp_ntz) updated_at from values ('late', '2024-02-01'), ('early', '2024-01-01') as x(v, t)")
    assert store.upsert(old, new, ["source_id", "source_record_id"]).first()["v"] == "late"


def test_store_names_tables_in_manifests(spark, tmp_path):
    one, two = store.Store(spark, str(tmp_path / "s")), store.Store(spark, str(tmp_path / "s"))
    assert one.read("a") is None and one.commit({"a": spark.range(3), "b": spark.range(1)}) == 1
    before = one.manifest()
    assert two.commit({"a": spark.range(5)}) == 2 and one.read("a").count() == 5 and one.manifest()["b"] == before["b"]
    late = store.Store(spark, str(tmp_path / "s"))
    late.version = lambda: 1  # a writer that began before the second commit
    with pytest.raises(RuntimeError, match="store_was_committed_meanwhile"):
        late.commit({"a": spark.range(9)})
    assert one.read("a").count() == 5


def test_snippet_takes_the_best_window(spark):
    from threadloom.operators import search

    words = ["the"] + ["x"] * 60 + ["the", "y", "and"] + ["z"] * 60
    got = spark.createDataFrame([(" ".join(words),), ("the end",), (None,)], "t string").select(search.window_snippet(F.col("t"), "the and")).collect()
    assert "the y and" in got[0][0] and len(got[0][0].split()) == 34 and got[1][0] == "the end" and got[2][0] == ""


def test_stream_matches_batch(spark, tmp_path):
    from threadloom.operators.store import Store
    from threadloom.schema import schema
    from threadloom.streaming import monthly

    base = events(spark, [{"text": "t"}, {"text": "u"}]).withColumns({"source_id": F.lit("s"), "event_type": F.lit("m"), "created_at": F.current_timestamp().cast("timestamp_ntz"), "updated_at": F.current_timestamp().cast("timestamp_ntz"), "timestamp_start": F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")})
    rows = base.select(*[(F.col(f.name) if f.name in base.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema("events").fields])
    rows.write.parquet(str(tmp_path / "in"))
    query = monthly.windowed_counts(monthly.landing(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(message_count) from counts").first()[0] == 2
    made = Store(spark, str(tmp_path / "store"))
    query = monthly.upserting(monthly.landing(spark, str(tmp_path / "in")), made).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert made.read("events").count() == 2
