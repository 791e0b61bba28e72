"""Queries of the library proper over the driver tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import catalog, context, graph, search, store, topics
from threadloom.plans import views
from threadloom.sources import chat_export, importer

LEAST, MOST, PER_EVENT = 5, 500, 5
START, END = datetime.datetime(2023, 2, 1), datetime.datetime(2024, 6, 1)
QUERY = "the and"
TARGET = "m1:2"

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_BUILD = rf"""{views.EVENTS_SQL},
toks AS (SELECT event_id, list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{Nl}}\p{{No}}]{{3,}}'), lambda x: NOT list_contains([{_STOP}], x)) AS w
  FROM ev WHERE is_active AND analysis_enabled AND text IS NOT NULL),
terms AS (SELECT event_id, unnest(list_concat(w, list_filter(list_transform(range(1, greatest(len(w), 1)), lambda i: CASE WHEN w[i] <> w[i + 1] THEN w[i] || ' ' || w[i + 1] END), lambda x: x IS NOT NULL))) AS term FROM toks),
tf AS (SELECT event_id, term, count(*) AS tf FROM terms GROUP BY ALL),
cf AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term),
selected AS (SELECT term, cf FROM cf WHERE cf >= {LEAST} ORDER BY cf DESC, length(term) - length(replace(term, ' ', '')) DESC, term LIMIT {MOST}),
total AS (SELECT count(DISTINCT event_id) AS n FROM tf),
scored AS (SELECT event_id, term, tf * (ln(CAST(n + 1 AS DOUBLE) / (cf + 1)) + 1.0) * (CASE WHEN contains(term, ' ') THEN 1.2 ELSE 1.0 END) AS weight FROM tf JOIN selected USING (term), total),
assigned AS (SELECT event_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, term) AS r FROM scored) WHERE r <= {PER_EVENT}),
et AS (SELECT event_id, 'topic-' || sha256(term) AS topic_id, weight FROM assigned),
placed AS (SELECT a.*, coalesce(nullif(e.context_id, ''), e.event_id) AS context, e.timestamp_start FROM assigned a JOIN ev e USING (event_id)),
topics AS (SELECT 'topic-' || sha256(term) AS topic_id, term AS name, 'keyword' AS category, CAST(count(*) AS INTEGER) AS message_count, CAST(count(DISTINCT context) AS INTEGER) AS conversation_count,
  min(timestamp_start) AS first_seen_at, max(timestamp_start) AS last_seen_at FROM placed GROUP BY term),
sizes AS (SELECT term, count(*) AS n FROM assigned GROUP BY term),
pairs AS (SELECT a.term AS x, b.term AS y, count(*) AS n, count(DISTINCT a.context) AS contexts FROM placed a JOIN placed b ON a.event_id = b.event_id AND a.term < b.term GROUP BY ALL),
relations AS (SELECT 'topic-relation-' || sha256('topic-' || sha256(x) || ':' || 'topic-' || sha256(y)) AS relation_id, 'topic-' || sha256(x) AS source_topic_id, 'topic-' || sha256(y) AS target_topic_id,
  CAST(p.n AS INTEGER) AS message_count, CAST(contexts AS INTEGER) AS conversation_count, p.n / sqrt(CAST(a.n * b.n AS DOUBLE)) AS weight FROM pairs p JOIN sizes a ON a.term = x JOIN sizes b ON b.term = y),
one AS (SELECT topic_id FROM topics ORDER BY message_count DESC, name LIMIT 1),
shown AS (SELECT * FROM ev WHERE is_active AND privacy_level = 'private')"""
_ACTIVE = "is_active AND privacy_level = 'private'"
_RANGE = "timestamp_start >= TIMESTAMP '2023-02-01' AND timestamp_start < TIMESTAMP '2024-06-01'"


def _graph_sql(where: str, least: int, weight: float, limit: int, selected: str | None = None) -> str:
    """Nodes and edges as CTEs after _BUILD; selected: an SQL expression."""
    keep = f"r <= {limit}" if selected is None else f"CASE WHEN (SELECT r FROM ranked WHERE topic_id = {selected}) > {limit} THEN r < {limit} OR topic_id = {selected} ELSE r <= {limit} END"
    return f"""{_BUILD},
rows_ AS (SELECT t.topic_id, t.name, t.category, e.event_id, coalesce(nullif(e.context_id, ''), e.event_id) AS context, e.timestamp_start FROM et JOIN topics t USING (topic_id) JOIN ev e USING (event_id) WHERE {where}),
stats AS (SELECT topic_id, name, category, count(DISTINCT event_id) AS message_count, count(DISTINCT context) AS context_count, min(timestamp_start) AS first_seen_at, max(timestamp_start) AS last_seen_at
  FROM rows_ GROUP BY ALL HAVING count(DISTINCT event_id) >= {least}),
ranked AS (SELECT *, row_number() OVER (ORDER BY message_count DESC, name, topic_id) AS r FROM stats),
nodes AS (SELECT CAST(row_number() OVER (ORDER BY message_count DESC, name, topic_id) AS INTEGER) AS rank, topic_id, name, category, message_count, context_count, first_seen_at, last_seen_at FROM ranked WHERE {keep}),
seen AS (SELECT DISTINCT event_id, topic_id, context FROM rows_ WHERE topic_id IN (SELECT topic_id FROM nodes)),
both_ AS (SELECT a.topic_id AS s, b.topic_id AS t, count(*) AS n, count(DISTINCT a.context) AS contexts FROM seen a JOIN seen b ON a.event_id = b.event_id AND a.topic_id < b.topic_id GROUP BY ALL),
edges AS (SELECT s AS source_topic_id, t AS target_topic_id, n AS message_count, contexts AS context_count, n / sqrt(CAST(x.message_count * y.message_count AS DOUBLE)) AS weight
  FROM both_ JOIN nodes x ON x.topic_id = s JOIN nodes y ON y.topic_id = t WHERE n / sqrt(CAST(x.message_count * y.message_count AS DOUBLE)) >= {weight})"""


class _World:
    """What queries share in one session and folder: the event view and the topics built from it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.events = views.events(spark, sf_dir)
        self.messages = views.messages(spark, sf_dir)
        self.documents = views.document_events(spark, sf_dir)
        self.sources = views.sources(spark)
        self.parsed = lambda: chat_export.parse(views.export_records(spark, sf_dir))

    @property
    def built(self) -> topics.Topics:
        return topics.build_topics(self.events, LEAST, MOST, PER_EVENT)

    def topic(self, built: topics.Topics) -> str:
        """The most frequent topic: the example of the queries about one."""
        row = built.topics.orderBy(F.desc("message_count"), "name").select("topic_id").first()
        return row[0] if row else ""


def _graph(w: _World, **how):
    b = w.built
    if how.pop("last", False):
        how["selected"] = w.topic(b) if "rank_from_end" not in how else None
    return graph.topic_graph(w.events, b.topics, b.event_topics, **how)


def _rare_topic(w: _World, b: topics.Topics) -> str:
    """An eligible topic far down the ranks."""
    row = b.topics.where("message_count >= 8").orderBy("message_count", F.desc("name")).select("topic_id").first()
    return row[0] if row else ""


_RARE_SQL = "(SELECT topic_id FROM topics WHERE message_count >= 8 ORDER BY message_count, name DESC LIMIT 1)"


def _selected_graph(w: _World, neighbors_only: bool):
    b = w.built
    return graph.topic_graph(w.events, b.topics, b.event_topics, min_relation_weight=0.02, node_limit=20, selected=_rare_topic(w, b), neighbors_only=neighbors_only)


def _about(w: _World, fn) -> DataFrame:
    b = w.built
    return fn(b, w.topic(b))


_ENTRIES: dict[str, tuple[Callable[[_World], DataFrame], str | None]] = {}


def _entry(name: str, sql: str | None):
    def keep(fn):
        _ENTRIES[name] = (fn, sql)
        return fn

    return keep


def _with(sql: str, select: str) -> str:
    return f"WITH {sql}\n{select}"


_EV = views.EVENTS_SQL
_FTS = rf"""{_EV},
words AS (SELECT event_id, list_concat(regexp_extract_all(strip_accents(lower(coalesce(title, ''))), '[\p{{L}}\p{{N}}]+'), regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+')) AS w FROM ev),
post AS (SELECT term, event_id, count(*) AS tf, any_value(size) AS size FROM (SELECT event_id, len(w) AS size, unnest(w) AS term FROM words) GROUP BY term, event_id),
hit AS (SELECT event_id FROM post WHERE term IN ('the', 'and') GROUP BY event_id HAVING count(DISTINCT term) = 2),
stat AS (SELECT count(*) AS n_all, avg(len(w)) AS mean FROM words),
freq AS (SELECT term, count(*) AS n FROM post WHERE term IN ('the', 'and') GROUP BY term),
score AS (SELECT event_id, -sum((CASE WHEN ln((n_all - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_all - n + 0.5) / (n + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS bm25
  FROM post JOIN hit USING (event_id) JOIN freq USING (term), stat GROUP BY event_id)"""
_SNIP = r"CASE WHEN length(f) > 280 THEN rtrim(left(f, 279)) || '…' ELSE f END"

_KINDS = "CASE WHEN contains(name, ' ') THEN 'phrase' ELSE 'keyword' END"


def _kinds(b: topics.Topics) -> DataFrame:
    """Built topics in two categories: words and phrases."""
    return b.topics.withColumn("category", F.when(F.col("name").contains(" "), "phrase").otherwise("keyword"))


_entry("catalog_meta", _with(_BUILD, f"""SELECT min(timestamp_start) AS earliest, max(timestamp_start) AS latest, count(event_id) AS event_count, (SELECT count(DISTINCT topic_id) FROM et JOIN ev e USING (event_id) WHERE e.is_active) AS topic_count, (SELECT count(*) FROM relations) AS relation_count,
  (SELECT string_agg(DISTINCT source_type, ',' ORDER BY source_type) FROM ev WHERE is_active) AS source_types, (SELECT coalesce(string_agg(DISTINCT {_KINDS}, ',' ORDER BY {_KINDS}), '') FROM topics) AS categories FROM ev WHERE is_active"""))(
    lambda w: (lambda b: catalog.meta(w.events, _kinds(b), b.event_topics, b.relations).withColumns({"source_types": F.array_join("source_types", ","), "categories": F.array_join("categories", ",")}))(w.built)
)
_entry("distinct_source_types", _with(_EV, "SELECT DISTINCT source_type FROM ev WHERE is_active"))(lambda w: catalog.source_types(w.sources, w.events))
_entry("source_type_filter", _with(_EV, f"SELECT event_id FROM ev WHERE {_ACTIVE} AND source_type = 'note'"))(lambda w: catalog.visible(w.events, source_type="note").select("event_id"))
_entry("active_privacy_filter", _with(_EV, f"SELECT event_id, context_id FROM ev WHERE {_ACTIVE}"))(lambda w: catalog.visible(w.events).select("event_id", "context_id"))
_entry("time_range_half_open", _with(_EV, f"SELECT event_id, timestamp_start FROM ev WHERE {_ACTIVE} AND {_RANGE}"))(lambda w: catalog.visible(w.events, start=START, end=END).select("event_id", "timestamp_start"))
_entry("category_in", _with(_graph_sql(f"{_ACTIVE} AND contains(t.name, ' ')", 2, 0.0, 50), "SELECT topic_id, name, 'phrase' AS category, message_count FROM nodes"))(
    lambda w: (lambda b: graph.topic_graph(w.events, _kinds(b), b.event_topics, categories=["phrase", "place"], node_limit=50)[0].select("topic_id", "name", "category", "message_count"))(w.built)
)
_entry("analysis_documents", _with(_BUILD, "SELECT count(DISTINCT event_id) AS documents FROM tf"))(lambda w: topics.analysed_documents(topics.totals_of(w.events)))
_entry("bigrams", _with(_BUILD, "SELECT event_id, term FROM terms WHERE contains(term, ' ')"))(
    lambda w: topics.analysed(w.events).select("event_id", F.explode(T.bigrams(T.tokens(T.fold(F.col("text"))))).alias("term"))
)
_entry("term_frequencies", _with(_BUILD, "SELECT event_id, term, tf FROM tf"))(lambda w: topics.term_counts(w.events))
_entry("corpus_term_totals", _with(_BUILD, "SELECT term, cf FROM cf"))(lambda w: topics.corpus_totals(topics.terms_of(w.events)))
_entry("selected_terms", _with(_BUILD, "SELECT term, cf FROM selected"))(lambda w: topics.select_terms(topics.totals_of(w.events), LEAST, MOST))
_entry("event_topic_assignments", _with(_BUILD, "SELECT event_id, topic_id, round(weight, 6) AS weight FROM et"))(lambda w: w.built.event_topics.withColumn("weight", F.round("weight", 6)))
_entry("topic_build_topics", _with(_BUILD, "SELECT * FROM topics"))(lambda w: w.built.topics)
_entry("topic_relations", _with(_BUILD, "SELECT relation_id, source_topic_id, target_topic_id, message_count, conversation_count, round(weight, 6) AS weight FROM relations"))(lambda w: w.built.relations.withColumn("weight", F.round("weight", 6)))
_entry("build_counters", _with(_BUILD, "SELECT (SELECT count(DISTINCT event_id) FROM tf) AS documents, (SELECT count(*) FROM topics) AS topics, (SELECT count(*) FROM assigned) AS assignments, (SELECT count(*) FROM relations) AS relations"))(lambda w: w.built.counters)
_MONTHS = f"SELECT strftime(timestamp_start, '%Y-%m') AS month, count(*) AS message_count, round(sum(weight), 6) AS weight FROM et JOIN ev USING (event_id) WHERE topic_id = (SELECT topic_id FROM one) AND {_ACTIVE} AND timestamp_start IS NOT NULL GROUP BY 1"
_entry("topic_monthly_intensity", _with(_BUILD, _MONTHS))(lambda w: _about(w, lambda b, t: topics.monthly_intensity(w.events, b.event_topics, t).withColumn("weight", F.round("weight", 6))))
_entry("intensity_bars", _with(_BUILD, f"SELECT month, greatest(5.0, message_count / max(message_count) OVER () * 100) AS height FROM ({_MONTHS})"))(lambda w: _about(w, lambda b, t: graph.intensity_bars(topics.monthly_intensity(w.events, b.event_topics, t))))
_STATS = "count(DISTINCT event_id) AS message_count, count(DISTINCT coalesce(context_id, event_id)) AS context_count, min(timestamp_start) AS first_seen_at, max(timestamp_start) AS last_seen_at"
_entry("topic_search", _with(_BUILD, f"SELECT topic_id, name, category, {_STATS} FROM (SELECT t.topic_id, t.name, t.category, s.* FROM et JOIN topics t USING (topic_id) JOIN shown s USING (event_id) WHERE lower(t.name) LIKE '%th%') GROUP BY ALL ORDER BY message_count DESC, name LIMIT 20"))(
    lambda w: (lambda b: catalog.search_topics(w.events, b.topics, b.event_topics, " TH "))(w.built)
)
_entry("topic_summary", _with(_BUILD, f"SELECT {_STATS} FROM et JOIN shown USING (event_id) WHERE topic_id = (SELECT topic_id FROM one)"))(lambda w: _about(w, lambda b, t: catalog.topic_summary(w.events, b.event_topics, t)))
_NEAR = """vis AS (SELECT et.event_id, topic_id, coalesce(context_id, event_id) AS context FROM et JOIN shown USING (event_id)), tgt AS (SELECT DISTINCT event_id FROM vis WHERE topic_id = (SELECT topic_id FROM one)),
near AS (SELECT topic_id, count(*) AS message_count, count(DISTINCT context) AS context_count FROM vis WHERE event_id IN (SELECT event_id FROM tgt) AND topic_id <> (SELECT topic_id FROM one) GROUP BY topic_id)"""
_NEIGHBORS = """SELECT topic_id, t.name, t.category, n.message_count, n.context_count, n.message_count / sqrt(CAST((SELECT count(*) FROM tgt) * (SELECT count(DISTINCT event_id) FROM vis v WHERE v.topic_id = n.topic_id) AS DOUBLE)) AS weight
FROM near n JOIN topics t USING (topic_id) ORDER BY weight DESC, name LIMIT 12"""
_entry("topic_neighbors", _with(f"{_BUILD},\n{_NEAR}", _NEIGHBORS))(lambda w: _about(w, lambda b, t: catalog.topic_neighbors(w.events, b.topics, b.event_topics, t)))
_entry("neighbor_percentages", _with(f"{_BUILD},\n{_NEAR}", f"SELECT topic_id, CAST(floor(weight * 100 + 0.5) AS INTEGER) AS percent FROM ({_NEIGHBORS})"))(
    lambda w: _about(w, lambda b, t: catalog.topic_neighbors(w.events, b.topics, b.event_topics, t).select("topic_id", graph.percentage(F.col("weight")).alias("percent")))
)
_DETAIL = f"""{_BUILD},
{_NEAR},
months_ AS ({_MONTHS}), neighbors_ AS ({_NEIGHBORS}), summary AS (SELECT {_STATS} FROM et JOIN shown USING (event_id) WHERE topic_id = (SELECT topic_id FROM one))"""
_entry("topic_detail", _with(_DETAIL, """SELECT t.topic_id, t.name, t.category, s.message_count, s.context_count, s.first_seen_at, s.last_seen_at, (SELECT string_agg(month || ':' || message_count, ',' ORDER BY month) FROM months_) AS months,
  (SELECT string_agg(name || ':' || message_count || ':' || context_count, ',' ORDER BY weight DESC, name) FROM neighbors_) AS neighbors FROM topics t JOIN one USING (topic_id), summary s"""))(
    lambda w: _about(w, lambda b, t: catalog.topic_detail(w.events, b.topics, b.event_topics, t).withColumns({"months": F.expr("array_join(transform(months, m -> concat(m.month, ':', m.message_count)), ',')"), "neighbors": F.expr("array_join(transform(neighbors, n -> concat_ws(':', n.name, n.message_count, n.context_count)), ',')")}))
)
_OCC = rf"SELECT event_id, timestamp_start AS occurred_at, role, title AS conversation_title, {_SNIP} AS snippet, source_record_id FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM shown WHERE event_id IN (SELECT event_id FROM et WHERE topic_id = (SELECT topic_id FROM one)) AND {_RANGE} AND source_type = 'chat')"
_occurrences = lambda w: _about(w, lambda b, t: catalog.occurrences(w.events, b.event_topics, t, START, END, "chat"))
_entry("topic_occurrences_page", _with(_BUILD, f"{_OCC} ORDER BY occurred_at DESC NULLS LAST, event_id LIMIT 10 OFFSET 5"))(lambda w: catalog.page(_occurrences(w), 10, 5))
_entry("occurrence_total", _with(_BUILD, f"SELECT count(*) AS total FROM ({_OCC})"))(lambda w: _occurrences(w).agg(F.count("*").alias("total")))
_entry("snippet_280", rf"SELECT conv_id, turn, {_SNIP} AS snippet FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM conversations)")(
    lambda w: w.events.select(F.split("event_id", ":")[1].cast("long").alias("turn"), F.substring(F.split("event_id", ":")[0], 2, 30).cast("long").alias("conv_id"), T.snippet(F.col("text")).alias("snippet"))
)
_entry("graph_nodes", _with(_graph_sql(_ACTIVE, 2, 0.0, 100), "SELECT * FROM nodes"))(lambda w: _graph(w)[0])
_entry("graph_edges", _with(_graph_sql(f"{_ACTIVE} AND {_RANGE} AND source_type = 'chat' AND NOT contains(t.name, ' ')", 3, 0.15, 100), "SELECT source_topic_id, target_topic_id, message_count, context_count, round(weight, 6) AS weight FROM edges"))(
    lambda w: (lambda b: graph.topic_graph(w.events, _kinds(b), b.event_topics, start=START, end=END, source_type="chat", categories=["keyword"], min_occurrences=3, min_relation_weight=0.15)[1].withColumn("weight", F.round("weight", 6)))(w.built)
)
_entry("graph_nodes_selected", _with(_graph_sql(_ACTIVE, 2, 0.02, 20, _RARE_SQL), "SELECT * FROM nodes"))(lambda w: _selected_graph(w, False)[0])
_EGO = f", ends AS (SELECT source_topic_id AS e FROM edges WHERE target_topic_id = {_RARE_SQL} UNION SELECT target_topic_id FROM edges WHERE source_topic_id = {_RARE_SQL} UNION SELECT {_RARE_SQL})"
_entry("graph_edges_neighbors_only", _with(_graph_sql(_ACTIVE, 2, 0.02, 20, _RARE_SQL) + _EGO, "SELECT source_topic_id, target_topic_id, message_count, context_count, round(weight, 6) AS weight FROM edges WHERE source_topic_id IN (SELECT e FROM ends) AND target_topic_id IN (SELECT e FROM ends)"))(
    lambda w: _selected_graph(w, True)[1].withColumn("weight", F.round("weight", 6))
)
_entry("node_sizes", _with(_graph_sql(_ACTIVE, 2, 0.0, 100), "SELECT topic_id, round(least(13.0, 3 + log2(message_count + 1) * 0.85), 9) AS size, message_count >= (SELECT message_count FROM nodes ORDER BY message_count DESC OFFSET 14 LIMIT 1) AS shows_label FROM nodes"))(lambda w: graph.node_sizes(_graph(w)[0]).withColumn("size", F.round("size", 9)))
_entry("edge_sizes", _with(_graph_sql(_ACTIVE, 2, 0.15, 100), "SELECT source_topic_id, target_topic_id, round(least(2.2, 0.2 + 2 * sqrt(weight)), 9) AS size FROM edges"))(lambda w: graph.edge_sizes(_graph(w, min_relation_weight=0.15)[1]).withColumn("size", F.round("size", 9)))
_entry("fts_match_and", _with(_FTS, "SELECT event_id FROM hit"))(lambda w: search.match_all(search.postings(w.events), QUERY))
_entry("fts_bm25_page", _with(_FTS, f"SELECT e.event_id, timestamp_start AS occurred_at, role, title AS conversation_title, source_record_id, round(bm25, 9) AS bm25 FROM score JOIN ev e USING (event_id) WHERE {_ACTIVE} ORDER BY score.bm25, timestamp_start DESC NULLS LAST, e.event_id LIMIT 20"))(
    lambda w: search.search_page(search.search_events(w.events, search.postings(w.events), QUERY)).withColumn("bm25", F.round("bm25", 9))
)
_BEST = rf"""{_FTS},
page AS (SELECT e.event_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM score JOIN ev e USING (event_id) WHERE {_ACTIVE} ORDER BY score.bm25, timestamp_start DESC NULLS LAST, e.event_id LIMIT 20),
hits AS (SELECT event_id, i FROM (SELECT event_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM page) WHERE list_has_any(regexp_extract_all(strip_accents(lower(ws[i])), '[\p{{L}}\p{{N}}]+'), ['and', 'the'])),
toks AS (SELECT event_id, i, t FROM (SELECT event_id, i, unnest(regexp_extract_all(strip_accents(lower(ws[i])), '[\p{{L}}\p{{N}}]+')) AS t FROM (SELECT event_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM page)) WHERE t IN ('and', 'the')),
wins AS (SELECT h.event_id, h.i, count(DISTINCT t) AS n, max(toks.i) AS z FROM hits h JOIN toks ON toks.event_id = h.event_id AND toks.i BETWEEN h.i AND h.i + 31 GROUP BY ALL),
best AS (SELECT event_id, i, z FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, i) AS r FROM wins) WHERE r = 1),
placed AS (SELECT event_id, ws, greatest(1, least(coalesce(i, 1) - greatest((32 - (coalesce(z, 1) - coalesce(i, 1) + 1)) // 2, 0), len(ws) - 31)) AS s FROM page LEFT JOIN best USING (event_id)),
cut AS (SELECT event_id, (CASE WHEN s > 1 THEN ' … ' ELSE '' END) || array_to_string(ws[s : s + 31], ' ') || (CASE WHEN s + 32 <= len(ws) THEN ' … ' ELSE '' END) AS c FROM placed)"""
_entry("fts_snippet", _with(_BEST, rf"SELECT event_id, {_SNIP} AS snippet FROM (SELECT event_id, trim(regexp_replace(c, '\s+', ' ', 'g')) AS f FROM cut)"))(
    lambda w: search.with_snippets(search.search_page(search.search_events(w.events, search.postings(w.events), QUERY)), w.events, QUERY).select("event_id", "snippet")
)
_entry("best_child", _with(views.MESSAGES_SQL, "SELECT parent_message_key AS key, event_id AS child FROM (SELECT *, row_number() OVER (PARTITION BY parent_message_key ORDER BY CASE WHEN is_on_current_branch THEN 0 ELSE 1 END, sequence_number) AS r FROM msg WHERE parent_message_key IS NOT NULL) WHERE r = 1"))(lambda w: context.best_children(w.messages))
_WALK = f"""RECURSIVE {views.MESSAGES_SQL}, {_EV},
best AS (SELECT parent_message_key AS key, event_id AS child FROM (SELECT *, row_number() OVER (PARTITION BY parent_message_key ORDER BY CASE WHEN is_on_current_branch THEN 0 ELSE 1 END, sequence_number) AS r FROM msg WHERE parent_message_key IS NOT NULL) WHERE r = 1),
up AS (SELECT event_id, parent_message_key, 0 AS position FROM msg WHERE event_id = '{TARGET}' UNION ALL SELECT m.event_id, m.parent_message_key, position - 1 FROM up JOIN msg m ON m.event_id = up.parent_message_key WHERE position > -2),
down AS (SELECT '{TARGET}' AS event_id, 0 AS position UNION ALL SELECT child, position + 1 FROM down JOIN best ON key = down.event_id WHERE position < 3),
path AS (SELECT event_id, position FROM up UNION SELECT event_id, position FROM down)"""
_entry("message_context", _with(_WALK, f"SELECT m.conversation_id, e.title AS conversation_title, CAST(position AS INTEGER) AS position, p.event_id, m.role, e.timestamp_start AS created_at, e.text, m.sequence_number, p.event_id = '{TARGET}' AS is_target FROM path p JOIN msg m USING (event_id) JOIN ev e USING (event_id)"))(
    lambda w: context.message_context(w.messages, w.events, TARGET, 2, 3)
)
_entry("month_of_date", _with(_EV, "SELECT event_id, coalesce(strftime(timestamp_start, '%Y-%m'), '') AS month FROM ev"))(lambda w: w.events.select("event_id", graph.month_of(F.col("timestamp_start")).alias("month")))
_HASHED = "list_reduce(list_transform(string_split(n_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: "
_entry("node_positions", f"SELECT n_name, round(cos(h / 4294967295.0 * 2 * pi()) * (1 + ((h >> 8) % 1000) / 400.0), 9) AS x, round(sin(h / 4294967295.0 * 2 * pi()) * (1 + ((h >> 8) % 1000) / 400.0), 9) AS y FROM (SELECT n_name, {_HASHED}(xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS h FROM nation)")(
    lambda w: w.nation.select("n_name", *[F.round(c, 9).alias(n) for c, n in zip(graph.position(F.col("n_name")), "xy", strict=True)])
)
_entry("category_colours", f"SELECT n_name, CAST({_HASHED}(h * 31 + c) % 4294967296, CAST(0 AS BIGINT)) % 5 AS INTEGER) AS colour FROM nation")(lambda w: w.nation.select("n_name", graph.colour_number(F.col("n_name")).alias("colour")))
_entry("export_messages", _with(views.EXPORT_SQL, "SELECT * FROM exported"))(lambda w: w.parsed().select("conversation_id", F.inline("messages")))
_entry("export_conversations", _with(views.EXPORT_SQL, "SELECT conversation_id, 'conversation ' || substr(conversation_id, 2) AS title, CAST(count(*) AS INTEGER) AS message_count, 0 AS warnings FROM exported GROUP BY ALL"))(
    lambda w: w.parsed().select("conversation_id", "title", F.size("messages").alias("message_count"), F.size("warnings").alias("warnings"))
)
_SCOPED = "conversation_id || ':' || message_id"
_entry("import_messages", _with(views.EXPORT_SQL, f"SELECT 'chatgpt-message-key-' || sha256('chatgpt:message-key:' || {_SCOPED}) AS message_key, 'chatgpt-message-' || sha256('chatgpt:message:' || {_SCOPED}) AS event_id, 'chatgpt-message-key-' || sha256('chatgpt:message-key:' || conversation_id || ':' || parent_message_id) AS parent_message_key, conversation_id, sequence_number FROM exported"))(
    lambda w: importer.rows_of(w.parsed(), "export")["messages"].select("message_key", "event_id", "parent_message_key", "conversation_id", "sequence_number")
)
_entry("import_events", _with(views.EXPORT_SQL, f"SELECT 'message:' || {_SCOPED} AS source_record_id, conversation_id AS context_id, created_at AS timestamp_start, 'conversation ' || substr(conversation_id, 2) AS title, text, content_type = 'text' AS analysis_enabled FROM exported UNION ALL SELECT DISTINCT 'conversation:' || conversation_id, conversation_id, CAST(NULL AS TIMESTAMP), 'conversation ' || substr(conversation_id, 2), NULL, false FROM exported"))(
    lambda w: importer.rows_of(w.parsed(), "export")["events"].select("source_record_id", "context_id", "timestamp_start", "title", "text", "analysis_enabled")
)
_entry("normalized_messages", _with(views.EXPORT_SQL, "SELECT message_id AS source_record_id, created_at AS timestamp_start, text, parent_message_id AS parent, CAST(is_on_current_branch AS VARCHAR) AS on_branch, 'chatgpt' AS source_type FROM exported"))(
    lambda w: importer.normalized(w.parsed()).select("source_record_id", "timestamp_start", "text", F.col("metadata")["parent_message_id"].alias("parent"), F.col("metadata")["is_on_current_branch"].alias("on_branch"), F.col("metadata")["source_type"].alias("source_type"))
)
_entry("topic_build_documents", _with(_BUILD.replace(views.EVENTS_SQL, views.DOCUMENT_EVENTS_SQL), "SELECT * FROM topics"))(lambda w: topics.build_topics(w.documents, LEAST, MOST, PER_EVENT).topics)
_OLD, _NEW = "turn % 3 <> 0", "turn % 3 <> 1"


def _old_new(w: _World) -> tuple[DataFrame, DataFrame]:
    each = w.events.select("source_id", "source_record_id", "title", "is_active", F.lit("2023-01-01").alias("created_at"), F.lit("2023-01-01").alias("updated_at"), F.split("event_id", ":")[1].cast("long").alias("turn"))
    new = each.where(_NEW).withColumns({"title": F.concat("title", F.lit(" again")), "is_active": F.lit(True), "created_at": F.lit("2024-01-01"), "updated_at": F.lit("2024-01-01")})
    return each.where(_OLD).drop("turn"), new.drop("turn")


_UPSERT = f"""{_EV},
each AS (SELECT source_id, source_record_id, title, is_active, CAST(split_part(event_id, ':', 2) AS BIGINT) AS turn FROM ev),
a AS (SELECT *, '2023-01-01' AS d FROM each WHERE {_OLD}), b AS (SELECT *, '2024-01-01' AS d FROM each WHERE {_NEW})"""
_entry("upsert_merge", _with(_UPSERT, "SELECT coalesce(b.source_id, a.source_id) AS source_id, coalesce(b.source_record_id, a.source_record_id) AS source_record_id, CASE WHEN b.source_record_id IS NULL THEN a.title ELSE b.title || ' again' END AS title, CASE WHEN b.source_record_id IS NULL THEN a.is_active ELSE true END AS is_active, coalesce(a.d, b.d) AS created_at, coalesce(b.d, a.d) AS updated_at FROM a FULL JOIN b ON a.source_id = b.source_id AND a.source_record_id = b.source_record_id"))(
    lambda w: store.upsert(*_old_new(w), ["source_id", "source_record_id"], keep_old=["created_at"])
)
_entry("soft_delete", _with(_UPSERT, "SELECT coalesce(b.source_record_id, a.source_record_id) AS source_record_id, CASE WHEN b.source_record_id IS NOT NULL THEN true WHEN a.source_id = 'conversations' THEN false ELSE a.is_active END AS is_active FROM a FULL JOIN b ON a.source_id = b.source_id AND a.source_record_id = b.source_record_id"))(
    lambda w: store.replace_source(*_old_new(w), "conversations").select("source_record_id", "is_active")
)
_entry("replace_keyword_topics", _with(_BUILD, "SELECT name, category FROM topics UNION ALL SELECT n_name, 'place' FROM nation"))(
    lambda w: (lambda made, nations: topics.replace_keyword_topics(nations.select(F.col("n_name").alias("name"), F.lit("place").alias("category")).unionByName(made.select("name", "category")), made.select("name", "category")))(w.built.topics, w.nation)
)
_entry("stable_ids", "SELECT conv_id, turn, 'chatgpt-message-' || sha256('chatgpt:message:' || conv_id || ':' || turn) AS event_id FROM conversations")(
    lambda w: w.conversations.select("conv_id", "turn", T.stable_id("message", F.concat_ws(":", "conv_id", "turn")).alias("event_id"))
)
_entry("parse_timestamps", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN make_timestamp((1672531200 + conv_id * 86400 + turn) * 1000000) WHEN 1 THEN make_timestamp((1672531200 + conv_id * 3600) * 1000000) END AS ts FROM conversations")(
    lambda w: w.conversations.select("conv_id", "turn", F.try_parse_json(F.when(F.col("turn") % 3 == 0, (F.lit(views.START) + F.col("conv_id") * 86400 + F.col("turn")).cast("string")).when(F.col("turn") % 3 == 1, F.date_format(F.timestamp_seconds(F.lit(views.START) + F.col("conv_id") * 3600), "'\"'yyyy-MM-dd'T'HH:mm:ss'Z\"'")).otherwise('"no time"')).alias("v"))
    .select("conv_id", "turn", chat_export.instant("v").alias("ts"))
)
_entry("point_lookup", _with(_EV, f"SELECT event_id, role, text FROM ev WHERE event_id = '{TARGET}'"))(lambda w: w.events.where(F.col("event_id") == TARGET).select("event_id", "role", "text").limit(1))
_entry("conversation_message_counts", "SELECT conv_id, count(*) AS message_count FROM conversations GROUP BY conv_id")(lambda w: w.conversations.groupBy("conv_id").agg(F.count("*").alias("message_count")))
_entry("streaming_monthly_counts", _with(_EV, "SELECT strftime(timestamp_start, '%Y-%m') AS month, count(*) AS message_count FROM ev WHERE is_active AND timestamp_start IS NOT NULL GROUP BY 1"))(lambda w: store.monthly_counts(w.events))


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = _World(spark, sf_dir)
        w.nation, w.conversations = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/conversations.parquet")
        return _ENTRIES[name][0](w)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic build."""
    return _query("topic_build_topics")(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in _ENTRIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ENTRIES.items() if sql}
