"""Full-text search: postings, conjunctive match, BM25, snippets."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.catalog import visible

K1, B = 1.2, 0.75


def postings(events: DataFrame) -> DataFrame:
    """(term, event_id, tf, size): over title and text of every event, inactive ones too. Written sorted by term, a search reads few row groups."""
    words = events.select("event_id", F.concat(T.search_tokens(F.coalesce("title", F.lit(""))), T.search_tokens(F.coalesce("text", F.lit("")))).alias("w"))
    each = words.select("event_id", F.size("w").alias("size"), F.explode("w").alias("term"))
    return each.groupBy("term", "event_id").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def match_all(index: DataFrame, query: str) -> DataFrame:
    """Events that hold every term of the query."""
    terms = sorted(set(T.query_terms(query)))
    return index.where(F.col("term").isin(terms)).groupBy("event_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(terms)).select("event_id")


def changed(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of `new` whose title or text is not that of `old`, and the ids whose postings go: the same, and events that vanished."""
    a, b = (df.select("event_id", F.xxhash64("title", "text").alias(c)) for df, c in ((old, "was"), (new, "is")))
    ids = a.join(b, "event_id", "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select("event_id")
    return new.join(ids, "event_id", "left_semi"), ids


def updated(index: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings after `old` events became `new`: only the texts that changed are cut into words again."""
    fresh, gone = changed(old, new)
    return index.join(gone, "event_id", "left_anti").unionByName(postings(fresh).select(index.columns)).sort("term")


def statistics(events: DataFrame, index: DataFrame) -> DataFrame:
    """One row: number of events, and mean number of words; kept beside the postings."""
    total = index.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
    return events.agg(F.count("*").alias("n_all")).crossJoin(total).select("n_all", F.try_divide("words", "n_all").alias("mean"))  # rows of one


def bm25(events: DataFrame, index: DataFrame, query: str, stats: DataFrame | None = None) -> DataFrame:
    """(event_id, bm25), smaller is better: statistics over all events, repeated query terms count again."""
    terms = Counter(T.query_terms(query))
    sizes = statistics(events, index) if stats is None else stats
    hits = index.where(F.col("term").isin(list(terms)))
    counted = hits.groupBy("term").agg(F.count("*").alias("n"))
    joined = hits.join(match_all(index, query), "event_id", "left_semi").join(F.broadcast(counted), "term").crossJoin(F.broadcast(sizes))  # rows: the query's terms; one
    idf = F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    times = F.element_at(F.create_map(*[x for t, k in terms.items() for x in (F.lit(t), F.lit(k))]), F.col("term"))
    score = times * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return joined.groupBy("event_id").agg((-F.sum(score)).alias("bm25"))


def window_snippet(text: F.Column, query: str, most: int = 32) -> F.Column:
    """The `most` words in a row that hold most different terms of the query, with ellipses where it is cut.

    Windows begin at a hit (the first of those that tie), moved so that the hits lie in its middle where the text allows.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    terms = F.array(*map(F.lit, sorted(set(T.query_terms(query)))))
    marked = F.transform(words, lambda w: F.array_intersect(T.search_tokens(w), terms))
    hits = F.filter(F.transform(marked, lambda m, i: F.when(F.size(m) > 0, i + 1)), lambda i: i.isNotNull())
    held = lambda at: F.size(F.array_distinct(F.flatten(F.slice(marked, at, most))))
    ranked = F.transform(hits, lambda at: F.struct(held(at).alias("n"), (-at).alias("at")))
    hit = F.coalesce(-F.array_max(ranked)["at"], F.lit(1))
    last = F.array_max(F.filter(hits, lambda i: i < hit + most))
    spare = F.greatest((most - (F.coalesce(last, hit) - hit + 1)) / 2, F.lit(0)).cast("int")
    start = F.greatest(F.least(hit - spare, F.size(words) - most + 1), F.lit(1)).cast("int")
    body = F.array_join(F.slice(words, start, most), " ")
    return F.concat(F.when(start > 1, " … ").otherwise(""), body, F.when(start + most <= F.size(words), " … ").otherwise(""))


def search_events(events: DataFrame, index: DataFrame, query: str, start=None, end=None, source_type: str | None = None, privacy: str = "private", stats: DataFrame | None = None) -> DataFrame:
    """Hits with bm25, unpaged; order by bm25, time (latest first), event_id. `search_page` cuts the page and adds excerpts."""
    shown = visible(events, privacy, start, end, source_type)
    return shown.join(bm25(events, index, query, stats), "event_id").select("event_id", F.col("timestamp_start").alias("occurred_at"), "role", F.col("title").alias("conversation_title"), "source_record_id", "bm25")


def search_page(rows: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return rows.orderBy("bm25", F.col("occurred_at").desc_nulls_last(), "event_id").offset(offset).limit(limit)


def with_snippets(page: DataFrame, events: DataFrame, query: str) -> DataFrame:
    """A page's rows with their excerpts: texts are read for those rows alone (a page is broadcast, it has at most its limit of rows)."""
    texts = events.select("event_id", "text").join(F.broadcast(page), "event_id")
    return texts.withColumn("snippet", T.snippet(window_snippet(F.col("text"), query))).select("event_id", "occurred_at", "role", "conversation_title", "snippet", "source_record_id", "bm25")
