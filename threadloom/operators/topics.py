"""Topic mining: terms, corpus totals, selection, assignments, relations, monthly intensity.

The frequency that selects and weighs terms is the sum of term counts over the corpus (not the number of
documents). A build reads the texts twice: corpus totals are partial counts by term, which shrink to the vocabulary before
they are shuffled; then only occurrences of the selected terms are counted and ranked, in one shuffle by event. Selected terms
are at most `max_topics` rows and are broadcast for that reason. The table of all events' terms, larger than the texts, is
never made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T


def analysed(events: DataFrame) -> DataFrame:
    return events.where("is_active and analysis_enabled and text is not null")


def fallback_context() -> F.Column:
    """An event without a context, or with an empty one, is its own."""
    return F.coalesce(F.nullif(F.col("context_id"), F.lit("")), F.col("event_id"))


def words_of(events: DataFrame) -> DataFrame:
    """(event_id, w): the words of each analysed event."""
    return analysed(events).select("event_id", T.tokens(T.fold(F.col("text"))).alias("w"))


def terms_of(events: DataFrame) -> DataFrame:
    """(event_id, term): every occurrence of a word or of two neighbours."""
    return words_of(events).select("event_id", F.explode(F.concat("w", T.bigrams(F.col("w")))).alias("term"))


def term_counts(events: DataFrame) -> DataFrame:
    """(event_id, term, tf): unigrams and bigrams of the analysed events."""
    return terms_of(events).groupBy("event_id", "term").agg(F.count("*").alias("tf"))


def corpus_totals(terms: DataFrame) -> DataFrame:
    """(term, cf) of `terms_of`."""
    return terms.groupBy("term").agg(F.count("*").alias("cf"))


def totals_of(events: DataFrame) -> DataFrame:
    """`corpus_totals`, and under the null term the number of events that have any: one pass and one exchange for both."""
    marked = words_of(events).select(F.explode(F.when(F.size("w") > 0, F.concat(F.array(F.lit(None).cast("string")), "w", T.bigrams(F.col("w"))))).alias("term"))
    return corpus_totals(marked)


def select_terms(totals: DataFrame, least: int = 5, most: int = 500) -> DataFrame:
    """At most `most` terms by (total, words in the term, term); a single top-k."""
    if least < 1 or most < 1:
        raise ValueError("topic_build_limits_must_be_positive")
    spaces = F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit("")))
    return totals.where(F.col("term").isNotNull() & (F.col("cf") >= least)).orderBy(F.desc("cf"), spaces.desc(), "term").limit(most)


def analysed_documents(totals: DataFrame) -> DataFrame:
    """One row: how many events have a term."""
    return totals.where(F.col("term").isNull()).agg(F.coalesce(F.max("cf"), F.lit(0)).alias("documents"))


def assignments(terms: DataFrame, selected: DataFrame, documents: DataFrame, per_event: int = 5) -> DataFrame:
    """(event_id, term, weight): of each event the best selected terms."""
    if per_event < 1:
        raise ValueError("topic_build_limits_must_be_positive")
    held = terms.join(F.broadcast(selected), "term")  # a top-k
    # By event alone, which serves the count and the ranking.
    counted = held.repartition("event_id").groupBy("event_id", "term").agg(F.count("*").alias("tf"), F.first("cf").alias("cf")).crossJoin(F.broadcast(documents))  # one row
    inverse = F.log((F.col("documents") + 1).cast("double") / (F.col("cf") + 1)) + 1.0
    bonus = F.when(F.col("term").contains(" "), 1.2).otherwise(1.0)
    scored = counted.withColumn("weight", F.col("tf") * inverse * bonus)
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("weight"), "term"))
    return scored.withColumn("r", rank).where(F.col("r") <= per_event).select("event_id", "term", "weight")


def topic_rows(assigned: DataFrame, events: DataFrame) -> DataFrame:
    """Per topic: assigned events, contexts, first and last seen."""
    placed = assigned.join(analysed(events).select("event_id", fallback_context().alias("context"), "timestamp_start"), "event_id")
    return placed.groupBy("term").agg(
        F.count("*").cast("int").alias("message_count"), F.countDistinct("context").cast("int").alias("conversation_count"),
        F.min("timestamp_start").alias("first_seen_at"), F.max("timestamp_start").alias("last_seen_at"),
    ).select(T.topic_id(F.col("term")).alias("topic_id"), F.col("term").alias("name"), F.lit("keyword").alias("category"), "message_count", "conversation_count", "first_seen_at", "last_seen_at")


def relation_rows(assigned: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs of topics of one event, in the order of their terms; at most per_event choose two pairs an event."""
    a, b = assigned.select("event_id", F.col("term").alias("x")), assigned.select("event_id", F.col("term").alias("y"))
    contexts = analysed(events).select("event_id", fallback_context().alias("context"))
    pairs = a.join(b, "event_id").where("x < y").join(contexts, "event_id")
    counted = pairs.groupBy("x", "y").agg(F.count("*").alias("n"), F.countDistinct("context").alias("contexts"))
    totals = assigned.groupBy("term").agg(F.count("*").alias("total"))
    both = counted.join(totals.select(F.col("term").alias("x"), F.col("total").alias("nx")), "x").join(totals.select(F.col("term").alias("y"), F.col("total").alias("ny")), "y")
    ids = both.withColumns({"source_topic_id": T.topic_id(F.col("x")), "target_topic_id": T.topic_id(F.col("y"))})
    return ids.select(
        T.relation_id(F.col("source_topic_id"), F.col("target_topic_id")).alias("relation_id"), "source_topic_id", "target_topic_id",
        F.col("n").cast("int").alias("message_count"), F.col("contexts").cast("int").alias("conversation_count"), T.cosine(F.col("n"), F.col("nx"), F.col("ny")).alias("weight"),
    )


@dataclass(frozen=True)
class Topics:
    """What a build makes: topics, event_topics (event_id, topic_id, weight), relations, and its one-row counters."""

    topics: DataFrame
    event_topics: DataFrame
    relations: DataFrame
    counters: DataFrame


def build_topics(events: DataFrame, least: int = 5, most: int = 500, per_event: int = 5) -> Topics:
    totals = totals_of(events)
    documents = analysed_documents(totals)
    assigned = assignments(terms_of(events), select_terms(totals, least, most), documents, per_event).cache()  # per_event small rows an event
    topics, relations = topic_rows(assigned, events), relation_rows(assigned, events)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counters = documents.crossJoin(one(topics, "topics")).crossJoin(one(assigned, "assignments")).crossJoin(one(relations, "relations"))  # rows of one
    return Topics(topics, assigned.select("event_id", T.topic_id(F.col("term")).alias("topic_id"), "weight"), relations, counters)


def replace_keyword_topics(old: DataFrame, new: DataFrame) -> DataFrame:
    """A rebuild replaces the keyword topics and keeps those of other categories."""
    return old.where(F.col("category") != "keyword").unionByName(new)


def monthly_intensity(events: DataFrame, event_topics: DataFrame, topic: str, privacy: str = "private") -> DataFrame:
    """(month, message_count, weight) of one topic; empty for an unknown one."""
    seen = events.where(F.col("is_active") & (F.col("privacy_level") == privacy) & F.col("timestamp_start").isNotNull()).select("event_id", "timestamp_start")
    joined = event_topics.where(F.col("topic_id") == topic).join(seen, "event_id")
    return joined.groupBy(F.date_format("timestamp_start", "yyyy-MM").alias("month")).agg(F.count("*").alias("message_count"), F.sum("weight").alias("weight")).orderBy("month")
