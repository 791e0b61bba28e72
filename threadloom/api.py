"""The read-only query surface: typed answers as dictionaries, with bounds, error codes and not-found cases."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import catalog, context, graph, search, topics
from threadloom.operators.store import Store
from threadloom.schema import PRIVACY_LEVELS

VERSION = "0.2.0"


class ApiError(Exception):
    def __init__(self, status: int, code: str):
        super().__init__(code)
        self.status, self.code = status, code


def _bounded(value: int, low: int, high: int | None, name: str) -> int:
    if value < low or high is not None and value > high:
        raise ApiError(422, f"{name}_out_of_range")
    return value


def _privacy(level: str) -> str:
    if level not in PRIVACY_LEVELS:
        raise ApiError(422, "privacy_level_unknown")
    return level


def rows(df: DataFrame) -> list[dict[str, Any]]:
    """A page's rows as JSON values; pages are bounded by their limits."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]


def month_range(first: str | None, last: str | None) -> tuple[datetime.datetime | None, datetime.datetime | None]:
    """Months (yyyy-MM) to the half-open range from the first's start to the start of the one after the last."""
    start = datetime.datetime.strptime(first, "%Y-%m") if first else None
    end = datetime.datetime.strptime(last, "%Y-%m") if last else None
    return start, (end + datetime.timedelta(days=32)).replace(day=1) if end else None


def turn_page(total: int, limit: int, offset: int) -> dict[str, Any]:
    """Label and neighbours of a page."""
    return {"from": min(offset + 1, total), "to": min(offset + limit, total), "previous": max(offset - limit, 0) if offset else None, "next": offset + limit if offset + limit < total else None}


class Api:
    """Queries over a store's newest version."""

    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store

    def _tables(self) -> tuple[DataFrame, ...]:
        events = self.store.read("events").join(F.broadcast(self.store.read("sources").select("source_id", "source_type")), "source_id")  # one row per import source
        events = events.join(self.store.read("messages").select("event_id", "role"), "event_id", "left")
        return events, self.store.read("topics"), self.store.read("event_topics"), self.store.read("topic_relations")

    def build_topics(self, least: int = 5, most: int = 500, per_event: int = 5) -> dict[str, int]:
        """Rebuild topics; those of other categories than keyword stay."""
        made = topics.build_topics(self.store.read("events"), least, most, per_event)
        old = self.store.read("topics")
        self.store.commit({"topics": made.topics if old is None else topics.replace_keyword_topics(old, made.topics), "event_topics": made.event_topics, "topic_relations": made.relations})
        return rows(made.counters)[0]

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    def meta(self) -> dict[str, Any]:
        return rows(catalog.meta(*self._tables()))[0]

    def graph(self, **filters: Any) -> dict[str, Any]:
        _bounded(filters.get("node_limit", 100), 1, 1000, "node_limit")
        _privacy(filters.get("privacy", "private"))
        events, names, event_topics, _ = self._tables()
        nodes, edges = graph.topic_graph(events, names, event_topics, **filters)
        return {"nodes": rows(nodes), "edges": rows(edges)}

    def default_graph(self) -> dict[str, Any]:
        """The preset of a first view."""
        return self.graph(min_occurrences=2, min_relation_weight=0.15, node_limit=100)

    def search_topics(self, q: str, limit: int = 20, privacy: str = "private") -> list[dict[str, Any]]:
        _bounded(len(q), 1, 200, "q")
        events, names, event_topics, _ = self._tables()
        return rows(catalog.search_topics(events, names, event_topics, q, _bounded(limit, 1, 100, "limit"), _privacy(privacy)))

    def topic(self, topic_id: str, privacy: str = "private") -> dict[str, Any]:
        events, names, event_topics, _ = self._tables()
        found = catalog.topic_detail(events, names, event_topics, topic_id, _privacy(privacy))
        if found is None:
            raise ApiError(404, "topic_not_found")
        return rows(found)[0]

    def intensity(self, topic_id: str, privacy: str = "private") -> list[dict[str, Any]]:
        events, _, event_topics, _ = self._tables()
        return rows(topics.monthly_intensity(events, event_topics, topic_id, _privacy(privacy)))

    def _page(self, every: DataFrame, cut: Callable[[DataFrame, int, int], DataFrame], limit: int, offset: int) -> dict[str, Any]:
        _bounded(limit, 1, 100, "limit"), _bounded(offset, 0, None, "offset")
        every = every.cache()  # read by the count and by the page
        out = {"total": every.count(), "limit": limit, "offset": offset, "items": rows(cut(every, limit, offset))}
        every.unpersist()
        return out

    def occurrences(self, topic_id: str, limit: int = 20, offset: int = 0, privacy: str = "private", **filters: Any) -> dict[str, Any]:
        events, names, event_topics, _ = self._tables()
        if names.where(F.col("topic_id") == topic_id).isEmpty():
            raise ApiError(404, "topic_not_found")
        return self._page(catalog.occurrences(events, event_topics, topic_id, privacy=_privacy(privacy), **filters), catalog.page, limit, offset)

    def search_events(self, q: str, limit: int = 20, offset: int = 0, privacy: str = "private", **filters: Any) -> dict[str, Any]:
        _bounded(len(q), 1, 200, "q")
        events, *_ = self._tables()
        _bounded(limit, 1, 100, "limit"), _bounded(offset, 0, None, "offset")
        index, stats = self.store.read("postings"), self.store.read("search_statistics")
        try:
            found = search.search_events(events, search.postings(events) if index is None else index, q, privacy=_privacy(privacy), stats=stats, **filters).cache()
        except ValueError as e:
            raise ApiError(422, str(e)) from e
        page = search.with_snippets(search.search_page(found, limit, offset), events, q)
        items = rows(search.search_page(page, limit))
        out = {"total": found.count(), "limit": limit, "offset": offset, "items": [{k: v for k, v in i.items() if k != "bm25"} for i in items]}
        found.unpersist()
        return out

    def context(self, event_id: str, before: int = 2, after: int = 2) -> dict[str, Any]:
        _bounded(before, 0, 10, "before"), _bounded(after, 0, 10, "after")
        found = rows(context.message_context(self.store.read("messages"), self.store.read("events"), event_id, before, after))
        if not found:
            raise ApiError(404, "message_not_found")
        keep = ("event_id", "role", "created_at", "text", "sequence_number", "is_target")
        return {"conversation_id": found[0]["conversation_id"], "conversation_title": found[0].get("conversation_title"), "messages": [{k: m.get(k) for k in keep} for m in found]}
