"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line: median of three warm runs each, in seconds.

Topic builds read `conversations` and `documents`; the graph, neighbours and months read topics that were built before, and a
search reads postings that were written before, as a store serves them.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import registry
from threadloom.operators import catalog, context, graph, search, topics
from threadloom.operators.store import Store
from threadloom.plans import views
from threadloom.session import session

RUNS = 3


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def headlines(spark: SparkSession, sf_dir: str, store: Store) -> dict[str, Callable[[], object]]:
    made = registry.queries()
    events = views.events(spark, sf_dir)
    built = topics.build_topics(events, registry.LEAST, registry.MOST, registry.PER_EVENT)
    index = search.postings(events).sort("term")
    store.commit({"events": events, "messages": views.messages(spark, sf_dir), "topics": built.topics, "event_topics": built.event_topics, "topic_relations": built.relations, "postings": index, "search_statistics": search.statistics(events, index)})
    events, names, links, messages, index, stats = map(store.read, ("events", "topics", "event_topics", "messages", "postings", "search_statistics"))
    topic = names.orderBy(F.desc("message_count"), "name").first()["topic_id"]
    page = lambda: search.with_snippets(search.search_page(search.search_events(events, index, registry.QUERY, stats=stats)), events, registry.QUERY)
    return {
        "topic_build_topics": lambda: noop(made["topic_build_topics"](spark, sf_dir)),
        "topic_build_documents": lambda: noop(made["topic_build_documents"](spark, sf_dir)),
        "topic_relations": lambda: noop(made["topic_relations"](spark, sf_dir)),
        "graph": lambda: [noop(df) for df in graph.topic_graph(events, names, links, node_limit=100)],
        "topic_neighbors": lambda: catalog.topic_neighbors(events, names, links, topic).collect(),
        "topic_monthly_intensity": lambda: topics.monthly_intensity(events, links, topic).collect(),
        "fts_bm25_page": lambda: page().collect(),
        "message_context": lambda: context.message_context(messages, events, registry.TARGET, 10, 10).collect(),
        "upsert_merge": lambda: noop(made["upsert_merge"](spark, sf_dir)),
        "term_frequencies": lambda: noop(made["term_frequencies"](spark, sf_dir)),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark, found = session("bench"), {}
    root = tempfile.mkdtemp(prefix="bench-")  # a bench runs on one machine
    try:
        for name, run in headlines(spark, sf_dir, Store(spark, root)).items():
            times = []
            for _ in range(RUNS):
                spark.catalog.clearCache()
                began = time.perf_counter()
                run()
                times.append(time.perf_counter() - began)
            found[name] = round(statistics.median(times), 3)
    finally:
        spark.stop()
        shutil.rmtree(root, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
