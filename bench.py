"""Headline queries at one scale: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "tfidf_top_k",
    "tfidf_index",
    "stored_ranking",
    "collection_summary",
    "dense_search",
    "search_hits",
    "identify_by_words",
    "identify_by_letters",
    "summaries",
    "textrank",
    "direct_translate",
    "transfer_translate",
    "main_content",
    "crawl_frontier",
    "match_command",
]
# Rows processed by the per-document queries, for the time per document.
PER_DOCUMENT = {
    "identify_by_words": "documents",
    "identify_by_letters": "documents",
    "summaries": "documents",
    "textrank": "documents",
    "direct_translate": "english",
    "transfer_translate": "english",
}


def session(cpus: str):
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusloom-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.log.level", "ERROR")
    )
    if "BENCH_CHECKPOINT_DIR" in os.environ:
        builder = builder.config("spark.checkpoint.dir", os.environ["BENCH_CHECKPOINT_DIR"])
    else:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        builder = builder.config("spark.checkpoint.dir", folder)
    return builder.getOrCreate()


def main() -> None:
    from corpusloom.operators.index import indexes
    from corpusloom.plans import load_catalog
    from corpusloom.sources.tables import read_table

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    catalog = load_catalog().QUERIES
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    docs = read_table(spark, sf_dir, "documents")
    rows = {"documents": docs.count(), "english": docs.filter("lang = 'en'").count()}
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr)
    per_document = {
        name: round(1000 * times[name] / max(1, rows[kind]), 4)
        for name, kind in PER_DOCUMENT.items()
        if name in times
    }
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "ms_per_document": per_document,
            }
        )
    )
    indexes.drop_all()  # built once by the first query that needs one, within its time
    spark.stop()


if __name__ == "__main__":
    main()
