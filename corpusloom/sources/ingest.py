"""Validation, inserts, refreshes and sinks of document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.text import strip
from corpusloom.functions.urls import is_web_address
from corpusloom.operators.skew import first_per_key, last_per_key

# Field limits.
TITLE_CHARS, URL_CHARS = 500, 2000


def validate_documents(docs: DataFrame) -> DataFrame:
    """Trimmed fields and ``reason``, which is null for accepted documents."""
    checked = docs.select(
        *[c for c in docs.columns if c not in ("title", "url", "text")],
        strip(F.col("title")).alias("title"),
        F.nullif(strip(F.col("url")), F.lit("")).alias("url"),
        strip(F.col("text")).alias("text"),
    )
    has_url = F.col("url").isNotNull()
    reason = (
        F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.lit("title is empty"))
        .when(F.length("title") > TITLE_CHARS, F.lit("title is too long"))
        .when(has_url & ~is_web_address(F.col("url")), F.lit("url is not http(s)"))
        .when(has_url & (F.length("url") > URL_CHARS), F.lit("url is too long"))
        .when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit("text is empty"))
    )
    return checked.withColumn("reason", reason)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted documents, and rejected ones with their reason."""
    return (
        checked.filter("reason is null").drop("reason"),
        checked.filter("reason is not null"),
    )


_KEY = ["collection", "url"]


def insert_new(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming documents whose ``(collection, url)`` is new, the lowest id of each.

    Documents without a URL are never duplicates.
    """
    with_url = incoming.filter("url is not null")
    fresh = first_per_key(with_url, _KEY, ["doc_id"]).join(
        existing.filter("url is not null").select(*_KEY), _KEY, "left_anti"
    )
    return fresh.unionByName(incoming.filter("url is null").select(fresh.columns))


def refresh_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Update documents in place by ``(collection, url)``, insert the others.

    The id of an existing document stays. Of several incoming versions the newest one counts.
    """
    latest = last_per_key(incoming.filter("url is not null"), _KEY, ["fetched_at", "doc_id"])
    values = [c for c in existing.columns if c not in (*_KEY, "doc_id")]
    old = existing.filter("url is not null")
    merged = old.alias("o").join(latest.alias("n"), _KEY, "outer").select(
        F.coalesce("o.doc_id", "n.doc_id").alias("doc_id"),
        *_KEY,
        *[
            F.when(F.col("n.doc_id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            for c in values
        ],
    )
    anonymous = existing.filter("url is null").unionByName(incoming.filter("url is null"))
    return merged.unionByName(anonymous.select(merged.columns))


def replace_results(
    results: DataFrame, path: str, run: str = "run_id", files_per_run: int = 8
) -> None:
    """Write results so that a run present in them replaces its earlier rows only.

    Rows are dealt by run and a few shares of it, so a run has at most ``files_per_run`` files and
    a large one is still written by several tasks.
    """
    share = F.pmod(F.xxhash64(*[c for c in results.columns if c != run]), F.lit(files_per_run))
    (
        results.repartition(run, share).write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .partitionBy(run)
        .parquet(path)
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Header from the columns, quotes doubled, nulls empty."""
    (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def export_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def stale_collections(collections: DataFrame, index_jobs: DataFrame) -> DataFrame:
    """Flag collections whose documents changed after their latest index finished."""
    latest = index_jobs.groupBy("collection").agg(F.max("finished_at").alias("indexed_at"))
    return collections.join(latest, "collection", "left").withColumn(
        "is_stale",
        F.coalesce(F.col("documents_changed_at") > F.col("indexed_at"), F.lit(False)),
    )


def collection_counts(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """All collections with their number of documents, counted before the join."""
    counts = documents.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))
    return collections.join(counts, "collection", "left").fillna(0, ["documents"])
