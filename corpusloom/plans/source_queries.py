"""Queries over scans, validation, inserts, refreshes and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import html as H, urls as U
from corpusloom.plans import sql
from corpusloom.plans.catalog import query
from corpusloom.sources import ingest as ig
from corpusloom.sources.shared import scratch_path
from corpusloom.sources.tables import read_table, read_texts, scan_documents


@query(
    "scan_documents",
    "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE source = 'src3' "
    "AND lang = 'en'",
)
def scan_documents_query(spark, sf):
    docs = read_table(spark, sf, "documents")
    return scan_documents(docs, collection="src3", language="en", ordered=True)


# Titles are first lines; addresses depend on the language, so every rule is met.
_RAW_SQL = r"""raw AS (SELECT doc_id, string_split(text, chr(10))[1] AS title,
    CASE lang WHEN 'de' THEN 'ftp://' || source || '/' || doc_id WHEN 'es' THEN '  '
    WHEN 'fr' THEN 'https:///' || doc_id
    ELSE ' http://' || source || '/' || (doc_id // 2) || ' ' END AS url,
    coalesce(array_to_string(string_split(text, chr(10))[2:], chr(10)), '') AS text,
    source AS collection FROM documents)"""
_VALID_SQL = (
    _RAW_SQL,
    rf"""trimmed AS (SELECT doc_id, {sql.strip('title')} AS title,
        nullif({sql.strip('url')}, '') AS url, {sql.strip('text')} AS text, collection FROM raw)""",
    r"""checked AS (SELECT *, CASE WHEN title = '' THEN 'title is empty'
        WHEN length(title) > 500 THEN 'title is too long'
        WHEN url IS NOT NULL AND NOT regexp_matches(url, '^https?://[^/?#]+')
        THEN 'url is not http(s)' WHEN length(url) > 2000 THEN 'url is too long'
        WHEN text = '' THEN 'text is empty' END AS reason FROM trimmed)""",
)


def raw_documents(spark, sf):
    docs = read_texts(spark, sf, "documents")
    lines = F.split("text", "\n")
    lang = F.col("lang")
    url = (
        F.when(lang == "de", F.concat(F.lit("ftp://"), "source", F.lit("/"), "doc_id"))
        .when(lang == "es", F.lit("  "))
        .when(lang == "fr", F.concat(F.lit("https:///"), "doc_id"))
        .otherwise(
            F.concat(F.lit(" http://"), "source", F.lit("/"), F.expr("doc_id div 2"), F.lit(" "))
        )
    )
    return docs.select(
        "doc_id",
        lines[0].alias("title"),
        url.alias("url"),
        F.array_join(F.slice(lines, 2, F.size(lines)), "\n").alias("text"),
        F.col("source").alias("collection"),
    )


@query(
    "validate_documents",
    sql.with_(*_VALID_SQL) + "SELECT doc_id, title, url, md5(text) AS digest, reason FROM checked",
)
def validate_documents(spark, sf):
    out = ig.validate_documents(raw_documents(spark, sf))
    return out.select("doc_id", "title", "url", F.md5("text").alias("digest"), "reason")


@query(
    "insert_new_documents",
    sql.with_(*_VALID_SQL)
    + """, ok AS (SELECT * FROM checked WHERE reason IS NULL),
    old AS (SELECT DISTINCT collection, url FROM ok WHERE collection IN ('src1', 'src2'))
    SELECT min(doc_id) AS doc_id, collection, url FROM ok
    WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM old WHERE old.collection = ok.collection
    AND old.url = ok.url) GROUP BY collection, url
    UNION ALL SELECT doc_id, collection, url FROM ok WHERE url IS NULL""",
)
def insert_new_documents(spark, sf):
    accepted, _ = ig.split_valid(ig.validate_documents(raw_documents(spark, sf)))
    existing = accepted.filter("collection in ('src1', 'src2')")
    return ig.insert_new(accepted, existing).select("doc_id", "collection", "url")


def _page_versions(spark, sf):
    """Stored pages as documents; the query-free address makes some of them versions of another."""
    pages = read_texts(spark, sf, "pages")
    return pages.select(
        F.col("page_id").alias("doc_id"),
        F.regexp_extract(U.host(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("collection"),
        U.without_query(F.col("url")).alias("url"),
        F.md5("html").alias("text"),
        F.length("html").alias("char_count"),
        F.col("page_id").alias("fetched_at"),
    )


@query(
    "refresh_documents",
    r"""WITH p AS (SELECT page_id AS doc_id, regexp_extract(regexp_extract(url,
        '^[a-z]+://([^/?#]*)', 1), '([^.]+\.[^.]+)$', 1) AS collection,
        regexp_replace(url, '[?#].*$', '') AS url, md5(html) AS text,
        length(html)::INT AS char_count, page_id AS fetched_at FROM pages),
    old AS (SELECT min(doc_id) AS doc_id, collection, url, arg_min(text, doc_id) AS text,
        arg_min(char_count, doc_id) AS char_count, min(fetched_at) AS fetched_at FROM p
        WHERE url LIKE 'http:%' GROUP BY collection, url),
    new AS (SELECT 1000000 + arg_max(doc_id, fetched_at) AS doc_id, collection,
        replace(url, 'https:', 'http:') AS url, md5(arg_max(text, fetched_at)) AS text,
        arg_max(char_count, fetched_at) + 1 AS char_count,
        max(fetched_at) + 1000000 AS fetched_at
        FROM p GROUP BY collection, replace(url, 'https:', 'http:'))
    SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, collection, url, new.text,
    new.char_count, new.fetched_at FROM old FULL JOIN new USING (collection, url)""",
)
def refresh_documents(spark, sf):
    """Every page fetched again under its plain address: known ones change in place."""
    versions = _page_versions(spark, sf)
    from corpusloom.operators.skew import first_per_key

    existing = first_per_key(versions.filter("url like 'http:%'"), ["collection", "url"], ["doc_id"])
    incoming = versions.select(
        (F.col("doc_id") + 1_000_000).alias("doc_id"),
        "collection",
        F.regexp_replace("url", "^https:", "http:").alias("url"),
        F.md5("text").alias("text"),
        (F.col("char_count") + 1).alias("char_count"),
        (F.col("fetched_at") + 1_000_000).alias("fetched_at"),
    )
    return ig.refresh_documents(existing, incoming)


@query(
    "replace_results",
    """SELECT event_id, user_id % 10 AS run_id, CASE WHEN user_id % 10 < 5 THEN value * 2
    ELSE value END AS value FROM events""",
)
def replace_results(spark, sf):
    """All runs stored, then the first half of them stored again with doubled values."""
    rows = read_table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 10).alias("run_id"), "value"
    )
    path = scratch_path(spark, "results")
    ig.replace_results(rows, path)
    again = rows.filter("run_id < 5").withColumn("value", F.col("value") * 2)
    ig.replace_results(again, path)
    return spark.read.schema("event_id bigint, value double, run_id bigint").parquet(path)


@query(
    "export_csv",
    """SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN NULL ELSE '"' || text || '", ok'
    END AS quoted FROM conversations""",
)
def export_csv(spark, sf):
    """Conversations written as CSV and read back; quotes, commas, line ends and nulls survive."""
    turns = read_table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("role") != "user", F.concat(F.lit('"'), "text", F.lit('", ok'))).alias("quoted"),
    )
    path = scratch_path(spark, "export-csv")
    ig.export_csv(turns, path)
    return (
        spark.read.schema("conv_id bigint, turn bigint, role string, quoted string")
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


@query(
    "export_json",
    "SELECT conv_id, turn, role, CASE WHEN role <> 'user' THEN text END AS content "
    "FROM conversations",
)
def export_json(spark, sf):
    turns = read_table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.when(F.col("role") != "user", F.col("text")).alias("content")
    )
    path = scratch_path(spark, "export-json")
    ig.export_json(turns, path)
    return spark.read.schema("conv_id bigint, turn bigint, role string, content string").json(path)


@query(
    "stale_collections",
    """WITH c AS (SELECT user_id AS collection, max(ts) FILTER (event_type = 'purchase')
        AS documents_changed_at FROM events GROUP BY user_id),
    j AS (SELECT user_id AS collection, max(ts) AS indexed_at FROM events
        WHERE event_type = 'click' GROUP BY user_id)
    SELECT collection, documents_changed_at, indexed_at,
    coalesce(documents_changed_at > indexed_at, false) AS is_stale
    FROM c LEFT JOIN j USING (collection)""",
)
def stale_collections(spark, sf):
    events = read_table(spark, sf, "events")
    changed = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    collections = events.groupBy(F.col("user_id").alias("collection")).agg(
        changed.alias("documents_changed_at")
    )
    jobs = events.filter("event_type = 'click'").select(
        F.col("user_id").alias("collection"), F.col("ts").alias("finished_at")
    )
    return ig.stale_collections(collections, jobs)


@query(
    "collection_counts",
    """SELECT c_custkey AS collection, count(o_orderkey) AS documents FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def collection_counts(spark, sf):
    return ig.collection_counts(
        read_table(spark, sf, "customer").select(F.col("c_custkey").alias("collection")),
        read_table(spark, sf, "orders").select(F.col("o_custkey").alias("collection")),
    )
