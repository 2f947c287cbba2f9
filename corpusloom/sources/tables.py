"""Explicit schemas and readers for the stored tables (no schema inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column lists are DDL strings so that they stay readable next to each other.
SCHEMAS: dict[str, str] = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stream_table(
    spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same table as a file-source stream."""
    reader = spark.readStream.schema(SCHEMAS[name])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def scan_documents(
    documents: DataFrame,
    collection: str | None = None,
    language: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Documents of a collection and optionally a language; both filters reach the Parquet scan."""
    out = documents
    if collection is not None:
        out = out.filter(out["source"] == collection)
    if language is not None:
        out = out.filter(out["lang"] == language)
    return out.orderBy("doc_id") if ordered else out


# Keys of the tables whose rows are costly to process.
_TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def read_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table with work for every core.

    A table stored in fewer splits than there are cores (one small file) is spread by its key
    first, since tokenizing costs far more than moving the text. A table with splits enough is
    left as it lies, so nothing large is ever shuffled here.
    """
    df = read_table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, _TEXT_KEYS[name])
