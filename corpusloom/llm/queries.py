"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import (
    bpe,
    fill_middle,
    fingerprints,
    language_id,
    neighbours,
    packing,
    secret_scan,
    sentence_pieces,
    shingle_join,
    token_alignment,
    token_files,
    toxicity,
    warc,
)
from corpusloom.sources.tables import read_table

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary; the files are read where they are, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_text(name: str = "word_bpe_49k.json") -> str:
    with open(tokenizer_file(name), encoding="utf-8") as file:
        return file.read()


@_query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_text())


@_query("op2_sequence_packing")
def op2_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = packing.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_text())
    return packing.pack(counted)


@_query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    with open(tokenizer_file("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), ranks, PATTERN)


@_query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.fit_and_score(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )


@_query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edited_texts(read_table(spark, sf_dir, "documents"))


@_query("op6_hilbert_neighbours")
def op6_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


@_query("op7_shingle_join")
def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join_documents(read_table(spark, sf_dir, "documents"))


@_query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.fit_and_identify(read_table(spark, sf_dir, "documents"))


@_query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


@_query(
    "op10_warc_archives",
    """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html FROM pages
    ), d AS (
        SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest
        FROM p
    ), f AS (
        SELECT payload_digest, min(page_id) AS first_id FROM d
        WHERE payload_bytes >= 100 GROUP BY payload_digest
    )
    SELECT d.page_id, d.payload_bytes, d.payload_digest,
           CASE WHEN f.first_id < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN f.first_id < d.page_id THEN f.first_id END AS refers_to
    FROM d LEFT JOIN f USING (payload_digest)
    """,
)
def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the archives differ from run to run, so the digest leaves them out."""
    records = warc.archive_pages(read_table(spark, sf_dir, "pages"))
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def tokenizer_bytes(name: str) -> bytes:
    with open(tokenizer_file(name), "rb") as file:
        return file.read()


@_query("op11_sentence_pieces")
def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(
        read_table(spark, sf_dir, "documents"), tokenizer_bytes("piece_bpe_32k.model")
    )


@_query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return token_alignment.align_documents(
        read_table(spark, sf_dir, "documents"),
        tokenizer_text("byte_bpe_50k.json"),
        PATTERN,
        tokenizer_bytes("piece_bpe_32k.model"),
    )


@_query("op13_fill_middle")
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.with_digests(read_table(spark, sf_dir, "documents"))
