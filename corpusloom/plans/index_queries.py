"""Queries over the term index: statistics, weights, stored vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import tokens as tok, weighting as wt
from corpusloom.operators.index import StoredIndex, indexes
from corpusloom.plans import lexicon, sql
from corpusloom.plans.catalog import query, r6
from corpusloom.plans.text_queries import lemmas_of
from corpusloom.sources.shared import materialise
from corpusloom.sources.tables import read_table, read_texts


def postings_of(docs):
    return wt.term_frequencies(tok.words_only(docs, "doc_id"))


def _index(spark, sf, kind, terms_of):
    """The session's index of the documents by one kind of terms."""

    def build():
        terms = terms_of(read_texts(spark, sf, "documents"))
        return StoredIndex.build(terms, read_table(spark, sf, "documents"))

    return indexes.get(spark, kind, f"{sf}/documents.parquet", build)


def word_index(spark, sf):
    return _index(spark, sf, "words", lambda docs: tok.words_only(docs, "doc_id"))


def lemma_index(spark, sf):
    return _index(spark, sf, "lemmas", lambda docs: lemmas_of(spark, docs))


def stored_postings(spark, sf):
    """Postings, written once, and the number of documents."""
    index = word_index(spark, sf)
    return index.postings, index.total


@query("term_frequencies", sql.with_(sql.TOKENS, sql.TF) + "SELECT * FROM tf")
def term_frequencies(spark, sf):
    return postings_of(read_texts(spark, sf, "documents"))


@query("document_frequencies", sql.with_(sql.TOKENS, sql.TF, sql.DFS) + "SELECT * FROM dfs")
def document_frequencies(spark, sf):
    return wt.document_frequencies(postings_of(read_texts(spark, sf, "documents")))


@query(
    "inverse_document_frequencies",
    sql.with_(sql.N, sql.TOKENS, sql.TF, sql.DFS)
    + "SELECT term, df, round(ln(n::DOUBLE / df), 6) AS idf FROM dfs CROSS JOIN n",
)
def inverse_document_frequencies(spark, sf):
    docs = read_texts(spark, sf, "documents")
    dfs = wt.document_frequencies(postings_of(docs))
    total = wt.row_count(read_table(spark, sf, "documents"))
    idfs = wt.inverse_document_frequencies(dfs, total)
    return idfs.select("term", "df", r6(F.col("idf"), "idf"))


@query(
    "raw_weights",
    sql.with_(*sql.INDEX[:5])
    + "SELECT doc_id, count(*) AS terms, round(sum(w), 6) AS total, round(max(w), 6) AS top "
    "FROM raw GROUP BY doc_id",
)
def raw_weights(spark, sf):
    postings, total = stored_postings(spark, sf)
    idfs = wt.inverse_document_frequencies(wt.document_frequencies(postings), total)
    return wt.raw_weights(postings, idfs, total).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"),
        r6(F.sum("weight"), "total"),
        r6(F.max("weight"), "top"),
    )


@query(
    "normalised_vectors",
    sql.with_(*sql.INDEX) + "SELECT doc_id, term, round(weight, 6) AS weight FROM weights",
)
def normalised_vectors(spark, sf):
    vectors = wt.tfidf_vectors(*stored_postings(spark, sf))
    return vectors.select("doc_id", "term", r6(F.col("weight"), "weight"))


@query(
    "binary_query_vectors",
    sql.with_(sql.QTOKENS) + "SELECT DISTINCT query_id, term, 1.0::DOUBLE AS weight FROM qtokens",
)
def binary_query_vectors(spark, sf):
    queries = read_table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    return wt.binary_vectors(tok.words_only(queries, "query_id"), "query_id")


MODIFIED_SQL = (
    "peak AS (SELECT doc_id, max(tf) AS peak FROM tf GROUP BY doc_id)",
    "modified AS (SELECT doc_id, term, 0.5::DOUBLE * (1 + tf::DOUBLE / peak) "
    "* ln(n::DOUBLE / df) AS weight "
    "FROM tf JOIN peak USING (doc_id) JOIN dfs USING (term) CROSS JOIN n)",
)


@query(
    "modified_weights",
    sql.with_(sql.N, sql.TOKENS, sql.TF, sql.DFS, *MODIFIED_SQL)
    + "SELECT doc_id, term, round(weight, 6) AS weight FROM modified",
)
def modified_weights(spark, sf):
    out = wt.modified_weights(*stored_postings(spark, sf))
    return out.select("doc_id", "term", r6(F.col("weight"), "weight"))


LEMMA_INDEX = (
    sql.N,
    sql.TOKENS,
    lexicon.STOP_SQL,
    *lexicon.LEMMA_SQL,
    sql.TF.replace("FROM tokens", "FROM lemmas"),
    sql.DFS,
    sql.RAW,
    sql.NORMS,
    sql.WEIGHTS,
)


@query(
    "tfidf_index",
    sql.with_(*LEMMA_INDEX)
    + """SELECT term, count(*) AS documents, sum(tf)::BIGINT AS occurrences,
    round(sum(weight), 6) AS weight FROM tf JOIN weights USING (doc_id, term) GROUP BY term""",
)
def tfidf_index(spark, sf):
    """The whole index job on lemmas, stored, read back and summed up per term."""
    index = lemma_index(spark, sf)
    by_term = index.postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences")
    )
    mass = index.weights.groupBy("term").agg(r6(F.sum("weight"), "weight"))
    return by_term.join(mass, "term")


@query(
    "index_summary",
    sql.with_(*LEMMA_INDEX)
    + """SELECT (SELECT n FROM n) AS documents, (SELECT count(*) FROM dfs) AS terms,
    (SELECT count(*) FROM tf) AS postings, (SELECT count(*) FROM weights) AS weights""",
)
def index_summary(spark, sf):
    index = lemma_index(spark, sf)
    return spark.range(1).select(
        index.total.cast("long").alias("documents"),
        wt.row_count(index.terms).alias("terms"),
        wt.row_count(index.postings).alias("postings"),
        wt.row_count(index.weights).alias("weights"),
    )


@query(
    "extend_vocabulary",
    sql.with_(
        sql.TOKENS,
        "terms AS (SELECT DISTINCT lang, term, md5(lang || '|' || term) AS m FROM tokens)",
        "old AS (SELECT row_number() OVER (ORDER BY m) AS term_id, lang, term FROM terms "
        "WHERE lang = 'en')",
        "new AS (SELECT (SELECT max(term_id) FROM old) + row_number() OVER (ORDER BY m) "
        "AS term_id, lang, term FROM terms WHERE lang <> 'en')",
    )
    + "SELECT * FROM old UNION ALL SELECT * FROM new",
)
def extend_vocabulary(spark, sf):
    """English first, then the terms of the other languages appended."""
    terms = tok.words_only(read_texts(spark, sf, "documents"), "lang").distinct()
    none = spark.createDataFrame([], "term_id bigint, lang string, term string")
    english = wt.extend_vocabulary(none, terms.filter("lang = 'en'"))
    return wt.extend_vocabulary(materialise(english, "vocabulary"), terms)


@query(
    "indexed_term_count",
    sql.with_(sql.TOKENS)
    + "SELECT lang, count(DISTINCT term) AS indexed_terms FROM tokens GROUP BY lang",
)
def indexed_term_count(spark, sf):
    terms = tok.words_only(read_texts(spark, sf, "documents"), "lang").distinct()
    return terms.groupBy("lang").agg(F.count(F.lit(1)).alias("indexed_terms"))


@query(
    "embed_chunks",
    rf"""WITH t AS (SELECT doc_id, {sql.strip('text')} AS body FROM documents),
    w AS (SELECT doc_id, body, string_split_regex(body, '\s+') AS w FROM t WHERE body <> ''),
    i AS (SELECT *, unnest(CASE WHEN len(w) <= 350 THEN [0]
        ELSE range(0, ((len(w) - 350 + 309) // 310) * 310 + 1, 310) END) AS s FROM w),
    c AS (SELECT doc_id, (s // 310)::INT AS chunk_index,
        CASE WHEN len(w) <= 350 THEN body ELSE array_to_string(w[s+1:s+350], ' ') END AS chunk
        FROM i),
    v AS (SELECT vec_id // 2 AS doc_id, (vec_id % 2)::INT AS chunk_index,
        'model-' || (label % 2) AS model, embedding FROM embeddings)
    SELECT doc_id, chunk_index, model, length(chunk)::INT AS n_chars,
    round(embedding[1]::DOUBLE, 6) AS first_value, len(embedding)::INT AS dims
    FROM c JOIN v USING (doc_id, chunk_index)""",
)
def embed_chunks(spark, sf):
    """Chunks joined to stored vectors, keyed by model as well."""
    vectors = read_table(spark, sf, "embeddings").select(
        F.expr("vec_id div 2").alias("doc_id"),
        F.expr("int(vec_id % 2)").alias("chunk_index"),
        F.concat(F.lit("model-"), F.expr("label % 2")).alias("model"),
        "embedding",
    )
    chunks = tok.chunks(read_texts(spark, sf, "documents"))
    return chunks.join(vectors, ["doc_id", "chunk_index"]).select(
        "doc_id",
        "chunk_index",
        "model",
        F.length("chunk").alias("n_chars"),
        r6(F.col("embedding")[0].cast("double"), "first_value"),
        F.size("embedding").alias("dims"),
    )
