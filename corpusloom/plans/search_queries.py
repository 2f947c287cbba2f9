"""Queries over similarity, search, hits and search runs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from corpusloom.operators import index, ranking, search, similarity as sim, tokens as tok, weighting as wt
from corpusloom.functions import text as T
from corpusloom.operators.skew import lookup_join
from corpusloom.plans import sql
from corpusloom.plans.catalog import query, r6
from corpusloom.plans.index_queries import word_index
from corpusloom.sources.shared import materialise
from corpusloom.sources.tables import read_table, read_texts

def benchmark_queries(spark, sf):
    return read_table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")


class Corpus:
    """The indexed corpus and its query vectors.

    The index is stored with its layout and built once in a session for each state of the texts.
    """

    def __init__(self, spark, sf):
        self.docs = read_texts(spark, sf, "documents")
        self.queries = benchmark_queries(spark, sf)
        self.index = word_index(spark, sf)
        self.total = self.index.total
        self.query_tokens = tok.words_only(self.queries, "query_id")

    @property
    def postings(self):
        return self.index.postings

    @property
    def dfs(self):
        return self.index.terms

    @property
    def weights(self):
        return self.index.weights

    @cached_property
    def vectors(self):
        # written, since they are counted before they are sent anywhere
        found = search.query_vectors(self.query_tokens, self.dfs, self.total)
        return materialise(found, "query-vectors")

    def scores(self, vectors=None):
        return search.tfidf_scores(
            self.vectors if vectors is None else vectors, self.weights
        )


def shingles(df, key, size=8):
    w = T.words(F.col("text"))
    grams = F.transform(
        F.sequence(F.lit(1), F.size("w") - (size - 1)),
        lambda i: F.array_join(F.slice("w", i, F.lit(size)), " "),
    )
    return (
        df.select(key, w.alias("w"))
        .filter(F.size("w") >= size)
        .select(key, F.explode(F.array_distinct(grams)).alias("shingle"))
    )


def shared_shingles(docs, queries):
    """Relevant pairs: a document sharing an 8-word shingle with a query text."""
    return (
        lookup_join(
            shingles(docs, "doc_id"),
            shingles(queries, "query_id"),
            ["shingle"],
            ["doc_id"],
            how="inner",
        )
        .select("query_id", "doc_id")
        .distinct()
    )


@query("relevance_judgments", sql.with_(*sql.QRELS) + "SELECT * FROM qrels")
def relevance_judgments(spark, sf):
    return shared_shingles(read_texts(spark, sf, "documents"), benchmark_queries(spark, sf))


@query(
    "sparse_dot_products",
    sql.with_(*sql.INDEX, sql.QTOKENS)
    + """SELECT query_id, doc_id, round(sum(weight), 6) AS dot, count(*) AS shared
    FROM (SELECT DISTINCT query_id, term FROM qtokens) JOIN weights USING (term)
    GROUP BY query_id, doc_id""",
)
def sparse_dot_products(spark, sf):
    c = Corpus(spark, sf)
    binary = wt.binary_vectors(c.query_tokens, "query_id")
    out = sim.dot_products(binary, c.weights)
    return out.select("query_id", "doc_id", r6(F.col("dot"), "dot"), "shared")


@query(
    "euclidean_norms",
    sql.with_(*sql.INDEX[:5])
    + "SELECT doc_id, round(sqrt(sum(w * w)), 6) AS norm FROM raw GROUP BY doc_id",
)
def euclidean_norms(spark, sf):
    c = Corpus(spark, sf)
    idfs = wt.inverse_document_frequencies(c.dfs, c.total)
    raw = wt.raw_weights(c.postings, idfs, c.total)
    return sim.norms(raw, "doc_id").select("doc_id", r6(F.col("norm"), "norm"))


@query(
    "cosine_similarities",
    sql.with_(*sql.INDEX, sql.QTOKENS)
    + """, q AS (SELECT DISTINCT query_id, term FROM qtokens),
    qn AS (SELECT query_id, sqrt(count(*)) AS qn FROM q GROUP BY query_id),
    dn AS (SELECT doc_id, sqrt(sum(weight * weight)) AS dn FROM weights GROUP BY doc_id)
    SELECT query_id, doc_id, round(sum(weight) / (any_value(qn) * any_value(dn)), 6) AS score
    FROM q JOIN weights USING (term) JOIN qn USING (query_id) JOIN dn USING (doc_id)
    GROUP BY query_id, doc_id""",
)
def cosine_similarities(spark, sf):
    c = Corpus(spark, sf)
    binary = wt.binary_vectors(c.query_tokens, "query_id")
    out = sim.cosine_similarities(binary, c.weights)
    return out.select("query_id", "doc_id", r6(F.col("score"), "score"))


@query(
    "manhattan_distances",
    sql.with_(*sql.INDEX, *sql.QUERY, *sql.QRELS)
    + """, a AS (SELECT query_id, doc_id, term, weight AS a FROM qrels JOIN qvec USING (query_id)),
    b AS (SELECT query_id, doc_id, term, weight AS b FROM qrels JOIN weights USING (doc_id))
    SELECT query_id AS left_id, doc_id AS right_id,
    round(sum(abs(coalesce(a, 0) - coalesce(b, 0))), 6) AS distance
    FROM a FULL JOIN b USING (query_id, doc_id, term) GROUP BY query_id, doc_id""",
)
def manhattan_distances(spark, sf):
    """Between each query vector and the vectors of its relevant documents."""
    c = Corpus(spark, sf)
    pairs = shared_shingles(c.docs, c.queries).toDF("left_id", "right_id")
    out = sim.manhattan_distances(
        c.vectors.withColumnRenamed("query_id", "left_id"),
        c.weights.withColumnRenamed("doc_id", "right_id"),
        pairs,
    )
    return out.select("left_id", "right_id", r6(F.col("distance"), "distance"))


@query(
    "rank_candidates",
    sql.with_(*sql.INDEX, *sql.QUERY)
    + """, cand AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id
        FROM documents),
    s AS (SELECT query_id, doc_id, round(coalesce(sum(q.weight * w.weight), 0), 6) AS score
        FROM cand LEFT JOIN (qvec q JOIN weights w USING (term)) USING (query_id, doc_id)
        GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, doc_id))::INT AS rank FROM s""",
)
def rank_candidates(spark, sf):
    """Every document is a candidate of one query; documents scoring 0 are ranked as well."""
    c = Corpus(spark, sf)
    candidates = c.docs.select(
        (F.col("doc_id") % wt.row_count(c.queries)).alias("query_id"), "doc_id"
    )
    scored = search.rank_candidates(c.vectors, c.weights, candidates)
    return ranking.full_ranking(scored)


@query(
    "query_vectors",
    sql.with_(*sql.INDEX[:4], *sql.QUERY)
    + "SELECT query_id, term, round(weight, 6) AS weight FROM qvec",
)
def query_vectors(spark, sf):
    return Corpus(spark, sf).vectors.select("query_id", "term", r6(F.col("weight"), "weight"))


@query("tfidf_search", sql.with_(*sql.SEARCH) + "SELECT query_id, doc_id, score FROM scores")
def tfidf_search(spark, sf):
    return Corpus(spark, sf).scores().select("query_id", "doc_id", r6(F.col("score"), "score"))


@query("tfidf_top_k", sql.with_(*sql.SEARCH) + "SELECT * FROM ranked WHERE rank <= 10")
def tfidf_top_k(spark, sf):
    c = Corpus(spark, sf)
    return search.search(c.vectors, search.Model("tfidf", c.weights))


@query("block_max_top_k", sql.with_(*sql.SEARCH) + "SELECT * FROM ranked WHERE rank <= 10")
def block_max_top_k(spark, sf):
    """The same hits from blocks of weights, without those that cannot matter."""
    c = Corpus(spark, sf)
    return ranking.top_k(index.block_max_scores(c.vectors, c.index.impacts, 10))


@query("stored_ranking", sql.with_(*sql.SEARCH) + "SELECT * FROM ranked")
def stored_ranking(spark, sf):
    """The full ranking of every query, as a search run stores it."""
    return ranking.full_ranking(Corpus(spark, sf).scores())


def chunk_vectors(spark, sf):
    """Stored vectors as chunks: four consecutive vectors belong to one document."""
    return read_table(spark, sf, "embeddings").select(
        F.expr("vec_id div 4").alias("doc_id"),
        F.expr("int(vec_id % 4)").alias("chunk_index"),
        F.expr("transform(embedding, x -> double(x))").alias("vector"),
        "label",
    )


def label_centroids(spark, sf):
    """One query vector per label: the mean of its vectors."""
    dims = read_table(spark, sf, "embeddings").select(
        "label", F.posexplode("embedding").alias("i", "x")
    )
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.expr("transform(array_sort(collect_list(struct(i, m))), x -> x.m)").alias("vector")
    )


CENTROID_SQL = (
    """dims AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i,
        unnest(embedding)::DOUBLE AS x FROM embeddings)""",
    "centroids AS (SELECT label::BIGINT AS query_id, i, avg(x) AS m FROM dims GROUP BY label, i)",
)


@query(
    "dense_search",
    sql.with_(*CENTROID_SQL)
    + """, cn AS (SELECT query_id, sqrt(sum(m * m)) AS cn FROM centroids GROUP BY query_id),
    vn AS (SELECT vec_id, sqrt(sum(x * x)) AS vn FROM dims GROUP BY vec_id),
    cs AS (SELECT query_id, vec_id, sum(m * x) / (any_value(cn) * any_value(vn)) AS s
        FROM centroids JOIN dims USING (i) JOIN cn USING (query_id) JOIN vn USING (vec_id)
        GROUP BY query_id, vec_id),
    best AS (SELECT query_id, vec_id // 4 AS doc_id, round(max(s), 6) AS score FROM cs
        GROUP BY ALL),
    r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT
        AS rank FROM best)
    SELECT * FROM r WHERE rank <= 10""",
)
def dense_search(spark, sf):
    return search.dense_search(label_centroids(spark, sf), chunk_vectors(spark, sf), 10)


def benchmark_vectors(spark, sf):
    """A query vector per benchmark text: the stored vector of its number."""
    return read_table(spark, sf, "embeddings").join(
        benchmark_queries(spark, sf).select("query_id"), F.col("vec_id") == F.col("query_id")
    ).select("query_id", F.expr("transform(embedding, x -> double(x))").alias("vector"))


DENSE_SQL = (
    """dv AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x
        FROM embeddings)""",
    "dn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM dv GROUP BY vec_id)",
    """dcos AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk,
        sum(q.x * c.x) / (any_value(qn.n) * any_value(cn.n)) AS s
        FROM dv q JOIN benchmark ON q.vec_id = item_id JOIN dv c USING (i)
        JOIN dn qn ON qn.vec_id = q.vec_id JOIN dn cn ON cn.vec_id = c.vec_id
        GROUP BY q.vec_id, c.vec_id)""",
    """dscores AS (SELECT query_id, chunk // 4 AS doc_id, round(max(s), 6) AS score FROM dcos
        GROUP BY ALL)""",
    """dranked AS (SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, doc_id))::INT AS rank FROM dscores)""",
)


@query("dense_ranking", sql.with_(*DENSE_SQL) + "SELECT * FROM dranked")
def dense_ranking(spark, sf):
    """Every document with chunk vectors, ranked for every query, as a search run stores it."""
    model = search.Model("dense_embedding", chunk_vectors(spark, sf))
    return search.ranking_of(benchmark_vectors(spark, sf), model)


@query("dense_hits", sql.with_(*DENSE_SQL) + "SELECT * FROM dranked WHERE rank <= 10")
def dense_hits(spark, sf):
    model = search.Model("dense_embedding", chunk_vectors(spark, sf))
    return search.search(benchmark_vectors(spark, sf), model)


@query(
    "first_chunk_vectors",
    """SELECT d.doc_id, v.embedding IS NULL AS missing,
    round(v.embedding[1]::DOUBLE, 6) AS first_value
    FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id * 4""",
)
def first_chunk_vectors(spark, sf):
    out = search.first_chunk_vectors(
        read_table(spark, sf, "documents"), chunk_vectors(spark, sf)
    )
    return out.select(
        "doc_id",
        F.col("vector").isNull().alias("missing"),
        r6(F.col("vector")[0], "first_value"),
    )


@query(
    "missing_vectors",
    """SELECT lang, count(*) AS missing FROM documents d ANTI JOIN embeddings v
    ON v.vec_id = d.doc_id * 4 GROUP BY lang""",
)
def missing_vectors(spark, sf):
    docs = read_table(spark, sf, "documents")
    gaps = search.missing_vectors(docs, chunk_vectors(spark, sf))
    return gaps.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(
        F.count(F.lit(1)).alias("missing")
    )


MATCHED_SQL = (
    "hits AS (SELECT * FROM ranked WHERE rank <= 10)",
    """matched AS (SELECT query_id, doc_id, list_sort(list(DISTINCT term)) AS matched_terms
        FROM hits JOIN qtokens USING (query_id) JOIN weights USING (doc_id, term)
        GROUP BY query_id, doc_id)""",
)


@query("matched_terms", sql.with_(*sql.SEARCH, *MATCHED_SQL) + "SELECT * FROM matched")
def matched_terms(spark, sf):
    c = Corpus(spark, sf)
    hits = materialise(search.search(c.vectors, search.Model("tfidf", c.weights)), "hits")
    return search.matched_terms(hits, c.query_tokens, c.weights)


@query(
    "search_hits",
    sql.with_(*sql.SEARCH, *MATCHED_SQL)
    + rf""", f AS (SELECT h.query_id, h.doc_id, h.rank, h.score, text,
        coalesce(matched_terms, []) AS matched_terms,
        list_filter(list_transform(typed, lambda w: instr(lower(text), w)
        - 1), lambda p: p >= 0) AS found_at
        FROM hits h LEFT JOIN matched USING (query_id, doc_id) JOIN documents USING (doc_id)
        JOIN (SELECT query_id, list(DISTINCT term) AS typed FROM qtokens GROUP BY query_id)
        USING (query_id)),
    s AS (SELECT *, greatest(0, coalesce(list_min(found_at), 0) - 106) AS s FROM f)
    SELECT query_id, doc_id, rank, score, matched_terms, (CASE WHEN s > 0 THEN '…' ELSE '' END)
    || {sql.strip('substr(text, s + 1, 320)')}
    || (CASE WHEN s + 320 < length(text) THEN '…' ELSE '' END) AS snippet FROM s""",
)
def search_hits(spark, sf):
    """Search end to end: ranked hits with matched terms and a snippet."""
    c = Corpus(spark, sf)
    hits = materialise(search.search(c.vectors, search.Model("tfidf", c.weights)), "hits")
    return search.with_snippets(
        hits, c.docs, search.matched_terms(hits, c.query_tokens, c.weights), c.queries
    )


@query(
    "latest_runs",
    """SELECT user_id AS query_id, event_type AS model, max(event_id) AS run_id
    FROM events GROUP BY ALL""",
)
def latest_runs(spark, sf):
    runs = read_table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"),
        F.col("event_type").alias("model"),
        F.col("event_id").alias("run_id"),
    )
    return search.latest_runs(runs)


@query(
    "register_queries",
    """WITH old AS (SELECT 'user' AS collection, text, item_id AS query_id FROM benchmark),
    new AS (SELECT role AS collection, text, min(1000000 + conv_id * 1000 + turn) AS query_id
        FROM conversations GROUP BY ALL)
    SELECT collection, text, query_id FROM old UNION ALL
    SELECT collection, text, query_id FROM new ANTI JOIN old USING (collection, text)""",
)
def register_queries(spark, sf):
    old = read_table(spark, sf, "benchmark").select(
        F.lit("user").alias("collection"), "text", F.col("item_id").alias("query_id")
    )
    new = read_table(spark, sf, "conversations").select(
        F.col("role").alias("collection"),
        "text",
        (F.col("conv_id") * 1000 + F.col("turn") + 1_000_000).alias("query_id"),
    )
    return search.register_queries(old, new)
