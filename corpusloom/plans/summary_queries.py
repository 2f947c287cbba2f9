"""Queries over sentence weights, summaries and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import summarize as sm, tokens as tok, weighting as wt
from corpusloom.operators.runs import RunLedger, run_method
from corpusloom.plans import lexicon, sql
from corpusloom.plans.catalog import query, r6
from corpusloom.plans.search_queries import CENTROID_SQL, chunk_vectors, label_centroids
from corpusloom.plans.text_queries import SPANS_SQL
from corpusloom.sources.shared import bucket_count, materialise, materialise_by
from corpusloom.sources.tables import read_table, read_texts

TERMS_SQL = (
    sql.N,
    sql.TOKENS,
    lexicon.STOP_SQL,
    *lexicon.LEMMA_SQL[:2],
    f"""sw AS (SELECT doc_id, lang, sent, unnest({sql.words('sentence')}) AS term
        FROM spans JOIN documents USING (doc_id))""",
    """st AS (SELECT doc_id, sent, coalesce(lemma, term) AS term, count(*) AS n FROM sw
        ANTI JOIN stop_words USING (lang, term) LEFT JOIN form_lemma USING (lang, term)
        GROUP BY ALL)""",
    "tf AS (SELECT doc_id, term, sum(n) AS tf FROM st GROUP BY doc_id, term)",
    sql.DFS,
    "peak AS (SELECT doc_id, max(tf) AS peak FROM tf GROUP BY doc_id)",
    """modified AS (SELECT doc_id, term, 0.5::DOUBLE * (1 + tf::DOUBLE / peak)
        * ln(n::DOUBLE / df) AS weight
        FROM tf JOIN peak USING (doc_id) JOIN dfs USING (term) CROSS JOIN n)""",
    """ss AS (SELECT doc_id, sent, sum(n * weight) AS score FROM st JOIN modified
        USING (doc_id, term) GROUP BY doc_id, sent)""",
)
ALG_SQL = (
    """pos AS (SELECT *, coalesce(1 - doc_start::DOUBLE / nullif(doc_length, 0), 1) AS ind,
        coalesce(1 - paragraph_start::DOUBLE / nullif(paragraph_length, 0), 1) AS inp
        FROM spans)""",
    """alg AS (SELECT doc_id, sent, sentence, round(ind * inp * coalesce(score, 0), 6) AS weight
        FROM pos LEFT JOIN ss USING (doc_id, sent)
        WHERE doc_id IN (SELECT doc_id FROM tf))""",
)
SELECT_SQL = (
    """sel AS (SELECT doc_id, sent, sentence, weight FROM alg QUALIFY row_number() OVER
        (PARTITION BY doc_id ORDER BY weight DESC, sent) <= 10)""",
)
SUMMARY_SQL = (
    """summ AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent) AS summary,
        list(sent ORDER BY sent) AS sentence_indices FROM sel GROUP BY doc_id)""",
)


class Sentences:
    """Sentences of the corpus and their counted lemmas.

    The texts are spread once, into buckets of documents: all that follows is grouped by document and
    finds its rows together.
    """

    def __init__(self, spark, sf):
        texts = read_table(spark, sf, "documents").select("doc_id", "lang", "text", "n_chars")
        self.docs = materialise_by(texts, "documents", "doc_id")
        self.spans = tok.sentence_spans(self.docs)
        self.total = wt.row_count(read_table(spark, sf, "documents"))
        # one row per sentence, language attached, without a join
        rows = self.docs.select(
            "doc_id", "lang", F.posexplode(_all_sentences()).alias("sent", "sentence")
        )
        self.sentences = rows.select("doc_id", "sent", "sentence")
        words = tok.words_only(rows, "doc_id", "lang", "sent", text="sentence")
        lemmas = tok.lemma_terms(words, lexicon.stop_words(spark), lexicon.form_lemma(self.docs))
        # stored: weights, scores and graphs all start from the counted terms
        self.terms = materialise_by(
            lemmas.groupBy("doc_id", "sent", "term").agg(F.count(F.lit(1)).alias("n")),
            "terms", "doc_id", bucket_count(texts),
        )

    def algorithmic(self):
        return sm.rank_algorithmic(self.spans, self.terms, self.total)

    def selected(self, weighted):
        """The sentences of a summary with their text; only their numbers are ranked."""
        picked = sm.select_sentences(weighted.select("doc_id", "sent", "weight"))
        return sm.with_sentences(picked, self.docs, _all_sentences())


def _all_sentences():
    from corpusloom.functions import text as T

    return F.flatten(F.transform(T.paragraphs(F.col("text")), T.sentences))


@query(
    "position_weights",
    sql.with_(*SPANS_SQL, ALG_SQL[0])
    + "SELECT doc_id, sent, round(ind, 6) AS in_document, round(inp, 6) AS in_paragraph FROM pos",
)
def position_weights(spark, sf):
    out = sm.position_weights(tok.sentence_spans(read_texts(spark, sf, "documents")))
    return out.select(
        "doc_id",
        "sent",
        r6(F.col("in_document"), "in_document"),
        r6(F.col("in_paragraph"), "in_paragraph"),
    )


@query(
    "sentence_scores",
    sql.with_(*SPANS_SQL, *TERMS_SQL) + "SELECT doc_id, sent, round(score, 6) AS score FROM ss",
)
def sentence_scores(spark, sf):
    s = Sentences(spark, sf)
    out = sm.sentence_scores(s.terms, s.total)
    return out.select("doc_id", "sent", r6(F.col("score"), "score"))


@query(
    "rank_algorithmic",
    sql.with_(*SPANS_SQL, *TERMS_SQL, *ALG_SQL) + "SELECT doc_id, sent, weight FROM alg",
)
def rank_algorithmic(spark, sf):
    return Sentences(spark, sf).algorithmic().select("doc_id", "sent", r6(F.col("weight"), "weight"))


GRAPH_SQL = (
    "sz AS (SELECT doc_id, sent, count(*) AS k FROM st GROUP BY doc_id, sent)",
    """edges AS (SELECT a.doc_id, a.sent AS i, b.sent AS j, count(*) /
        (ln(any_value(x.k) + 1) + ln(any_value(y.k) + 1)) AS w
        FROM st a JOIN st b ON a.doc_id = b.doc_id AND a.term = b.term AND a.sent <> b.sent
        JOIN sz x ON x.doc_id = a.doc_id AND x.sent = a.sent
        JOIN sz y ON y.doc_id = b.doc_id AND y.sent = b.sent GROUP BY a.doc_id, a.sent, b.sent)""",
    """strength AS (SELECT doc_id, i AS sent, count(*) AS degree, sum(w) AS out FROM edges
        GROUP BY doc_id, i)""",
)


@query(
    "sentence_graph",
    sql.with_(*SPANS_SQL, *TERMS_SQL[:7], *GRAPH_SQL)
    + """SELECT doc_id, sent, coalesce(degree, 0) AS degree,
    round(coalesce(out, 0), 6) AS strength FROM spans LEFT JOIN strength USING (doc_id, sent)""",
)
def sentence_graph(spark, sf):
    s = Sentences(spark, sf)
    out = sm.sentence_graph(s.sentences, s.terms)
    return out.select("doc_id", "sent", "degree", r6(F.col("strength"), "strength"))


def _step(k: int) -> str:
    return f"""s{k} AS (SELECT s.doc_id, s.sent, s.n, CASE WHEN s.n = 1 THEN 1.0 ELSE
        0.15::DOUBLE / s.n + 0.85::DOUBLE * coalesce(x.v, 0) END AS v FROM s{k - 1} s LEFT JOIN
        (SELECT e.doc_id, e.i AS sent, sum(e.w / t.out * p.v) AS v FROM edges e
        JOIN strength t ON t.doc_id = e.doc_id AND t.sent = e.j
        JOIN s{k - 1} p ON p.doc_id = e.doc_id AND p.sent = e.j GROUP BY e.doc_id, e.i) x
        ON x.doc_id = s.doc_id AND x.sent = s.sent)"""


@query(
    "textrank_three_steps",
    sql.with_(
        *SPANS_SQL,
        *TERMS_SQL[:7],
        *GRAPH_SQL,
        """s0 AS (SELECT doc_id, sent, count(*) OVER (PARTITION BY doc_id) AS n,
            1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id) AS v FROM spans)""",
        _step(1),
        _step(2),
        _step(3),
    )
    + "SELECT doc_id, sent, round(v + 1e-9, 6) AS weight FROM s3",
)
def textrank_three_steps(spark, sf):
    """The power iteration stopped after three steps, where SQL can follow it.

    Few sentences give short exact decimals; both sides move them off the rounding edge.
    """
    s = Sentences(spark, sf)
    out = sm.textrank(s.sentences, s.terms, iterations=3, tolerance=0.0)
    return out.select("doc_id", "sent", r6(F.col("weight") + 1e-9, "weight"))


@query("textrank")
def textrank(spark, sf):
    s = Sentences(spark, sf)
    out = sm.textrank(s.sentences, s.terms)
    return out.select("doc_id", "sent", r6(F.col("weight"), "weight"))


def _sentence_vectors(spark, sf):
    return chunk_vectors(spark, sf).select(
        "doc_id", F.col("chunk_index").alias("sent"), "vector", F.col("label").cast("bigint").alias("query_id")
    )


@query(
    "centrality",
    """WITH d AS (SELECT vec_id // 4 AS doc_id, (vec_id % 4)::INT AS sent,
        generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    c AS (SELECT doc_id, i, avg(x) AS m FROM d GROUP BY doc_id, i)
    SELECT doc_id, sent, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS weight
    FROM d JOIN c USING (doc_id, i) GROUP BY doc_id, sent""",
)
def centrality(spark, sf):
    out = sm.centrality(_sentence_vectors(spark, sf))
    return out.select("doc_id", "sent", r6(F.col("weight"), "weight"))


@query(
    "query_similarity",
    sql.with_(*CENTROID_SQL)
    + """SELECT vec_id // 4 AS doc_id, (vec_id % 4)::INT AS sent, query_id,
    round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS weight
    FROM dims JOIN centroids USING (i) WHERE label = query_id GROUP BY vec_id, query_id""",
)
def query_similarity(spark, sf):
    queries = label_centroids(spark, sf).withColumnRenamed("vector", "query_vector")
    out = sm.query_similarity(_sentence_vectors(spark, sf), queries)
    return out.select("doc_id", "sent", "query_id", r6(F.col("weight"), "weight"))


@query(
    "select_sentences",
    sql.with_(*SPANS_SQL, *TERMS_SQL, *ALG_SQL, *SELECT_SQL)
    + "SELECT doc_id, sent, sentence, weight FROM sel",
)
def select_sentences(spark, sf):
    s = Sentences(spark, sf)
    out = s.selected(s.algorithmic())
    return out.select("doc_id", "sent", "sentence", r6(F.col("weight"), "weight"))


@query(
    "summaries",
    sql.with_(*SPANS_SQL, *TERMS_SQL, *ALG_SQL, *SELECT_SQL, *SUMMARY_SQL)
    + """SELECT d.doc_id, coalesce(summary, '') AS summary,
    coalesce(sentence_indices, []) AS sentence_indices,
    (SELECT count(*) FROM spans s WHERE s.doc_id = d.doc_id) AS total_sentences,
    round(coalesce(length(summary)::DOUBLE / nullif(length(text), 0), 0), 6) AS compression
    FROM documents d LEFT JOIN summ USING (doc_id)""",
)
def summaries(spark, sf):
    s = Sentences(spark, sf)
    out = sm.summaries(s.selected(s.algorithmic()), s.sentences, s.docs)
    return out.withColumn("compression", F.round("compression", 6))


@query(
    "top_keywords",
    sql.with_(*SPANS_SQL, *TERMS_SQL)
    + """SELECT doc_id, term, weight, (row_number() OVER (PARTITION BY doc_id
    ORDER BY weight DESC, term))::INT AS rank
    FROM (SELECT doc_id, term, round(weight, 6) AS weight FROM modified) QUALIFY rank <= 15""",
)
def top_keywords(spark, sf):
    s = Sentences(spark, sf)
    postings = s.terms.groupBy("doc_id", "term").agg(F.sum("n").alias("tf"))
    return sm.top_keywords(wt.modified_weights(postings, s.total))


def corpus_summaries(spark, sf, method):
    """Summaries of all documents by one method; the algorithmic one skips unindexed documents."""
    s = Sentences(spark, sf)
    if method == "algorithmic":
        weighted = s.algorithmic()
        docs = s.docs.join(s.terms.select("doc_id").distinct(), "doc_id", "left_semi")
    else:
        weighted, docs = sm.textrank(s.sentences, s.terms), s.docs
    out = sm.summaries(s.selected(weighted), s.sentences, docs)
    elapsed = s.docs.select("doc_id", (F.col("n_chars") / 1000.0).alias("elapsed_ms"))
    return out.join(elapsed, "doc_id").withColumn("method", F.lit(method))


@query(
    "summary_run_summary",
    sql.with_(*SPANS_SQL, *TERMS_SQL, *ALG_SQL, *SELECT_SQL, *SUMMARY_SQL)
    + """SELECT 'algorithmic' AS method, count(*) AS documents,
    round(avg(n_chars / 1000.0::DOUBLE), 6) AS mean_elapsed_ms,
    round(avg(length(summary)::DOUBLE / length(text)), 6) AS mean_compression,
    round(avg(len(sentence_indices)), 6) AS mean_selected
    FROM summ JOIN documents USING (doc_id)""",
)
def summary_run_summary(spark, sf):
    return _run_summary(corpus_summaries(spark, sf, "algorithmic"))


def _run_summary(results):
    out = sm.run_summary(results)
    return out.select("method", "documents", *[r6(F.col(c), c) for c in out.columns[2:]])


@query("summarize_corpus")
def summarize_corpus(spark, sf):
    """Both methods over the whole corpus, stored per run, compared by method."""
    runs = [
        materialise(corpus_summaries(spark, sf, m), f"summaries-{m}")
        for m in ("algorithmic", "textrank")
    ]
    return _run_summary(runs[0].unionByName(runs[1]))


@query(
    "summary_runs",
    sql.with_(*SPANS_SQL, *TERMS_SQL, *ALG_SQL, *SELECT_SQL, *SUMMARY_SQL)
    + """SELECT 2::BIGINT AS run_id, 'algorithmic' AS method, count(*) AS documents,
    0::BIGINT AS failures, round(avg(length(summary)::DOUBLE / length(text)), 6)
    AS mean_compression, round(avg(len(sentence_indices)), 6) AS mean_selected
    FROM summ JOIN documents USING (doc_id)""",
)
def summary_runs(spark, sf):
    """The corpus summarised twice: the newest completed run of the method, with its means."""
    ledger = RunLedger(spark)
    docs = read_table(spark, sf, "documents").select("doc_id")
    whole = corpus_summaries(spark, sf, "algorithmic").select(
        "doc_id", "summary", "sentence_indices", "compression"
    )
    for _ in range(2):
        run_method(
            ledger, None, "algorithmic", docs,
            lambda part: whole.join(part, "doc_id", "left_semi"), whole.schema,
        )
    newest = ledger.newest_completed("method")
    ids = [row["run_id"] for row in newest.select("run_id").collect()]
    means = ledger.results(ids, whole.schema).groupBy("run_id").agg(
        r6(F.avg("compression"), "mean_compression"),
        r6(F.avg(F.size("sentence_indices")), "mean_selected"),
    )
    return newest.select("run_id", "method", "documents", "failures").join(means, "run_id")
