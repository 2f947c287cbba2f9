"""Queries over language profiles, identification and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import classify as clf, langid as li
from corpusloom.plans import sql
from corpusloom.plans.catalog import query, r6
from corpusloom.plans.search_queries import CENTROID_SQL, chunk_vectors, label_centroids
from corpusloom.sources.shared import materialise
from corpusloom.sources.tables import read_table, read_texts

SPLIT_SQL = (
    """base AS (SELECT doc_id, lang, text, n_chars, md5('7:' || doc_id) AS m,
        count(*) OVER (PARTITION BY lang) AS total FROM documents)""",
    """split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY m) <=
        (CASE WHEN total < 2 THEN 0 ELSE greatest(1, least(round_even(total * 0.2::DOUBLE, 0),
        total - 1)) END) THEN 'test' ELSE 'train' END AS split FROM base)""",
    "train AS (SELECT * FROM split WHERE split = 'train')",
)
WORD_PROFILE_SQL = (
    f"ptok AS (SELECT lang, unnest({sql.words('text')}) AS term FROM train)",
    """profile AS (SELECT lang, term, row_number() OVER (PARTITION BY lang
        ORDER BY count(*) DESC, term) - 1 AS rank FROM ptok GROUP BY lang, term
        QUALIFY rank < 300)""",
)
WORD_DISTANCE_SQL = (
    """dr AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id
        ORDER BY tf DESC, term) - 1 AS doc_rank FROM tf)""",
    """dist AS (SELECT d.doc_id, p.lang, sum(CASE WHEN doc_rank IS NULL THEN 300
        ELSE abs(rank - doc_rank) END)::DOUBLE AS distance
        FROM (SELECT doc_id FROM documents) d CROSS JOIN profile p
        LEFT JOIN dr ON dr.doc_id = d.doc_id AND dr.term = p.term GROUP BY ALL)""",
)
LETTERS = (
    r"unnest(string_split(regexp_replace(lower(text), '\P{L}', '', 'g'), '')) AS letter"
)
ALPHABET_SQL = (
    f"""plc AS (SELECT lang, letter, count(*) AS n FROM (SELECT lang, {LETTERS} FROM train)
        WHERE letter <> '' GROUP BY ALL)""",
    "alpha AS (SELECT lang, letter, n::DOUBLE / sum(n) OVER (PARTITION BY lang) AS freq FROM plc)",
)
ALPHABET_DISTANCE_SQL = (
    f"""dlc AS (SELECT doc_id, letter, count(*) AS n FROM (SELECT doc_id, {LETTERS}
        FROM documents) WHERE letter <> '' GROUP BY ALL)""",
    """dalpha AS (SELECT doc_id, letter, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS f
        FROM dlc)""",
    """keys AS (SELECT doc_id, lang, letter FROM (SELECT doc_id FROM documents) CROSS JOIN alpha
        UNION SELECT doc_id, lang, letter FROM dalpha
        CROSS JOIN (SELECT DISTINCT lang FROM alpha))""",
    """dist AS (SELECT doc_id, lang, sum(abs(coalesce(freq, 0) - coalesce(f, 0))) AS distance
        FROM keys LEFT JOIN alpha USING (lang, letter) LEFT JOIN dalpha USING (doc_id, letter)
        GROUP BY doc_id, lang)""",
)
IDENTIFY_SQL = (
    "rdist AS (SELECT doc_id, lang, round(distance, 6) AS distance FROM dist)",
    """ident AS (SELECT doc_id, arg_min(lang, (distance, lang)) AS predicted,
        min(distance) AS distance FROM rdist GROUP BY doc_id)""",
)


def split_documents(spark, sf):
    docs = read_texts(spark, sf, "documents").withColumn("split", F.lit(None).cast("string"))
    return li.stratified_split(docs, 0.2, seed=7)


def training_texts(spark, sf):
    return split_documents(spark, sf).filter("split = 'train'")


@query(
    "frequent_word_profiles",
    sql.with_(*SPLIT_SQL, *WORD_PROFILE_SQL) + "SELECT lang, term, rank::INT AS rank FROM profile",
)
def frequent_word_profiles(spark, sf):
    return li.word_profiles(training_texts(spark, sf))


@query(
    "out_of_place_distances",
    sql.with_(*SPLIT_SQL, *WORD_PROFILE_SQL, sql.TOKENS, sql.TF, *WORD_DISTANCE_SQL)
    + "SELECT * FROM dist",
)
def out_of_place_distances(spark, sf):
    profiles = materialise(li.word_profiles(training_texts(spark, sf)), "profiles")
    return li.out_of_place_distances(read_texts(spark, sf, "documents"), profiles)


@query(
    "alphabet_profiles",
    sql.with_(*SPLIT_SQL, *ALPHABET_SQL)
    + "SELECT lang, letter, round(freq, 6) AS freq FROM alpha",
)
def alphabet_profiles(spark, sf):
    out = li.alphabet_profiles(training_texts(spark, sf))
    return out.select("lang", "letter", r6(F.col("freq"), "freq"))


@query(
    "alphabet_distances",
    sql.with_(*SPLIT_SQL, *ALPHABET_SQL, *ALPHABET_DISTANCE_SQL)
    + "SELECT doc_id, lang, round(distance, 6) AS distance FROM dist",
)
def alphabet_distances(spark, sf):
    profiles = materialise(li.alphabet_profiles(training_texts(spark, sf)), "profiles")
    out = li.alphabet_distances(read_texts(spark, sf, "documents"), profiles)
    return out.select("doc_id", "lang", r6(F.col("distance"), "distance"))


def identified(spark, sf, method):
    build = {"frequent_words": li.word_profiles, "alphabetic": li.alphabet_profiles}[method]
    profiles = materialise(build(training_texts(spark, sf)), "profiles")
    return li.identify(li.METHODS[method](read_texts(spark, sf, "documents"), profiles))


_WORDS = (*SPLIT_SQL, *WORD_PROFILE_SQL, sql.TOKENS, sql.TF, *WORD_DISTANCE_SQL, *IDENTIFY_SQL)
_LETTERS = (*SPLIT_SQL, *ALPHABET_SQL, *ALPHABET_DISTANCE_SQL, *IDENTIFY_SQL)
_IDENT = """SELECT doc_id, predicted, i.distance, list_aggregate(list(lang || '=' ||
    printf('%.6f', r.distance) ORDER BY lang), 'string_agg', ' ') AS distances
    FROM ident i JOIN rdist r USING (doc_id) GROUP BY doc_id, predicted, i.distance"""


def _printable(df):
    text = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("distances")),
            lambda e: F.format_string("%s=%.6f", e["key"], e["value"]),
        ),
        " ",
    )
    return df.withColumn("distances", text)


@query("identify_by_words", sql.with_(*_WORDS) + _IDENT)
def identify_by_words(spark, sf):
    return _printable(identified(spark, sf, "frequent_words"))


@query("identify_by_letters", sql.with_(*_LETTERS) + _IDENT)
def identify_by_letters(spark, sf):
    return _printable(identified(spark, sf, "alphabetic"))


def _vectors(spark, sf):
    return chunk_vectors(spark, sf).select("doc_id", "chunk_index", "vector", "label")


@query("train_classifier")
def train_classifier(spark, sf):
    """The loss curve of the softmax classifier on the stored vectors."""
    model = clf.train(_vectors(spark, sf))
    return clf.loss_curve(model, spark).select("epoch", r6(F.col("loss"), "loss"))


@query("classify_vectors")
def classify_vectors(spark, sf):
    vectors = _vectors(spark, sf)
    out = clf.classify(clf.train(vectors), vectors)
    return out.select(
        "doc_id",
        "chunk_index",
        "label",
        "predicted",
        r6(F.col("distances")[F.col("predicted")], "distance"),
    )


# Slope of the loss that counts as none: training stops at a relative change of its own.
SLOPE_LEFT = 1e-3


@query(
    "classifier_at_optimum",
    "SELECT DISTINCT label AS class, true AS at_optimum FROM embeddings",
)
def classifier_at_optimum(spark, sf):
    """Whether no coefficient of the trained classes has a slope left in the penalised loss."""
    vectors = _vectors(spark, sf)
    table = clf.coefficients(clf.train(vectors), spark)
    slopes = clf.loss_gradient(table, vectors)
    return slopes.groupBy("class").agg(
        (F.max(F.abs("gradient")) < SLOPE_LEFT).alias("at_optimum")
    )


@query(
    "softmax_classes",
    sql.with_(*CENTROID_SQL)
    + """, z AS (SELECT vec_id, label, query_id AS class, sum(4 * m * x) AS z FROM dims
        JOIN (SELECT query_id, i, m FROM centroids) USING (i) GROUP BY ALL),
    e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
    p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)
    SELECT (vec_id // 4) AS doc_id, (vec_id % 4)::INT AS chunk_index, any_value(label) AS label,
    arg_max(class, (p, -class))::INT AS predicted, round(1 - max(p), 6) AS distance
    FROM p GROUP BY vec_id""",
)
def softmax_classes(spark, sf):
    """Classes of all vectors from stored coefficients: four times the mean vector of each label."""
    table = label_centroids(spark, sf).select(
        F.col("query_id").cast("int").alias("class"),
        F.lit(0.0).alias("intercept"),
        F.expr("transform(vector, x -> 4 * x)").alias("weights"),
    )
    out = clf.classify_by_table(table, _vectors(spark, sf))
    return out.select("doc_id", "chunk_index", "label", "predicted", r6(F.col("distance"), "distance"))


PAIRS_SQL = (
    """pairs AS (SELECT s.doc_id, s.lang AS actual, i.predicted, s.n_chars / 1000.0::DOUBLE
        AS elapsed_ms FROM split s JOIN ident i USING (doc_id) WHERE s.split = 'test')""",
    "confusion AS (SELECT actual, predicted, count(*) AS n FROM pairs GROUP BY ALL)",
    """labels_ AS (SELECT actual AS label FROM confusion UNION SELECT predicted FROM confusion)""",
    """lc AS (SELECT label, sum(n) FILTER (actual = label AND predicted = label) AS tp,
        sum(n) FILTER (actual = label) AS an, sum(n) FILTER (predicted = label) AS pn
        FROM labels_ CROSS JOIN confusion GROUP BY label)""",
    """lpr AS (SELECT label, coalesce(tp::DOUBLE / pn, 0) AS precision,
        coalesce(tp::DOUBLE / an, 0) AS recall FROM lc)""",
    """lf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1
        FROM lpr)""",
)


def result_pairs(spark, sf, method="frequent_words"):
    """Held-out documents with actual and predicted language."""
    held_out = split_documents(spark, sf).filter("split = 'test'")
    return held_out.join(identified(spark, sf, method), "doc_id").select(
        "doc_id",
        F.col("lang").alias("actual"),
        "predicted",
        (F.col("n_chars") / 1000.0).alias("elapsed_ms"),
    )


@query("confusion_matrix", sql.with_(*_WORDS, *PAIRS_SQL) + "SELECT * FROM confusion")
def confusion_matrix(spark, sf):
    return li.confusion_matrix(result_pairs(spark, sf))


@query(
    "macro_scores",
    sql.with_(*_WORDS, *PAIRS_SQL)
    + "SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, "
    "round(avg(f1), 6) AS f1 FROM lf",
)
def macro_scores(spark, sf):
    out = li.macro_scores(li.confusion_matrix(result_pairs(spark, sf)))
    return out.select(*[r6(F.col(c), c) for c in out.columns])


@query(
    "langid_run_summary",
    sql.with_(*_LETTERS, *PAIRS_SQL)
    + """SELECT count(*) AS documents, round(avg((actual = predicted)::INT), 6) AS accuracy,
    (SELECT round(avg(precision), 6) FROM lf) AS precision,
    (SELECT round(avg(recall), 6) FROM lf) AS recall, (SELECT round(avg(f1), 6) FROM lf) AS f1,
    round(avg(elapsed_ms), 6) AS mean_elapsed_ms FROM pairs""",
)
def langid_run_summary(spark, sf):
    out = li.run_summary(materialise(result_pairs(spark, sf, "alphabetic"), "results"))
    return out.select("documents", *[r6(F.col(c), c) for c in out.columns[1:]])


@query(
    "label_quality_scores",
    """WITH p AS (SELECT CAST(quality AS VARCHAR) AS actual, CASE WHEN n_chars >= 500 THEN '1'
        ELSE '0' END AS predicted FROM labels JOIN documents USING (doc_id)),
    l AS (SELECT unnest(['0', '1']) AS label),
    c AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS tp,
        count(*) FILTER (actual = label) AS an, count(*) FILTER (predicted = label) AS pn
        FROM l CROSS JOIN p GROUP BY label)
    SELECT label, round(coalesce(tp::DOUBLE / nullif(pn, 0), 0), 6) AS precision,
    round(coalesce(tp::DOUBLE / nullif(an, 0), 0), 6) AS recall,
    round(coalesce(2.0::DOUBLE * tp / nullif(pn + an, 0), 0), 6) AS f1 FROM c""",
)
def label_quality_scores(spark, sf):
    """Per-label scores of a length rule against the stored quality labels."""
    pairs = read_table(spark, sf, "labels").join(
        read_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    pairs = pairs.select(
        F.col("quality").cast("string").alias("actual"),
        F.when(F.col("n_chars") >= 500, F.lit("1")).otherwise(F.lit("0")).alias("predicted"),
    )
    out = li.label_scores(li.confusion_matrix(pairs))
    return out.select("label", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query("stratified_split", sql.with_(*SPLIT_SQL) + "SELECT doc_id, lang, split FROM split")
def stratified_split(spark, sf):
    return split_documents(spark, sf).select("doc_id", "lang", "split")


# Labelled documents are confirmed; those of a known quality are already split.
_LABELLED_SQL = """lab AS (SELECT doc_id, lang, CASE WHEN quality IS NOT NULL THEN lang END
    AS confirmed, CASE WHEN toxic = 1 THEN 'test' WHEN quality = 1 THEN 'train' END AS split
    FROM documents LEFT JOIN labels USING (doc_id))"""


def labelled(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(read_table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id",
        "lang",
        F.when(F.col("quality").isNotNull(), F.col("lang")).alias("confirmed"),
        F.when(F.col("toxic") == 1, "test").when(F.col("quality") == 1, "train").alias("split"),
    )


@query(
    "extend_split",
    sql.with_(_LABELLED_SQL)
    + """, t AS (SELECT lang, count(*) AS total, count(*) FILTER (split = 'test') AS has
        FROM lab GROUP BY lang),
    need AS (SELECT lang, CASE WHEN total < 2 THEN 0 ELSE greatest(0, greatest(1,
        least(round_even(total * 0.3::DOUBLE, 0), total - 1)) - has) END AS need FROM t),
    f AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id))
        AS i FROM lab WHERE split IS NULL)
    SELECT doc_id, lang, split FROM lab WHERE split IS NOT NULL UNION ALL
    SELECT doc_id, lang, CASE WHEN i <= need THEN 'test' ELSE 'train' END FROM f
    JOIN need USING (lang)""",
)
def extend_split(spark, sf):
    """A split that counts the documents already assigned."""
    return li.stratified_split(labelled(spark, sf).drop("confirmed"), 0.3, seed=3)


@query(
    "split_counts",
    sql.with_(_LABELLED_SQL)
    + """SELECT lang, count(*) FILTER (split = 'train') AS train,
    count(*) FILTER (split = 'test') AS test, count(*) FILTER (split IS NULL) AS unassigned
    FROM lab GROUP BY lang""",
)
def split_counts(spark, sf):
    return li.split_counts(labelled(spark, sf))


@query(
    "label_progress",
    sql.with_(_LABELLED_SQL)
    + """SELECT lang, count(confirmed) AS confirmed,
    count(*) FILTER (confirmed IS NULL) AS unlabelled FROM lab GROUP BY lang""",
)
def label_progress(spark, sf):
    return li.label_progress(labelled(spark, sf))


@query(
    "document_selections",
    sql.with_(_LABELLED_SQL)
    + """SELECT 'training' AS selection, doc_id, lang FROM lab WHERE confirmed IS NOT NULL
        AND split = 'train'
    UNION ALL SELECT 'test', doc_id, lang FROM lab WHERE confirmed IS NOT NULL
        AND split = 'test'
    UNION ALL SELECT 'unlabelled', doc_id, lang FROM lab WHERE confirmed IS NULL""",
)
def document_selections(spark, sf):
    docs = labelled(spark, sf)
    parts = [
        li.selection(docs, which).select(F.lit(which).alias("selection"), "doc_id", "lang")
        for which in ("training", "test", "unlabelled")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "training_languages",
    sql.with_(_LABELLED_SQL)
    + """SELECT confirmed AS lang, count(*) AS documents FROM lab WHERE split = 'train'
    AND confirmed IS NOT NULL GROUP BY confirmed""",
)
def training_languages(spark, sf):
    rows = li.selection(labelled(spark, sf), "training")
    return rows.groupBy(F.col("confirmed").alias("lang")).agg(F.count(F.lit(1)).alias("documents"))


@query(
    "compare_methods",
    """SELECT 'method-' || (user_id % 5) AS method, max(event_id) AS run_id FROM events
    WHERE event_type = 'purchase' GROUP BY ALL""",
)
def compare_methods(spark, sf):
    runs = read_table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("method-"), F.col("user_id") % 5).alias("method"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"),
    )
    return li.newest_per_method(runs)
