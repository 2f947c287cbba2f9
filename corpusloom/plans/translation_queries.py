"""Queries over dictionaries, direct and transfer translation, and keyword phrases."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from corpusloom.operators import (
    morphology as mo,
    summarize as sm,
    transfer as tf,
    translate as tr,
    weighting as wt,
)
from corpusloom.plans import annotate as an, sql
from corpusloom.operators.runs import RunLedger, run_method
from corpusloom.plans.catalog import query, r6
from corpusloom.sources import lexicons
from corpusloom.sources.shared import materialise, scratch_path
from corpusloom.sources.tables import read_table, scan_documents

BASE_SQL = (*an.TOKEN_SQL, *an.DICT_SQL, *an.KNOWN_SQL)


class Translation:
    """Annotated tokens with their translations, and the lexicons."""

    def __init__(self, spark, sf):
        self.spark = spark
        # the annotation is an input table elsewhere: written once, then read by every step
        self.tokens = materialise(an.tokens_of(spark, sf), "tokens")

    @cached_property
    def lookup(self):
        return an.lookup_of(self.spark, self.tokens)

    @cached_property
    def known(self):
        return tr.with_translation(self.tokens, self.lookup)

    @property
    def untranslated(self):
        """The tokens for rules whose result no translation has a part in."""
        return self.tokens.withColumn("translation", F.lit(None).cast("string"))

    @cached_property
    def stored(self):
        """The translated tokens, written once for rules that read them several times."""
        return materialise(self.known.repartition("doc_id"), "translated")

    def lexicons(self):
        return an.lexicons_of(self.spark, self.lookup)


@query(
    "annotated_tokens",
    sql.with_(*an.TOKEN_SQL)
    + """SELECT pos, dep, number, is_stop, count(*) AS n, sum(head_i - i)::BIGINT AS reach,
    sum(sent_id)::BIGINT AS sents, count(DISTINCT lemma) AS lemmas FROM tok GROUP BY ALL""",
)
def annotated_tokens(spark, sf):
    tokens = an.tokens_of(spark, sf).withColumn("number", F.try_element_at("morph", F.lit("Number")))
    return tokens.groupBy("pos", "dep", "number", "is_stop").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("head_i") - F.col("i")).alias("reach"),
        F.sum("sent_id").alias("sents"),
        F.countDistinct("lemma").alias("lemmas"),
    )


@query(
    "merge_dictionaries",
    sql.with_(*an.TOKEN_SQL, *an.DICT_SQL)
    + "SELECT id, source_lemma, pos, target_text FROM dictionary",
)
def merge_dictionaries(spark, sf):
    return an.dictionary(spark, an.tokens_of(spark, sf)).select(
        "id", "source_lemma", "pos", "target_text"
    )


@query("build_lookup", sql.with_(*an.TOKEN_SQL, *an.DICT_SQL) + "SELECT * FROM lookup")
def build_lookup(spark, sf):
    return tr.build_lookup(an.dictionary(spark, an.tokens_of(spark, sf)), "en", "fr")


@query(
    "lookup_translations",
    sql.with_(*BASE_SQL)
    + "SELECT lemma, pos, translation, count(*) AS n FROM known GROUP BY ALL",
)
def lookup_translations(spark, sf):
    return Translation(spark, sf).known.groupBy("lemma", "pos", "translation").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "match_case",
    sql.with_(*BASE_SQL)
    + f"""SELECT text, translation, {an.match_case_sql('text', 'translation')} AS cased
    FROM known WHERE is_alpha AND translation IS NOT NULL GROUP BY ALL""",
)
def match_case(spark, sf):
    from corpusloom.functions.text import match_case as cased

    known = Translation(spark, sf).known.filter("is_alpha and translation is not null")
    return known.select(
        "text", "translation", cased(F.col("text"), F.col("translation")).alias("cased")
    ).distinct()


DIRECT_SQL = (
    f"""direct AS (SELECT doc_id, string_agg(CASE WHEN is_alpha AND translation IS NOT NULL THEN
        {an.match_case_sql('text', 'translation')} ELSE text END || trailing_ws, '' ORDER BY i)
        AS translated_text, count(*) FILTER (is_alpha) AS word_count,
        count(*) FILTER (is_alpha AND translation IS NOT NULL) AS translated_word_count
        FROM known GROUP BY doc_id)""",
)


@query("direct_translate", sql.with_(*BASE_SQL, *DIRECT_SQL) + "SELECT * FROM direct")
def direct_translate(spark, sf):
    return tr.direct_translate(Translation(spark, sf).known)


@query(
    "translation_word_list",
    sql.with_(*BASE_SQL)
    + """SELECT doc_id, lemma, pos, count(*) AS frequency, arg_min(lower(text), i) AS surface,
    any_value(translation) AS translation, (row_number() OVER (PARTITION BY doc_id
    ORDER BY count(*) DESC, min(i)))::INT AS rank
    FROM known WHERE is_alpha AND NOT is_stop GROUP BY doc_id, lemma, pos""",
)
def translation_word_list(spark, sf):
    return tr.word_list(Translation(spark, sf).known)


COVERAGE_SQL = (
    r"""covered AS (SELECT *, coalesce(translated_word_count::DOUBLE / nullif(word_count, 0), 0)
        AS coverage, len(list_filter(string_split_regex(translated_text, '\s+'),
        lambda w: w <> '')) AS output_word_count FROM direct)""",
)


@query(
    "translation_coverage",
    sql.with_(*BASE_SQL, *DIRECT_SQL, *COVERAGE_SQL)
    + """SELECT doc_id, word_count, translated_word_count, output_word_count::INT
    AS output_word_count, round(coverage, 6) AS coverage FROM covered""",
)
def translation_coverage(spark, sf):
    out = tr.with_coverage(tr.direct_translate(Translation(spark, sf).known))
    return out.select(
        "doc_id",
        "word_count",
        "translated_word_count",
        "output_word_count",
        r6(F.col("coverage"), "coverage"),
    )


NEGATION_SQL = (
    "neg AS (SELECT doc_id, i AS neg_i, head_i FROM known WHERE dep = 'neg')",
    """aux AS (SELECT doc_id, head_i, min(i) AS aux_i FROM known WHERE dep = 'aux'
        AND lemma = 'do' GROUP BY doc_id, head_i)""",
    """gone AS (SELECT doc_id, neg_i AS i FROM neg UNION SELECT a.doc_id, aux_i FROM aux a
        SEMI JOIN neg USING (doc_id, head_i))""",
    """u1 AS (SELECT *, i AS spot, 0 AS part, 0 AS sub, NULL::VARCHAR AS literal FROM known
        ANTI JOIN gone USING (doc_id, i)
        UNION ALL BY NAME SELECT n.doc_id, h.sent_id, n.head_i AS spot, p.part, n.neg_i AS sub,
        p.literal FROM neg n JOIN known h ON h.doc_id = n.doc_id AND h.i = n.head_i
        CROSS JOIN (VALUES (-1, 'ne'), (2, 'pas')) p(part, literal)
        WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = n.doc_id AND g.i = n.head_i))""",
)


def _move_sql(source: str, target: str) -> str:
    prenominal = ", ".join(f"'{w}'" for w in tf.PRENOMINAL)
    return f"""{target} AS (SELECT u.* REPLACE (CASE WHEN m.i IS NULL THEN spot
        ELSE u.head_i END AS spot, CASE WHEN m.i IS NULL THEN part ELSE 1 END AS part,
        CASE WHEN m.i IS NULL THEN sub ELSE u.i END AS sub) FROM {source} u LEFT JOIN
        (SELECT a.doc_id, a.i FROM known a JOIN known h ON h.doc_id = a.doc_id
        AND h.i = a.head_i WHERE a.dep = 'amod' AND a.i < h.i AND h.pos IN ('NOUN', 'PROPN')
        AND lower(a.lemma) NOT IN ({prenominal})) m ON m.doc_id = u.doc_id AND m.i = u.i)"""


def _order_sql(units: str) -> str:
    return (
        "SELECT doc_id, string_agg(coalesce(literal, text), ' ' ORDER BY spot, part, sub) "
        f"AS words FROM {units} GROUP BY doc_id"
    )


def _in_order(units):
    word = F.coalesce("literal", "text")
    return units.groupBy("doc_id").agg(
        tr.ordered_concat(units, word, "at", "part", "sub", sep=" ").alias("words")
    )


@query("negation", sql.with_(*BASE_SQL, *NEGATION_SQL) + _order_sql("u1"))
def negation(spark, sf):
    return _in_order(tf.negation(tf.start_units(Translation(spark, sf).untranslated)))


@query(
    "adjective_postposition",
    sql.with_(
        *BASE_SQL,
        "u0 AS (SELECT *, i AS spot, 0 AS part, 0 AS sub, NULL::VARCHAR AS literal FROM known)",
        _move_sql("u0", "u2"),
    )
    + _order_sql("u2"),
)
def adjective_postposition(spark, sf):
    return _in_order(tf.adjective_postposition(tf.start_units(Translation(spark, sf).untranslated)))


def _agree_sql(source: str, target: str) -> str:
    return f"""{target} AS (SELECT u.*, CASE
        WHEN u.dep = 'amod' THEN CASE WHEN u.translation IS NOT NULL AND h.translation IS NOT NULL
        THEN coalesce(CASE WHEN coalesce(hn.gender, 'm') = 'f' THEN
            CASE WHEN coalesce(h.number, u.number) = 'Plur' THEN a.fp ELSE a.fs END
            WHEN coalesce(h.number, u.number) = 'Plur' THEN a.mp ELSE a.ms END, u.translation) END
        WHEN u.pos = 'VERB' THEN CASE WHEN u.translation IS NOT NULL THEN
            coalesce(CASE WHEN u.number = 'Plur' THEN v.p3p ELSE v.p3s END, u.translation) END
        WHEN u.pos IN ('NOUN', 'PROPN') AND u.number = 'Plur' AND u.translation IS NOT NULL
            THEN coalesce(n.plural, u.translation) END AS forced
        FROM {source} u LEFT JOIN known h ON h.doc_id = u.doc_id AND h.i = u.head_i
        LEFT JOIN nouns hn ON hn.word = h.translation
        LEFT JOIN adjectives a ON a.word = u.translation
        LEFT JOIN verbs v ON v.word = u.translation
        LEFT JOIN nouns n ON n.word = u.translation)"""


@query(
    "agreement",
    sql.with_(*BASE_SQL, *an.LEXICON_SQL, _agree_sql("known", "u3"))
    + "SELECT pos, dep, translation, forced, count(*) AS n FROM u3 "
    "WHERE forced IS NOT NULL GROUP BY ALL",
)
def agreement(spark, sf):
    t = Translation(spark, sf)
    units = tf.agreement(tf.start_units(t.known), *t.lexicons())
    return units.filter("forced is not null").groupBy("pos", "dep", "translation", "forced").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "morphology",
    sql.with_(*BASE_SQL, *an.LEXICON_SQL)
    + """SELECT translation, coalesce(n.gender, 'm') AS gender,
    coalesce(n.plural, translation) AS plural, coalesce(a.fp, translation) AS feminine_plural,
    coalesce(v.p2p, translation) AS second_plural, coalesce(v.p3s, translation) AS third_singular
    FROM (SELECT DISTINCT translation FROM known WHERE translation IS NOT NULL)
    LEFT JOIN nouns n ON n.word = translation LEFT JOIN adjectives a ON a.word = translation
    LEFT JOIN verbs v ON v.word = translation""",
)
def morphology(spark, sf):
    t = Translation(spark, sf)
    nouns, adjectives, verbs = t.lexicons()
    df = (
        t.known.filter("translation is not null")
        .groupBy("translation")
        .agg(F.min("doc_id").alias("doc_id"), F.min("i").alias("i"))
        .withColumn("f", F.lit("f"))
        .withColumn("plur", F.lit("Plur"))
        .withColumn("second", F.lit("2"))
        .withColumn("none", F.lit(None).cast("string"))
    )
    df = mo.with_gender(df, nouns, "translation", "gender")
    df = mo.with_plural(df, nouns, "translation", "plural")
    df = mo.with_agreed_adjective(df, adjectives, "translation", "f", "plur", "feminine_plural")
    df = mo.with_conjugation(df, verbs, "translation", "second", "plur", "second_plural")
    df = mo.with_conjugation(df, verbs, "translation", "none", "none", "third_singular")
    return df.select(
        "translation", "gender", "plural", "feminine_plural", "second_plural", "third_singular"
    )


_SOURCE = (
    "CASE WHEN is_sent_start AND NOT (upper(text) = text AND upper(text) <> lower(text) "
    "AND length(text) > 1) THEN lower(text) ELSE text END"
)
_CLOSING = ", ".join(f"'{c}'" for c in tf.CLOSING_MARKS)
_VOWELS = ", ".join(f"'{c}'" for c in tf.VOWEL_SOUNDS)
_PAIRS = " ".join(
    f"WHEN lower(piece) = '{a}' AND lower(nxt) = '{b}' THEN '{c}'"
    for (a, b), c in tf.CONTRACTIONS.items()
)
RENDER_SQL = (
    *an.LEXICON_SQL,
    *NEGATION_SQL,
    _move_sql("u1", "u2"),
    _agree_sql("u2", "u3"),
    f"""u4 AS (SELECT *, coalesce(nullif(forced, ''), translation) AS tr, {_SOURCE} AS src,
        row_number() OVER w AS n, literal IS NULL AND coalesce(lag(CASE WHEN literal IS NULL
        THEN i END) OVER w = i - 1, false) AS adjacent FROM u3
        WINDOW w AS (PARTITION BY doc_id ORDER BY spot, part, sub))""",
    f"""pieces AS (SELECT doc_id, n, sent_id, CASE WHEN literal IS NOT NULL THEN literal
        WHEN NOT is_alpha THEN text WHEN tr IS NULL THEN src
        ELSE {an.match_case_sql('src', 'tr')} END AS piece,
        literal IS NULL AND NOT is_alpha AS is_mark, (adjacent AND no_space_before)
        OR (literal IS NULL AND NOT is_alpha AND text IN ({_CLOSING})) AS glued FROM u4)""",
)
CONTRACT_SQL = (
    """c1 AS (SELECT *, lead(piece) OVER w AS nxt, lead(is_mark) OVER w AS nxt_mark FROM pieces
        WINDOW w AS (PARTITION BY doc_id ORDER BY n))""",
    f"c2 AS (SELECT *, CASE WHEN is_mark OR nxt_mark THEN NULL {_PAIRS} END AS merged FROM c1)",
    f"""c3 AS (SELECT * REPLACE (CASE WHEN merged IS NULL THEN piece
        ELSE {an.match_case_sql('piece', 'merged')} END AS piece),
        lag(merged) OVER (PARTITION BY doc_id ORDER BY n) IS NOT NULL AS eaten FROM c2)""",
    "contracted AS (SELECT doc_id, n, sent_id, piece, glued FROM c3 WHERE NOT eaten)",
)
ELIDE_SQL = (
    f"""elided AS (SELECT * REPLACE (CASE WHEN lower(piece) = 'ne' AND lower(nxt[1]) IN ({_VOWELS})
        THEN CASE WHEN piece[1] = 'N' THEN 'N''' ELSE 'n''' END ELSE piece END AS piece)
        FROM (SELECT *, lead(piece) OVER (PARTITION BY doc_id ORDER BY n) AS nxt
        FROM contracted))""",
)
JOIN_SQL = (
    """transfer AS (SELECT doc_id, string_agg(CASE WHEN prev IS NULL OR glued OR prev LIKE '%'''
        THEN '' ELSE ' ' END || CASE WHEN sent_id IS DISTINCT FROM prev_sent
        THEN upper(piece[1]) || piece[2:] ELSE piece END, '' ORDER BY n) AS translated_text
        FROM (SELECT *, lag(piece) OVER w AS prev, lag(sent_id) OVER w AS prev_sent FROM elided
        WINDOW w AS (PARTITION BY doc_id ORDER BY n)) GROUP BY doc_id)""",
)


def _pieces(spark, sf):
    t = Translation(spark, sf)
    units = tf.adjective_postposition(tf.negation(tf.start_units(t.known)))
    return tf.render(tf.agreement(units, *t.lexicons()))


def _piece_text(pieces):
    return pieces.groupBy("doc_id").agg(
        tr.ordered_concat(pieces, F.col("piece"), "at", "part", "sub", sep=" ").alias("words")
    )


def _piece_sql(name):
    return f"SELECT doc_id, string_agg(piece, ' ' ORDER BY n) AS words FROM {name} GROUP BY doc_id"


@query(
    "contractions",
    sql.with_(*BASE_SQL, *RENDER_SQL, *CONTRACT_SQL) + _piece_sql("contracted"),
)
def contractions(spark, sf):
    return _piece_text(tf.contractions(_pieces(spark, sf)))


@query(
    "elision",
    sql.with_(*BASE_SQL, *RENDER_SQL, *CONTRACT_SQL, *ELIDE_SQL) + _piece_sql("elided"),
)
def elision(spark, sf):
    return _piece_text(tf.elision(tf.contractions(_pieces(spark, sf))))


@query(
    "detokenise",
    sql.with_(
        *BASE_SQL, *RENDER_SQL,
        "elided AS (SELECT * FROM pieces)",
        *JOIN_SQL,
    )
    + "SELECT * FROM transfer",
)
def detokenise(spark, sf):
    """Rendered pieces joined as they are, before contractions and elisions."""
    return tf.detokenise(_pieces(spark, sf)).select("doc_id", "translated_text")


TRANSFER_SQL = (*BASE_SQL, *RENDER_SQL, *CONTRACT_SQL, *ELIDE_SQL, *JOIN_SQL)


@query(
    "transfer_translate",
    sql.with_(*TRANSFER_SQL, *DIRECT_SQL)
    + """SELECT doc_id, t.translated_text, word_count, translated_word_count
    FROM transfer t JOIN direct d USING (doc_id)""",
)
def transfer_translate(spark, sf):
    t = Translation(spark, sf)
    return tf.transfer_translate(t.tokens, t.lookup, *t.lexicons(), translated=t.stored)


@query("diff_against_direct")
def diff_against_direct(spark, sf):
    t = Translation(spark, sf)
    direct = tr.direct_translate(t.known).select(
        "doc_id", F.col("translated_text").alias("direct_text")
    )
    transfer = tf.transfer_translate(t.tokens, t.lookup, *t.lexicons(), translated=t.stored)
    both = transfer.join(direct, "doc_id")
    return both.select(
        "doc_id", tf.diff_segments("direct_text", "translated_text").alias("segments")
    )


_RUN_SQL = """SELECT 'direct' AS method, count(*) AS documents,
    round(avg(n_chars / 1000.0::DOUBLE), 6) AS mean_elapsed_ms,
    round(avg(word_count), 6) AS mean_words,
    round(avg(translated_word_count), 6) AS mean_translated_words,
    round(avg(output_word_count), 6) AS mean_output_words,
    round(avg(coverage), 6) AS mean_coverage
    FROM covered JOIN documents USING (doc_id)"""


def _translated_runs(spark, sf):
    """Direct translations of the documents in the source language, with an error column.

    A document that yields no tokens keeps its row and says why.
    """
    docs = scan_documents(read_table(spark, sf, "documents"), language="en")
    out = tr.with_coverage(tr.direct_translate(Translation(spark, sf).known))
    return (
        docs.select("doc_id", "source", (F.col("n_chars") / 1000.0).alias("elapsed_ms"))
        .join(out, "doc_id", "left")
        .withColumn("method", F.lit("direct"))
        .withColumn(
            "error",
            F.when(F.col("translated_text").isNull(), F.lit("the document has no tokens")),
        )
    )


@query("translation_run_summary", sql.with_(*BASE_SQL, *DIRECT_SQL, *COVERAGE_SQL) + _RUN_SQL)
def translation_run_summary(spark, sf):
    out = tr.run_summary(_translated_runs(spark, sf).filter("error is null"))
    return out.select("method", "documents", *[r6(F.col(c), c) for c in out.columns[2:]])


@query(
    "corpus_translation",
    sql.with_(*BASE_SQL, *DIRECT_SQL, *COVERAGE_SQL)
    + """SELECT source AS collection, 'direct' AS method, count(*) AS documents,
    count(*) FILTER (translated_text IS NULL) AS failed,
    coalesce(sum(translated_word_count), 0)::BIGINT AS translated_words,
    round(coalesce(avg(coverage), 0), 6) AS mean_coverage
    FROM documents LEFT JOIN covered USING (doc_id) WHERE lang = 'en' GROUP BY source""",
)
def corpus_translation(spark, sf):
    return _translated_runs(spark, sf).groupBy(F.col("source").alias("collection"), "method").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum("translated_word_count"), F.lit(0)).alias("translated_words"),
        r6(F.coalesce(F.avg("coverage"), F.lit(0.0)), "mean_coverage"),
    )


@query(
    "translation_runs",
    sql.with_(*TRANSFER_SQL, *DIRECT_SQL)
    + """SELECT 2::BIGINT AS run_id, 'direct' AS method, 'completed' AS status,
    count(*) AS documents, 0::BIGINT AS failures, sum(word_count)::BIGINT AS words,
    sum(length(translated_text))::BIGINT AS chars FROM direct
    UNION ALL SELECT 3, 'transfer', 'completed', count(*), 0, sum(word_count)::BIGINT,
    sum(length(t.translated_text))::BIGINT FROM transfer t JOIN direct d USING (doc_id)""",
)
def translation_runs(spark, sf):
    """Direct translation run twice and transfer once: what the newest completed runs stored."""
    t = Translation(spark, sf)
    columns = ["doc_id", "translated_text", "word_count"]
    docs = scan_documents(read_table(spark, sf, "documents"), language="en").select("doc_id")
    transferred = tf.transfer_translate(t.tokens, t.lookup, *t.lexicons(), translated=t.stored)
    methods = {"direct": tr.direct_translate(t.stored), "transfer": transferred}
    ledger = RunLedger(spark)
    for method in ("direct", "direct", "transfer"):
        whole = methods[method].select(columns)
        run_method(
            ledger, None, method, docs,
            lambda part, whole=whole: whole.join(part, "doc_id", "left_semi"), whole.schema,
        )
    newest = ledger.newest_completed("method").select(
        "run_id", "method", "status", "documents", "failures"
    )
    ids = [row["run_id"] for row in newest.collect()]
    stored = ledger.results(ids, methods["direct"].select(columns).schema)
    sums = stored.groupBy("run_id").agg(
        F.sum("word_count").alias("words"),
        F.sum(F.length("translated_text")).cast("long").alias("chars"),
    )
    return newest.join(sums, "run_id")


@query(
    "read_dictionary_tsv",
    """SELECT p_name AS source_lemma, p_brand AS pos, p_type AS target_text
    FROM part WHERE p_size % 7 NOT IN (0, 1)""",
)
def read_dictionary_tsv(spark, sf):
    """The part table written as lines, some a column short or long, and read back."""
    part = read_table(spark, sf, "part")
    line = (
        F.when(F.col("p_size") % 7 == 0, F.concat_ws("\t", "p_name", "p_brand"))
        .when(F.col("p_size") % 7 == 1, F.concat_ws("\t", "p_name", "p_brand", "p_type", "p_name"))
        .otherwise(F.concat_ws("\t", "p_name", "p_brand", "p_type"))
    )
    path = scratch_path(spark, "dictionary")
    part.select(line.alias("line")).write.text(path)
    return lexicons.read_dictionary_tsv(spark, path)


@query(
    "read_lexicons",
    sql.with_(*an.TOKEN_SQL, *an.DICT_SQL, *an.LEXICON_SQL)
    + """SELECT 'noun' AS kind, word, gender || '|' || coalesce(plural, '-') AS forms FROM nouns
    UNION ALL SELECT 'adjective', word, concat_ws('|', ms, fs, mp, fp) FROM adjectives
    UNION ALL SELECT 'verb', word, concat_ws('|', p1s, p2s, p3s, p1p, p2p, p3p) FROM verbs""",
)
def read_lexicons(spark, sf):
    lookup = an.lookup_of(spark, an.tokens_of(spark, sf))
    nouns, adjectives, verbs = an.lexicons_of(spark, lookup)
    row = lambda df, kind, *forms: df.select(
        F.lit(kind).alias("kind"), "word", F.concat_ws("|", *forms).alias("forms")
    )
    return (
        row(nouns, "noun", "gender", F.coalesce("plural", F.lit("-")))
        .unionByName(row(adjectives, "adjective", "ms", "fs", "mp", "fp"))
        .unionByName(row(verbs, "verb", *lexicons.VERB_SLOTS))
    )


PHRASE_SQL = (
    """pr AS (SELECT doc_id, i, lower(lemma) AS w, is_alpha AND NOT is_stop
        AND pos IN ('NOUN', 'PROPN', 'ADJ') AS ok FROM tok)""",
    """pi AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM pr)""",
    """phrases AS (SELECT doc_id, min(i) AS start, list(w ORDER BY i) AS words FROM pi WHERE ok
        GROUP BY doc_id, run HAVING count(*) >= 2)""",
)


@query("candidate_phrases", sql.with_(*an.TOKEN_SQL, *PHRASE_SQL) + "SELECT * FROM phrases")
def candidate_phrases(spark, sf):
    return tr.candidate_phrases(an.tokens_of(spark, sf))


@query("keyword_hierarchy")
def keyword_hierarchy(spark, sf):
    """Root keywords of each document with their phrases."""
    # phrases and terms need no more of the annotation than this
    needed = ["doc_id", "i", "lemma", "pos", "is_alpha", "is_stop"]
    tokens = materialise(an.tokens_of(spark, sf, language=None).select(needed), "tokens")
    terms = tokens.filter("is_alpha and not is_stop").select(
        "doc_id", F.lower("lemma").alias("term")
    )
    docs = read_table(spark, sf, "documents")
    postings = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    weights = materialise(wt.modified_weights(postings, wt.row_count(docs)), "weights")
    keywords = sm.top_keywords(weights)
    return tr.keyword_hierarchy(tr.candidate_phrases(tokens), weights, keywords)
