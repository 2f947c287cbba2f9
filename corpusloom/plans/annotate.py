"""Annotated tokens of documents, and a dictionary and lexicons derived from the English ones.

The parser and the dictionary files that feed translation elsewhere are input data. Here plain
rules over the corpus stand in for them, so that the translation operators run on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from corpusloom.functions import text as T
from corpusloom.plans import lexicon, sql
from corpusloom.operators.translate import build_lookup, merge_dictionaries
from corpusloom.sources import lexicons
from corpusloom.sources.shared import materialise, scratch_path
from corpusloom.sources.tables import read_texts, scan_documents

TOKEN_PATTERN = r"([\p{L}\p{Nl}\p{No}]+|[^\p{L}\p{Nl}\p{No}\s])(\s*)"
# the same for Spark, whose \s has the vertical tab as well
SPARK_TOKEN_PATTERN = TOKEN_PATTERN.replace(r"\s])", r"\t\n\f\r ])").replace(r"\s*", r"[\t\n\f\r ]*")

# What ends a sentence.
_ENDS = (".", "!", "?")
_PLACES = StructType().add("sent_id", IntegerType()).add("head", IntegerType())

# Entries that take precedence over derived ones. "*" stands for any part of speech.
CURATED = [
    (1, "of", "ADP", "de"),
    (2, "the", "DET", "le"),
    (3, "to", "ADP", "à"),
    (4, "in", "ADP", "dans"),
    (5, "and", None, "et"),
    (6, "A", "DET", "un"),
    (7, "this", "DET", "ce"),
    (8, "with", "ADP", "avec"),
    (9, "for", "*", "pour"),
]


def tokens_of(spark, sf, language="en"):
    """The annotated token table of the documents of a language, or of all documents for None.

    Stop words are those of the document's own language; lists of English words hold for English.
    The tokens of a document stay where its row lies, in their order: they are neither shuffled nor
    sorted, and ``placed`` walks along them.
    """
    docs = scan_documents(read_texts(spark, sf, "documents"), language=language)
    part = lambda group: F.regexp_extract_all(
        T.strip(F.col("text")), F.lit(SPARK_TOKEN_PATTERN), F.lit(group)
    )
    rows = (
        docs.select("doc_id", "lang", part(1).alias("texts"), part(2).alias("blanks"))
        # an inner explode would find the tokens once more to see whether there are any
        .select("doc_id", "lang", "texts", "blanks", F.posexplode_outer("texts").alias("i", "text"))
        .filter("i is not null")
        .select(
            "doc_id", "lang", "i", "text",
            F.get("blanks", F.col("i")).alias("trailing_ws"),
            F.get("texts", F.col("i") - 1).alias("_before"),
            T.lower(F.col("text")).alias("_form"),
        )
    )
    form = F.col("_form")

    def of(language, words):
        return F.col("lang").eqNullSafe(F.lit(language)) & form.isin(words)

    stop = F.lit(False)
    for name, words in lexicon.STOP_WORDS.items():
        stop = stop | of(name, words.split())
    auxiliary = of("en", ["is", "are", "was", "were", "be"])
    adposition = of("en", ["of", "in", "on", "for", "with", "at", "from", "to", "as"])
    first = F.substring("text", 1, 1)
    # a capital inside a sentence
    capital = (first != T.lower(first)) & (F.col("i") > 0) & ~F.col("_before").isin(*_ENDS)
    rows = rows.withColumn("is_alpha", F.col("text").rlike(r"^\p{L}+$")).withColumn("is_stop", stop)
    rows = rows.withColumn(
        "plural", F.endswith(form, F.lit("s")) & (F.length(form) >= 4) & ~F.col("is_stop")
    )
    rows = rows.withColumn(
        "lemma",
        F.when(auxiliary, F.lit("do"))
        .when(F.col("plural"), F.left(form, F.length("text") - 1))
        .otherwise(form),
    ).withColumn(
        "pos",
        F.when(~F.col("is_alpha"), F.lit("PUNCT"))
        .when(auxiliary, F.lit("AUX"))
        .when(of("en", ["by"]), F.lit("PART"))
        .when(adposition, F.lit("ADP"))
        .when(F.col("is_stop"), F.lit("DET"))
        .when(capital, F.lit("PROPN"))
        .when(F.length("lemma") % 3 == 0, F.lit("NOUN"))
        .when(F.length("lemma") % 3 == 1, F.lit("ADJ"))
        .otherwise(F.lit("VERB")),
    )
    rows = placed(
        rows.select(
            "doc_id", "i", "text", "trailing_ws", "lemma", "pos", "is_alpha", "is_stop", "plural"
        )
    )
    headed = F.col("head").isNotNull()
    return rows.select(
        "doc_id",
        "sent_id",
        "i",
        "text",
        "lemma",
        "pos",
        F.when((F.col("pos") == "ADJ") & headed, F.lit("amod"))
        .when((F.col("pos") == "PART") & headed, F.lit("neg"))
        .when((F.col("pos") == "AUX") & headed, F.lit("aux"))
        .otherwise(F.lit("dep"))
        .alias("dep"),
        F.coalesce("head", "i").alias("head_i"),
        "is_alpha",
        (~F.col("is_alpha")).alias("is_punct"),
        "is_stop",
        "trailing_ws",
        F.when(
            F.col("is_alpha"),
            F.create_map(
                F.lit("Number"), F.when(F.col("plural"), F.lit("Plur")).otherwise(F.lit("Sing"))
            ),
        )
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("morph"),
    )


def placed(tokens):
    """The tokens, which come in their order, with ``sent_id`` and ``head``.

    The head is the place of the next noun for an adjective, and of the next verb for an auxiliary or a
    particle, if their sentence has one. A task holds a batch of tokens and the sentence that goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, ended = [], 0  # tokens of a sentence that may go on, and the sentences before it
        for batch in batches:
            if not batch.num_rows:
                continue
            last = _last_start(batch)
            if last is None:
                waiting.append(batch)
                continue
            whole, ended = _placed(pa.concat_batches([*waiting, batch.slice(0, last)]), ended)
            yield whole
            waiting = [batch.slice(last)]
        if waiting:
            yield _placed(pa.concat_batches(waiting), ended)[0]

    schema = StructType([*tokens.schema.fields, *_PLACES])
    return tokens.mapInArrow(run, schema)


def _ends(tokens: pa.RecordBatch) -> np.ndarray:
    return np.asarray(pc.is_in(tokens.column("text"), value_set=pa.array(_ENDS)))


def _last_start(tokens: pa.RecordBatch) -> int | None:
    """Where the last sentence or document begins after the first token, if any does."""
    begins = np.asarray(tokens.column("i")) == 0
    begins[1:] |= _ends(tokens)[:-1]
    found = np.flatnonzero(begins)
    return int(found[-1]) if len(found) else None


def _placed(tokens: pa.RecordBatch, ended: int) -> tuple[pa.RecordBatch, int]:
    """Whole sentences with their numbers and heads; ``ended`` sentences of the first document came
    before. Also the sentences of the last document so far."""
    n, i = tokens.num_rows, np.asarray(tokens.column("i"))
    before = np.append(0, np.cumsum(_ends(tokens)))
    starts = np.flatnonzero(i == 0)
    if not len(starts) or starts[0]:
        starts = np.append(0, starts)
    base = before[starts]
    if n and i[0]:
        base[0] -= ended
    sizes = np.diff(np.append(starts, n))
    sentence = before[:n] - np.repeat(base, sizes)
    stop = np.repeat(np.append(starts[1:], n), sizes)
    head = np.full(n, -1)
    pos = tokens.column("pos")
    for wanted, seeking in ((("NOUN", "PROPN"), ("ADJ",)), (("VERB",), ("PART", "AUX"))):
        there, seeker = (
            np.asarray(pc.is_in(pos, value_set=pa.array(kinds))) for kinds in (wanted, seeking)
        )
        there = np.where(there, np.arange(n), n)
        following = np.append(np.minimum.accumulate(there[::-1])[::-1], n)
        seeker = np.flatnonzero(seeker)
        found = following[seeker + 1]
        good = (found < stop[seeker]) & (before[found] == before[seeker])
        head[seeker[good]] = i[found[good]]
    out = pa.RecordBatch.from_arrays(
        [*tokens.columns, pa.array(sentence.astype(np.int32)),
         pa.array(head.astype(np.int32), mask=head < 0)],
        names=[*tokens.schema.names, *_PLACES.names],
    )
    return out, int(before[n] - base[-1]) if n else ended


def bulk_dictionary(tokens):
    """Entries for most of the vocabulary; some are missing, empty, for any POS, or capitalised."""
    vocab = tokens.filter("is_alpha").select("lemma", "pos").distinct()
    h = F.substring(F.md5("lemma"), 1, 1)
    rows = vocab.withColumn("h", h).filter(~F.col("h").isin("0", "1"))
    mark = F.substring(F.md5(F.concat_ws("|", "lemma", "pos")), 1, 8)
    return rows.select(
        F.conv(mark, 16, 10).cast("bigint").alias("id"),
        F.lit("en").alias("source_lang"),
        F.lit("fr").alias("target_lang"),
        F.when(F.col("h") == "4", T.capitalised(F.col("lemma"))).otherwise(F.col("lemma")).alias(
            "source_lemma"
        ),
        F.when(F.col("h") != "2", F.col("pos")).alias("pos"),
        F.when(F.col("h") == "3", F.lit(""))
        .otherwise(F.concat(F.translate("lemma", "aeiou", "eioua"), F.lit("e")))
        .alias("target_text"),
    )


def curated_dictionary(spark):
    rows = [(i, "en", "fr", lemma, pos, target) for i, lemma, pos, target in CURATED]
    return spark.createDataFrame(
        rows,
        "id bigint, source_lang string, target_lang string, source_lemma string, pos string, "
        "target_text string",
    )


def dictionary(spark, tokens):
    return merge_dictionaries(curated_dictionary(spark), bulk_dictionary(tokens))


def lookup_of(spark, tokens):
    return materialise(build_lookup(dictionary(spark, tokens), "en", "fr"), "lookup")


def lexicons_of(spark, lookup):
    """Noun, adjective and verb lexicons, written as tab-separated files and read back."""
    words = lookup.filter("target <> ''").select("pos", F.col("target").alias("w")).distinct()
    h = F.substring(F.md5("w"), 1, 1)
    words = words.withColumn("h", h).filter("h <> 'f'")
    blank = lambda marks, form: F.when(F.col("h").isin(*marks), F.lit("")).otherwise(form)
    add = lambda suffix: F.concat("w", F.lit(suffix))

    def write(rows, *columns):
        path = scratch_path(spark, "lexicon")
        rows.select(F.concat_ws("\t", *columns).alias("line")).distinct().write.text(path)
        return path

    nouns = write(
        words.filter("pos in ('NOUN', 'PROPN')"),
        "w",
        F.when(F.col("h") < "8", F.lit("f")).otherwise(F.lit("m")),
        # rows with a column too many are malformed
        F.when(F.col("h") == "e", F.lit("x\tx")).otherwise(blank("08", add("x"))),
    )
    adjectives = write(
        words.filter("pos = 'ADJ'"),
        "w",
        blank("1", add("e")),
        blank("2", add("s")),
        blank("13", add("es")),
    )
    verbs = write(
        words.filter("pos = 'VERB'"),
        "w",
        add("a"),
        add("b"),
        blank("4", add("c")),
        add("d"),
        add("f"),
        blank("5", add("g")),
    )
    return (
        lexicons.read_noun_forms(spark, nouns),
        lexicons.read_adjective_forms(spark, adjectives),
        lexicons.read_verb_forms(spark, verbs),
    )


_STOPS = ", ".join(f"'{w}'" for w in lexicon.STOP_WORDS["en"].split())
_AUX = "('is', 'are', 'was', 'were', 'be')"

TOKEN_SQL = (
    f"""a1 AS (SELECT doc_id, regexp_extract_all(body, '{TOKEN_PATTERN}', 1) AS t,
        regexp_extract_all(body, '{TOKEN_PATTERN}', 2) AS ws
        FROM (SELECT doc_id, {sql.strip('text')} AS body FROM documents WHERE lang = 'en'))""",
    """a2 AS (SELECT doc_id, (generate_subscripts(t, 1) - 1)::INT AS i, unnest(t) AS text,
        unnest(ws) AS trailing_ws FROM a1)""",
    rf"""a3 AS (SELECT *, lower(text) AS form, regexp_full_match(text, '\p{{L}}+') AS is_alpha,
        lower(text) IN ({_STOPS}) AS is_stop,
        coalesce(sum((text IN ('.', '!', '?'))::INT) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sent_id FROM a2)""",
    f"""a4 AS (SELECT *, form LIKE '%s' AND length(form) >= 4 AND NOT is_stop AS plural,
        lag(sent_id) OVER (PARTITION BY doc_id ORDER BY i) AS prev_sent,
        lag(trailing_ws) OVER (PARTITION BY doc_id ORDER BY i) AS prev_ws FROM a3)""",
    f"""a5 AS (SELECT *, CASE WHEN form IN {_AUX} THEN 'do' WHEN plural
        THEN form[1:length(form) - 1] ELSE form END AS lemma FROM a4)""",
    f"""a6 AS (SELECT *, CASE WHEN NOT is_alpha THEN 'PUNCT' WHEN form IN {_AUX} THEN 'AUX'
        WHEN form = 'by' THEN 'PART' WHEN form IN ('of', 'in', 'on', 'for', 'with', 'at', 'from',
        'to', 'as') THEN 'ADP' WHEN is_stop THEN 'DET'
        WHEN text[1] <> lower(text[1]) AND sent_id = prev_sent THEN 'PROPN'
        WHEN length(lemma) % 3 = 0 THEN 'NOUN' WHEN length(lemma) % 3 = 1 THEN 'ADJ'
        ELSE 'VERB' END AS pos FROM a5)""",
    """a7 AS (SELECT *, min(CASE WHEN pos IN ('NOUN', 'PROPN') THEN i END) OVER later AS nn,
        min(CASE WHEN pos = 'VERB' THEN i END) OVER later AS nv FROM a6
        WINDOW later AS (PARTITION BY doc_id, sent_id ORDER BY i DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    """a8 AS (SELECT *, CASE WHEN pos = 'ADJ' AND nn IS NOT NULL THEN 'amod'
        WHEN pos = 'PART' AND nv IS NOT NULL THEN 'neg'
        WHEN pos = 'AUX' AND nv IS NOT NULL THEN 'aux' ELSE 'dep' END AS dep FROM a7)""",
    """tok AS (SELECT doc_id, sent_id, i, text, lemma, pos, dep, CASE dep WHEN 'amod' THEN nn
        WHEN 'neg' THEN nv WHEN 'aux' THEN nv ELSE i END AS head_i, is_alpha, is_stop,
        trailing_ws, CASE WHEN is_alpha THEN CASE WHEN plural THEN 'Plur' ELSE 'Sing' END END
        AS number, coalesce(prev_ws, ' ') = '' AS no_space_before,
        sent_id IS DISTINCT FROM prev_sent AS is_sent_start FROM a8)""",
)
DICT_SQL = (
    """bulk AS (SELECT ('0x' || substr(md5(lemma || '|' || pos), 1, 8))::BIGINT AS id,
        CASE WHEN h = '4' THEN upper(lemma[1]) || lemma[2:] ELSE lemma END AS source_lemma,
        CASE WHEN h <> '2' THEN pos END AS pos, CASE WHEN h = '3' THEN ''
        ELSE translate(lemma, 'aeiou', 'eioua') || 'e' END AS target_text
        FROM (SELECT DISTINCT lemma, pos, substr(md5(lemma), 1, 1) AS h FROM tok WHERE is_alpha)
        WHERE h NOT IN ('0', '1'))""",
    "curated(id, source_lemma, pos, target_text) AS (VALUES "
    + ", ".join(
        f"({i}, '{lemma}', {'NULL' if pos is None else repr(pos)}, '{target}')"
        for i, lemma, pos, target in CURATED
    )
    + ")",
    """dictionary AS (SELECT * FROM curated UNION ALL SELECT * FROM bulk b WHERE NOT EXISTS
        (SELECT 1 FROM curated c WHERE lower(c.source_lemma) = lower(b.source_lemma)
        AND coalesce(c.pos, '*') = coalesce(b.pos, '*')))""",
    """lrows AS (SELECT id, lower(source_lemma) AS lemma, coalesce(pos, '*') AS pos,
        target_text AS target FROM dictionary)""",
    """lookup AS (SELECT lemma, pos, arg_max(target, id) AS target FROM lrows WHERE pos <> '*'
        GROUP BY lemma, pos UNION ALL SELECT lemma, '*', coalesce(
        arg_max(target, id) FILTER (pos = '*'), arg_min(target, id)) FROM lrows GROUP BY lemma)""",
)
KNOWN_SQL = (
    """known AS (SELECT t.*, coalesce(nullif(e.target, ''), nullif(a.target, '')) AS translation
        FROM tok t LEFT JOIN lookup e ON e.lemma = t.lemma AND e.pos = t.pos
        LEFT JOIN lookup a ON a.lemma = t.lemma AND a.pos = '*')""",
)
LEXICON_SQL = (
    """lex AS (SELECT DISTINCT pos, target AS w, substr(md5(target), 1, 1) AS h FROM lookup
        WHERE target <> '' AND h <> 'f')""",
    """nouns AS (SELECT DISTINCT w AS word, CASE WHEN h < '8' THEN 'f' ELSE 'm' END AS gender,
        CASE WHEN h NOT IN ('0', '8') THEN w || 'x' END AS plural FROM lex
        WHERE pos IN ('NOUN', 'PROPN') AND h <> 'e')""",
    """adjectives AS (SELECT w AS word, w AS ms, CASE WHEN h = '1' THEN w ELSE w || 'e' END AS fs,
        CASE WHEN h = '2' THEN w ELSE w || 's' END AS mp, CASE WHEN h = '1' THEN w
        WHEN h = '3' THEN w || 'e' ELSE w || 'es' END AS fp FROM lex WHERE pos = 'ADJ')""",
    """verbs AS (SELECT w AS word, w || 'a' AS p1s, w || 'b' AS p2s, CASE WHEN h = '4' THEN w
        ELSE w || 'c' END AS p3s, w || 'd' AS p1p, w || 'f' AS p2p, CASE WHEN h = '5' THEN w
        ELSE w || 'g' END AS p3p FROM lex WHERE pos = 'VERB')""",
)


def match_case_sql(source: str, translation: str) -> str:
    s, t = source, translation
    return (
        f"CASE WHEN upper({s}) = {s} AND upper({s}) <> lower({s}) AND length({s}) > 1 "
        f"THEN upper({t}) WHEN upper({s}[1]) = {s}[1] AND lower({s}[1]) <> {s}[1] "
        f"THEN upper({t}[1]) || {t}[2:] ELSE {t} END"
    )
