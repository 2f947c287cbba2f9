"""Queries over texts: tokens, sentences, chunks, snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.edit_distance import word_errors
from corpusloom.operators import tokens as tok
from corpusloom.plans import lexicon, sql
from corpusloom.plans.catalog import query, r6
from corpusloom.sources.tables import read_table, read_texts


@query(
    "word_tokens",
    f"""SELECT doc_id, len(w)::INT AS n_tokens, len(list_distinct(w))::INT AS n_distinct,
    md5(array_to_string(w, ' ')) AS digest
    FROM (SELECT doc_id, {sql.words('text')} AS w FROM documents)""",
)
def word_tokens(spark, sf):
    w = T.words(F.col("text"))
    return read_texts(spark, sf, "documents").select("doc_id", w.alias("w")).select(
        "doc_id",
        F.size("w").alias("n_tokens"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.md5(F.array_join("w", " ")).alias("digest"),
    )


@query(
    "token_positions",
    f"""SELECT term, count(*) AS n, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos
    FROM (SELECT unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos
          FROM (SELECT {sql.words('text')} AS w FROM documents)) GROUP BY term""",
)
def token_positions(spark, sf):
    return tok.word_tokens(read_texts(spark, sf, "documents")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
    )


@query(
    "char_ngrams",
    """WITH w AS (SELECT ' ' || unnest(regexp_extract_all(lower(text),
        '[a-z]+(?:''[a-z]+)?')) || ' ' AS p FROM documents),
    p AS (SELECT p, count(*) AS c FROM w GROUP BY p)
    SELECT substr(p, i, 5) AS gram, sum(c)::BIGINT AS n
    FROM (SELECT p, c, unnest(range(1, length(p) - 3)) AS i FROM p WHERE length(p) >= 5)
    GROUP BY gram""",
)
def char_ngrams(spark, sf):
    grams = tok.char_ngrams(read_texts(spark, sf, "documents"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_sentences",
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text,
        {sql.SENTENCE}), lambda x: {sql.strip('x')}), lambda x: x <> '') AS l FROM documents)
    SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS sent, unnest(l) AS sentence FROM s""",
)
def split_sentences(spark, sf):
    return tok.sentences(read_texts(spark, sf, "documents"))


@query(
    "split_paragraphs",
    rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(
        {sql.strip('text')}, '\n\s*\n+'), lambda x: {sql.strip('x')}), lambda x: x <> '') AS l
        FROM documents)
    SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS para, unnest(l) AS paragraph FROM s""",
)
def split_paragraphs(spark, sf):
    return tok.paragraphs(read_texts(spark, sf, "documents"))


SPANS_SQL = (
    rf"""t AS (SELECT doc_id, text, {sql.strip('text')} AS body,
        length(text) - length(regexp_replace(text, '^\s+', '')) AS lead FROM documents)""",
    r"""u AS (SELECT doc_id, length(text) AS doc_length, lead,
        string_split_regex(body, '\n\s*\n+') AS ps, regexp_extract_all(body, '\n\s*\n+') AS seps
        FROM t)""",
    rf"""paras AS (SELECT doc_id, doc_length, i AS para, {sql.strip('ps[i]')} AS p,
        lead + coalesce(list_sum(list_transform(ps[1:i-1], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(seps[1:i-1], lambda x: length(x))), 0)
        + length(ps[i]) - length(regexp_replace(ps[i], '^\s+', '')) AS para_start
        FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM u))""",
    f"""pieces AS (SELECT doc_id, doc_length, para, para_start, length(p) AS paragraph_length,
        length(regexp_extract(p, '^[.!?]*')) AS lead2, generate_subscripts(l, 1) AS piece,
        unnest(l) AS raw
        FROM (SELECT *, regexp_extract_all(p, {sql.SENTENCE}) AS l FROM paras WHERE p <> ''))""",
    f"""placed AS (SELECT *, {sql.strip('raw')} AS sentence,
        lead2 + coalesce(sum(length(raw)) OVER (PARTITION BY doc_id, para ORDER BY piece
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paragraph_start FROM pieces)""",
    """spans AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY para, piece)
        - 1)::INT AS sent, sentence, (para_start + paragraph_start)::BIGINT AS doc_start,
        paragraph_start::BIGINT AS paragraph_start, paragraph_length::INT AS paragraph_length,
        doc_length::INT AS doc_length FROM placed WHERE sentence <> '')""",
)


@query("sentence_spans", sql.with_(*SPANS_SQL) + "SELECT * FROM spans")
def sentence_spans(spark, sf):
    return tok.sentence_spans(read_texts(spark, sf, "documents"))


@query(
    "lemma_terms",
    sql.with_(sql.TOKENS, lexicon.STOP_SQL, *lexicon.LEMMA_SQL)
    + "SELECT lang, term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM lemmas GROUP BY ALL",
)
def lemma_terms(spark, sf):
    terms = lemmas_of(spark, read_texts(spark, sf, "documents"))
    postings = terms.groupBy("lang", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return postings.groupBy("lang", "term").agg(
        F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs")
    )


def lemmas_of(spark, docs):
    """``(doc_id, lang, term)`` with the stand-in word lists."""
    return tok.lemma_terms(
        tok.words_only(docs, "doc_id", "lang"), lexicon.stop_words(spark), lexicon.form_lemma(docs)
    )


@query(
    "chunk_text",
    rf"""WITH t AS (SELECT doc_id, {sql.strip('text')} AS body FROM documents),
    w AS (SELECT doc_id, body, string_split_regex(body, '\s+') AS w FROM t WHERE body <> ''),
    i AS (SELECT *, unnest(CASE WHEN len(w) <= 350 THEN [0]
        ELSE range(0, ((len(w) - 350 + 309) // 310) * 310 + 1, 310) END) AS s FROM w)
    SELECT doc_id, (s // 310)::INT AS chunk_index,
    CASE WHEN len(w) <= 350 THEN body ELSE array_to_string(w[s+1:s+350], ' ') END AS chunk
    FROM i""",
)
def chunk_text(spark, sf):
    return tok.chunks(read_texts(spark, sf, "documents"))


_FLUSHED = "CASE WHEN {a}.open = '' THEN {a}.done ELSE list_append({a}.done, {a}.open) END"
_JOINED = "CASE WHEN acc.open = '' THEN s.open ELSE acc.open || ' ' || s.open END"


@query(
    "pack_sentences",
    rf"""WITH flat AS (SELECT doc_id, {sql.squeeze('text')} AS t FROM documents),
    cut AS (SELECT doc_id, t, list_filter(list_transform(regexp_extract_all(regexp_replace(t,
        '([.!?]+)(\s|$)', '\1' || chr(10) || '\2', 'g'), '[^.!?\n]+[.!?]+\n|[^.!?\n]+$'),
        lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS found FROM flat),
    parts AS (SELECT doc_id, CASE WHEN len(found) > 0 THEN found WHEN t <> '' THEN [t]
        ELSE [] END AS p FROM cut),
    packed AS (SELECT doc_id, list_reduce(list_prepend(
        {{'done': []::VARCHAR[], 'open': ''}},
        list_transform(p, lambda x: {{'done': []::VARCHAR[], 'open': x}})),
        lambda acc, s: CASE WHEN length(s.open) > 240
        THEN {{'done': ({_FLUSHED.format(a='acc')}) || list_transform(
            range(1, length(s.open) + 1, 240), lambda i: substr(s.open, i, 240)), 'open': ''}}
        WHEN acc.open <> '' AND length({_JOINED}) > 120
        THEN {{'done': ({_FLUSHED.format(a='acc')}), 'open': s.open}}
        ELSE {{'done': acc.done, 'open': {_JOINED}}} END) AS r FROM parts),
    pieces AS (SELECT doc_id, {_FLUSHED.format(a='r')} AS x FROM packed)
    SELECT doc_id, (generate_subscripts(x, 1) - 1)::INT AS piece_index, unnest(x) AS piece
    FROM pieces""",
)
def pack_sentences(spark, sf):
    docs = read_texts(spark, sf, "documents")
    return docs.select(
        "doc_id", F.posexplode(T.speech_chunks(F.col("text"))).alias("piece_index", "piece")
    )


@query(
    "snippets",
    rf"""WITH f AS (SELECT doc_id, text, list_filter(list_transform(['from', 'nicht', 'dans',
        'para'], lambda w: instr(lower(text), w) - 1), lambda p: p >= 0) AS hits FROM documents),
    s AS (SELECT doc_id, text, greatest(0, coalesce(list_min(hits), 0) - 106) AS s FROM f)
    SELECT doc_id, (CASE WHEN s > 0 THEN '…' ELSE '' END)
    || {sql.strip('substr(text, s + 1, 320)')}
    || (CASE WHEN s + 320 < length(text) THEN '…' ELSE '' END) AS snippet FROM s""",
)
def snippets(spark, sf):
    focus = F.array(*[F.lit(w) for w in ("from", "nicht", "dans", "para")])
    return read_texts(spark, sf, "documents").select(
        "doc_id", T.snippet(F.col("text"), focus).alias("snippet")
    )


@query(
    "letter_frequencies",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '\P{L}', '',
        'g'), '')) AS letter FROM documents),
    c AS (SELECT doc_id, letter, count(*) AS n FROM l WHERE letter <> '' GROUP BY ALL)
    SELECT doc_id, letter, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY doc_id), 6) AS freq
    FROM c""",
)
def letter_frequencies(spark, sf):
    out = tok.letter_frequencies(read_texts(spark, sf, "documents"), "doc_id")
    return out.select("doc_id", "letter", "n", r6(F.col("freq"), "freq"))


@query(
    "normalise_phrase",
    f"SELECT conv_id, turn, {sql.phrase('text')} AS phrase FROM conversations",
)
def normalise_phrase(spark, sf):
    return read_table(spark, sf, "conversations").select(
        "conv_id", "turn", T.normalise_phrase(F.col("text")).alias("phrase")
    )


@query(
    "word_error_rate",
    sql.with_(*sql.WORD_ERRORS)
    + """SELECT role, count(*) AS pairs, sum(errors)::BIGINT AS errors,
    round(avg(errors / greatest(len(w), 1)), 6) AS mean_rate,
    round(sum(errors) / greatest(sum(len(w)), 1), 6) AS pooled_rate
    FROM word_errors GROUP BY role""",
)
def word_error_rate(spark, sf):
    """Each turn against the next one of its conversation, and the pooled rate per role."""
    turns = read_table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", T.normalise_phrase(F.col("text")).alias("phrase")
    ).withColumn("w", F.filter(F.split("phrase", " "), lambda x: x != ""))
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("hyp"))
    scored = turns.join(nxt, ["conv_id", "turn"]).withColumn("errors", word_errors("w", "hyp"))
    return scored.groupBy("role").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("errors").alias("errors"),
        r6(F.avg(F.col("errors") / F.greatest(F.size("w"), F.lit(1))), "mean_rate"),
        r6(F.sum("errors") / F.greatest(F.sum(F.size("w")), F.lit(1)), "pooled_rate"),
    )
