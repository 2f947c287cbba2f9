"""Queries over command phrases and matching runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.edit_distance import word_errors
from corpusloom.operators import phrases as ph
from corpusloom.plans import sql
from corpusloom.plans.catalog import query, r6
from corpusloom.sources.tables import read_table, read_texts

COMMAND_SQL = (
    f"""commands AS (SELECT item_id AS command_order, {sql.phrase('w[1] || chr(32) || w[2]')}
        AS phrase, 'action-' || item_id AS action, item_id % 5 <> 0 AS is_active,
        CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'de' END AS language
        FROM (SELECT item_id, string_split_regex(text, '\\s+') AS w FROM benchmark))""",
)


def commands_of(spark, sf):
    """Commands whose phrases are the first two words of the benchmark texts."""
    w = F.split("text", r"\s+")
    return read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("command_order"),
        F.concat_ws(" ", w[0], w[1]).alias("phrase"),
        F.concat(F.lit("action-"), "item_id").alias("action"),
        (F.col("item_id") % 5 != 0).alias("is_active"),
        F.when(F.col("item_id") % 2 == 0, "en").otherwise("de").alias("language"),
    )


def _match_sql(extra: str = "") -> str:
    return (
        sql.with_(*COMMAND_SQL)
        + f"""SELECT d.doc_id AS id, min(command_order) AS command_order,
        arg_min(action, command_order) AS action
        FROM (SELECT doc_id, lang, {sql.phrase('text')} AS heard FROM documents) d
        LEFT JOIN commands c ON is_active AND heard <> '' AND contains(heard, phrase) {extra}
        GROUP BY d.doc_id"""
    )


def _transcripts(spark, sf):
    return read_texts(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("language")
    )


@query("match_command", _match_sql())
def match_command(spark, sf):
    return ph.match_commands(_transcripts(spark, sf), commands_of(spark, sf))


@query("match_command_by_language", _match_sql("AND language = lang"))
def match_command_by_language(spark, sf):
    return ph.match_commands(_transcripts(spark, sf), commands_of(spark, sf), by_language=True)


@query("match_many_commands", _match_sql())
def match_many_commands(spark, sf):
    """The same matches with every lookup shuffled, as long command lists have it."""
    return ph.match_commands(_transcripts(spark, sf), commands_of(spark, sf), rows=0)


@query(
    "matching_report",
    sql.with_(*COMMAND_SQL, *sql.WORD_ERRORS)
    + rf""", t AS (SELECT conv_id, turn, role AS kind, 'v' || (conv_id % 3) AS voice,
        {sql.phrase('text')} AS heard, length(text) AS chars, coalesce(e.errors, len(w)) AS errors
        FROM turn_words LEFT JOIN (SELECT conv_id, turn, errors FROM word_errors) e
        USING (conv_id, turn)),
    m AS (SELECT t.conv_id, t.turn, kind, voice, any_value(chars) AS chars,
        any_value(errors) AS errors,
        any_value(heard) AS heard, min(command_order) AS matched FROM t LEFT JOIN commands
        ON is_active AND contains(heard, phrase) GROUP BY ALL),
    r AS (SELECT kind, voice, matched, CASE WHEN turn % 2 = 0 THEN coalesce(matched, 1) END
        AS expected, errors, len(list_filter(string_split(heard, ' '),
        lambda w: w <> '')) AS ref_words, chars * 2.5::DOUBLE AS ms FROM m)
    SELECT kind, voice, count(*) AS n, count(*) FILTER (expected = matched) AS hits,
    round(coalesce(count(*) FILTER (expected = matched)::DOUBLE / nullif(count(expected), 0), 0),
    6) AS hit_rate,
    count(*) FILTER (expected IS NULL AND matched IS NOT NULL) AS false_positives,
    round(sum(errors)::DOUBLE / sum(ref_words), 6) AS wer,
    count(*) FILTER (errors = 0) AS perfect, round(avg(ms), 6) AS mean_ms,
    round(median(ms), 6) AS median_ms,
    round(sum(ms) / 1000 / sum(ref_words * 0.4::DOUBLE), 6) AS real_time_factor
    FROM r GROUP BY kind, voice""",
)
def matching_report(spark, sf):
    """Turns as transcripts of what the next turn says; the last turn is heard as nothing."""
    turns = read_table(spark, sf, "conversations").withColumn(
        "id", F.concat_ws(":", "conv_id", "turn")
    )
    hits = ph.match_commands(turns.select("id", "text"), commands_of(spark, sf))
    heard = F.filter(F.split(T.normalise_phrase(F.col("text")), " "), lambda w: w != "")
    said = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), heard.alias("hyp"))
    turns = turns.withColumn("w", heard).join(said, ["conv_id", "turn"], "left").withColumn(
        "hyp", F.coalesce("hyp", F.array().cast("array<string>"))
    )
    chars = F.length("text")
    results = turns.join(hits, "id").select(
        F.col("role").alias("kind"),
        F.concat(F.lit("v"), F.col("conv_id") % 3).alias("voice"),
        F.col("command_order").alias("matched"),
        F.when(F.col("turn") % 2 == 0, F.coalesce("command_order", F.lit(1))).alias("expected"),
        word_errors("w", "hyp").alias("errors"),
        F.size("w").alias("ref_words"),
        (chars * 2.5).alias("ms"),
    ).withColumn("seconds", F.col("ref_words") * 0.4)
    out = ph.matching_report(results, ["kind", "voice"])
    doubles = {"hit_rate", "wer", "mean_ms", "median_ms", "real_time_factor"}
    return out.select(*[r6(F.col(c), c) if c in doubles else F.col(c) for c in out.columns])
