"""Queries that run a stream to the end of its input and return what it left."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans import sql
from corpusloom.plans.catalog import query
from corpusloom.plans.phrase_queries import COMMAND_SQL, commands_of
from corpusloom.sources.shared import scratch_path
from corpusloom.sources.tables import read_table, stream_table
from corpusloom.streaming import incremental, jobs, transcripts

_TEXT_SQL = (
    f"chunks AS (SELECT conv_id, turn, {sql.squeeze('text')} AS chunk FROM conversations)",
    """so_far AS (SELECT conv_id, turn, chunk, string_agg(CASE WHEN chunk <> '' THEN chunk END,
        ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING
        AND CURRENT ROW) AS full_text FROM chunks)""",
)


@query(
    "stream_transcripts",
    sql.with_(*_TEXT_SQL)
    + """SELECT conv_id, turn, chunk, (length(full_text) - length(chunk))::BIGINT
    AS chars_before, length(full_text)::BIGINT AS total_chars, right(full_text, 200) AS tail
    FROM so_far""",
)
def stream_transcripts(spark, sf):
    states = transcripts.transcript_states(stream_table(spark, sf, "conversations"))
    return jobs.run_to_table(states, "transcripts").drop("heard")


@query(
    "stream_full_texts",
    sql.with_(*_TEXT_SQL)
    + """SELECT conv_id, coalesce(string_agg(CASE WHEN chunk <> '' THEN chunk END, ' '
        ORDER BY turn), '') AS full_text, length(coalesce(string_agg(CASE WHEN chunk <> ''
        THEN chunk END, ' ' ORDER BY turn), ''))::BIGINT AS total_chars
    FROM chunks GROUP BY conv_id""",
)
def stream_full_texts(spark, sf):
    """What every session has said when the stream ends."""
    states = transcripts.transcript_states(stream_table(spark, sf, "conversations"))
    return transcripts.full_texts(jobs.run_to_table(states, "transcripts"))


@query(
    "stream_texts_so_far",
    sql.with_(*_TEXT_SQL)
    + "SELECT conv_id, turn, coalesce(full_text, '') AS full_text FROM so_far WHERE turn % 2 = 0",
)
def stream_texts_so_far(spark, sf):
    """The text so far at every second turn of the sessions."""
    states = transcripts.transcript_states(stream_table(spark, sf, "conversations"))
    stored = jobs.run_to_table(states, "transcripts")
    return transcripts.texts_so_far(stored, stored.filter("turn % 2 = 0"))


@query(
    "stream_final_match",
    sql.with_(*COMMAND_SQL)
    + f""", s AS (SELECT conv_id, {sql.phrase("string_agg(text, ' ' ORDER BY turn)")} AS heard
        FROM conversations GROUP BY conv_id)
    SELECT conv_id, min(command_order) AS command_order, arg_min(action, command_order) AS action
    FROM s LEFT JOIN commands ON is_active AND contains(heard, phrase) GROUP BY conv_id""",
)
def stream_final_match(spark, sf):
    """Commands heard in whole sessions, also across the borders of chunks."""
    commands = commands_of(spark, sf)
    longest = commands.agg(F.max(F.length("phrase"))).first()[0] or 1
    states = transcripts.transcript_states(
        stream_table(spark, sf, "conversations"), phrase_chars=longest
    )
    return transcripts.final_matches(jobs.run_to_table(states, "transcripts"), commands)


@query(
    "stream_job_progress",
    """SELECT user_id AS job_id, count(*) AS entries, count(*) FILTER (event_type = 'error')
    AS errors, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at,
    arg_max(event_type, (ts, event_id)) IN ('purchase', 'error') AS is_done
    FROM events GROUP BY user_id""",
)
def stream_job_progress(spark, sf):
    log = stream_table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("status"),
        "ts",
        F.col("event_id").alias("seq"),
    )
    return jobs.run_updates(jobs.job_progress(log, ["purchase", "error"]), ["job_id"], "progress")


@query(
    "stream_incremental_index",
    f"""WITH d AS (SELECT doc_id, text || CASE WHEN lang = 'fr' THEN ' nouveau passage' ELSE ''
        END AS text FROM documents),
    t AS (SELECT DISTINCT doc_id, unnest({sql.words('text')}) AS term FROM d)
    SELECT term, count(*) AS df FROM t GROUP BY term""",
)
def stream_incremental_index(spark, sf):
    """All documents arrive, then the French ones again with more text."""
    docs = read_table(spark, sf, "documents")
    path = scratch_path(spark, "arrivals")
    docs.select("doc_id", "text", F.lit(1).cast("bigint").alias("version")).write.parquet(path)
    docs.filter("lang = 'fr'").select(
        "doc_id",
        F.concat("text", F.lit(" nouveau passage")).alias("text"),
        F.lit(2).cast("bigint").alias("version"),
    ).write.mode("append").parquet(path)
    stream = (
        spark.readStream.schema("doc_id bigint, text string, version bigint")
        .option("maxFilesPerTrigger", 1)
        .parquet(path)
    )
    return incremental.run_incremental_index(stream).document_frequencies()
