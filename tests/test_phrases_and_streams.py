"""Command matching, reports, and streams over several micro-batches."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import phrases as ph
from corpusloom.streaming import incremental, jobs, transcripts

COMMANDS = "command_order bigint, phrase string, action string, language string, is_active boolean"


def commands(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COMMANDS)


def match(spark, texts, cmds, **kw):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id bigint, text string, language string")
    return {r.id: r.command_order for r in ph.match_commands(df, cmds, **kw).collect()}


@pytest.mark.parametrize("rows", [200_000, 0])
def test_first_command_in_list_order(spark, rows):
    cmds = commands(
        spark,
        ("off", "a", "en", False), ("Read this!", "b", "en", True), ("read this document", "c", "en", True),
        ("read, THIS", "d", "de", True), ("x", "e", "de", True),
    )
    texts = [("Please read this document", "en"), ("...", "en"), ("bread thistle", "en"), ("off", "en"), ("Axe", "de")]
    assert match(spark, texts, cmds, rows=rows) == {0: 1, 1: None, 2: 1, 3: None, 4: 4}
    assert match(spark, texts, cmds, rows=rows, by_language=True) == {0: 1, 1: None, 2: 1, 3: None, 4: 4}
    assert match(spark, [("read this", "de")], cmds, rows=rows, by_language=True) == {0: 3}


def test_phrases_of_any_length(spark):
    long = "w" * 40_000 + " " + "v" * 30_000
    cmds = commands(spark, ("nothing", "a", "en", True), (long, "b", "en", True))
    texts = [("x " + long + " y", "en"), (long[:-1], "en"), (None, "en"), ("x" + long + "y", "en")]
    assert match(spark, texts, cmds) == {0: 1, 1: None, 2: None, 3: 1}
    assert match(spark, texts, commands(spark)) == dict.fromkeys(range(4))


@pytest.mark.parametrize("rows", [200_000, 0])
def test_matches_equal_brute_force(spark, rows):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    cmds = [(" ".join(word() for _ in range(rng.randint(1, 4))), f"a{i}", "en", rng.random() < 0.8) for i in range(25)]
    cmds.append(("!?", "blank", "en", True))
    texts = [(" ".join(word() for _ in range(rng.randint(0, 300))), "en") for _ in range(40)]
    expected = {
        i: next((o for o, (p, _, _, on) in enumerate(cmds) if on and t and (p.strip("!?") in t)), None)
        for i, (t, _) in enumerate(texts)
    }
    assert match(spark, texts, commands(spark, *cmds), rows=rows) == expected


def test_report_and_medians(spark):
    rng = random.Random(7)
    rows = [("k" if i % 3 else "other", rng.randint(0, 900) / 2) for i in range(301)]
    df = spark.createDataFrame(rows, "kind string, ms double")
    got = {r.kind: r.median for r in ph.medians(df, ["kind"], "ms", 50.0).collect()}
    assert got == {k: statistics.median(m for kk, m in rows if kk == k) for k in ("k", "other")}
    results = spark.createDataFrame(
        [("cmd", 1, 1, 0, 2, 100.0, 1.0), ("cmd", 1, 2, 1, 2, 300.0, 1.0), ("neg", None, 3, 0, 4, 50.0, 1.0),
         ("neg", None, None, 2, 4, 50.0, 1.0)],
        "kind string, expected bigint, matched bigint, errors int, ref_words int, ms double, seconds double",
    )
    out = {r.kind: r for r in ph.matching_report(results, ["kind"]).collect()}
    assert (out["cmd"].hits, out["cmd"].hit_rate, out["cmd"].wer) == (1, 0.5, 0.25)
    assert (out["cmd"].median_ms, out["cmd"].real_time_factor, out["cmd"].perfect) == (200.0, 0.2, 1)
    assert (out["neg"].false_positives, out["neg"].hits, out["neg"].hit_rate) == (1, 0, 0)


def stream_of(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_transcripts_over_micro_batches(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, text string"
    batches = [
        [(1, 0, " Hello  there "), (2, 0, "x" * 150)],
        [(1, 1, "  "), (1, 2, "open\nthe")],
        [(1, 3, "Door now"), (2, 1, "y" * 150)],
    ]
    stream = stream_of(spark, tmp_path / "in", batches, schema)
    states = jobs.run_to_table(transcripts.transcript_states(stream, phrase_chars=20), "t")
    rows = {(r.conv_id, r.turn): r for r in states.collect()}
    full = {1: "", 2: ""}
    for batch in batches:
        for conv, turn, text in batch:
            chunk = " ".join(text.split())
            full[conv] = " ".join(p for p in (full[conv], chunk) if p)
            r = rows[(conv, turn)]
            assert (r.total_chars, r.tail) == (len(full[conv]), full[conv][-200:])
            if chunk:
                assert full[conv][r.chars_before :] == chunk
    cmds = commands(spark, ("nothing", "n", "en", True), ("the door", "d", "en", True), ("hello", "h", "en", True))
    got = {r.conv_id: r.command_order for r in transcripts.final_matches(states, cmds).collect()}
    assert got == {1: 1, 2: None}


def test_text_of_a_very_long_session(spark, tmp_path):
    """A hundred thousand chunks in one session: bounded state, the whole text at the end."""
    rows = spark.range(100_000).selectExpr(
        "1L AS conv_id", "id AS turn",
        "CASE WHEN id % 10 = 3 THEN '  ' ELSE concat(' chunk  ', id) END AS text",
    )
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    other = [(2, 0, "  "), (2, 1, None), (3, 0, "one"), (3, 1, "two\nthree")]
    schema = "conv_id bigint, turn bigint, text string"
    spark.createDataFrame(other, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    states = jobs.run_to_table(transcripts.transcript_states(stream), "long")
    assert states.agg(F.max(F.length("tail"))).first()[0] == 200
    want = " ".join(f"chunk {i}" for i in range(100_000) if i % 10 != 3)
    for block in (transcripts.BLOCK_CHARS, 5000):
        got = {r.conv_id: r for r in transcripts.full_texts(states, block).collect()}
        assert {i: r.full_text for i, r in got.items()} == {1: want, 2: "", 3: "one two three"}
        assert got[1].total_chars == len(want)
    asked = spark.createDataFrame([(1, 4), (3, 0), (3, 9)], "conv_id bigint, turn bigint")
    so_far = {(r.conv_id, r.turn): r.full_text for r in transcripts.texts_so_far(states, asked).collect()}
    assert so_far == {(1, 4): "chunk 0 chunk 1 chunk 2 chunk 4", (3, 0): "one", (3, 9): "one two three"}


def test_job_progress_over_micro_batches(spark, tmp_path):
    schema = "job_id bigint, status string, ts timestamp_ntz, seq bigint"
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[(1, "running", at(1), 1), (2, "error", at(1), 2)], [(1, "done", at(2), 3)], [(3, "running", at(0), 4)]]
    stream = stream_of(spark, tmp_path / "in", batches, schema)
    out = jobs.run_updates(jobs.job_progress(stream, ["done", "error"]), ["job_id"], "p")
    got = {r.job_id: (r.entries, r.errors, r.status, r.is_done) for r in out.collect()}
    assert got == {1: (2, 0, "done", True), 2: (1, 1, "error", True), 3: (1, 0, "running", False)}


def test_incremental_index_equals_full_index(spark, tmp_path):
    schema = "doc_id bigint, text string, version bigint"
    batches = [
        [(1, "cat dog", 1), (2, "dog fish", 1)],
        [(2, "fish fish bird", 2), (3, "cat", 1), (3, "cat cow", 2)],
        [(1, "stale", 0), (4, "", 1)],
    ]
    stream = stream_of(spark, tmp_path / "in", batches, schema)
    log = incremental.run_incremental_index(stream)
    assert {r.term: r.df for r in log.document_frequencies().collect()} == {
        "cat": 2, "dog": 1, "fish": 1, "bird": 1, "cow": 1,
    }
    assert {(r.doc_id, r.term): r.tf for r in log.postings().collect()} == {
        (1, "cat"): 1, (1, "dog"): 1, (2, "fish"): 2, (2, "bird"): 1, (3, "cat"): 1, (3, "cow"): 1,
    }
    assert log.documents().count() == 4
