"""The log-structured index: merged runs, pruned reads, repeated batches."""

import random

import pytest

from corpusloom.functions import text as T
from corpusloom.sources.shared import scratch_path
from corpusloom.streaming.incremental import TermIndexLog

SCHEMA = "doc_id bigint, text string, version bigint"


def word(i):
    return "w" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10]


@pytest.fixture(scope="module")
def built(spark):
    """Twelve batches with new, changed and outdated documents, merged three by three."""
    rng = random.Random(3)
    log = TermIndexLog(spark, scratch_path(spark, "log"), fan=3)
    newest, sizes = {}, []
    for batch in range(12):
        rows = []
        for doc in {*range(batch * 20, batch * 20 + 20), *rng.sample(range(batch * 20 + 2), 2)}:
            version = rng.randint(0, 5)
            text = " ".join(word(rng.randint(0, 60)) for _ in range(rng.randint(0, 9)))
            rows.append((doc, text, version))
            if doc not in newest or version > newest[doc][0]:
                newest[doc] = (version, text)
        log.apply(spark.createDataFrame(rows, SCHEMA), batch)
        sizes.append(len(log.live_runs()))
    return log, newest, sizes


def test_merged_runs_hold_the_index(built):
    log, newest, _ = built
    got = {(r.doc_id, r.term): r.tf for r in log.postings().collect()}
    want = {}
    for doc, (_, text) in newest.items():
        for term in text.split():
            want[doc, term] = want.get((doc, term), 0) + 1
    assert got == want
    dfs = {}
    for _, term in want:
        dfs[term] = dfs.get(term, 0) + 1
    assert {r.term: r.df for r in log.document_frequencies().collect()} == dfs
    assert {r.doc_id: r.version for r in log.documents().collect()} == {
        doc: version for doc, (version, _) in newest.items()
    }


def test_live_runs_stay_few(built):
    log, _, sizes = built
    assert max(sizes) <= 5  # below three of each of the levels 0 to 2
    levels = [r["level"] for r in log.live_runs()]
    assert levels == sorted(levels, reverse=True)


def test_a_batch_reads_only_what_it_touches(spark, built):
    log, newest, _ = built
    runs = [r["run"] for r in log.live_runs()]
    batch = spark.createDataFrame([(239, "x", 99), (238, "y", 99)], SCHEMA)
    known = log.known_versions(batch, runs)
    assert {r.doc_id for r in known.collect()} == {238, 239}
    named = {r.run for r in known.collect()}
    assert len(named) == 1 < len(runs)
    files = [f for f in log.outdated_postings(known).inputFiles() if "/postings/" in f]
    assert files and all(f"run={run}/" in f for f in files for run in named)
    plan = log.outdated_postings(known)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id" in plan


def test_a_repeated_batch_replaces_itself(spark, built):
    log, newest, _ = built
    before = sorted(map(tuple, log.postings().collect()))
    again = spark.createDataFrame([(7, "changed words here", 50)], SCHEMA)
    for _ in range(2):
        log.apply(again, 12)
        terms = {r.term for r in log.postings().filter("doc_id = 7").collect()}
        assert terms == {"changed", "words", "here"}
        assert {r.term: r.df for r in log.document_frequencies().collect()}["changed"] == 1
    rest = sorted(map(tuple, log.postings().filter("doc_id <> 7").collect()))
    assert rest == [row for row in before if row[0] != 7]


def test_a_log_is_opened_again(spark, built):
    log, _, _ = built
    again = TermIndexLog.open(spark, log.path, fan=3)
    assert again.last_batch == log.last_batch and again.live_runs() == log.live_runs()
    assert again.postings().count() == log.postings().count()


def test_words_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame([(word(5),)], "w string")
    assert df.select(T.words(df.w).alias("w")).first().w == [word(5)]
