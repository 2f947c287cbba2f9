"""The stored index: layout, reuse, reopening, and searches that stop early."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation, ranking, search, tokens as tok, weighting as wt
from corpusloom.operators.index import (
    IndexCatalog,
    StoredIndex,
    block_max_scores,
    prune,
    state_of,
)
from corpusloom.sources.shared import materialise


def word(i):
    return "w" + "abcdefghij"[i // 100] + "abcdefghij"[i // 10 % 10] + "abcdefghij"[i % 10]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = [word(i) for i in range(300)]
    heavy = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, heavy, k=rng.randint(0, 120)))) for i in range(900)]
    rows.append((900, None))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def index(spark, corpus):
    made = StoredIndex.build(tok.words_only(corpus, "doc_id"), corpus)
    yield made
    made.drop()


@pytest.fixture(scope="module")
def vectors(spark, index):
    rng = random.Random(12)
    rows = [(q, word(int(rng.paretovariate(0.6)) % 300)) for q in range(6) for _ in range(5)]
    rows += [(6, "nowhere"), (7, word(250)), (7, word(0))]
    asked = spark.createDataFrame(rows, "query_id bigint, term string")
    return materialise(search.query_vectors(asked, index.terms, index.total), "vectors")


def exchanges(df):
    """Exchanges over more than the query side: those of the plan that read the index."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def same(left, right, columns):
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()), key=str)
    found = rows(left)
    assert found and found == rows(right)


def test_tables_equal_the_plain_ones(index, corpus):
    postings = wt.term_frequencies(tok.words_only(corpus, "doc_id"))
    same(index.postings, postings, ["doc_id", "term", "tf"])
    weights = wt.tfidf_vectors(postings, F.lit(901))
    rounded = ["doc_id", "term", F.round("weight", 9)]
    same(index.weights, weights, rounded)
    opened = index.impacts.select("term", F.inline(F.arrays_zip("doc_ids", "weights")))
    same(opened.toDF("term", "doc_id", "weight"), weights, rounded)


def test_work_by_document_reads_the_layout(index, vectors):
    """No exchange of weights for scores, norms or matched terms."""
    assert exchanges(search.tfidf_search(vectors, index.weights)) == []
    norms = index.weights.groupBy("doc_id").agg(F.sum("weight"))
    assert exchanges(norms) == []
    hits = materialise(vectors.selectExpr("query_id", "3L AS doc_id").distinct(), "hits")
    found = search.matched_terms(hits, vectors.select("query_id", "term"), index.weights)
    # the asked terms of the hits are made distinct; nothing else moves
    assert len(exchanges(found)) <= 2
    assert all("term" in line and "doc_id" not in line for line in exchanges(found))


def test_an_index_is_built_once_for_a_state(spark, tmp_path, corpus):
    path = str(tmp_path / "documents.parquet")
    corpus.limit(20).coalesce(1).write.parquet(path)
    built = []

    def build():
        docs = spark.read.parquet(path)
        built.append(docs.count())
        return StoredIndex.build(tok.words_only(docs, "doc_id"), docs)

    catalog = IndexCatalog()
    first = catalog.get(spark, "words", path, build)
    assert catalog.get(spark, "words", path, build) is first
    before = state_of(spark, path)
    corpus.limit(5).coalesce(1).write.mode("append").parquet(path)
    assert state_of(spark, path) != before
    assert catalog.get(spark, "words", path, build) is not first
    assert built == [20, 25]
    table = first.postings
    name = first._names["postings"]
    assert table.count() and spark.catalog.tableExists(name)
    catalog.drop_all()
    assert not spark.catalog.tableExists(name)


def test_an_index_is_opened_again(spark, corpus):
    made = StoredIndex.build(tok.words_only(corpus, "doc_id"), corpus)
    counts = [t.count() for t in (made.postings, made.terms, made.weights, made.impacts)]
    again = StoredIndex.open(spark, made.manifest.folder)
    assert again.manifest == made.manifest
    assert [t.count() for t in (again.postings, again.terms, again.weights, again.impacts)] == counts
    assert exchanges(again.weights.groupBy("doc_id").count()) == []
    again.drop()
    made.drop()


@pytest.mark.parametrize("k", [1, 3, 10, 100])
@pytest.mark.parametrize("seed_blocks", [1, 8])
def test_pruned_search_is_exact(index, vectors, k, seed_blocks):
    full = ranking.top_k(search.tfidf_search(vectors, index.weights), k)
    scores = block_max_scores(vectors, index.impacts, k, seed_blocks=seed_blocks)
    same(ranking.top_k(scores, k), full, ["query_id", "doc_id", "rank", "score"])


def test_pruned_search_scores_less(spark):
    """Of a rare and a frequent word, the frequent one names no candidate, and its blocks are opened
    in the ranges of documents with a candidate alone."""
    rng = random.Random(13)
    rows = []
    for i in range(20_000):
        text = ["common"] * rng.randint(0, 6) + ["other"] * rng.randint(1, 9)
        rows.append((i, " ".join(text + (["rare"] * 4 if i in range(100, 1000, 99) else []))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = StoredIndex.build(tok.words_only(docs, "doc_id"), docs)
    asked = spark.createDataFrame([(1, "rare"), (1, "common")], "query_id bigint, term string")
    vectors = materialise(search.query_vectors(asked, made.terms, made.total), "vectors")
    left = prune(vectors, made.impacts, 3)
    ranges = left.candidates.select("query_id", "part").distinct()
    near = left.blocks.join(ranges, ["query_id", "part"], "left_semi")
    opened = near.agg(F.sum(F.size("doc_ids")).alias("n")).first()["n"]
    everything = made.weights.join(vectors.select("term"), "term").count()
    pairs = search.tfidf_search(vectors, made.weights)
    assert everything > 15_000
    assert left.candidates.count() <= 20
    assert opened < everything / 2
    best = ranking.top_k(block_max_scores(vectors, made.impacts, 3), 3)
    same(best, ranking.top_k(pairs, 3), ["query_id", "doc_id", "rank", "score"])
    made.drop()


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    made = StoredIndex.build(tok.words_only(none, "doc_id"), none)
    assert made.postings.count() == 0 and made.weights.count() == 0 and made.impacts.count() == 0
    made.drop()


@pytest.fixture
def no_small_joins(spark):
    """Joins are broadcast where the code asks for it alone, as with large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_full_scores_keep_no_pairs(index, vectors, no_small_joins):
    """No hash table of pairs, and the same scores as the plain search."""
    scores = search.BACKENDS["tfidf"](vectors, index.weights, None)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert not any("Aggregate" in x and "query_id" in x and "doc_id" in x for x in plan.splitlines())
    rounded = ["query_id", "doc_id", F.round("score", 9)]
    same(scores, search.tfidf_search(vectors, index.weights), rounded)


def test_a_full_ranking_moves_its_rows_once(index, vectors, no_small_joins):
    """The ranks come to rows that are stored in their order, without another exchange."""
    ranked = search.ranking_of(vectors, search.Model("tfidf", index.weights))
    assert exchanges(ranked) == []
    assert ranked.columns == ["query_id", "doc_id", "score", "rank"]


def test_candidates_leave_the_weights_where_they_are(spark, index, vectors, no_small_joins):
    queries = [r.query_id for r in vectors.select("query_id").distinct().collect()]
    pairs = [(q, d) for i, q in enumerate(queries) for d in range(i, 900, 7)]
    candidates = materialise(
        spark.createDataFrame(pairs, "query_id bigint, doc_id bigint"), "candidates"
    )
    ranked = search.rank_candidates(vectors, index.weights, candidates)
    assert not any("term" in line and "doc_id" in line for line in exchanges(ranked))
    asked = {(r.query_id, r.doc_id): r.score for r in ranked.collect()}
    plain = search.tfidf_search(vectors, index.weights).collect()
    dots = {(r.query_id, r.doc_id): r.score for r in plain}
    assert set(asked) == set(pairs)
    assert all(abs(asked[p] - dots.get(p, 0.0)) < 1e-9 for p in pairs)


def test_relevant_pairs_leave_rankings_where_they_are(spark, no_small_joins):
    rows = [(1, 7, d, d + 1) for d in range(50)]
    rankings = spark.createDataFrame(rows, "run_id bigint, query_id bigint, doc_id bigint, rank int")
    judged = spark.createDataFrame([(7, 3, True), (7, 9, True), (7, 4, False)],
                                   "query_id bigint, doc_id bigint, is_relevant boolean")
    found = evaluation.hits(rankings, judged)
    assert not any("query_id" in line and "doc_id" in line for line in exchanges(found))
    assert sorted((r["rank"], r.found) for r in found.collect()) == [(4, 1), (10, 2)]
