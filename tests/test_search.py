"""Weights, similarity, ranking and evaluation against small known cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as ev, ranking, search, similarity as sim, weighting as wt
from corpusloom.operators.tokens import words_only


def vectors(spark, key, data):
    rows = [(k, t, float(w)) for k, v in data.items() for t, w in v.items()]
    return spark.createDataFrame(rows, f"{key} bigint, term string, weight double")


@pytest.fixture(scope="module")
def tokens(spark):
    texts = {4: "elm elm elm oak", 8: "oak ivy", 9: "oak", 12: "ivy fern"}
    rows = [(d, t) for d, text in texts.items() for t in text.split()]
    return spark.createDataFrame(rows, "doc_id bigint, term string")


def test_statistics_and_weights(spark, tokens):
    tf = wt.term_frequencies(tokens)
    dfs = wt.document_frequencies(tf)
    assert {r.term: r.df for r in dfs.collect()} == {"elm": 1, "oak": 3, "ivy": 2, "fern": 1}
    weights = wt.tfidf_vectors(tf, F.lit(4)).collect()
    for doc in (4, 8, 9, 12):
        assert sum(r.weight**2 for r in weights if r.doc_id == doc) == pytest.approx(1)
    raw = wt.raw_weights(tf, wt.inverse_document_frequencies(dfs, F.lit(4)), F.lit(4))
    found = {(r.doc_id, r.term): r.weight for r in raw.collect()}
    assert found[(4, "elm")] == pytest.approx(3 * math.log(4))
    assert found[(8, "ivy")] == pytest.approx(math.log(2))


def test_a_term_everywhere_weighs_nothing(spark):
    tf = spark.createDataFrame([(1, "x", 2), (2, "x", 1)], "doc_id bigint, term string, tf int")
    assert wt.tfidf_vectors(tf, F.lit(2)).count() == 0


def test_idf_of_an_empty_collection_fails(spark, tokens):
    dfs = wt.document_frequencies(wt.term_frequencies(tokens))
    with pytest.raises(Exception, match="no documents"):
        wt.inverse_document_frequencies(dfs, F.lit(0)).collect()


def test_modified_weight(spark):
    rows = [(1, "a", 3), (1, "b", 4), (2, "b", 1)]
    tf = spark.createDataFrame(rows, "doc_id bigint, term string, tf int")
    got = {(r.doc_id, r.term): r.weight for r in wt.modified_weights(tf, F.lit(4)).collect()}
    assert got[(1, "a")] == pytest.approx(0.5 * (1 + 3 / 4) * math.log(4))


def test_similarities(spark):
    docs = vectors(spark, "doc_id", {1: {"oak": 2, "elm": 1}, 2: {"oak": 5}, 3: {"ivy": 1}})
    queries = vectors(spark, "query_id", {7: {"oak": 1}})
    got = {r.doc_id: r.score for r in sim.cosine_similarities(queries, docs).collect()}
    assert got == {1: pytest.approx(2 / math.sqrt(5)), 2: pytest.approx(1.0)}
    candidates = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "query_id bigint, doc_id bigint")
    ranked = ranking.full_ranking(search.rank_candidates(queries, docs, candidates))
    order = [(r.doc_id, r.score) for r in ranked.orderBy("rank").collect()]
    assert [d for d, _ in order] == [2, 1, 3] and order[-1][1] == 0.0
    pairs = spark.createDataFrame([(7, 1), (7, 3)], "left_id bigint, right_id bigint")
    far = sim.manhattan_distances(
        queries.withColumnRenamed("query_id", "left_id"),
        docs.withColumnRenamed("doc_id", "right_id"),
        pairs,
    )
    assert {r.right_id: r.distance for r in far.collect()} == {1: 2.0, 3: 2.0}


def test_salted_term_join_equals_broadcast(spark):
    docs = vectors(spark, "doc_id", {i: {"hot": 1, f"t{i % 7}": 2} for i in range(200)})
    queries = vectors(spark, "query_id", {q: {"hot": 1, f"t{q}": 1} for q in range(7)})
    small = sim._join_on_term(queries.withColumnRenamed("weight", "w"), docs)
    salted = sim._join_on_term(queries.withColumnRenamed("weight", "w"), docs, rows=0)
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(small) == key(salted)


def test_full_ranking_with_a_hot_score(spark):
    rows = [(q, d, 0.5 if d % 3 else 1 / (d + 1)) for q in (1, 2) for d in range(400)]
    scores = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double")
    got = ranking.full_ranking(scores, rows_per_block=16)
    for q in (1, 2):
        mine = sorted(((-round(s, 6), d) for qq, d, s in rows if qq == q))
        ranks = {r.doc_id: r["rank"] for r in got.filter(f"query_id = {q}").collect()}
        assert ranks == {d: i for i, (_, d) in enumerate(mine, 1)}


@pytest.mark.parametrize("cells", [4_000_000, 8])
def test_dense_search_against_brute_force(spark, cells):
    rng = np.random.default_rng(0)
    chunks = rng.normal(size=(120, 4))
    chunks[5] = 0
    queries = rng.normal(size=(6, 4))
    chunk_rows = [(i // 3, i % 3, v.tolist()) for i, v in enumerate(chunks)]
    df = spark.createDataFrame(chunk_rows, "doc_id bigint, chunk_index int, vector array<double>")
    q = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vector array<double>"
    )
    got = search.dense_search(q, df.repartition(5), 4, cells=cells).collect()
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    best = np.round(norm(queries) @ norm(chunks).T, 6).reshape(6, 40, 3).max(axis=2)
    for i in range(6):
        expected = sorted(range(40), key=lambda d: (-best[i, d], d))[:4]
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [r.doc_id for r in mine] == expected


@pytest.mark.parametrize("held", [20_000, 7])
def test_dense_ranking_is_complete(spark, held):
    rng = np.random.default_rng(3)
    rows = [(i // 2, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 5)))]
    chunks = spark.createDataFrame(rows, "doc_id bigint, vector array<double>")
    asked = rng.normal(size=(31, 5))
    q = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(asked)], "query_id bigint, vector array<double>"
    )
    got = {(r.query_id, r.doc_id): r.score for r in search.dense_scores(q, chunks, held=held).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = (unit(asked) @ unit(np.array([v for _, v in rows])).T).reshape(31, 45, 2).max(axis=2)
    assert len(got) == 31 * 45
    assert all(abs(best[i, d] - s) < 1e-6 for (i, d), s in got.items())
    full = search.ranking_of(q, search.Model("dense_embedding", chunks))
    assert sorted(r["rank"] for r in full.filter("query_id = 3").collect()) == list(range(1, 46))


def test_unknown_model_kind():
    with pytest.raises(ValueError, match="model kind"):
        search.search(None, search.Model("psychic", None))


def test_missing_vectors_are_counted(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    chunks = spark.createDataFrame(
        [(1, 0, [1.0]), (2, 1, [1.0])], "doc_id bigint, chunk_index int, vector array<double>"
    )
    with pytest.raises(ValueError, match="2 documents"):
        search.require_first_chunk_vectors(docs, chunks)


def test_top_k_limits():
    for k in (0, 101):
        with pytest.raises(ValueError):
            ranking.top_k(None, k)


def run(spark, ranked, relevant, extra=()):
    rankings = spark.createDataFrame(
        [(1, 9, d, i) for i, d in enumerate(ranked, 1)],
        "run_id bigint, query_id bigint, doc_id bigint, rank int",
    )
    runs = spark.createDataFrame([(1, 9, "m")], "run_id bigint, query_id bigint, model string")
    qrels = spark.createDataFrame(
        [(9, d, True) for d in relevant] + [(9, d, False) for d in extra],
        "query_id bigint, doc_id bigint, is_relevant boolean",
    )
    return runs, rankings, qrels


def test_measures(spark):
    m = ev.run_measures(*run(spark, [11, 12, 13, 14, 15, 16], [11, 13, 16, 99])).first()
    assert m.average_precision == pytest.approx((1 + 2 / 3 + 3 / 6) / 4)
    assert m.r_precision == pytest.approx(2 / 4)
    assert m.precision_at_5 == pytest.approx(0.4)
    m = ev.run_measures(*run(spark, [21, 22, 23], [22])).first()
    assert (m.precision_at_5, m.precision_at_10, m.recall_at_5) == (0.2, 0.1, 1.0)
    m = ev.run_measures(*run(spark, [1, 2], [], [1])).first()
    assert (m.precision_at_5, m.recall_at_5, m.average_precision, m.f1_at_5) == (0, 0, 0, 0)
    assert (m.retrieved, m.relevant) == (2, 0)


def test_interpolated_curve(spark):
    ranked, relevant = [1, 2, 3, 4, 5, 6, 7], [2, 4, 7, 99]
    curve = ev.interpolated_curves(*run(spark, ranked, relevant)).collect()
    points, hits = [], 0
    for k, d in enumerate(ranked, 1):
        hits += d in relevant
        points.append((hits / len(relevant), hits / k))
    for row in curve:
        expected = max((p for r, p in points if r >= row.level), default=0.0)
        assert row.precision == pytest.approx(expected)
    assert len(curve) == 11


def test_summary_counts_unscored_queries(spark):
    runs, rankings, qrels = run(spark, [1, 2], [1])
    more = spark.createDataFrame([(8, 1, False)], qrels.schema)
    runs = runs.unionByName(spark.createDataFrame([(2, 8, "m"), (3, 7, "m")], runs.schema))
    measures = ev.run_measures(runs, rankings, qrels.unionByName(more))
    row = ev.collection_summary(measures, search.latest_runs(runs), qrels.unionByName(more)).first()
    assert (row.queries, row.unscored, row.map) == (1, 1, 1.0)


def test_index_search_and_drift(spark):
    """Stored weights stay while statistics follow the collection."""
    texts = [(1, "cats like cats"), (2, "dogs like bones"), (3, "stars and planets")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    tf = wt.term_frequencies(words_only(docs, "doc_id"))
    weights = wt.tfidf_vectors(tf, wt.row_count(docs))
    queries = spark.createDataFrame([(1, "cats"), (2, "unknown")], "query_id bigint, text string")
    tokens = words_only(queries, "query_id")
    v = search.query_vectors(tokens, wt.document_frequencies(tf), wt.row_count(docs))
    hits = ranking.top_k(search.tfidf_search(v, weights)).collect()
    assert [(r.query_id, r.doc_id) for r in hits] == [(1, 1)]
    fewer = tf.filter("doc_id = 1")
    v = search.query_vectors(tokens, wt.document_frequencies(fewer), F.lit(1))
    assert v.count() == 0


@pytest.mark.parametrize("held", [40, 1000])
def test_block_products_against_brute_force(spark, held):
    rng = np.random.default_rng(4)
    made = lambda n, terms: {
        i: {f"t{t}": round(float(rng.random()), 1) + 0.1 for t in rng.choice(12, terms, replace=False)}
        for i in range(n)
    }
    docs, queries = made(60, 3), {**made(9, 2), 20: {"unknown": 1.0}}
    docs[70] = dict(docs[3])  # a copy ties with the smaller id
    q, d = vectors(spark, "query_id", queries), vectors(spark, "doc_id", docs)
    want = {
        (i, j): sum(w * docs[j][t] for t, w in queries[i].items() if t in docs[j])
        for i in queries for j in docs if set(queries[i]) & set(docs[j])
    }
    got = sim.block_products(q, d, held=held).collect()
    assert {(r.query_id, r.doc_id): r.dot for r in got} == pytest.approx(want)
    top = search.search(q, search.Model("tfidf", d), 4).collect()
    for i in queries:
        order = sorted((-round(s, 6), j) for (p, j), s in want.items() if p == i)[:4]
        mine = sorted((r for r in top if r.query_id == i), key=lambda r: r["rank"])
        assert [r.doc_id for r in mine] == [j for _, j in order]
    limited = sim.block_products(q, d, 4, held=held).groupBy("query_id").count().collect()
    places = max(-(-sum(map(len, docs.values())) // held), 1)
    assert all(r["count"] <= 4 * places for r in limited)


def test_rounding_in_blocks_is_that_of_spark(spark):
    values = [0.1234565, 0.1234575, 2.5e-6, -0.0000015, 0.3, 1.0000005, 0.0000004999999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = [r[0] for r in df.select(F.round("v", 6)).collect()]
    assert sim.rounded6(np.array(values)).tolist() == want
