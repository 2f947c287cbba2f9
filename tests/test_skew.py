"""Helpers for hot keys against the plain way."""

import random

import pytest
from pyspark.sql import Window, functions as F

from corpusloom.operators import skew, weighting as wt


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 50)}", rng.random()) for i in range(3000)]
    return spark.createDataFrame(rows, "id bigint, key string, x double")


def test_position_in_group(hot):
    got = skew.position_in_group(
        hot, ["key"], F.floor(F.col("x") * 20), [F.col("x"), F.col("id")], "p"
    )
    plain = hot.withColumn("p", F.row_number().over(Window.partitionBy("key").orderBy("x", "id")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("rows", [0, 1000])
@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_lookup_join(spark, hot, rows, how):
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key string, v int")
    got = skew.lookup_join(hot, lookup, ["key"], ["id"], how, rows=rows)
    plain = hot.join(lookup, "key", how)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(
        map(str, plain.select(sorted(plain.columns)).collect())
    )


@pytest.mark.parametrize("rows, moved", [(0, 2000), (1, 1000), (20, 0), (1000, 0)])
def test_frequent_keys_stay_where_they_are(spark, rows, moved):
    """Facts of frequent keys and those without a key never meet the lookup in a shuffle."""
    key = "if(id % 3 = 0, null, if(id % 3 = 1, 'hot', concat('k', id % 10)))"
    facts = spark.range(3000).selectExpr("id", f"{key} AS key")
    lookup = spark.range(9).selectExpr("concat('k', id) AS key", "id AS v", "map('a', id) AS m")
    lookup = lookup.unionByName(spark.sql("SELECT 'hot' AS key, 99L AS v, map('b', 1L) AS m"))
    before = skew.fits
    skew.fits = lambda df, n=0: False
    try:
        got = skew.frequent_lookup_join(facts, lookup, "key", rows=rows)
    finally:
        skew.fits = before
    plain = facts.join(lookup, "key", "left").select("id", "key", "v", "m")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    far = got.groupBy().count()
    assert far.first()[0] == 3000
    kept = skew._least_frequency(facts.filter("key is not null").groupBy("key").count().withColumnRenamed("count", "df"), rows)
    assert facts.filter("key is not null").groupBy("key").count().filter(f"count < {kept}").agg(
        F.coalesce(F.sum("count"), F.lit(0))
    ).first()[0] == moved


def test_join_term_stats_covers_hot_and_cold_terms(spark):
    rows = [(d, t, 1) for d in range(300) for t in ("everywhere", f"rare{d % 90}")]
    postings = spark.createDataFrame(rows, "doc_id bigint, term string, tf int")
    stats = wt.document_frequencies(postings).filter("term <> 'rare7'")
    got = skew.join_term_stats(postings, stats, F.lit(300))
    plain = postings.join(stats, "term", "left").select("doc_id", "term", "tf", "df")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("rows, least", [(0, 1 << 63), (1, 256), (500, 4)])
def test_join_term_stats_moves_rare_terms_alone(spark, rows, least):
    made = [(d, t, [1]) for d in range(300) for t in ("everywhere", *(f"r{d % 60}{i}" for i in range(5)))]
    postings = spark.createDataFrame(made, "doc_id bigint, term string, places array<int>")
    stats = wt.document_frequencies(postings).filter("term <> 'r71'")
    got = skew.join_term_stats(postings, stats, F.lit(300), rows=rows)
    plain = postings.join(stats, "term", "left").select("doc_id", "term", "places", "df")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert skew._least_frequency(stats, rows) == min(least, (1 << 63) - 1)


def test_first_and_last_per_key(hot):
    first = {r.key: r.id for r in skew.first_per_key(hot, ["key"], ["x", "id"]).collect()}
    last = {r.key: r.id for r in skew.last_per_key(hot, ["key"], ["x", "id"]).collect()}
    rows = hot.collect()
    for key in first:
        mine = [(r.x, r.id) for r in rows if r.key == key]
        assert first[key] == min(mine)[1] and last[key] == max(mine)[1]


def test_extend_vocabulary_keeps_ids(spark):
    none = spark.createDataFrame([], "term_id bigint, lang string, term string")
    one = spark.createDataFrame([("en", f"w{i}") for i in range(40)], "lang string, term string")
    two = spark.createDataFrame([("en", f"w{i}") for i in range(30, 90)], "lang string, term string")
    first = wt.extend_vocabulary(none, one)
    both = wt.extend_vocabulary(first, two)
    ids = {r.term: r.term_id for r in both.collect()}
    assert sorted(ids.values()) == list(range(1, 91))
    assert all(ids[r.term] == r.term_id for r in first.collect())


def test_missing_keys_are_spread(spark):
    """Rows without a key find nothing, wherever they are: they must not meet in one task."""
    facts = spark.range(4000).selectExpr("id", "if(id % 2 = 0, null, id % 500) AS key")
    lookup = spark.range(500).selectExpr("id AS key", "id * 2 AS value")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = skew.lookup_join(facts, lookup, ["key"], ["id"], rows=0)
        missing = got.filter("key is null").groupBy(F.spark_partition_id()).count().collect()
        found = got.filter("value = key * 2").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in missing) == 2000 and found == 2000
    assert max(r["count"] for r in missing) < 1500
