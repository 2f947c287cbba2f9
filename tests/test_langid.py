"""Language profiles, distances, splits and scores."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import classify as clf, langid as li
from corpusloom.operators.tokens import letter_frequencies

EN = "the cat sat on the mat and the dog ran"
FR = "le chat est sur le tapis et le chien court"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([("en", EN), ("fr", FR)], "lang string, text string")


def test_profiles_and_out_of_place(spark, texts):
    profiles = li.word_profiles(texts, 5)
    words = [r.term for r in profiles.filter("lang = 'en'").orderBy("rank").collect()]
    assert words == ["the", "and", "cat", "dog", "mat"]
    docs = spark.createDataFrame(
        [(1, "the cat and the dog"), (2, "zzz"), (3, "")], "doc_id bigint, text string"
    )
    got = {(r.doc_id, r.lang): r.distance for r in li.out_of_place_distances(docs, profiles, 5).collect()}
    # document ranks: the 0, and 1, cat 2, dog 3; "mat" is absent
    assert got[(1, "en")] == 5
    assert got[(2, "en")] == got[(3, "fr")] == 25
    assert len(got) == 6


def test_alphabet(spark, texts):
    profiles = li.alphabet_profiles(texts)
    docs = spark.createDataFrame(
        [(1, EN), (2, FR.upper()), (3, "123"), (4, "ззз")], "doc_id bigint, text string"
    )
    got = {(r.doc_id, r.lang): r.distance for r in li.alphabet_distances(docs, profiles).collect()}
    assert got[(1, "en")] == pytest.approx(0, abs=1e-9)
    assert got[(2, "fr")] == pytest.approx(0, abs=1e-9)
    assert got[(3, "en")] == pytest.approx(1)
    assert got[(4, "en")] == pytest.approx(2)
    a, b = (
        {r.letter: r.freq for r in letter_frequencies(texts, "lang").collect() if r.lang == lang}
        for lang in ("en", "fr")
    )
    assert got[(1, "fr")] == pytest.approx(
        sum(abs(a.get(k, 0) - b.get(k, 0)) for k in a.keys() | b.keys())
    )
    best = {r.doc_id: r for r in li.identify(li.alphabet_distances(docs, profiles)).collect()}
    assert best[1].predicted == "en" and best[2].predicted == "fr"
    assert set(best[1].distances) == {"en", "fr"}


def test_identify_needs_two_profiles(spark):
    one = spark.createDataFrame([(1, "en", 1.0)], "doc_id bigint, lang string, distance double")
    with pytest.raises(Exception, match="two languages"):
        li.identify(one).collect()


def test_macro_scores(spark):
    pairs = spark.createDataFrame(
        [("en", "en"), ("en", "ru"), ("ru", "ru"), ("ru", "ru")], "actual string, predicted string"
    )
    m = li.macro_scores(li.confusion_matrix(pairs)).first()
    assert m.precision == pytest.approx((1 + 2 / 3) / 2)
    assert m.recall == pytest.approx(0.75)
    never = spark.createDataFrame([("en", "xx")], "actual string, predicted string")
    m = li.macro_scores(li.confusion_matrix(never)).first()
    assert (m.precision, m.recall, m.f1) == (0, 0, 0)
    empty = spark.createDataFrame([], "actual string, predicted string, elapsed_ms double")
    assert tuple(li.run_summary(empty).first()) == (0, 0, 0, 0, 0, 0)


@pytest.mark.parametrize("have, ratio, expected", [(0, 0.2, (2, 1)), (1, 0.2, (2, 1)), (0, 0.5, (5, 2))])
def test_split_sizes(spark, have, ratio, expected):
    rows = [(i, "en" if i < 10 else "fr", "test" if i < have else None) for i in range(15)]
    rows.append((99, "de", None))
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, split string")
    out = li.stratified_split(docs, ratio)
    counts = {r.lang: r for r in li.split_counts(out).collect()}
    # 15 * .5 rounds 2.5 of the French ones to the even 2
    assert (counts["en"].test, counts["fr"].test) == expected
    assert (counts["de"].test, counts["de"].train) == (0, 1)
    assert out.count() == 16 and sum(c.unassigned for c in counts.values()) == 0
    with pytest.raises(ValueError):
        li.stratified_split(docs, 1.0)


def test_classifier(spark):
    rows = [([float(i % 2), 1.0 - i % 2, i / 100], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vector array<double>, label int")
    model = clf.train(df)
    out = clf.classify(model, df)
    assert out.filter("predicted <> label").count() == 0
    assert out.filter(F.expr("distances[predicted] > 0.5")).count() == 0
    curve = [r.loss for r in clf.loss_curve(model, spark).orderBy("epoch").collect()]
    assert curve[-1] < curve[0]
    with pytest.raises(ValueError):
        clf.train(df.filter("label = 0"))
