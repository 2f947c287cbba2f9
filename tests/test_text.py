"""Text functions against hand-computed values and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.edit_distance import edit_distance, word_errors
from corpusloom.operators import tokens as tok


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "text string").select(expression).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("L'été, c'est 3 fois déjà_vu!", ["l'été", "c'est", "fois", "déjà", "vu"]),
        ("don't 'quote' x'", ["don't", "quote", "x"]),
        ("12 34", []),
        ("", []),
    ],
)
def test_words(spark, text, expected):
    assert one(spark, T.words(F.col("text")), text) == expected


def test_char_ngrams(spark):
    grams = one(spark, T.char_ngrams(F.col("text")), "The a cats")
    assert grams == [" the ", " cats", "cats "]


def test_paragraphs_and_spans(spark):
    text = "  First one. Second one!\n\n \n Third? fourth"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = tok.sentence_spans(docs).orderBy("sent").collect()
    assert [r.sentence for r in rows] == ["First one.", "Second one!", "Third?", "fourth"]
    for r in rows:
        assert text[r.doc_start :].lstrip().startswith(r.sentence)
    assert [r.paragraph_start for r in rows] == [0, 10, 0, 6]
    assert {r.doc_length for r in rows} == {len(text)}
    assert [r.paragraph_length for r in rows] == [22, 22, 13, 13]


def test_chunks(spark):
    words = [f"word{i}" for i in range(1000)]
    chunks = one(spark, T.chunks(F.col("text")), " ".join(words))
    expected, start = [], 0
    while True:
        expected.append(" ".join(words[start : start + 350]))
        if start + 350 >= 1000:
            break
        start += 310
    assert chunks == expected
    assert "word349" in chunks[0].split() and "word349" in chunks[1].split()
    assert one(spark, T.chunks(F.col("text")), "  just a few  words ") == ["just a few  words"]
    assert one(spark, T.chunks(F.col("text")), " \n ") == []
    assert len(one(spark, T.chunks(F.col("text")), " ".join(words[:351]))) == 2


def test_speech_chunks_keep_everything(spark):
    rng = random.Random(5)
    text = " ".join(
        " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 80))) + rng.choice(".!?")
        for _ in range(40)
    )
    chunks = one(spark, T.speech_chunks(F.col("text")), text)
    assert "".join(chunks).replace(" ", "") == text.replace(" ", "")
    assert all(len(c) <= 240 for c in chunks)
    short = one(spark, T.speech_chunks(F.col("text")), "One. Two! Three?")
    assert short == ["One. Two! Three?"]
    assert one(spark, T.speech_chunks(F.col("text")), "  ") == []
    long = "x" * 500 + ". End."
    assert [len(c) for c in one(spark, T.speech_chunks(F.col("text")), long)] == [240, 240, 21, 4]


def test_snippet(spark):
    text = "a" * 500 + " Needle " + "b" * 500
    focus = F.array(F.lit("missing"), F.lit("needle"))
    got = one(spark, T.snippet(F.col("text"), focus), text)
    start = 501 - 106
    assert got == "…" + text[start : start + 320].strip() + "…"
    none = F.array().cast("array<string>")
    assert one(spark, T.snippet(F.col("text"), none), "short text") == "short text"


def test_normalise_phrase(spark):
    assert one(spark, T.normalise_phrase(F.col("text")), "  Read,\tTHIS_now!  ") == "read this_now"


@pytest.mark.parametrize(
    "source, translation, expected",
    [("CAT", "chat", "CHAT"), ("Cat", "chat", "Chat"), ("cat", "chat", "chat"), ("A", "un", "Un"),
     ("É", "é", "É"), ("42", "x", "x")],
)
def test_match_case(spark, source, translation, expected):
    df = spark.createDataFrame([(source, translation)], "s string, t string")
    assert df.select(T.match_case(F.col("s"), F.col("t"))).first()[0] == expected


def slow_distance(r, h):
    table = [[i + j if i * j == 0 else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            table[i][j] = min(
                table[i - 1][j] + 1, table[i][j - 1] + 1,
                table[i - 1][j - 1] + (r[i - 1] != h[j - 1]),
            )
    return table[-1][-1]


def test_edit_distance(spark):
    rng = random.Random(1)
    pairs = [
        ([rng.choice("abcd") for _ in range(rng.randint(0, 12))],
         [rng.choice("abcd") for _ in range(rng.randint(0, 12))])
        for _ in range(200)
    ]
    assert [edit_distance(r, h) for r, h in pairs] == [slow_distance(r, h) for r, h in pairs]
    df = spark.createDataFrame(pairs, "r array<string>, h array<string>")
    got = [x[0] for x in df.select(word_errors("r", "h")).collect()]
    assert sorted(got) == sorted(slow_distance(r, h) for r, h in pairs)


def test_lemma_terms(spark):
    tokens = spark.createDataFrame(
        [(1, "en", w) for w in "cats are friendly to the cats".split()],
        "doc_id bigint, lang string, term string",
    )
    stops = spark.createDataFrame(
        [("en", w) for w in ("are", "to", "the", "and")], "lang string, term string"
    )
    forms = spark.createDataFrame([("en", "cats", "Cat")], "lang string, term string, lemma string")
    got = sorted(r.term for r in tok.lemma_terms(tokens, stops, forms).collect())
    assert got == ["cat", "cat", "friendly"]


@pytest.mark.parametrize(
    "source, translation, expected",
    [("Cat", "ßung", "ẞung"), ("CAT", "maße", "MAẞE"), ("CAT", "ﬁn", "ﬁN"), ("ẞA", "x", "X"),
     ("ßa", "x", "x")],
)
def test_capitals_are_single_letters(spark, source, translation, expected):
    df = spark.createDataFrame([(source, translation)], "s string, t string")
    assert df.select(T.match_case(F.col("s"), F.col("t"))).first()[0] == expected
