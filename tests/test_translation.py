"""Dictionary and transfer translation on small annotated sentences."""

import duckdb
import pytest

from corpusloom.functions import word_blocks
from corpusloom.operators import transfer as tf, translate as tr
from corpusloom.plans import annotate as an, load_catalog
from corpusloom.sources import lexicons

TOKENS = (
    "doc_id bigint, sent_id int, i int, text string, lemma string, pos string, dep string, "
    "head_i int, is_alpha boolean, is_punct boolean, is_stop boolean, trailing_ws string, "
    "morph map<string,string>"
)
DICTIONARY = [
    ("the", "DET", "le"), ("cat", "NOUN", "chat"), ("run", "VERB", "courir"),
    ("red", "ADJ", "rouge"), ("big", "ADJ", "grand"), ("car", "NOUN", "voiture"),
    ("eat", "VERB", "avoir"), ("of", "ADP", "de"), ("fast", "*", "vite"),
]


def annotate(doc, *sentences):
    """Words as ``text|lemma|pos|dep|head|morph``, heads counted in the document."""
    rows, i = [], 0
    for s, sentence in enumerate(sentences):
        for word in sentence.split():
            text, lemma, pos, dep, head, *morph = word.split("|")
            glued = text.startswith("~")
            if glued:
                rows[-1][11] = ""
            text = text.lstrip("~")
            features = dict(m.split("=") for m in morph[0].split(",")) if morph else {}
            rows.append(
                [doc, s, i, text, lemma, pos, dep, i if head == "-" else int(head), text.isalpha(),
                 not text.isalpha(), lemma in ("the", "of", "do", "not"), " ", features]
            )
            i += 1
    rows[-1][11] = ""
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def lookup(spark):
    rows = [(i, "en", "fr", lemma, pos, target) for i, (lemma, pos, target) in enumerate(DICTIONARY)]
    entries = spark.createDataFrame(
        rows,
        "id bigint, source_lang string, target_lang string, source_lemma string, pos string, "
        "target_text string",
    )
    return tr.build_lookup(entries, "en", "fr").cache()


@pytest.fixture(scope="module")
def forms(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("forms")

    def write(name, *lines):
        path = folder / name
        path.write_text("\n".join(lines) + "\n", encoding="utf-8")
        return str(path)

    return (
        lexicons.read_noun_forms(spark, write("n.tsv", "voiture\tf\tvoitures", "chat\tm\t", "x\ty")),
        lexicons.read_adjective_forms(spark, write("a.tsv", "rouge\t\trouges\t", "grand\tgrande\tgrands\tgrandes")),
        lexicons.read_verb_forms(spark, write("v.tsv", "courir\tcours\tcours\tcourt\t\t\tcourent", "avoir\tai\tas\ta\tavons\tavez\tont")),
    )


def test_lexicon_fallbacks(forms):
    nouns, adjectives, verbs = forms
    assert {r.word: r.plural for r in nouns.collect()} == {"voiture": "voitures", "chat": None}
    red = adjectives.filter("word = 'rouge'").first()
    assert (red.ms, red.fs, red.mp, red.fp) == ("rouge", "rouge", "rouges", "rouge")
    assert verbs.filter("word = 'courir'").first().p1p == "courir"


def test_lookup_rules(spark):
    rows = [
        (5, "en", "fr", "Run", "NOUN", "course"), (2, "en", "fr", "run", "VERB", "courir"),
        (9, "en", "fr", "run", "VERB", "filer"), (3, "en", "fr", "go", "VERB", "aller"),
        (4, "en", "fr", "go", None, "va"), (6, "en", "fr", "empty", "NOUN", ""),
        (7, "en", "de", "run", "VERB", "rennen"),
    ]
    entries = spark.createDataFrame(
        rows,
        "id bigint, source_lang string, target_lang string, source_lemma string, pos string, "
        "target_text string",
    )
    got = {(r.lemma, r.pos): r.target for r in tr.build_lookup(entries, "en", "fr").collect()}
    assert got == {
        ("run", "NOUN"): "course", ("run", "VERB"): "filer", ("run", "*"): "courir",
        ("go", "VERB"): "aller", ("go", "*"): "va", ("empty", "NOUN"): "", ("empty", "*"): "",
    }


def transfer(spark, lookup, forms, *sentences):
    tokens = spark.createDataFrame(annotate(1, *sentences), TOKENS)
    return tf.transfer_translate(tokens, lookup, *forms).first().translated_text


def test_direct(spark, lookup):
    tokens = spark.createDataFrame(
        annotate(1, "Red|red|ADJ|amod|1 cars|car|NOUN|nsubj|2 eat|eat|VERB|ROOT|- ~!|!|PUNCT|punct|2"),
        TOKENS,
    )
    known = tr.with_translation(tokens, lookup)
    row = tr.with_coverage(tr.direct_translate(known)).first()
    assert row.translated_text == "Rouge voiture avoir!"
    assert (row.word_count, row.translated_word_count, row.coverage) == (3, 3, 1.0)
    words = tr.word_list(known).orderBy("rank").collect()
    assert [(w.lemma, w.surface, w.translation) for w in words] == [
        ("red", "red", "rouge"), ("car", "cars", "voiture"), ("eat", "eat", "avoir"),
    ]


@pytest.mark.parametrize(
    "sentence, expected",
    [
        # adjective moves behind a plural feminine noun and agrees with it
        ("The|the|DET|det|2 red|red|ADJ|amod|2 cars|car|NOUN|nsubj|3|Number=Plur "
         "run|run|VERB|ROOT|-|Person=3,Number=Plur ~.|.|PUNCT|punct|3",
         "Le voitures rouge courent."),
        # a prenominal adjective stays
        ("big|big|ADJ|amod|1 car|car|NOUN|ROOT|-|Number=Sing", "Grande voiture"),
        # two moved adjectives keep their order, also with one behind the noun already
        ("red|red|ADJ|amod|2 fast|fast|ADJ|amod|2 car|car|NOUN|ROOT|-|Number=Sing "
         "red|red|ADJ|amod|2", "Voiture rouge rouge vite"),
        # negation with its auxiliary, and elision
        ("cat|cat|NOUN|nsubj|3 does|do|AUX|aux|3 not|not|PART|neg|3 eat|eat|VERB|ROOT|-|Number=Sing "
         "~.|.|PUNCT|punct|3", "Chat n'a pas."),
        ("cat|cat|NOUN|nsubj|2 not|not|PART|neg|2 run|run|VERB|ROOT|-", "Chat ne court pas"),
        # contraction
        ("cat|cat|NOUN|ROOT|- of|of|ADP|prep|0 the|the|DET|det|3 car|car|NOUN|pobj|1",
         "Chat du voiture"),
        # unknown words stay, capitals inside a sentence too
        ("Zed|zed|PROPN|nsubj|1 saw|saw|VERB|ROOT|- CAT|cat|NOUN|dobj|1", "Zed saw CHAT"),
    ],
)
def test_transfer(spark, lookup, forms, sentence, expected):
    assert transfer(spark, lookup, forms, sentence) == expected


def test_sentences_are_capitalised(spark, lookup, forms):
    got = transfer(
        spark, lookup, forms,
        "Cat|cat|NOUN|ROOT|- ~!|!|PUNCT|punct|0",
        "fast|fast|ADV|ROOT|-",
    )
    assert got == "Chat! Vite"


def test_diff_segments(spark):
    df = spark.createDataFrame(
        [("le rouge chat court", "le chat  rouge court"), ("a", "")], "a string, b string"
    )
    rows = [r[0] for r in df.select(tf.diff_segments("a", "b")).collect()]
    first = [(s.text, s.changed) for s in rows[0]]
    assert "".join(t for t, _ in first) == "le chat  rouge court"
    assert first == [("le ", False), ("chat", True), ("  rouge court", False)]
    assert rows[1] == []


@pytest.mark.parametrize("few_pairs", [0, 40, 4096])
def test_common_blocks_are_those_of_the_standard_matcher(few_pairs, monkeypatch):
    import difflib
    import random

    monkeypatch.setattr(word_blocks, "_FEW_PAIRS", few_pairs)
    rnd = random.Random(6)
    for _ in range(400):
        letters = "abcdefghijklmnopqrst"[: rnd.choice([2, 3, 6, 20])]
        old = rnd.choices(letters, k=rnd.randint(0, 60))
        new = [w for w in old if rnd.random() > 0.15] if rnd.random() < 0.6 else []
        for _ in range(rnd.randint(0, 25)):
            new.insert(rnd.randint(0, len(new)), rnd.choice(letters))
        matcher = difflib.SequenceMatcher(None, old, new, autojunk=False)
        want, got = [], []
        for block in matcher.get_matching_blocks():
            want += [(block.a + k, block.b + k) for k in range(block.size)]
        for i, j, size in word_blocks.common_blocks(old, new):
            got += [(i + k, j + k) for k in range(size)]
        assert sorted(got) == want


@pytest.mark.parametrize("kind", ["replaced", "every second", "shuffled", "two words", "one word"])
def test_diff_of_long_documents_ends(spark, kind):
    """Twenty thousand words within seconds, whatever they look like."""
    import random
    import time

    rnd = random.Random(8)
    old = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(20_000)]
    if kind == "replaced":
        new = [w if rnd.random() > 0.1 else "other" for w in old]
    elif kind == "every second":
        new = [w if k % 2 else f"q{k}" for k, w in enumerate(old)]
    elif kind == "shuffled":
        new = rnd.sample(old, len(old))
    else:
        old, new = (rnd.choices("ab" if kind == "two words" else "a", k=20_000) for _ in "xy")
    df = spark.createDataFrame([(" ".join(old), " ".join(new))], "a string, b string")
    began = time.time()
    segments = df.select(tf.diff_segments("a", "b")).first()[0]
    assert time.time() - began < 20
    assert "".join(s.text for s in segments) == " ".join(new)
    kept = word_blocks.kept_words(old, new)
    flags = [w for s in segments for w in [s.changed] * len(s.text.split())]
    assert flags == (~kept).tolist()
    assert all(x.changed != y.changed for x, y in zip(segments, segments[1:]))


def test_segments_keep_every_character(spark):
    rows = [("a b c", "  a x  b\nc "), ("", "new text"), ("same", "same"), ("a", "b"), ("x", " ")]
    df = spark.createDataFrame(rows, "a string, b string")
    for row in df.select("b", tf.diff_segments("a", "b").alias("s")).collect():
        assert "".join(s.text for s in row.s) == row.b
        flags = [s.changed for s in row.s]
        assert all(x != y for x, y in zip(flags, flags[1:]))


def test_merge_prefers_curated(spark):
    schema = "id bigint, source_lemma string, pos string, target_text string"
    curated = spark.createDataFrame([(1, "Cat", "NOUN", "chat"), (2, "fast", None, "vite")], schema)
    bulk = spark.createDataFrame(
        [(3, "cat", "NOUN", "chatte"), (4, "cat", "VERB", "x"), (5, "fast", "*", "rapide")], schema
    )
    assert sorted(r.id for r in tr.merge_dictionaries(curated, bulk).collect()) == [1, 2, 4]


def test_candidate_phrases(spark):
    tokens = spark.createDataFrame(
        annotate(
            1,
            "red|red|ADJ|amod|1 Cars|Car|NOUN|ROOT|- and|and|CCONJ|cc|1 cat|cat|NOUN|conj|1 ~,|,|PUNCT|p|1 "
            "big|big|ADJ|amod|7 fast|fast|ADJ|amod|7 dog|dog|NOUN|conj|1",
        ),
        TOKENS,
    )
    got = [r.words for r in tr.candidate_phrases(tokens).orderBy("start").collect()]
    assert got == [["red", "car"], ["big", "fast", "dog"]]


def test_capitalised_entries_are_found_under_their_lemma(spark):
    # the md5 of the lemma begins with 4, so its entry is written with a capital
    tokens = spark.createDataFrame(
        [("ßung", "ADJ", True)], "lemma string, pos string, is_alpha boolean"
    )
    entries = an.bulk_dictionary(tokens)
    assert [r["source_lemma"] for r in entries.collect()] == ["ẞung"]
    found = tr.build_lookup(entries, "en", "fr").filter("lemma = 'ßung' and pos = 'ADJ'")
    assert [r["target"] for r in found.collect()] == ["ßange"]


# A capital sigma at the end of a word, a dotted capital I after "ne", a vertical tab, and a blank
# before a last separator of lines.
ODD_TEXTS = [
    "The ΟΔΟΣ of ΣΑΣ stands. ΟΔΟΣ by İzmir runs",
    "By İstanbul we run by İstanbul İ. \u0130\u0130 İŞ by ΣΑΣ",
    "oak\x0b elm by \x0bash \x0b",
    "the red oak stands \u2028",
    "the red oak stands \u0085",
    "a quiet wood by a lake stands \u2029",
]


@pytest.mark.parametrize(
    "name",
    ["lookup_translations", "direct_translate", "elision", "transfer_translate", "corpus_translation"],
)
def test_odd_letters_and_blanks_as_in_sql(spark, tmp_path, name):
    catalog = load_catalog()
    rows = [(i, text, "en", "web", len(text)) for i, text in enumerate(ODD_TEXTS)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(path)
    df = catalog.QUERIES[name](spark, str(tmp_path))
    got = sorted(map(str, map(tuple, df.collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert got == sorted(map(str, expected))


@pytest.mark.parametrize("name", ["negation", "adjective_postposition"])
def test_moved_words_need_no_dictionary(spark, tmp_path, monkeypatch, name):
    rows = [(1, "We run by the lake. A quiet tree stands by oaks", "en", "web", 46)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.delattr(an, "lookup_of")
    assert load_catalog().QUERIES[name](spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize("batch", [1, 2, 10_000])
def test_tokens_of_a_document_are_annotated_where_it_lies(spark, tmp_path, batch):
    """No window holds and sorts the tokens, and sentences go on from one batch to the next."""
    texts = [
        "A quiet tree stands. By the lake we are here! Trees by", "", None, "...", "no end by a big",
        "By oaks. ! Red by ? are", "The red red red old oak by a lake and by the big hills stands here",
    ]
    rows = [(i, text, "en", "web", len(text or "")) for i, text in enumerate(texts)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = an.tokens_of(spark, str(tmp_path)).drop("morph", "is_punct")
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, map(tuple, df.collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "Window" not in plan and "Sort" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    expected = con.execute(
        f"WITH {', '.join(an.TOKEN_SQL)} SELECT {', '.join(df.columns)} FROM tok"
    ).fetchall()
    assert got == sorted(map(str, expected))


@pytest.mark.parametrize("rows", [0, 1, 3, 1000])
def test_translations_of_rare_lemmas_alone_move(spark, lookup, rows):
    tokens = spark.createDataFrame(
        annotate(
            1,
            "red|red|ADJ|amod|1 car|Car|NOUN|ROOT|- of|of|ADP|p|1 the|the|DET|d|1 cat|cat|VERB|p|1",
            "run|run|VERB|ROOT|- fast|fast|ADV|p|5 red|red|ADJ|p|5 zed|zed|X|p|5 red|red|NOUN|p|5",
        ),
        TOKENS,
    )
    got = tr.with_translation(tokens, lookup, rows=rows).orderBy("i")
    assert [r.translation for r in got.collect()] == [
        "rouge", "voiture", "de", "le", "chat", "courir", "vite", "rouge", None, "rouge",
    ]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_units_know_their_heads_without_windows(spark, batch):
    """Tokens meet their document once: no window, and no join with the heads."""
    import random

    rnd, rows = random.Random(4), []
    for doc in range(12):
        size = rnd.choice([1, 2, 5, 30])
        for i in range(size):
            head = rnd.choice([None, i, rnd.randrange(size), max(0, i - 1), i - 2, size + 3])
            dep = rnd.choice(["amod", "amod", "neg", "aux", "dep"])
            rows.append(
                (doc, i // 4, i, rnd.choice(["Oak", "oak"]), rnd.choice(["Do", "do", "oak"]),
                 rnd.choice(["NOUN", "ADJ"]), dep, head, rnd.random() < 0.8, False, False,
                 rnd.choice(["", " "]), rnd.choice([{}, {"Number": "Plur"}]), rnd.choice([None, "x"]))
            )
    want = []
    for d, sent, i, text, lemma, pos, dep, head, alpha, _, _, _, morph, _ in rows:
        own = [r for r in rows if r[0] == d]
        of = lambda h: [r for r in own if r[7] == h]
        dos = lambda h: [r[2] for r in of(h) if r[6] == "aux" and r[4].lower() == "do"]
        gone = lambda r: r[6] == "neg" or (
            any(x[6] == "neg" for x in of(r[7])) and dos(r[7])[:1] == [r[2]]
        )
        behind = [r[2] - head for r in of(head) if r[6] == "amod" and head is not None and r[2] > head]
        trailing = max([k for k, x in enumerate(behind, 1) if k == x], default=0)
        known = next((r for r in own if r[2] == head), None)
        want.append((
            d, i, i > 0 and own[i - 1][11] == "", i == 0 or own[i - 1][1] != sent,
            sum(r[8] for r in own), sum(r[8] and r[13] is not None for r in own),
            known and (known[5], known[1], known[13], known[12].get("Number"), gone(known)),
            known is not None and gone(own[i]), trailing,
        ))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = tf.start_units(spark.createDataFrame(rows, f"{TOKENS}, translation string")).select(
            "doc_id", "i", "no_space_before", "is_sent_start", "word_count",
            "translated_word_count", "head", "gone", "trailing",
        )
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = [(*r[:6], r[6] and tuple(r[6]), *r[7:]) for r in df.orderBy("doc_id", "i").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "Window" not in plan and "Join" not in plan
    assert got == want


def test_phrases_without_a_root_meet_no_weights(spark):
    phrases = spark.createDataFrame(
        [(1, 0, ["red", "oak"]), (1, 4, ["old", "elm"]), (1, 9, ["red", "oak"]), (2, 0, ["red", "oak"])],
        "doc_id bigint, start int, words array<string>",
    )
    keywords = spark.createDataFrame(
        [(1, 1, "oak"), (1, 2, "ash"), (2, 1, "elm")], "doc_id bigint, rank int, term string"
    )
    kept = tr.phrases_of_roots(phrases, keywords).collect()
    assert [(r.doc_id, r.start, r.words) for r in kept] == [(1, 0, ["red", "oak"])]
    weights = spark.createDataFrame(
        [(1, "red", 1.0), (1, "oak", 2.0), (1, "elm", 9.0)], "doc_id bigint, term string, weight double"
    )
    got = tr.keyword_hierarchy(phrases, weights, keywords).orderBy("doc_id", "rank").collect()
    assert [(r.doc_id, r.term, r.children) for r in got] == [
        (1, "oak", ["red oak"]), (1, "ash", []), (2, "elm", []),
    ]
