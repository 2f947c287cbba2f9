"""Piece encoding, token alignment and fill-in-middle against the libraries and plain loops."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fill_middle, sentence_pieces, token_alignment

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ALPHABET = ["a", "b", "the", "in", " ", "  ", "\n", "ing", "er", "1", "é", "日本", "한", "🙂", "=", "x"]
ALPHABET += ["—", "<s>", "<0x0A>", "<|endoftext|>", "'s", "tion", "\t", "\x00", "<", "P>"]


def made_texts(n, seed, extra=()):
    draw = random.Random(seed)
    letters = [*ALPHABET, *extra]
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(n)]


ODD = ["", None, "a", " ", "   ", "▁", "a▁b", "<P>x", "é" * 300, "=" * 5000, " " * 77, "x" * 999]
LONG = "a quick brown fox—jumps over 日本 some lazy dogs\nnear the river bank. " * 4000


@pytest.fixture(scope="module")
def rows():
    texts = [*ODD, LONG, *made_texts(150, 3), "twice the same", "twice the same"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, "no id"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)
    # names that operators use inside must not get in the way
    return frame.selectExpr(
        "*", "1 AS n", "'x' AS form", "2 AS in_n", "3 AS row", "4 AS pair", "5 AS links", "6 AS Output"
    )


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def sha(text):
    data = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return hashlib.sha256(data).hexdigest()


def same_rows(frame, want):
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(want, key=str)


# pieces


@pytest.fixture(scope="module")
def piece_file():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model(piece_file):
    with open(piece_file, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(piece_file):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_file)


@pytest.fixture(scope="module")
def encoder(model):
    return sentence_pieces.Encoder(sentence_pieces.read_model(model))


def ids_of(encoder, texts):
    ids, counts = encoder.encode(pa.array(texts))
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), counts.tolist())]


def test_pieces_match_the_library(encoder, library):
    texts = made_texts(4000, 1, ["▁", "▁▁", "​"])
    pieces = [p for p, k in zip(encoder.model.pieces, encoder.model.kinds) if k == 1]
    draw = random.Random(2)
    texts += ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 8))) for _ in range(4000)]
    texts += [" " * k + end for k in range(40) for end in ("", "the", "\n")] + ["a" * 70, LONG]
    assert ids_of(encoder, texts) == library.encode(texts, num_threads=1)


def test_every_piece_is_its_own_code(encoder, library):
    spelt = [p[1:] for p in encoder.model.pieces if p[:1] == "▁" and len(p) > 1]
    assert ids_of(encoder, spelt) == library.encode(spelt, num_threads=1)


def test_backtracking_alone_gives_the_merges(encoder):
    """Without units: whole texts by backtracking against merging pairs one by one."""
    merges = encoder.merges

    def merged(text):
        symbols = [merges.symbols.get(c, merges.other) for c in text]
        while True:
            ranked = [
                (merges.rank[p], k)
                for k in range(len(symbols) - 1)
                if (p := merges.pairs.get((symbols[k], symbols[k + 1]))) is not None
            ]
            if not ranked:
                return symbols
            _, k = min(ranked)
            symbols[k : k + 2] = [merges.pairs[symbols[k], symbols[k + 1]]]

    for text in made_texts(600, 7, ["▁", "▁▁▁", "aa", "ana", "nan"]):
        assert encoder.symbols_of(text) == merged(text)


@pytest.mark.parametrize("kinds", [(0, 31_999), (0, 270)])
def test_decoding_any_ids_matches_the_library(encoder, library, kinds):
    draw = random.Random(4)
    runs = [[draw.randint(*kinds) for _ in range(draw.randint(0, 12))] for _ in range(3000)]
    counts = np.array([len(r) for r in runs])
    got = encoder.decode(np.array([i for r in runs for i in r]), counts)
    assert [g.decode() for g in got] == library.decode(runs)


def test_piece_digests(docs, rows, model, library):
    want = []
    for key, text in rows:
        ids = library.encode(text or "") + [2]
        listed = " ".join(map(str, ids))
        want.append((key, len(ids), sha(listed), sha(library.decode(ids))))
    same_rows(sentence_pieces.encode_documents(docs, model), want)


def test_piece_round_trip(spark, docs, rows, model, library):
    coded = sentence_pieces.tokens(docs, model)
    want = [(key, library.decode(library.encode(text or ""))) for key, text in rows]
    same_rows(sentence_pieces.texts(coded, model), want)
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    same_rows(sentence_pieces.texts(nulls, model), [(1, ""), (2, "")])


def test_pieces_of_no_documents(nothing, model):
    assert sentence_pieces.encode_documents(nothing, model).collect() == []
    assert sentence_pieces.tokens(nothing, model).collect() == []


def test_other_models_are_refused(model):
    with pytest.raises(ValueError):
        sentence_pieces.read_model(b"")


# alignment


@pytest.fixture(scope="module")
def byte_spec():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def plain_runs(a, b):
    """Ends of the groups, one by one."""
    common = set(a) & set(b)
    where = {e: j for j, e in enumerate(b)}
    return [(i, where[e]) for i, e in enumerate(a) if e in common]


def test_runs_against_plain_loops():
    draw = random.Random(9)
    for _ in range(1500):
        size = draw.randint(1, 60)
        ends = [
            sorted({size, *draw.sample(range(1, size + 1), draw.randint(0, size))})
            for _ in range(2)
        ]
        if draw.random() < 0.3:
            ends[1] = sorted(set(ends[0]) ^ {draw.randint(1, size)} | {size})
        got = [(i + k, j + k) for i, j, n in token_alignment.runs(*ends) for k in range(n)]
        assert got == plain_runs(*ends)


def test_long_stretches_are_jumped():
    """One run for a long one-to-one stretch, however long."""
    ends = list(range(3, 300_003, 3))
    got = token_alignment.runs(ends, [1, 2, *ends])
    assert got == [(0, 2, 1), (1, 3, 99_999)]


def test_byte_ranks_are_those_of_the_rank_file(byte_spec):
    from corpusloom.llm.bpe import parse_ranks

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        assert token_alignment.byte_ranks(byte_spec) == parse_ranks(file.read())


def plain_alignment(rows, byte_spec, library):
    from tokenizers import Tokenizer

    first = Tokenizer.from_str(byte_spec)
    first.encode_special_tokens = True
    spelt = {i: t for t, i in token_alignment.byte_ranks(byte_spec).items()}

    def piece(i):
        text = library.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if library.is_byte(i) else text.replace("▁", " ").encode()

    aligned = []
    for key, text in rows:
        a = first.encode(f" {text or ''}", add_special_tokens=False).ids
        b = library.encode(text or "")
        bytes_a, bytes_b = [spelt[i] for i in a], [piece(i) for i in b]
        want = f" {text}".encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            aligned.append((key, 0, 0, []))
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in (bytes_a, bytes_b)]
        groups, i0, j0 = [], 0, 0
        for i, j in plain_runs(*ends):
            groups.append((a[i0 : i + 1], b[j0 : j + 1]))
            i0, j0 = i + 1, j + 1
        aligned.append((key, len(a), len(b), groups))
    count = Counter()
    for *_, groups in aligned:
        count.update({(x, y) for ga, gb in groups for x in set(ga) for y in set(gb)})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for key, n_a, n_b, groups in aligned:
        links, best, total = 0, 0, 0
        for ga, gb in groups:
            times_a, times_b = Counter(ga), Counter(gb)
            for x, k in times_a.items():
                for y, m in times_b.items():
                    links += k * m
                    best += k * m * (count[x, y] == most[x])
                    total += k * m * count[x, y]
        listed = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        digest = sha(listed) if groups else ""
        out.append((key, n_a, n_b, len(groups), links, best, total, digest))
    return out


def aligned(docs, byte_spec, model):
    pattern = public_tokenizers.PATTERN
    return token_alignment.align_documents(docs, byte_spec, pattern, model)


def test_alignment_against_plain_loops(docs, rows, byte_spec, model, library):
    same_rows(aligned(docs, byte_spec, model), plain_alignment(rows, byte_spec, library))


def test_alignment_with_rare_pairs_shuffled(spark, rows, byte_spec, model, library, monkeypatch):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", 40)
    monkeypatch.setattr(token_alignment, "_LARGE_GROUP", 3)
    rows = [r for r in rows if r[1] != LONG]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    same_rows(aligned(docs, byte_spec, model), plain_alignment(rows, byte_spec, library))


def test_alignment_of_no_documents(nothing, byte_spec, model):
    assert aligned(nothing, byte_spec, model).collect() == []


# fill in the middle


def plain_transformation(key, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if h[3] % 100 < 20:
        return n, "spm", x, y - x, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", x, y - x, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_middle_against_slices(docs, rows):
    want = []
    for key, text in rows:
        *sizes, output = plain_transformation(key, text)
        want.append((key, *sizes, sha(output), sha(text or "")))
    same_rows(fill_middle.with_digests(docs), want)


def test_fill_middle_keeps_other_columns(docs, rows):
    got = fill_middle.transform(docs)
    assert got.columns == [
        "doc_id", "text", "lang", "source", "n_chars", "in_in_n", "in_form", "in_n", "row", "pair",
        "links", "in_Output", "n", "form", "prefix_chars", "middle_chars", "output",
    ]
    want = [(key, text, *plain_transformation(key, text)) for key, text in rows]
    same_rows(
        got.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"), want
    )


def test_fill_middle_by_words(spark):
    texts = made_texts(120, 11) + [LONG, " lead", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in fill_middle.transform(docs, units=r"\S+").collect()}
    import regex

    for key, text in enumerate(texts):
        starts = [m.start() for m in regex.finditer(r"\S+", text)]
        starts = sorted({0, *starts[(starts[:1] == [0]) :]} if text else set())
        if text and starts[:1] != [0]:
            starts = [0, *starts]
        n = len(starts)
        row = got[key]
        assert row["n"] == n
        if row["form"] == "plain":
            continue
        x, y = sorted(int(v) % (n + 1) for v in fill_middle.draws([key])[0, :2])
        at = [*starts, len(text)]
        assert (row["prefix_chars"], row["middle_chars"]) == (at[x], at[y] - at[x])
        assert row["output"].endswith("<M>" + text[at[x] : at[y]])
    back = fill_middle.transform(docs, units=r"\S+").select(
        "doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text")
    )
    same_rows(back, list(enumerate(texts)))


def test_cuts_at_every_place():
    """Every cut of texts around the block length."""
    texts = ["é" * 127 + "a" * 3 + "日" * 200, "a" * fill_middle.BLOCK, "", "🙂" * 640, "ab" * 700]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    trees = fill_middle.BlockTrees(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert trees.totals.tolist() == [len(t) for t in texts]
    for k, text in enumerate(texts):
        units = np.arange(len(text) + 1)
        place, chars = trees.cut(np.full(len(units), k), units)
        assert place.tolist() == [len(text[:u].encode()) for u in units]
        assert chars.tolist() == units.tolist()


def test_fill_middle_of_no_documents(nothing):
    assert fill_middle.with_digests(nothing).collect() == []


def test_registered():
    from corpusloom.llm.queries import QUERIES

    assert {"op11_sentence_pieces", "op12_token_alignment", "op13_fill_middle"} <= set(QUERIES)
    assert json.dumps(sorted(QUERIES))


def test_pipeline_of_no_documents(spark, nothing, tmp_path):
    import corpus_pipeline

    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
