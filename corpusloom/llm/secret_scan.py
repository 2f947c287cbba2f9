"""Secrets in texts: fixed patterns, and a battery of randomness tests for other tokens.

Everything here is DataFrame functions inside a row; no row is shuffled.

The patterns find assignments, access keys and hexadecimal strings. Other tokens of letters and
digits are tested by the alphabet of the encoding they seem to have: uniformity of its letters
(chi-squared), runs of letter classes, and serial correlation of neighbouring letters. Each
statistic is measured against what written words give in that alphabet at that length, and the
three are added with an allowance for their dependence. Tokens that touch no pattern compete within
their length class: the Benjamini-Hochberg threshold of each class is taken from the counts over the
whole table.

Defined results: a null text is empty; an empty text has no spans; rows are kept as they are,
repeated ones and those without an id too; an empty table gives no rows; other columns of the
input are not read, or kept by ``mask_secrets``. Tokens of letters only or digits only, and
tokens under twenty letters, are never added by the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed patterns of the base kinds.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Runs shorter than these are dropped, so the patterns may as well ask for them.
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
LONG_HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")

# An equals sign belongs to a token as padding at its end only, so that a key before one is split
# off; base32 pads with up to six.
TOKEN = r"[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
# Written words in an alphabet: chance that two letters are equal, chance that the class changes from
# one letter to the next, serial correlation of letter places, and what the sum of the three distances
# is divided by. Set from names of corpus words and numbers (of words like "decade" for base 16), 3,000
# for each alphabet and length from 20 to 64, so that at most one in a thousand has p below 0.001.
NARROW = (0.115, 0.15, 0.8, 2.0)
SINGLE = (0.06, 0.11, 0.35, 1.7)
JOINED = (0.055, 0.28, 0.5, 2.2)
# Encodings by the letters a token uses, narrowest first: name, pattern, alphabet, written words.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef", NARROW),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF", NARROW),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567", (0.062, 0.11, 0.45, 1.7)),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER, SINGLE),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER, SINGLE),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER, (0.05, 0.25, 0.7, 1.9)),
    ("base64", "^[0-9A-Za-z+/]+$", DIGITS + UPPER + LOWER + "+/", JOINED),
    ("base64url", "^[0-9A-Za-z_-]+$", DIGITS + UPPER + LOWER + "_-", JOINED),
)
# Allowed share of false discoveries, and how unlike a random token may be in any one test.
FALSE_SHARE = 5e-2
MAX_DEVIATION = 3.5

_BLOCK = 256


def starts_of(steps: Column) -> Column:
    """Sum of all earlier elements for every element of an array of numbers.

    Sums run within blocks of 256 on top of block totals, so long arrays stay cheap.
    """
    size = F.size(steps)
    blocks = F.sequence(F.lit(0), F.floor((size - 1) / _BLOCK).cast("int"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    totals = F.transform(blocks, lambda b: total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    before = F.transform(blocks, lambda b: total(F.slice(totals, F.lit(1), b)))

    def within(b: Column) -> Column:
        empty = F.struct(
            F.element_at(before, b + 1).alias("at"),
            F.array().cast("array<bigint>").alias("out"),
        )
        return F.aggregate(
            F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)),
            empty,
            lambda s, x: F.struct(
                (s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")
            ),
            lambda s: s["out"],
        )

    return F.when(size <= 0, F.array().cast("array<bigint>")).otherwise(
        F.flatten(F.transform(blocks, within))
    )


def matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, gaps before and after them) of a pattern; both empty where nothing matches."""
    found = text.rlike(pattern)
    none = F.array().cast("array<string>")
    return (
        F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        F.when(found, F.split(text, pattern, -1)).otherwise(none),
    )


def spans_of(found: Column, gaps: Column) -> Column:
    """array<struct<start, end, token>> in code points."""
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)),
        found,
        lambda gap, match: (F.length(gap) + F.length(match)).cast("long"),
    )
    ends = F.zip_with(starts_of(steps), steps, lambda start, step: start + step)
    return F.zip_with(
        ends,
        found,
        lambda end, match: F.struct(
            (end - F.length(match)).alias("start"), end.alias("end"), match.alias("token")
        ),
    )


def normal_tail(z: Column) -> Column:
    """Chance that a standard normal exceeds z (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    upper = 0.3989422804014327 * F.exp(-x * x / 2) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def battery(token: Column) -> Column:
    """struct<length, p, deviation> of a token; null where no encoding is inferred.

    ``p`` is the chance that written words of this length look as random; ``deviation`` is the
    largest distance, in standard deviations, from what a random token of the encoding gives.
    """
    body = F.regexp_replace(token, "=+$", "")
    names = ("repeat", "change", "serial", "spread")
    encoding = F.coalesce(
        *[
            F.when(
                body.rlike(pattern),
                F.struct(
                    F.lit(letters).alias("alphabet"),
                    *[F.lit(x).alias(name) for name, x in zip(names, words)],
                ),
            )
            for _, pattern, letters, words in ENCODINGS
        ]
    )
    parts = F.struct(
        body.alias("body"),
        F.split(body, "").alias("letters"),
        F.length(body).cast("double").alias("n"),
        encoding["alphabet"].alias("alphabet"),
        F.length(encoding["alphabet"]).cast("double").alias("k"),
        encoding.alias("words"),
    )
    tested = token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.length(body) >= 20)
    return F.when(tested & encoding.isNotNull(), _let(parts, _measured))


def _measured(t: Column) -> Column:
    """The three statistics of a token with its letters and alphabet."""
    n, k = t["n"], t["k"]
    squares = F.aggregate(
        F.array_distinct(t["letters"]),
        F.lit(0.0),
        lambda a, c: a + F.pow(n - F.length(F.replace(t["body"], c, F.lit(""))), F.lit(2.0)),
    )
    classes = F.translate(
        t["body"], UPPER + LOWER + DIGITS, "U" * len(UPPER) + "L" * len(LOWER) + "D" * len(DIGITS)
    )

    def share(chars: str) -> Column:
        others = F.length(F.translate(t["alphabet"], chars, ""))
        return F.pow((k - others) / k, F.lit(2.0))

    marks = F.length(F.translate(t["alphabet"], UPPER + LOWER + DIGITS, "")) / k
    places = F.transform(t["letters"], lambda c: F.instr(t["alphabet"], c) - (k + 1) / 2)
    products = _let(
        places,
        lambda p: F.zip_with(
            F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1),
            lambda a, b: a * b,
        ),
    )
    measures = F.struct(
        (k / n * squares - n).alias("chi"),
        (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1.0).alias("changes"),
        (1 - share(UPPER) - share(LOWER) - share(DIGITS) - F.pow(marks, F.lit(2.0))).alias("change"),
        (
            F.aggregate(products, F.lit(0.0), lambda a, x: a + x) / ((n - 1) * (k * k - 1) / 12)
        ).alias("serial"),
    )
    return _let(measures, lambda m: _judged(n, k, m, t["words"]))


def _judged(n: Column, k: Column, m: Column, words: Column) -> Column:
    df = k - 1
    # uniformity: against a random token, and against words, whose letters repeat more often
    even = (F.cbrt(m["chi"] / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    excess = (n - 1) * (k * words["repeat"] - 1)
    uniform = (df + excess - m["chi"]) / F.sqrt(2 * df + 4 * excess)
    # runs of letter classes
    random_runs = (m["changes"] - (n - 1) * m["change"]) / F.sqrt(
        (n - 1) * m["change"] * (1 - m["change"])
    )
    runs = (m["changes"] - (n - 1) * words["change"]) / F.sqrt(
        (n - 1) * words["change"] * (1 - words["change"])
    )
    # serial correlation of places in the alphabet
    random_serial = m["serial"] * F.sqrt(n - 1)
    unlike = (words["serial"] - m["serial"]) * F.sqrt(n - 1)
    combined = (uniform + runs + unlike) / words["spread"]
    return F.struct(
        n.cast("int").alias("length"),
        normal_tail(combined).alias("p"),
        F.greatest(even, F.abs(random_runs), F.abs(random_serial)).alias("deviation"),
    )


def length_class(length: Column) -> Column:
    """Lengths that compete with each other: 20-23, 24-31, 32-47, 48-63, then by doubling."""
    return (
        F.when(length < 24, 0).when(length < 32, 1).when(length < 48, 2).when(length < 64, 3)
    ).otherwise(F.floor(F.log2(length.cast("double"))) - 2).cast("int")


def discovery_thresholds(docs: DataFrame, text: str = "text") -> dict[int, float]:
    """Largest p accepted per length class, from the counts of the tokens of all texts that touch
    no base span: what a pattern finds is no discovery, and would loosen the threshold of the rest.

    Counts are kept per class and hundredth of a decade of p: a few thousand rows at most.
    """
    texts = docs.select(F.col(text).alias("text")).filter(F.col("text").rlike(TOKEN))
    tested = _searched(texts, "text").select(
        F.explode(F.transform("_free", lambda s: battery(s["token"]))).alias("b")
    )
    # a token too unlike a random one is never added, whatever its p
    p = F.when(F.col("b.deviation") <= MAX_DEVIATION, F.col("b.p")).otherwise(1.0)
    grade = F.floor(F.least(F.lit(30.0), -F.log10(F.greatest(p, F.lit(1e-30)))) * 100)
    counts = (
        tested.filter("b is not null")
        .groupBy(length_class(F.col("b.length")).alias("class"), grade.alias("grade"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    thresholds: dict[int, float] = {}
    by_class: dict[int, list[tuple[int, int]]] = {}
    for row in counts:
        by_class.setdefault(row["class"], []).append((row["grade"], row["n"]))
    for name, grades in by_class.items():
        tests, seen = sum(n for _, n in grades), 0
        for value, n in sorted(grades, reverse=True):
            seen += n
            p = 10 ** (-value / 100)
            if p <= FALSE_SHARE * seen / tests:
                thresholds[name] = p
    return thresholds


def _searched(docs: DataFrame, text: str) -> DataFrame:
    """The table with ``_base``, the base spans in order as array<struct<start, kind, end>>, and
    ``_free``, the tokens that touch none of them as array<struct<start, end, token>>."""
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    patterns = {0: ASSIGN, 1: LONG_ACCESS, 2: LONG_HEX, 3: TOKEN}
    for k, pattern in patterns.items():
        found, gaps = matches(F.col("_text"), pattern)
        out = out.withColumns({f"_m{k}": found, f"_g{k}": gaps})
    for k in patterns:
        spans = F.when(F.size(f"_m{k}") > 0, spans_of(F.col(f"_m{k}"), F.col(f"_g{k}")))
        empty = F.array().cast("array<struct<start:bigint,end:bigint,token:string>>")
        out = out.withColumn(f"_s{k}", F.coalesce(spans, empty)).drop(f"_m{k}", f"_g{k}")
    out = out.withColumn(
        "_s0",
        F.filter(
            "_s0",
            lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= MIN_ASSIGNED,
        ),
    )
    base = F.concat(*[_of_kind(F.col(f"_s{k}"), k) for k in (0, 1, 2)])
    out = out.withColumn("_base", F.array_sort(base))
    free = F.filter(
        "_s3",
        lambda s: ~F.exists("_base", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])),
    )
    return out.withColumn("_free", free).drop("_text", *[f"_s{k}" for k in patterns])


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with ``_spans``: array<struct<start, kind, end>> in order, kind by its place in
    ``KINDS``, of all base spans and of those the tests add beside them."""
    thresholds = discovery_thresholds(docs, text)
    out = _searched(docs, text)
    more = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    if thresholds:
        more = F.when(F.size("_free") > 0, _added(F.col("_free"), thresholds)).otherwise(more)
    return out.withColumn("_spans", F.array_sort(F.concat("_base", more))).drop("_free")


def _added(free: Column, thresholds: dict[int, float]) -> Column:
    """The tokens that pass the battery."""
    limits = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])

    def passes(s: Column) -> Column:
        b = battery(s["token"])
        limit = F.element_at(limits, length_class(b["length"]))
        return F.coalesce((b["p"] <= limit) & (b["deviation"] <= MAX_DEVIATION), F.lit(False))

    return _of_kind(F.filter(free, passes), 3)


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"], F.lit(kind).alias("kind"), s["end"])
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]),
        ),
        ",",
    )


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document the counts of the base kinds, their digest, and all spans."""
    found = with_spans(
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    )

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
        written(F.col("_spans")).alias("spans"),
    )


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The table with every span of its texts replaced; texts without spans, null ones too, stay."""
    found = with_spans(docs, text)
    value = F.col(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, span: Column) -> Column:
        # a span inside one already masked adds nothing
        piece = F.when(
            span["end"] <= s["at"], s["out"]
        ).when(
            span["start"] < s["at"], s["out"]
        ).otherwise(
            F.array_append(
                F.array_append(
                    s["out"],
                    F.substring(value, s["at"].cast("int") + 1, (span["start"] - s["at"]).cast("int")),
                ),
                F.lit(mask),
            )
        )
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), piece.alias("out"))

    def finish(s: Column) -> Column:
        rest = F.substring(value, s["at"].cast("int") + 1, F.length(value))
        return F.concat(F.array_join(s["out"], ""), rest)

    masked = F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, finish))
    return found.withColumn(text, F.coalesce(masked, value)).drop("_base", "_spans")
