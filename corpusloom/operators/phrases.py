"""Command phrases inside transcripts, and the report on a matching run.

A phrase occurs in a transcript if its letters do, so its first word may be the end of a heard word
and its last word the beginning of one; a phrase of one word may lie inside a word. Phrases are
therefore looked up in the vocabulary of the transcripts first, which is short beside them:
``word_matches`` joins the outer words of phrases to the vocabulary. A phrase of one word is decided
by that. Any other phrase is anchored at its rarest word, only transcripts with an anchor's word meet
the phrase, and the row of the transcript tells whether the whole phrase is in it. Commands stay a
table throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import normalise_phrase
from corpusloom.operators.skew import BROADCAST_ROWS, lookup_join
from corpusloom.sources.shared import materialise

# Letters by which the outer words of phrases meet the vocabulary: at the end or the beginning of a
# word, and anywhere in it.
EDGE_LETTERS = 6
INNER_LETTERS = 4

INSIDE, AT_END, AT_START, WHOLE = "inside", "at end", "at start", "whole"


def _prepared(commands: DataFrame, by_language: bool) -> DataFrame:
    """Active commands with normalised phrases; of equal phrases the first in list order."""
    language = F.col("language") if by_language else F.lit("")
    return (
        commands.filter("is_active")
        .select(language.alias("key"), normalise_phrase(F.col("phrase")).alias("phrase"),
                "command_order", "action")
        .filter("phrase is not null")
        .groupBy("key", "phrase")
        .agg(F.min(F.struct("command_order", "action")).alias("command"))
    )


def _grams(word: Column, letters: int) -> Column:
    """Distinct stretches of 1 to ``letters`` letters of a word, each read off by a look ahead."""
    sizes = range(1, letters + 1)
    found = (F.regexp_extract_all(word, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)) for n in sizes)
    return F.array_distinct(F.concat(*found))


def _ends(word: Column, side: str) -> Column:
    """The first or last 1 to ``EDGE_LETTERS`` letters of a word."""
    take = F.left if side == AT_START else F.right
    sizes = F.sequence(F.lit(1), F.least(F.length(word), F.lit(EDGE_LETTERS)))
    return F.transform(sizes, lambda n: take(word, n))


def word_matches(
    vocabulary: DataFrame, needles: DataFrame, rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``(side, needle, word, df)``: the words that have a needle inside, at their end or start.

    ``vocabulary`` has ``word`` and ``df``, ``needles`` distinct ``(side, needle)``. Both meet by a
    few letters, and whole needles are compared in the row. A frequent stretch of letters is spread.
    """
    word, needle = F.col("word"), F.col("needle")
    keyed = vocabulary.select(
        "word",
        "df",
        F.explode(
            F.map_from_arrays(
                F.array(F.lit(INSIDE), F.lit(AT_END), F.lit(AT_START)),
                F.array(_grams(word, INNER_LETTERS), _ends(word, AT_END), _ends(word, AT_START)),
            )
        ).alias("side", "letters"),
    ).select("word", "df", "side", F.explode("letters").alias("letters"))
    asked = needles.select(
        "side",
        "needle",
        F.when(F.col("side") == INSIDE, F.left(needle, F.lit(INNER_LETTERS)))
        .when(F.col("side") == AT_END, F.right(needle, F.lit(EDGE_LETTERS)))
        .otherwise(F.left(needle, F.lit(EDGE_LETTERS)))
        .alias("letters"),
    )
    met = lookup_join(keyed, asked, ["side", "letters"], ["word"], "inner", rows)
    fitting = (
        F.when(F.col("side") == INSIDE, F.contains(word, needle))
        .when(F.col("side") == AT_END, F.endswith(word, needle))
        .otherwise(F.startswith(word, needle))
    )
    return met.filter(fitting).select("side", "needle", "word", "df")


def _anchors(phrases: DataFrame, vocabulary: DataFrame, matches: DataFrame) -> DataFrame:
    """``(phrase, word)``: the heard words at which phrases of several words are looked for.

    Every word of a phrase is a possible anchor: an inner one is a heard word, an outer one stands
    for all heard words that end or begin with it. The one heard in the fewest transcripts is taken;
    a phrase with a word that is never heard drops out.
    """
    size = F.size("words")
    options = phrases.select(
        "phrase",
        F.explode(
            F.transform(
                "words",
                lambda w, i: F.struct(
                    F.when(i == 0, AT_END).when(i == size - 1, AT_START).otherwise(WHOLE).alias("side"),
                    w.alias("needle"),
                ),
            )
        ).alias("o"),
    ).select("phrase", "o.*")
    whole = options.filter(F.col("side") == WHOLE).select("side", "needle").distinct()
    heard = whole.join(vocabulary.withColumnRenamed("word", "needle"), "needle").select(
        "side", "needle", F.col("needle").alias("word"), "df"
    )
    places = matches.filter(F.col("side") != INSIDE).unionByName(heard)
    totals = places.groupBy("side", "needle").agg(F.sum("df").alias("total"))
    rated = options.join(totals, ["side", "needle"], "left")
    best = (
        rated.groupBy("phrase")
        .agg(
            F.min(F.struct(F.coalesce("total", F.lit(0)).alias("total"), "side", "needle")).alias("o")
        )
        .filter("o.total > 0")
        .select("phrase", "o.side", "o.needle")
    )
    return best.join(places, ["side", "needle"]).select("phrase", "word")


def match_commands(
    transcripts: DataFrame,
    commands: DataFrame,
    by_language: bool = False,
    rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(id, command_order, action)``: the first command whose phrase the transcript contains.

    Transcripts without a match, and blank ones, keep their row with nulls. Compares normalised
    texts; phrases may have any length and number. By language, a transcript or command without a
    language matches nothing. An empty phrase is part of every transcript that is not blank.
    Lookups of at most ``rows`` rows are broadcast, longer ones shuffle with hot words spread.
    """
    key = F.col("language") if by_language else F.lit("")
    heard = materialise(
        transcripts.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            key.alias("key"),
            normalise_phrase(F.col("text")).alias("heard"),
        ),
        "heard",
    )
    ready = materialise(_prepared(commands, by_language), "commands")
    said = heard.filter("heard <> ''")
    words = said.select(
        "row", "key", F.explode(F.array_distinct(F.split("heard", " "))).alias("word")
    )
    vocabulary = materialise(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "words")
    phrases = (
        ready.filter("phrase <> ''").select("phrase").distinct()
        .select("phrase", F.split("phrase", " ").alias("words"))
    )
    first, last = F.element_at("words", 1), F.element_at("words", -1)
    needles = F.when(
        F.size("words") == 1,
        F.array(F.struct(F.lit(INSIDE).alias("side"), first.alias("needle"))),
    ).otherwise(
        F.array(
            F.struct(F.lit(AT_END).alias("side"), first.alias("needle")),
            F.struct(F.lit(AT_START).alias("side"), last.alias("needle")),
        )
    )
    asked = phrases.select(F.inline(needles)).distinct()
    matches = materialise(word_matches(vocabulary, asked, rows), "word-matches")

    # phrases of one word: the first command of each heard word
    single = (
        matches.filter(F.col("side") == INSIDE)
        .join(ready.withColumnRenamed("phrase", "needle"), "needle")
        .groupBy("word", "key")
        .agg(F.min("command").alias("command"))
    )
    # others: transcripts with an anchor's word, and the whole phrase
    longer = phrases.filter(F.size("words") > 1)
    anchors = _anchors(longer, vocabulary, matches)
    met = lookup_join(words, materialise(anchors, "anchors"), ["word"], ["row"], "inner", rows)
    wanted = met.select("row", "key", "phrase").distinct()
    asked_for = lookup_join(wanted, ready, ["key", "phrase"], ["row"], "inner", rows).select(
        F.col("row").alias("in_row"), "phrase", "command"
    )
    whole = said.join(
        asked_for, (F.col("row") == F.col("in_row")) & F.contains("heard", F.col("phrase"))
    )
    everywhere = ready.filter("phrase = ''").select("key", "command")
    found = (
        lookup_join(words, materialise(single, "single"), ["word", "key"], ["row"], "inner", rows)
        .select("row", "command")
        .unionByName(whole.select("row", "command"))
        .unionByName(
            lookup_join(said.select("row", "key"), everywhere, ["key"], ["row"], "inner", rows)
            .select("row", "command")
        )
    )
    best = found.groupBy("row").agg(F.min("command").alias("command"))
    return heard.join(best, "row", "left").select("id", "command.*")


def medians(df: DataFrame, group: list[str], value: str, width: float) -> DataFrame:
    """The exact median per group from counts per distinct value.

    Equal values are counted before anything is sorted, and values are placed block by block of
    ``width``, so neither a frequent value nor a large group meets in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("_c")
    ).withColumn("_block", F.floor(F.col(value) / width))
    blocks = counts.groupBy(*group, "_block").agg(F.sum("_c").alias("_b"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = blocks.select(
        *group,
        "_block",
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_before"),
        F.sum("_b").over(Window.partitionBy(*group)).alias("_n"),
    )
    up_to = Window.partitionBy(*group, "_block").orderBy(value)
    last = F.col("_before") + F.sum("_c").over(up_to)
    ranged = counts.join(placed, [*group, "_block"]).withColumn("_last", last)
    covers = lambda at: (F.col("_last") - F.col("_c") < at) & (F.col("_last") >= at)
    low, high = F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")
    # one or two values cover the middle places
    middle = ranged.filter(covers(low) | covers(high))
    return middle.groupBy(*group).agg(F.avg(value).alias("median"))


def matching_report(results: DataFrame, group: list[str]) -> DataFrame:
    """Hit rate, false positives, pooled word error rate, latency and real-time factor.

    Takes ``expected`` and ``matched`` (null for none), ``errors``, ``ref_words``, ``ms`` and
    ``seconds`` of audio.
    """
    hit = F.col("matched").eqNullSafe(F.col("expected"))
    totals = results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("expected").isNotNull() & hit).alias("hits"),
        F.coalesce(
            F.try_divide(
                F.count_if(F.col("expected").isNotNull() & hit), F.count("expected")
            ),
            F.lit(0.0),
        ).alias("hit_rate"),
        F.count_if(F.col("expected").isNull() & F.col("matched").isNotNull()).alias(
            "false_positives"
        ),
        F.coalesce(F.try_divide(F.sum("errors"), F.sum("ref_words")), F.lit(0.0)).alias("wer"),
        F.count_if(F.col("errors") == 0).alias("perfect"),
        F.avg("ms").alias("mean_ms"),
        F.coalesce(F.try_divide(F.sum("ms") / 1000, F.sum("seconds")), F.lit(0.0)).alias(
            "real_time_factor"
        ),
    )
    middle = medians(results, group, "ms", 50.0).withColumnRenamed("median", "median_ms")
    return totals.join(middle, group, "left")
