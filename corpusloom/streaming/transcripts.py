"""Streaming transcripts: per session, the text so far as offsets and a bounded tail."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpusloom.functions.text import normalise_phrase, squeeze

# Fixed value: characters of context kept.
TAIL_CHARS = 200
# Characters of a session that one task joins.
BLOCK_CHARS = 1 << 20

_OUT = (
    "conv_id bigint, turn bigint, chunk string, chars_before bigint, total_chars bigint, "
    "tail string, heard string"
)
_STATE = "total bigint, tail string, heard string"


class TranscriptState(StatefulProcessor):
    """State per session: length of the text so far, its tail, and its normalised tail."""

    def __init__(self, tail_chars: int, phrase_chars: int):
        self._tail_chars = tail_chars
        self._phrase_chars = phrase_chars

    def init(self, handle) -> None:
        self._state = handle.getValueState("transcript", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        known = self._state.get()
        total, tail, heard = known if known is not None else (0, "", "")
        # one session's chunks of one micro-batch
        batch = pd.concat(list(rows)).sort_values("turn")
        out = []
        for turn, chunk, phrase in zip(batch["turn"], batch["chunk"], batch["phrase"]):
            before = total
            if chunk:
                glue = " " if total else ""
                before = total + len(glue)
                total = before + len(chunk)
                tail = (tail + glue + chunk)[-self._tail_chars :]
            window = " ".join(p for p in (heard, phrase) if p)
            heard = window[-self._phrase_chars :] if self._phrase_chars else ""
            out.append((key[0], turn, chunk, before, total, tail, window))
        self._state.update((total, tail, heard))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def transcript_states(
    chunks: DataFrame, tail_chars: int = TAIL_CHARS, phrase_chars: int = 0
) -> DataFrame:
    """One row per chunk ``(conv_id, turn, text)`` of a stream.

    The text so far is given by ``total_chars``, each chunk by its offset ``chars_before``, and
    the context by ``tail``; the state of a session does not grow with it. ``heard`` is the
    normalised chunk after the last ``phrase_chars`` normalised characters before it, so any
    phrase of up to ``phrase_chars + 1`` characters shows up whole in one of these windows.
    """
    cleaned = chunks.select(
        "conv_id",
        "turn",
        squeeze(F.col("text")).alias("chunk"),
        normalise_phrase(F.col("text")).alias("phrase"),
    )
    return cleaned.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=TranscriptState(tail_chars, phrase_chars),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="None",
    )


def full_texts(states: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(conv_id, full_text, total_chars)``: what a session has said so far, from its stored chunks.

    A session's chunks are joined block by block of ``block_chars`` characters first, so that one
    long session is the work of many tasks; only its finished blocks meet at the end.
    """
    said = states.filter("chunk <> ''").select(
        "conv_id",
        F.floor(F.col("chars_before") / block_chars).alias("block"),
        F.struct("chars_before", "chunk").alias("piece"),
    )
    joined = lambda pieces, field: F.array_join(
        F.transform(F.array_sort(F.collect_list(pieces)), lambda p: p[field]), " "
    )
    blocks = said.groupBy("conv_id", "block").agg(joined("piece", "chunk").alias("text"))
    texts = blocks.groupBy("conv_id").agg(
        joined(F.struct("block", "text"), "text").alias("full_text")
    )
    sessions = states.select("conv_id").distinct()
    return sessions.join(texts, "conv_id", "left").select(
        "conv_id",
        F.coalesce("full_text", F.lit("")).alias("full_text"),
        F.coalesce(F.length("full_text"), F.lit(0)).cast("long").alias("total_chars"),
    )


def texts_so_far(states: DataFrame, asked: DataFrame) -> DataFrame:
    """``(conv_id, turn, full_text)``: the text of a session up to the asked turns.

    Only chunks of asked sessions are read on; a chunk that several turns include is repeated for
    each of them, which is what their texts do as well.
    """
    wanted = asked.select("conv_id", F.col("turn").alias("asked_turn")).distinct()
    met = states.join(wanted, "conv_id").filter(F.col("turn") <= F.col("asked_turn"))
    pieces = F.collect_list(F.when(F.col("chunk") != "", F.struct("chars_before", "chunk")))
    text = F.array_join(F.transform(F.array_sort(pieces), lambda p: p["chunk"]), " ")
    return met.groupBy("conv_id", "asked_turn").agg(text.alias("full_text")).select(
        "conv_id", F.col("asked_turn").alias("turn"), "full_text"
    )


def final_matches(states: DataFrame, commands: DataFrame) -> DataFrame:
    """The first command in list order heard anywhere in a session, from its stored windows."""
    from corpusloom.operators.phrases import match_commands

    windows = states.select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", F.col("heard").alias("text")
    )
    hits = match_commands(windows, commands)
    sessions = hits.withColumn("conv_id", F.split("id", ":")[0].cast("bigint"))
    best = F.min(F.when(F.col("command_order").isNotNull(), F.struct("command_order", "action")))
    return sessions.groupBy("conv_id").agg(best.alias("c")).select(
        "conv_id", F.col("c.command_order").alias("command_order"), F.col("c.action").alias("action")
    )
