"""Streams of answer fragments: reasoning is held back, fillers are dropped, the rest passes on as it comes.

``clean_fragments`` is the rule as a state machine over one stream's fragments; ``clean_batch`` applies it to ordered
rows and ``clean_stream`` to a stream with state, giving the same text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalbox.functions.text import FILLER, REASONING, REASONING_GLUED

#: Characters an answer's head is held back for judging, or up to its first line end.
HEAD = 60
_OPEN, _CLOSE = "<think>", "</think>"


@dataclass
class State:
    """What a stream's machine remembers between fragments."""

    thinking: bool = False
    started: bool = False
    leaked: bool = False
    pending: str = ""
    head: str = ""


def _held(text: str) -> int:
    """Length of a tail that may be the beginning of a tag."""
    low = text.lower()
    return next((n for n in range(min(len(low), len(_CLOSE) - 1), 0, -1) if _OPEN.startswith(low[-n:]) or _CLOSE.startswith(low[-n:])), 0)


def _reasons(head: str) -> bool:
    glued = re.sub("[^a-z0-9]+", "", head.lower())
    return bool(re.match(REASONING, head)) or any(glued.startswith(p) for p in REASONING_GLUED)


def feed(state: State, text: str, last: bool = False) -> str:
    """Take a fragment; give what may pass on."""
    data, out = state.pending + text, ""
    state.pending = ""
    while data:
        low = data.lower()
        tag = _CLOSE if state.thinking else _OPEN
        at = low.find(tag)
        if at < 0 and not state.thinking and _CLOSE in low:  # a closing tag alone: what came before was reasoning
            at = low.find(_CLOSE)
            data, out, state.head, state.started, state.leaked = data[at + len(_CLOSE) :], "", "", False, False
            continue
        if at < 0:
            keep = 0 if last else _held(data)
            if not state.thinking:
                out += data[: len(data) - keep]
            state.pending = data[len(data) - keep :] if keep else ""
            break
        if not state.thinking:
            out += data[:at]
        state.thinking = not state.thinking
        data = data[at + len(tag) :]
    if state.started:
        return "" if state.leaked else out
    state.head += out
    if last or len(state.head) >= HEAD or "\n" in state.head.lstrip():
        head = re.sub(FILLER, "", state.head).lstrip()
        if head or last:
            state.started, state.leaked, state.head = True, _reasons(head), ""
            return "" if state.leaked else head
    return ""


def clean_fragments(fragments: list[str]) -> list[str]:
    """What passes on for each fragment of a whole stream."""
    state = State()
    return [feed(state, x or "", i == len(fragments) - 1) for i, x in enumerate(fragments)]


_OUT = "stream_id string, seq bigint, content string"


def clean_batch(frames: DataFrame) -> DataFrame:
    """(stream_id, seq, content) of (stream_id, seq, content): streams are spread by hash, sorted within their tasks and
    cleaned as they go by; a stream is one answer, bounded by its model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            open_ = pdf["stream_id"] == pdf["stream_id"].iloc[-1]  # may go on in the next batch
            rest = pdf[open_]
            yield _cleaned(pdf[~open_])
        if rest is not None:
            yield _cleaned(rest)

    return frames.select("stream_id", "seq", "content").repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(run, _OUT)


def _cleaned(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, own in pdf.groupby("stream_id", sort=False):
        out += clean_fragments(own["content"].tolist())
    done = pdf.assign(content=pd.Series(out, index=pdf.index, dtype=object))
    return done[done["content"] != ""]


def clean_stream(frames: DataFrame, abandoned_ms: int | None = None) -> DataFrame:
    """The same over a stream of (stream_id, seq, content, done); where ``abandoned_ms`` is given, a stream
    without a fragment for so long (by the clock) is given up, and what was held back of it is judged as if it had ended.
    A query that runs until its input is used up never ends with such a clock, so it takes none."""

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            *machine, seq = state.get
            rest = feed(State(*machine), "", True)
            state.remove()
            yield pd.DataFrame([(key[0], seq + 1, rest)] if rest else [], columns=["stream_id", "seq", "content"])
            return
        s = State(*state.get[:-1]) if state.exists else State()
        rows, done = [], False
        for pdf in batches:
            rows.append(pdf)
        pdf = pd.concat(rows).sort_values("seq")
        out = []
        for seq, text, end in zip(pdf["seq"], pdf["content"], pdf["done"], strict=True):
            if piece := feed(s, text or "", bool(end)):
                out.append((key[0], seq, piece))
            done = done or bool(end)
        if done:
            state.remove()
        else:
            state.update((s.thinking, s.started, s.leaked, s.pending, s.head, int(pdf["seq"].max())))
            if abandoned_ms:
                state.setTimeoutDuration(abandoned_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "content"])

    return frames.groupBy("stream_id").applyInPandasWithState(
        run, _OUT, "thinking boolean, started boolean, leaked boolean, pending string, head string, seq bigint", "append", GroupStateTimeout.ProcessingTimeTimeout if abandoned_ms else GroupStateTimeout.NoTimeout
    )


def answer_events(rows: DataFrame) -> DataFrame:
    """(query, seq, event, payload): the events of an answered question in order: sources, tokens, final, done."""
    parts = F.concat(
        F.array(F.struct(F.lit("sources").alias("event"), F.to_json("sources").alias("payload"))),
        F.transform(F.regexp_extract_all("answer", F.lit(r"(\S+\s*)"), 1), lambda t: F.struct(F.lit("token").alias("event"), F.to_json(F.struct(t.alias("text"))).alias("payload"))),
        F.array(F.struct(F.lit("final").alias("event"), F.to_json(F.struct("answer")).alias("payload")), F.struct(F.lit("done").alias("event"), F.lit("{}").alias("payload"))),
    )
    return rows.select("query", F.posexplode(parts).alias("seq", "e")).select("query", "seq", "e.event", "e.payload")


def sse(rows: DataFrame) -> DataFrame:
    """Events as lines of a server-sent event stream."""
    return rows.withColumn("frame", F.format_string("event: %s\ndata: %s\n\n", F.col("event"), F.col("payload")))
