"""A sliding-window limiter: accepted events of the last period are counted, refused ones are not."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT, PERIOD_MS = 12, 60_000


def accepted(times: Column, limit: int = LIMIT, period: int = PERIOD_MS) -> Column:
    """The accepted ones of sorted times (ms): at most ``limit`` in any ``period``, an event exactly a period old no longer
    counts. A fold that carries only the last ``limit`` accepted times."""
    start = F.struct(F.array().cast("array<bigint>").alias("last"), F.array().cast("array<bigint>").alias("ok"))

    def step(acc: Column, t: Column) -> Column:
        live = F.filter(acc["last"], lambda x: t - x < period)
        takes = F.size(live) < limit
        return F.struct(F.when(takes, F.array_append(live, t)).otherwise(live).alias("last"), F.when(takes, F.array_append(acc["ok"], t)).otherwise(acc["ok"]).alias("ok"))

    return F.aggregate(times, start, step, lambda acc: acc["ok"])


def _decide(times: list[int], last: list[int], limit: int, period: int) -> tuple[list[bool], list[int]]:
    out = []
    for t in times:
        last = [x for x in last if t - x < period]
        out.append(len(last) < limit)
        if out[-1]:
            last.append(t)
    return out, last


def limit_batch(events: DataFrame, key: str, ms: str, limit: int = LIMIT, period: int = PERIOD_MS) -> DataFrame:
    """(key, ms, ok) of a batch.

    A key's events are cut where nothing happened for a period, which is exact, so a busy key is many parts. Quiet gaps
    lie only between periods of the clock, so these are counted first, with their first and last event: the window that
    numbers the parts sees a row per key and period, never a key's events. Parts are spread by hash, sorted within their
    tasks and decided as they stream by, remembering at most ``limit`` times.
    """
    clock = F.floor(F.col(ms) / F.lit(period)).alias("__clock")
    rows = events.select(key, ms, clock)
    w = Window.partitionBy(key).orderBy("__clock")
    seen = rows.groupBy(key, "__clock").agg(F.min(ms).alias("__from"), F.max(ms).alias("__to"))
    gap = F.coalesce(F.col("__from") - F.lag("__to").over(w), F.lit(period)) >= period
    numbered = seen.select(F.col(key).alias("__key"), F.col("__clock").alias("__at"), F.sum(F.when(gap, 1).otherwise(0)).over(w).alias("__part"))
    parts = rows.join(numbered, F.col(key).eqNullSafe(F.col("__key")) & F.col("__clock").eqNullSafe(F.col("__at"))).select(key, ms, "__part")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, []
        for pdf in frames:
            out = []
            for k, part, t in zip(pdf[key], pdf["__part"], pdf[ms], strict=True):
                if (k, part) != at:
                    at, last = (k, part), []
                ok, last = _decide([t], last, limit, period)
                out += ok
            yield pdf[[key, ms]].assign(ok=out)

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    ordered = parts.repartition(key, "__part").sortWithinPartitions(key, "__part", ms)
    return ordered.mapInPandas(run, f"`{key}` {kinds[key]}, `{ms}` {kinds[ms]}, ok boolean")


def limit_stream(events: DataFrame, key: str, ms: str, limit: int = LIMIT, period: int = PERIOD_MS) -> DataFrame:
    """The same over a stream: the state of a key is the accepted times of the last period, and expires."""

    def run(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get[0]) if state.exists else []
        for pdf in frames:
            pdf = pdf.sort_values(ms, kind="stable")
            ok, last = _decide(pdf[ms].tolist(), last, limit, period)
            yield pd.DataFrame({key: k[0], ms: pdf[ms].to_numpy(), "ok": ok})
        state.update((last,))
        state.setTimeoutDuration(period * 2)

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.groupBy(key).applyInPandasWithState(
        run, f"`{key}` {kinds[key]}, `{ms}` {kinds[ms]}, ok boolean", "last array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
