"""Rolling totals over trailing periods (problem 6).

Events are deduplicated by id, counted per entity and day, made dense by giving each entity every day of
the calendar, and summed over a fixed number of preceding rows. Hot entities cost nothing: counting is
partial before the shuffle, so no entity has more rows than the calendar has days.

Defined results
---------------
* an event delivered several times (same id) counts once; a null id is an event of its own;
* events with null or blank entity, or without day and arrival, count nowhere; days outside the calendar too;
* every entity with at least one event in the calendar has a row for each day, silent days with 0;
* averages divide by the length of the period, also at the calendar's start (nothing happened before);
* no events give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, entity: Column, day: Column, event_id: str | None = "id") -> DataFrame:
    """(entity, day, n): events per entity and day, each id once."""
    base = events.select(
        (F.col(event_id) if event_id else F.lit(None).cast("bigint")).alias("__id"), entity.alias("entity"), day.cast("date").alias("day")
    ).where((F.trim("entity") != "") & F.col("day").isNotNull())
    if event_id:
        # One shuffle on the id; partial aggregation removes repeats within a task first.
        named = base.where(F.col("__id").isNotNull()).groupBy("__id").agg(F.min(F.struct("entity", "day")).alias("e"))
        base = named.select("e.entity", "e.day").unionAll(base.where(F.col("__id").isNull()).select("entity", "day"))
    return base.groupBy("entity", "day").agg(F.count("*").alias("n"))


def trailing_totals(daily: DataFrame, first_day: str, last_day: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """(entity, day, n, total_<p>, avg_<p> for each period): dense over first_day..last_day.

    The entity-calendar product is an ``explode`` of the fixed calendar for each distinct entity (entities x
    days, the size of the result), hash-partitioned by entity once; aggregation and window reuse that.
    """
    a, b = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    inside = daily.where(F.col("day").between(a, b)).select("entity", "day", "n").repartition("entity")
    spine = inside.groupBy("entity").agg(F.lit(0).cast("bigint").alias("n")).select(
        "entity", F.explode(F.sequence(a, b)).alias("day"), "n"
    )
    dense = inside.unionAll(spine).repartition("entity").groupBy("entity", "day").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("entity").orderBy("day")
    total = lambda p: F.sum("n").over(w.rowsBetween(-(p - 1), 0))
    return dense.select(
        "entity",
        "day",
        "n",
        *[x for p in periods for x in (total(p).alias(f"total_{p}"), (total(p) / F.lit(float(p))).alias(f"avg_{p}"))],
    )
