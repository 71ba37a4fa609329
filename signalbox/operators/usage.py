"""Usage analytics over page hits and questions: totals, series over days and hours, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most days a series may span.
MAX_DAYS = 90


def since(today: str, days: int) -> Column:
    """The first day of a range of ``days`` (clamped) that ends today."""
    return F.date_sub(F.lit(today).cast("date"), max(1, min(MAX_DAYS, days)) - 1)


def totals(hits: DataFrame, questions: DataFrame, today: str) -> DataFrame:
    """One row: hits and questions in all and today, model and cache answers, mean duration of today's model answers."""
    now = F.lit(today).cast("date")
    fresh = F.coalesce(F.col("cached"), F.lit(0)) == 0
    h = hits.agg(F.count("*").alias("hits"), F.count_if(F.col("day") == now).alias("hits_today"))
    q = questions.agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("day") == now).alias("questions_today"),
        F.count_if(F.col("cached") == 1).alias("cached"),
        F.count_if(fresh).alias("uncached"),
        F.round(F.avg(F.when((F.col("day") == now) & fresh, F.col("duration_ms")))).cast("bigint").alias("mean_ms_today"),
    )
    return h.crossJoin(F.broadcast(q))  # one row each


def _events(hits: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    h = hits.select(F.col(key), F.lit(1).alias("hit"), F.lit(0).alias("question"), F.lit(0).alias("cached"))
    q = questions.select(F.col(key), F.lit(0).alias("hit"), F.lit(1).alias("question"), (F.coalesce(F.col("cached"), F.lit(0)) == 1).cast("int").alias("cached"))
    return h.unionByName(q)


def _filled(spine: DataFrame, events: DataFrame, key: str) -> DataFrame:
    counted = events.groupBy(key).agg(F.sum("hit").alias("hits"), F.sum("question").alias("questions"), F.sum("cached").alias("cached"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return spine.join(F.broadcast(counted), key, "left").select(key, zero("hits"), zero("questions"), zero("cached"))


def daily(hits: DataFrame, questions: DataFrame, today: str, days: int = 14) -> DataFrame:
    """(day, hits, questions, cached) for each day of the range, silent days with 0. Both logs in one aggregation."""
    first, last = since(today, days), F.lit(today).cast("date")
    spine = hits.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return _filled(spine, _events(hits, questions, "day").where(F.col("day").between(first, last)), "day")


def hourly(hits: DataFrame, questions: DataFrame, today: str) -> DataFrame:
    """(hour, hits, questions, cached) of today, all 24 hours."""
    now = F.lit(today).cast("date")
    spine = hits.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return _filled(spine, _events(hits.where(F.col("day") == now), questions.where(F.col("day") == now), "hour"), "hour")


def top(rows: DataFrame, key: Column, name: str, k: int = 10) -> DataFrame:
    """The k most frequent keys; ties in the key's order."""
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def active_days(hits: DataFrame) -> DataFrame:
    """The number of distinct days with hits."""
    return hits.agg(F.countDistinct("day").alias("active_days"))


def record_hit(name: Column) -> Column:
    """A page name as it is logged: 80 characters at most."""
    return F.substring(name, 1, 80)


def page_name(path: Column) -> Column:
    """The page a path counts as: none for the interface's own paths and files, ``home`` for the root."""
    p = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(path, F.lit(""))), r"[?#].*$", ""), "^/+|/+$", "")
    return F.when(p.startswith("api/") | (p == "api") | F.contains(p, F.lit(".")), F.lit(None)).when(p == "", F.lit("home")).otherwise(F.split(p, "/")[0])
