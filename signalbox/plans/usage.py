"""Usage analytics over the logs of page hits and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.operators import usage
from signalbox.tables import load

TODAY = "2024-06-30"


def _logs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, d, "usage_page_hits", "id", "name", "day", "hour"), load(spark, d, "usage_questions", "id", "question", "model", "day", "hour", "cached", "duration_ms")


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counters of both logs."""
    return usage.totals(*_logs(spark, d), TODAY)


def usage_daily_spine(spark: SparkSession, d: str) -> DataFrame:
    """The last thirty days."""
    return usage.daily(*_logs(spark, d), TODAY, 30).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def usage_hourly_spine(spark: SparkSession, d: str) -> DataFrame:
    """The hours of today."""
    return usage.hourly(*_logs(spark, d), TODAY)


def top_questions(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent questions since the range began."""
    rows = _logs(spark, d)[1].where((F.col("day") >= usage.since(TODAY, 90)) & F.col("question").isNotNull())
    return usage.top(rows, F.lower(F.trim("question")), "question")


def top_pages(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent pages since the range began."""
    rows = _logs(spark, d)[0].where((F.col("day") >= usage.since(TODAY, 90)) & F.col("name").isNotNull())
    return usage.top(rows, F.col("name"), "name")


def active_days(spark: SparkSession, d: str) -> DataFrame:
    """Days with hits."""
    return usage.active_days(_logs(spark, d)[0])


def recent_questions(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest questions."""
    from signalbox.operators.merge import newest

    return newest(_logs(spark, d)[1].distinct(), "id", 50).select("id", "question", "cached")


def page_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the name a path counts as."""
    hits = _logs(spark, d)[0].select(usage.page_name(F.col("name")).alias("page"))
    return hits.groupBy("page").agg(F.count("*").alias("n"))


QUERIES = {
    "usage_totals": usage_totals,
    "usage_daily_spine": usage_daily_spine,
    "usage_hourly_spine": usage_hourly_spine,
    "top_questions": top_questions,
    "top_pages": top_pages,
    "active_days": active_days,
    "recent_questions": recent_questions,
    "page_classifier": page_classifier,
}

_EVENTS = """WITH e AS (
  SELECT day, hour, 1 AS hit, 0 AS question, 0 AS cached FROM usage_page_hits
  UNION ALL SELECT day, hour, 0, 1, CASE WHEN coalesce(cached, 0) = 1 THEN 1 ELSE 0 END FROM usage_questions)
"""
_SUMS = "CAST(coalesce(sum(hit), 0) AS BIGINT) AS hits, CAST(coalesce(sum(question), 0) AS BIGINT) AS questions, CAST(coalesce(sum(cached), 0) AS BIGINT) AS cached"

SQL = {
    "usage_totals": f"""SELECT (SELECT count(*) FROM usage_page_hits) AS hits, (SELECT count(*) FROM usage_page_hits WHERE day = DATE '{TODAY}') AS hits_today,
        count(*) AS questions, count(*) FILTER (day = DATE '{TODAY}') AS questions_today, count(*) FILTER (cached = 1) AS cached,
        count(*) FILTER (coalesce(cached, 0) = 0) AS uncached,
        CAST(round(avg(duration_ms) FILTER (day = DATE '{TODAY}' AND coalesce(cached, 0) = 0)) AS BIGINT) AS mean_ms_today FROM usage_questions""",
    "usage_daily_spine": _EVENTS + f"""SELECT strftime(s.day, '%Y-%m-%d') AS day, {_SUMS} FROM (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - 29, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day) s
        LEFT JOIN e ON e.day = s.day GROUP BY s.day""",
    "usage_hourly_spine": _EVENTS + f"""SELECT s.hour, {_SUMS} FROM (SELECT CAST(unnest(range(24)) AS INT) AS hour) s
        LEFT JOIN e ON e.hour = s.hour AND e.day = DATE '{TODAY}' GROUP BY s.hour""",
    "top_questions": f"""SELECT lower(trim(question, ' ')) AS question, count(*) AS n FROM usage_questions WHERE day >= DATE '{TODAY}' - 89 AND question IS NOT NULL
        GROUP BY 1 ORDER BY n DESC, question LIMIT 10""",
    "top_pages": f"""SELECT name, count(*) AS n FROM usage_page_hits WHERE day >= DATE '{TODAY}' - 89 AND name IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 10""",
    "active_days": "SELECT count(DISTINCT day) AS active_days FROM usage_page_hits",
    "recent_questions": "SELECT id, question, cached FROM (SELECT DISTINCT * FROM usage_questions) ORDER BY id DESC LIMIT 50",
    "page_classifier": """WITH p AS (SELECT regexp_replace(regexp_replace(lower(coalesce(name, '')), '[?#].*$', ''), '^/+|/+$', '', 'g') AS p FROM usage_page_hits)
        SELECT CASE WHEN p LIKE 'api/%' OR p = 'api' OR contains(p, '.') THEN NULL WHEN p = '' THEN 'home' ELSE string_split(p, '/')[1] END AS page, count(*) AS n FROM p GROUP BY 1""",
}
