"""Streaming operators, run to completion over whole tables, and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.session import scratch
from signalbox.streaming import answers, limiter, windows
from signalbox.tables import load


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table as a stream of files."""
    schema = load(spark, d, table).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{table}.parquet*")


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = scratch(spark, "stream")
    return windows.run_once(stream, f"{folder}/out", f"{folder}/state")


def tumbling_counts_batch(spark: SparkSession, d: str) -> DataFrame:
    """Page hits per name and day of arrival."""
    hits = load(spark, d, "usage_page_hits", "name", "at")
    return windows.tumbling(hits, "at", "name").select("name", F.date_format("bucket", "yyyy-MM-dd").alias("day"), "n")


def tumbling_counts_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same counts by a stream, but repeats of an id are dropped within the watermark; buckets come out once closed, the
    last ones at the end of the input."""
    hits = _stream(spark, d, "usage_page_hits").select("name", "at", "id")
    hits = windows.closed(spark, hits, "at", load(spark, d, "usage_page_hits", "at"), scratch(spark, "end"))
    counts = windows.tumbling(hits, "at", "name", once="id")
    return _run(spark, counts).select("name", F.date_format("bucket", "yyyy-MM-dd").alias("day"), "n")


def rate_limit_accepts(spark: SparkSession, d: str) -> DataFrame:
    """Accepted and refused page hits of each name, at twelve an hour."""
    hits = load(spark, d, "usage_page_hits", "name", "at").where("name IS NOT NULL").select("name", F.unix_millis(F.col("at").cast("timestamp")).alias("ms"))
    ok = limiter.limit_batch(hits, "name", "ms", limit=12, period=3_600_000)
    return ok.groupBy("name").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("refused"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Passages as answers that arrive in fragments after their reasoning."""
    c = load(spark, d, "rag_chunks", "id", "content")
    text = F.concat(F.lit("<think>Let me see.</think>Okay, "), "content")
    return c.select(F.col("id").cast("string").alias("stream_id"), F.posexplode(F.regexp_extract_all(text, F.lit(r"((?s).{1,40})"), 1)).alias("seq", "content")).withColumn("seq", F.col("seq").cast("bigint"))


def stream_think_parser(spark: SparkSession, d: str) -> DataFrame:
    """What of each answer passes on."""
    out = answers.clean_batch(_frames(spark, d)).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("p"))
    return out.select("stream_id", F.array_join(F.transform("p", lambda x: x["content"]), "").alias("answer"))


def sse_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of every passage as an answer."""
    c = load(spark, d, "rag_chunks", "id", "source", "content").select(F.col("id").alias("query"), F.array("source").alias("sources"), F.col("content").alias("answer"))
    frames = answers.sse(answers.answer_events(c))
    return frames.groupBy("query").agg(F.count("*").alias("events"), F.count_if(F.col("event") == "token").alias("tokens"), F.sum(F.length("frame")).alias("chars"))


QUERIES = {f.__name__: f for f in (tumbling_counts_batch, tumbling_counts_stream, rate_limit_accepts, stream_think_parser, sse_events)}

_COUNTS = """SELECT name, strftime("at", '%Y-%m-%d') AS day, count(*) AS n FROM usage_page_hits GROUP BY 1, 2"""
SQL = {
    "tumbling_counts_batch": _COUNTS,
    "tumbling_counts_stream": """WITH once AS (SELECT id, any_value(name) AS name, min("at") AS t FROM usage_page_hits WHERE id IS NOT NULL GROUP BY id
  UNION ALL SELECT id, name, "at" FROM usage_page_hits WHERE id IS NULL)
SELECT name, strftime(t, '%Y-%m-%d') AS day, count(*) AS n FROM once GROUP BY 1, 2""",
    "rate_limit_accepts": """WITH RECURSIVE hits AS (SELECT name, epoch_ms("at") AS ms, row_number() OVER (PARTITION BY name ORDER BY "at") AS k FROM usage_page_hits WHERE name IS NOT NULL),
seen AS (
  SELECT name, k, [ms] AS last, TRUE AS ok FROM hits WHERE k = 1
  UNION ALL
  SELECT h.name, h.k, CASE WHEN len(list_filter(s.last, lambda x: h.ms - x < 3600000)) < 12 THEN list_append(list_filter(s.last, lambda x: h.ms - x < 3600000), h.ms) ELSE list_filter(s.last, lambda x: h.ms - x < 3600000) END,
    len(list_filter(s.last, lambda x: h.ms - x < 3600000)) < 12
  FROM seen s JOIN hits h ON h.name = s.name AND h.k = s.k + 1
)
SELECT name, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS refused FROM seen GROUP BY name""",
    "sse_events": r"""WITH parts AS (SELECT id, source, content, regexp_extract_all(content, '([^\s\x{000b}]+[\s\x{000b}]*)', 1) AS t FROM rag_chunks)
SELECT id AS query, len(t) + 3 AS events, CAST(len(t) AS BIGINT) AS tokens, CAST(coalesce(list_sum(list_transform(t, lambda x: len(CAST(to_json(x) AS VARCHAR)) + 30)), 0)
  + 23 + len(CAST(to_json([source]) AS VARCHAR)) + 32 + len(CAST(to_json(content) AS VARCHAR)) + 22 AS BIGINT) AS chars FROM parts""",
}
