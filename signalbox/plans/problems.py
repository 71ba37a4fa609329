"""The pN_ queries of the general problems (3, 4 and 6) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.operators.orphans import Edge, Relation, orphan_cascade, orphan_report
from signalbox.operators.packed import split_packed
from signalbox.operators.trailing import daily_counts, trailing_totals
from signalbox.tables import load

FIRST_DAY, LAST_DAY = "2024-01-01", "2024-12-31"


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per keyword of documents.keywords."""
    docs = load(spark, d, "documents", "doc_id", "keywords")
    return split_packed(docs, "keywords", value="keyword").select("doc_id", "pos", "keyword")


def library_graph(spark: SparkSession, d: str) -> tuple[dict[str, Relation], list[Edge]]:
    """The library's tables and references; passages take the month and time of their source's index record."""
    month = lambda c: F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("unknown"))
    docs = load(spark, d, "documents", "doc_id", "filename", "upload_date").withColumn("__period", month("upload_date"))
    index = load(spark, d, "rag_documents", "source", "indexed_at").withColumn("__period", month("indexed_at"))
    times = index.groupBy("source").agg(F.max("indexed_at").alias("__indexed"))
    chunks = (
        load(spark, d, "rag_chunks", "id", "source", "document_id")
        .join(times, "source", "left")
        .withColumn("__period", month("__indexed"))
    )
    relations = {
        "documents": Relation("documents", docs, "doc_id", "__period"),
        "rag_documents": Relation("rag_documents", index, "source", "__period"),
        "rag_chunks": Relation("rag_chunks", chunks, "id", "__period"),
    }
    edges = [
        Edge("rag_chunks", "document_id", "documents", "doc_id", born="upload_date", until="__indexed"),
        Edge("rag_documents", "source", "documents", "filename", born="upload_date", until="indexed_at"),
        Edge("documents", "filename", "rag_documents", "source"),
        Edge("rag_chunks", "source", "rag_documents", "source", check=False),
    ]
    return relations, edges


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans with their level."""
    return orphan_cascade(*library_graph(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The cascade's direct orphans: every reference without its target at the time."""
    return p4_cascade(spark, d).where(F.col("kind") == "direct").select("table_name", "row_key", "period")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month."""
    return orphan_report(p4_cascade(spark, d))


def p6_series(spark: SparkSession, d: str) -> DataFrame:
    """Hits per page name and cached questions per model, with 7 and 30 day totals and averages."""
    hits = load(spark, d, "usage_page_hits", "id", "name", "day", "at")
    asked = load(spark, d, "usage_questions", "id", "model", "cached", "day", "at").where(F.col("cached") == 1)
    day = F.coalesce(F.col("day"), F.to_date("at"))
    squeezed = F.lower(F.regexp_replace("name", r"(?U)^\s+|\s+$", ""))
    parts = [
        trailing_totals(daily_counts(rows, entity, day), FIRST_DAY, LAST_DAY).select(F.lit(series).alias("series"), "*")
        for series, rows, entity in (("page_hits", hits, squeezed), ("cached_questions", asked, F.col("model")))
    ]
    return reduce(DataFrame.unionAll, parts)


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    """The whole dense series."""
    out = p6_series(spark, d)
    return out.select("series", "entity", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "total_7", F.round("avg_7", 6).alias("avg_7"), "total_30", F.round("avg_30", 6).alias("avg_30"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Days silent over a week but not over thirty days."""
    out = p6_series(spark, d).where((F.col("total_7") == 0) & (F.col("total_30") != 0))
    return out.select("series", "entity", F.date_format("day", "yyyy-MM-dd").alias("day"))


QUERIES = {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_cascade": p4_cascade,
    "p4_report": p4_report,
    "p6_found": p6_found,
    "p6_totals": p6_totals,
}

_P4_DIRECT = """
WITH t AS (SELECT source, max(indexed_at) AS indexed_at FROM rag_documents GROUP BY source)
SELECT 'rag_chunks' AS table_name, CAST(c.id AS VARCHAR) AS row_key, coalesce(strftime(t.indexed_at, '%Y-%m'), 'unknown') AS period
FROM rag_chunks c LEFT JOIN t ON t.source = c.source LEFT JOIN documents d ON d.doc_id = c.document_id
WHERE c.document_id IS NOT NULL AND (d.doc_id IS NULL OR d.upload_date > t.indexed_at)
UNION ALL
SELECT 'rag_documents', r.source, coalesce(strftime(r.indexed_at, '%Y-%m'), 'unknown')
FROM rag_documents r LEFT JOIN documents d ON d.filename = r.source
WHERE d.doc_id IS NULL OR d.upload_date > r.indexed_at
UNION ALL
SELECT 'documents', CAST(d.doc_id AS VARCHAR), coalesce(strftime(d.upload_date, '%Y-%m'), 'unknown')
FROM documents d LEFT JOIN rag_documents r ON d.filename = r.source WHERE d.filename IS NOT NULL AND r.source IS NULL
"""

_P4_CASCADE = f"""
WITH RECURSIVE direct AS (SELECT DISTINCT * FROM ({_P4_DIRECT})),
months AS (SELECT source, coalesce(strftime(max(indexed_at), '%Y-%m'), 'unknown') AS period FROM rag_documents GROUP BY source),
links AS (
  SELECT 'rag_chunks' AS child, CAST(c.id AS VARCHAR) AS child_key, coalesce(m.period, 'unknown') AS period, 'documents' AS parent, CAST(d.doc_id AS VARCHAR) AS parent_key
  FROM rag_chunks c JOIN documents d ON d.doc_id = c.document_id LEFT JOIN months m ON m.source = c.source
  UNION ALL SELECT 'rag_chunks', CAST(c.id AS VARCHAR), m.period, 'rag_documents', c.source FROM rag_chunks c JOIN months m ON m.source = c.source
  UNION ALL SELECT 'rag_documents', r.source, coalesce(strftime(r.indexed_at, '%Y-%m'), 'unknown'), 'documents', CAST(d.doc_id AS VARCHAR) FROM rag_documents r JOIN documents d ON d.filename = r.source
  UNION ALL SELECT 'documents', CAST(d.doc_id AS VARCHAR), coalesce(strftime(d.upload_date, '%Y-%m'), 'unknown'), 'rag_documents', r.source FROM documents d JOIN rag_documents r ON d.filename = r.source
),
reached AS (
  SELECT table_name, row_key, period, 0 AS level FROM direct
  UNION SELECT l.child, l.child_key, l.period, r.level + 1 FROM reached r JOIN links l ON l.parent = r.table_name AND l.parent_key = r.row_key WHERE r.level < 8
),
least AS (SELECT table_name, row_key, min(period) AS period, min(level) AS level FROM reached GROUP BY 1, 2)
"""

_P6 = """
WITH raw AS (
  SELECT 'page_hits' AS series, id, lower(trim(name)) AS entity, coalesce(day, CAST("at" AS DATE)) AS day FROM usage_page_hits
  UNION ALL
  SELECT 'cached_questions', id, model, coalesce(day, CAST("at" AS DATE)) FROM usage_questions WHERE cached = 1
), once AS (SELECT DISTINCT series, id, entity, day FROM raw WHERE trim(entity) <> '' AND day BETWEEN DATE '2024-01-01' AND DATE '2024-12-31'),
daily AS (SELECT series, entity, day, count(*) AS n FROM once GROUP BY ALL),
spine AS (SELECT series, entity, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT series, entity FROM daily)),
dense AS (SELECT s.series, s.entity, s.day, coalesce(d.n, 0) AS n FROM spine s LEFT JOIN daily d USING (series, entity, day)),
rolled AS (SELECT *, sum(n) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS t7, sum(n) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS t30
  FROM dense WINDOW w AS (PARTITION BY series, entity ORDER BY day))
"""

SQL = {
    "p4_found": _P4_DIRECT,
    "p4_cascade": _P4_CASCADE + "SELECT table_name, row_key, period, CASE WHEN level = 0 THEN 'direct' ELSE 'inherited' END AS kind, CAST(level AS INTEGER) AS level FROM least",
    "p4_report": _P4_CASCADE
    + "SELECT table_name, period, CAST(count(*) FILTER (WHERE level = 0) AS BIGINT) AS direct, CAST(count(*) FILTER (WHERE level > 0) AS BIGINT) AS inherited FROM least GROUP BY 1, 2",
    "p6_found": _P6 + "SELECT series, entity, strftime(day, '%Y-%m-%d') AS day FROM rolled WHERE t7 = 0 AND t30 <> 0",
    "p6_totals": _P6
    + "SELECT series, entity, strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n, CAST(t7 AS BIGINT) AS total_7, round(t7 / CAST(7 AS DOUBLE), 6) AS avg_7, CAST(t30 AS BIGINT) AS total_30, round(t30 / CAST(30 AS DOUBLE), 6) AS avg_30 FROM rolled",
}
