"""Back-fills, validation, edits, page lists and fall-back answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.operators import records
from signalbox.tables import load

PREFIXES = {"swi": "Work instruction", "MAN": "Manual", "Aud": "Audit"}


def backfill_types(spark: SparkSession, d: str) -> DataFrame:
    """Empty document types filled in from the number's prefix."""
    docs = load(spark, d, "documents", "doc_id", "document_number", "document_type")
    empty = docs.withColumn("document_type", F.when(F.trim("document_type") == "", "").otherwise(F.col("document_type")))
    return records.backfill_by_prefix(empty, "document_type", "document_number", PREFIXES).select("doc_id", "document_type")


def history_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """The passages of a file as a conversation: the turns that are kept."""
    c = load(spark, d, "rag_chunks", "id", "source", "chunk_index", "page", "content").where("chunk_index < 10")
    turn = F.struct("page", "chunk_index", "id", F.when(F.col("id") % 5 == 0, "  ").otherwise(F.col("content")).alias("question"), F.col("content").alias("answer"))
    turns = c.groupBy("source").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    kept = turns.select("source", records.clean_history(F.transform("t", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer")))).alias("h"))
    return kept.select("source", F.size("h").alias("turns"), F.aggregate("h", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["question"]) * 3 + F.length(x["answer"])).alias("chars"))


def valid_questions(spark: SparkSession, d: str) -> DataFrame:
    """Which questions may be asked."""
    q = load(spark, d, "usage_questions", "id", "question").distinct()
    return q.select("id", records.valid_question(F.col("question")).alias("valid"))


def _edits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rules = load(spark, d, "rulebooks_rules", "id", "book", "chapter", "number", "title", "body")
    old = rules.where("id % 7 = 0").select("book", "chapter", "number", F.lit("old").alias("title"), F.lit("old").alias("body"), F.lit("first").alias("orig_title"), F.lit("first").alias("orig_body"))
    new = rules.where("id % 3 = 0").select("book", F.when(F.col("id") % 2 == 0, F.col("chapter")).otherwise(F.col("chapter") + 50).alias("chapter"), "number", F.lit("new").alias("title"), "body")
    return rules, old, new.where(records.valid_edit(F.col("chapter"), F.col("number"), F.col("title"), F.col("body"), 99).isNull())


def edits_set(spark: SparkSession, d: str) -> DataFrame:
    """The edits after new ones: the originals of first edits are kept."""
    key = ["book", "chapter", "number"]
    return records.set_edits(*_edits(spark, d), key, ["title", "body"])[1].select(*key, "title", "orig_title", F.length("orig_body").alias("orig_chars"))


def edited_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules after new edits, those that were in no book added."""
    key = ["book", "chapter", "number"]
    return records.set_edits(*_edits(spark, d), key, ["title", "body"])[0].select(*key, "title", F.length("body").alias("chars"))


def edits_with_rules(spark: SparkSession, d: str) -> DataFrame:
    """Edits with the number of rules they belong to."""
    rules, _, new = _edits(spark, d)
    key = ["book", "chapter", "number"]
    return records.edits_with_rules(new.select(*key), rules, key)


def pages_concat(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the text layer beside read ones, not merged: rows and characters of each page."""
    c = load(spark, d, "rag_chunks", "source", "page", "content").where("page IS NOT NULL")
    both = records.concat_pages(c.where("page % 2 = 0"), c.where("page % 3 = 0"))
    return both.groupBy("source", "page").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def fallback_answers(spark: SparkSession, d: str) -> DataFrame:
    """What each document would be named as where no answer could be composed."""
    docs = load(spark, d, "documents", "doc_id", "document_number", "caption")
    one = F.struct(F.col("document_number").alias("number"), F.col("caption").alias("title"), (F.col("doc_id") % 3).cast("int").alias("page"))
    return docs.select("doc_id", records.fallback_answer(F.array(one)).alias("answer"))


QUERIES = {f.__name__: f for f in (backfill_types, history_sanitised, valid_questions, edits_set, edited_rules, edits_with_rules, pages_concat, fallback_answers)}

_NEW = "new AS (SELECT book, CASE WHEN id % 2 = 0 THEN chapter ELSE chapter + 50 END AS chapter, number, 'new' AS title, body FROM rulebooks_rules WHERE id % 3 = 0), ok AS (SELECT * FROM new WHERE chapter BETWEEN 1 AND 99 AND regexp_full_match(trim(number), '[0-9]{1,2}\\.[0-9]{1,2}') AND trim(coalesce(body, '')) <> '')"
_SPACE = r"[\s\x{000b}\x{0085}\p{Z}]+"
SQL = {
    "backfill_types": "SELECT doc_id, CASE WHEN trim(document_type) <> '' OR document_type IS NULL THEN document_type WHEN lower(document_number) LIKE 'swi%' THEN 'Work instruction' WHEN lower(document_number) LIKE 'man%' THEN 'Manual' WHEN lower(document_number) LIKE 'aud%' THEN 'Audit' ELSE '' END AS document_type FROM documents",
    "history_sanitised": rf"""WITH t AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY page DESC NULLS LAST, chunk_index DESC, id DESC) AS back,
  left(regexp_replace(CASE WHEN id % 5 = 0 THEN '  ' ELSE coalesce(content, '') END, '^{_SPACE}|{_SPACE}$', '', 'g'), 1000) AS q, left(regexp_replace(coalesce(content, ''), '^{_SPACE}|{_SPACE}$', '', 'g'), 4000) AS a FROM rag_chunks WHERE chunk_index < 10)
SELECT source, CAST(count(*) FILTER (WHERE back <= 6 AND q <> '') AS INTEGER) AS turns, CAST(coalesce(sum(length(q) * 3 + length(a)) FILTER (WHERE back <= 6 AND q <> ''), 0) AS BIGINT) AS chars FROM t GROUP BY source""",
    "valid_questions": rf"SELECT DISTINCT id, question IS NOT NULL AND length(regexp_replace(question, '^{_SPACE}|{_SPACE}$', '', 'g')) BETWEEN 1 AND 1000 AS valid FROM (SELECT DISTINCT id, question FROM usage_questions)",
    "edits_set": f"""WITH {_NEW}, old AS (SELECT book, chapter, number FROM rulebooks_rules WHERE id % 7 = 0)
SELECT n.book, n.chapter, n.number, n.title, CASE WHEN o.book IS NOT NULL THEN 'first' ELSE r.title END AS orig_title, CASE WHEN o.book IS NOT NULL THEN 5 ELSE CAST(length(r.body) AS INTEGER) END AS orig_chars
  FROM ok n LEFT JOIN old o USING (book, chapter, number) LEFT JOIN rulebooks_rules r USING (book, chapter, number)
UNION ALL SELECT book, chapter, number, 'old', 'first', 5 FROM old o WHERE NOT EXISTS (SELECT 1 FROM ok n WHERE n.book = o.book AND n.chapter = o.chapter AND n.number = o.number)""",
    "edited_rules": f"""WITH {_NEW} SELECT book, chapter, number, title, CAST(length(body) AS INTEGER) AS chars FROM ok
UNION ALL SELECT book, chapter, number, title, CAST(length(body) AS INTEGER) FROM rulebooks_rules r WHERE NOT EXISTS (SELECT 1 FROM ok n WHERE n.book = r.book AND n.chapter = r.chapter AND n.number = r.number)""",
    "edits_with_rules": f"WITH {_NEW} SELECT n.book, n.chapter, n.number, (SELECT count(*) FROM rulebooks_rules r WHERE r.book = n.book AND r.chapter = n.chapter AND r.number = n.number) AS rule_exists FROM ok n",
    "pages_concat": "SELECT source, page, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM (SELECT * FROM rag_chunks WHERE page % 2 = 0 UNION ALL SELECT * FROM rag_chunks WHERE page % 3 = 0) GROUP BY source, page",
    "fallback_answers": "SELECT doc_id, 'No clean answer could be composed just now.' || CASE WHEN l = '' THEN ' Please ask in more words.' ELSE ' Perhaps in these documents: ' || l || CASE WHEN doc_id % 3 <> 0 THEN ', page ' || (doc_id % 3) ELSE '' END || '.' END AS answer FROM (SELECT doc_id, CASE WHEN coalesce(document_number, '') <> '' THEN document_number ELSE coalesce(caption, '') END AS l FROM documents)",
}
