"""The catalogue, the index and its maintenance, rule books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions.text import natural_key
from signalbox.operators import catalog, fuzzy, merge, rulebooks
from signalbox.tables import load

FIELDS = ["document_number", "caption", "original_name"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").drop("text")


def _types(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "document_types")


def access_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose type, as written, needs no login."""
    return catalog.with_access(_docs(spark, d), _types(spark, d)).where(~F.col("restricted")).select("doc_id", "document_type")


def access_filter_nocase(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose type needs no login, whatever its case."""
    return catalog.with_access(_docs(spark, d), _types(spark, d), ignore_case=True).where(~F.col("restricted")).select("doc_id", "document_type")


def type_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a type that is named in another case."""
    return catalog.of_type(_docs(spark, d), _types(spark, d), "TECHNICAL NOTES").select("doc_id")


def unknown_type(spark: SparkSession, d: str) -> DataFrame:
    """An unknown type filters nothing."""
    return catalog.of_type(_docs(spark, d), _types(spark, d), "no such type").select("doc_id")


def browse_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain every word of a query in number, caption or name."""
    return catalog.containing(_docs(spark, d), "brake valve", FIELDS).select("doc_id")


def browse_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of all documents, newest first."""
    p = catalog.page(_docs(spark, d), [F.desc_nulls_last("upload_date"), F.desc("doc_id")], 2, 60)
    return p.select("place", "doc_id", "total", "pages")


def browse_natural_sort(spark: SparkSession, d: str) -> DataFrame:
    """The key by which document numbers sort with numbers by value."""
    return _docs(spark, d).select("doc_id", natural_key(F.col("document_number")).alias("sort_key"))


def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents found by a misspelt query."""
    return fuzzy.search(_docs(spark, d), "doc_id", [*FIELDS, "keywords"], "brkae valve", [F.desc_nulls_last("upload_date"), F.col("doc_id")]).select("doc_id", "exact")


def docs_per_type(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each type."""
    return _docs(spark, d).groupBy(F.lower(F.coalesce("document_type", F.lit(""))).alias("document_type")).agg(F.count("*").alias("n"))


def index_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the index."""
    r = load(spark, d, "rag_documents").agg(
        F.count_if((F.col("status") == "indexed") & (F.col("chunk_count") > 0)).alias("indexed"),
        F.count_if(F.col("status").isin("error", "no-text")).alias("failed"),
        F.count_if(F.col("status") == "restricted").alias("restricted"),
        F.count_if(F.col("ocr_pages") > 0).alias("read_from_images"),
    )
    return r.crossJoin(F.broadcast(load(spark, d, "rag_chunks", "id").agg(F.count("*").alias("chunks"))))  # one row each


def list_files_sort(spark: SparkSession, d: str) -> DataFrame:
    """Index records in the order of the file list, as places by a range-partitioned sort key."""
    r = load(spark, d, "rag_documents", "source", "status", "ocr_pages")
    return r.select("source", (F.col("status") != "indexed").alias("problem"), (F.col("ocr_pages") > 0).alias("images"), F.lower("source").alias("name")).orderBy("problem", F.desc("images"), "name")


def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    """Indexed records without a library row."""
    docs = _docs(spark, d).select(F.col("filename").alias("source"))
    return load(spark, d, "rag_documents", "source", "status").where("status = 'indexed'").join(docs, "source", "left_anti").select("source")


def index_actions(spark: SparkSession, d: str) -> DataFrame:
    """What an index pass does with every file and record, the library's rows being the files."""
    r = load(spark, d, "rag_documents")
    model = r.where("status = 'indexed'").groupBy("embedding_model").count().orderBy(F.desc("count"), "embedding_model").limit(1).select(F.col("embedding_model").alias("model"))
    files = _docs(spark, d).select(F.col("filename").alias("source"), F.col("file_size").alias("size"), F.expr("try_cast(split(filename, '-')[0] AS bigint)").alias("modified_ms"))
    return merge.index_actions(files.crossJoin(F.broadcast(model)), r)  # one model


def upsert_keep_final(spark: SparkSession, d: str) -> DataFrame:
    """The index with the library's current metadata put in; the final mark stays."""
    r = load(spark, d, "rag_documents").select("source", "title", "document_number", "keywords", F.coalesce("final", F.lit(0)).alias("final"))
    new = _docs(spark, d).select(F.col("filename").alias("source"), F.col("caption").alias("title"), "document_number", "keywords", F.lit(0).alias("final"))
    return merge.upsert(r, new, ["source"], keep=["final"])


def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Types with those that only documents name."""
    named = _docs(spark, d).where("trim(document_type) <> ''").select(F.col("document_type").alias("name")).distinct()
    return merge.insert_missing(_types(spark, d).select("name"), named, ["name"])


def type_rename_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Documents after a type was renamed."""
    return merge.rename(_docs(spark, d), "document_type", "Manuals", "Handbooks").select("doc_id", "document_type")


def prune_newest_n(spark: SparkSession, d: str) -> DataFrame:
    """The log cut to its newest 5,000 rows (a limit of the log)."""
    return merge.newest(load(spark, d, "usage_questions", "id", "model").distinct(), "id", 5000)


def last_version(spark: SparkSession, d: str) -> DataFrame:
    """The last passage stored for each place of a source."""
    c = load(spark, d, "rag_chunks", "id", "source", "page", "chunk_index")
    return merge.last_wins(c, ["source", "page", "chunk_index"], F.col("id"))


def missing_pages_anti(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every indexed file without a passage."""
    files = load(spark, d, "rag_documents", "source", "page_count")
    pages = load(spark, d, "rag_chunks", "source", "page").distinct()
    return merge.missing_pages(files, pages, "source", "page_count", "page")


def merge_layer_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of a page joined: each page's first and last passage stand for text layer and image."""
    c = load(spark, d, "rag_chunks", "id", "source", "page", "content")
    first = c.groupBy("source", "page").agg(F.min_by("content", "id").alias("text"))
    last = c.groupBy("source", "page").agg(F.max_by("content", "id").alias("text"), F.count("*").alias("n")).where("n > 1").drop("n")
    return merge.merge_pages(first, last, ["source", "page"], "text")


def edit_overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    """Rules with an overlay: every rule without text gets a note."""
    r = load(spark, d, "rulebooks_rules")
    edits = r.where("coalesce(trim(body), '') = ''").select("book", "chapter", "number", "title", F.lit("(no text)").alias("body"))
    return merge.overlay(r, edits, ["book", "chapter", "number"], ["title", "body"])


def rule_exists(spark: SparkSession, d: str) -> DataFrame:
    """For every number of a book whether other books have it."""
    r = load(spark, d, "rulebooks_rules", "book", "number")
    n = r.groupBy("number").agg(F.countDistinct("book").alias("books"))
    return r.join(n, "number").select("book", "number", (F.col("books") - 1).alias("others"))


def rulebook_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chapters and rules of every book."""
    return rulebooks.counts(load(spark, d, "rulebooks_rules"))


def page_outline_nested(spark: SparkSession, d: str) -> DataFrame:
    """Every chapter's rules in order."""
    o = rulebooks.outline(load(spark, d, "rulebooks_rules", "book", "chapter", "number", "title"))
    return o.select("book", "chapter", F.array_join(F.transform("rules", lambda x: F.concat_ws(" ", x["number"], x["title"])), "\n").alias("rules"))


def book_lines(spark: SparkSession, d: str) -> DataFrame:
    """The books as the lines they were parsed from: chapter marks, headings and bodies in order."""
    r = load(spark, d, "rulebooks_rules").withColumn("minor", F.get(F.split("number", r"\."), F.lit(1)).try_cast("int"))
    marks = r.select("book", "chapter").distinct().select("book", "chapter", F.lit(-1).alias("minor"), F.explode(F.array(F.struct(F.lit(0).alias("i"), F.concat(F.lit("CHAPTER "), F.col("chapter").cast("string")).alias("line")), F.struct(F.lit(1).alias("i"), F.concat(F.lit("Part "), F.col("chapter").cast("string")).alias("line")))).alias("x"))
    heads = r.select("book", "chapter", "minor", F.struct(F.lit(0).alias("i"), F.concat_ws(" ", "number", "title").alias("line")).alias("x"))
    bodies = r.where("body IS NOT NULL").select("book", "chapter", "minor", F.posexplode(F.split("body", "\n")).alias("i", "line")).select("book", "chapter", "minor", F.struct((F.col("i") + 1).alias("i"), "line").alias("x"))
    rows = marks.unionAll(heads).unionAll(bodies).select("book", "chapter", "minor", "x.i", "x.line")
    return rows.select("book", (F.col("chapter").cast("bigint") * 1_000_000_000 + (F.col("minor") + 1).cast("bigint") * 1_000_000 + F.col("i")).alias("pos"), "line")


def rulebook_parse(spark: SparkSession, d: str) -> DataFrame:
    """The books parsed back from their lines."""
    _, rules = rulebooks.parse(book_lines(spark, d))
    return rules.select("book", "chapter", "number", "title", F.length("body").alias("body_chars"))


_FUNCTIONS = (
    access_filter, access_filter_nocase, type_filter, unknown_type, browse_filter, browse_page, browse_natural_sort, catalog_search, docs_per_type, index_counts,
    list_files_sort, orphan_files, index_actions, upsert_keep_final, insert_or_ignore, type_rename_cascade, prune_newest_n, last_version, missing_pages_anti,
    merge_layer_ocr, edit_overlay_merge, rule_exists, rulebook_counts, page_outline_nested, rulebook_parse,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_TEXT = "trim(regexp_replace(lower(concat_ws(' ', document_number, caption, original_name)), '[^a-z0-9]+', ' ', 'g'))"

SQL = {
    "access_filter": "SELECT doc_id, document_type FROM documents d LEFT JOIN document_types t ON t.name = d.document_type WHERE coalesce(requires_login, 0) <> 1",
    "access_filter_nocase": "SELECT doc_id, document_type FROM documents d LEFT JOIN document_types t ON lower(t.name) = lower(d.document_type) WHERE coalesce(requires_login, 0) <> 1",
    "type_filter": "SELECT doc_id FROM documents WHERE document_type = 'Technical Notes'",
    "unknown_type": "SELECT doc_id FROM documents",
    "browse_filter": f"SELECT doc_id FROM documents WHERE contains({_TEXT}, 'brake') AND contains({_TEXT}, 'valve')",
    "browse_page": """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY upload_date DESC NULLS LAST, doc_id DESC) AS place, count(*) OVER () AS total FROM documents)
        SELECT CAST(place AS INT) AS place, doc_id, total, CAST(greatest(1, ceil(total / CAST(60 AS DOUBLE))) AS BIGINT) AS pages FROM p WHERE place BETWEEN 61 AND 120""",
    "browse_natural_sort": "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(coalesce(document_number, '')), '([0-9]+|[^0-9]+)', 1), lambda r: CASE WHEN regexp_matches(r, '^[0-9]+$') THEN lpad(r, 12, '0') ELSE r END), '') AS sort_key FROM documents",
    "docs_per_type": "SELECT lower(coalesce(document_type, '')) AS document_type, count(*) AS n FROM documents GROUP BY 1",
    "index_counts": """SELECT count(*) FILTER (status = 'indexed' AND chunk_count > 0) AS indexed, count(*) FILTER (status IN ('error', 'no-text')) AS failed,
        count(*) FILTER (status = 'restricted') AS restricted, count(*) FILTER (ocr_pages > 0) AS read_from_images, (SELECT count(*) FROM rag_chunks) AS chunks FROM rag_documents""",
    "list_files_sort": "SELECT source, status <> 'indexed' AS problem, ocr_pages > 0 AS images, lower(source) AS name FROM rag_documents ORDER BY 2, 3 DESC, 4",
    "orphan_files": "SELECT source FROM rag_documents r WHERE status = 'indexed' AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.filename = r.source)",
    "index_actions": """WITH m AS (SELECT embedding_model AS model FROM rag_documents WHERE status = 'indexed' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        f AS (SELECT filename AS source, file_size AS size, TRY_CAST(string_split(filename, '-')[1] AS BIGINT) AS ms, model FROM documents, m)
        SELECT coalesce(f.source, r.source) AS source, CASE WHEN f.source IS NULL AND coalesce(r.final, 0) = 1 THEN 'keep' WHEN f.source IS NULL THEN 'remove' WHEN r.source IS NOT NULL AND coalesce(r.final, 0) = 1 THEN 'final'
          WHEN r.status = 'indexed' AND f.size IS NOT DISTINCT FROM r.size AND f.ms IS NOT DISTINCT FROM r.modified_ms AND f.model IS NOT DISTINCT FROM r.embedding_model THEN 'unchanged' ELSE 'index' END AS action
        FROM f FULL JOIN rag_documents r ON r.source = f.source""",
    "upsert_keep_final": """SELECT coalesce(r.source, d.filename) AS source, CASE WHEN d.filename IS NOT NULL THEN d.caption ELSE r.title END AS title, CASE WHEN d.filename IS NOT NULL THEN d.document_number ELSE r.document_number END AS document_number,
        CASE WHEN d.filename IS NOT NULL THEN d.keywords ELSE r.keywords END AS keywords, CASE WHEN r.source IS NOT NULL THEN coalesce(r.final, 0) ELSE 0 END AS final FROM rag_documents r FULL JOIN documents d ON d.filename = r.source""",
    "insert_or_ignore": "SELECT name FROM document_types UNION SELECT document_type FROM documents WHERE trim(document_type) <> ''",
    "type_rename_cascade": "SELECT doc_id, CASE WHEN document_type = 'Manuals' THEN 'Handbooks' ELSE document_type END AS document_type FROM documents",
    "prune_newest_n": "SELECT DISTINCT id, model FROM usage_questions ORDER BY id DESC LIMIT 5000",
    "last_version": "SELECT max(id) AS id, source, page, chunk_index FROM rag_chunks GROUP BY source, page, chunk_index",
    "missing_pages_anti": """SELECT source, CAST(page AS INT) AS page FROM (SELECT source, unnest(range(1, page_count + 1)) AS page FROM rag_documents WHERE page_count > 0) f
        WHERE NOT EXISTS (SELECT 1 FROM rag_chunks c WHERE c.source = f.source AND c.page = f.page)""",
    "merge_layer_ocr": "SELECT source, page, CASE WHEN count(*) > 1 THEN concat_ws(chr(10), arg_min(content, id), arg_max(content, id)) ELSE arg_min(content, id) END AS text FROM rag_chunks GROUP BY source, page",
    "edit_overlay_merge": """SELECT book, chapter, number, title, CASE WHEN coalesce(trim(body, ' '), '') = '' THEN '(no text)' ELSE body END AS body, coalesce(trim(body, ' '), '') = '' AS edited FROM rulebooks_rules""",
    "rule_exists": "SELECT r.book, r.number, n.books - 1 AS others FROM rulebooks_rules r JOIN (SELECT number, count(DISTINCT book) AS books FROM rulebooks_rules GROUP BY number) n ON n.number = r.number",
    "rulebook_counts": "SELECT book, count(DISTINCT chapter) AS chapters, count(*) AS rules FROM rulebooks_rules GROUP BY book",
    "page_outline_nested": """SELECT book, chapter, string_agg(number || ' ' || title, chr(10) ORDER BY TRY_CAST(string_split(number, '.')[1] AS INT), TRY_CAST(string_split(number, '.')[2] AS INT), number, title) AS rules FROM rulebooks_rules GROUP BY book, chapter""",
}
