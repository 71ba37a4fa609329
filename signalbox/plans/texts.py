"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions import text as T
from signalbox.operators.chunking import CHUNK_CHARS, build_chunks
from signalbox.tables import load


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Extracted text made uniform."""
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", T.normalize_extracted(F.col("text")).alias("text"))


def collapse_text(spark: SparkSession, d: str) -> DataFrame:
    """White space collapsed."""
    return load(spark, d, "rag_chunks", "id", "content").select("id", T.collapse(F.col("content")).alias("content"))


def readable_gate(spark: SparkSession, d: str) -> DataFrame:
    """Passages with their share of readable words and the gate's verdict."""
    c = load(spark, d, "rag_chunks", "id", "content")
    return c.select("id", F.round(T.readable_share(F.col("content")), 6).alias("share"), T.is_readable(F.col("content")).alias("readable"))


def stamp_only_filter(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are no more than a stamp."""
    return load(spark, d, "documents", "doc_id", "text").where(T.is_stamp_only(F.col("text"))).select("doc_id")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Runs up to end marks, as chunking takes them."""
    docs = load(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(T.sentences(T.collapse(F.col("text")))).alias("pos", "sentence"))


def hard_split(spark: SparkSession, d: str) -> DataFrame:
    """Slices of the chunk size."""
    docs = load(spark, d, "documents", "doc_id", "text").where("text <> ''")
    return docs.select("doc_id", F.posexplode(T.hard_split(F.col("text"), CHUNK_CHARS)).alias("pos", "piece"))


def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """The search terms of every question and the keyword query made of them."""
    q = load(spark, d, "usage_questions", "id", "question").distinct()
    return q.select("id", F.array_join(T.terms(F.col("question")), " ").alias("terms"), T.or_query(F.col("question")).alias("query"))


def question_key(spark: SparkSession, d: str) -> DataFrame:
    """Questions by the key that wording does not change."""
    q = load(spark, d, "usage_questions", "question")
    return q.groupBy(T.question_key(F.col("question")).alias("key")).agg(F.count("*").alias("n"))


def is_upperish(spark: SparkSession, d: str) -> DataFrame:
    """Rule titles and whether they are capitals."""
    r = load(spark, d, "rulebooks_rules", "id", "title")
    return r.select("id", T.is_upperish(F.col("title")).alias("upper"), T.plain_quotes(F.col("title")).alias("title"))


def metadata_lines(spark: SparkSession, d: str) -> DataFrame:
    """The metadata lines and the searchable metadata text of every document."""
    docs = load(spark, d, "documents", "doc_id", "document_number", "caption", "keywords")
    args = [F.col(c) for c in ("document_number", "caption", "keywords")]
    return docs.select("doc_id", F.array_join(T.metadata_lines(*args), "\n").alias("lines"), T.metadata_text(*args).alias("meta"))


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text as one page, cut into readable overlapping chunks."""
    docs = load(spark, d, "documents", "doc_id", "text").withColumn("page", F.lit(1))
    return build_chunks(docs, "doc_id", "page", "text").select(F.col("source").alias("doc_id"), "chunk_index", "content")


QUERIES = {f.__name__: f for f in (normalize_text, collapse_text, readable_gate, stamp_only_filter, sentence_split, hard_split, search_terms, question_key, is_upperish, metadata_lines, chunk_pages)}

_SPACE = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE}', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def terms_sql(x: str, limit: int | None = T.MAX_TERMS) -> str:
    """The list of search terms of a text."""
    l = f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND (regexp_matches(t, '[0-9]') OR t NOT IN ({_STOP})))"  # noqa: E741
    once = f"(SELECT list_filter(all_terms, lambda t, i: list_position(all_terms, t) = i) FROM (SELECT {l} AS all_terms))"
    return once if limit is None else f"({once})[1:{limit}]"


_TITLE = _collapse("translate(title, '‘’“”', '''''\"\"')")
_WORDS = r"list_filter(string_split_regex(lower(coalesce(content, '')), '[\s\x{000b}]+'), lambda w: w <> '')"
_READ = rf"""WITH w AS (SELECT id, {_WORDS} AS w FROM rag_chunks), l AS (SELECT id, w, list_filter(w, lambda x: length(x) >= 2) AS l FROM w),
s AS (SELECT id, w, CASE WHEN len(l) > 0 THEN CAST(len(list_filter(l, lambda x: length(regexp_replace(x, '[^a-z0-9\x{{0900}}-\x{{097f}}\x{{0600}}-\x{{06ff}}]', '', 'g')) * 10 >= length(x) * 6)) AS DOUBLE) / len(l) ELSE CAST(0 AS DOUBLE) END AS share FROM l)
SELECT id, round(share, 6) AS share, CASE WHEN len(w) = 0 THEN false ELSE share >= CAST(0.6 AS DOUBLE) AND CAST(length(array_to_string(w, '')) AS DOUBLE) / len(w) >= 3 END AS readable FROM s"""


def _line(label: str, column: str) -> str:
    return f"CASE WHEN coalesce({column}, '') <> '' THEN '{label}: ' || {column} END"


_LINES = f"list_filter([{_line('Document number', 'document_number')}, {_line('Title', 'caption')}, {_line('Keywords', 'keywords')}], lambda x: x IS NOT NULL)"
_STAMPED = r"trim(coalesce(text, ''))"
for _p in T.STAMPS:
    _RE2 = _p.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")
    _STAMPED = f"regexp_replace({_STAMPED}, '{_RE2}', ' ', 'g')"
_STAMPED = rf"trim(regexp_replace({_STAMPED}, '[\s\x{{000b}}\-–—_=*~]+', ' ', 'g'))"

SQL = {
    "normalize_text": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t\x{00a0}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text FROM documents""",
    "collapse_text": f"SELECT id, {_collapse('content')} AS content FROM rag_chunks",
    "readable_gate": _READ,
    "stamp_only_filter": rf"""WITH s AS (SELECT doc_id, {_STAMPED} AS left_over, trim(coalesce(text, '')) AS value FROM documents),
        r AS (SELECT doc_id, left_over, value, {_WORDS.replace("content", "left_over")} AS w FROM s), l AS (SELECT *, list_filter(w, lambda x: length(x) >= 2) AS l FROM r)
        SELECT doc_id FROM l WHERE length(left_over) < 8 OR (length(value) <= 60 AND NOT (len(w) > 0 AND len(l) > 0
          AND CAST(len(list_filter(l, lambda x: length(regexp_replace(x, '[^a-z0-9\x{{0900}}-\x{{097f}}\x{{0600}}-\x{{06ff}}]', '', 'g')) * 10 >= length(x) * 6)) AS DOUBLE) / len(l) >= CAST(0.6 AS DOUBLE)
          AND CAST(length(array_to_string(w, '')) AS DOUBLE) / len(w) >= 3))""",
    "sentence_split": rf"""WITH c AS (SELECT doc_id, {_collapse('text')} AS t FROM documents),
        m AS (SELECT doc_id, t, regexp_extract_all(t, '([^.!?\n]+[.!?]*[\s\x{{000b}}]*)', 1) AS m FROM c),
        s AS (SELECT doc_id, list_filter(list_transform(CASE WHEN len(m) > 0 THEN m ELSE [t] END, lambda x: trim(x)), lambda x: x <> '') AS s FROM m)
        SELECT doc_id, CAST(i - 1 AS INT) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""",
    "hard_split": f"""SELECT doc_id, CAST(i AS INT) AS pos, substring(text, CAST(i * {CHUNK_CHARS} + 1 AS BIGINT), {CHUNK_CHARS}) AS piece
        FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / CAST({CHUNK_CHARS} AS DOUBLE)) AS BIGINT))) AS i FROM documents WHERE text <> '')""",
    "search_terms": f"""WITH q AS (SELECT DISTINCT id, question FROM usage_questions), t AS (SELECT id, {terms_sql('question')} AS t FROM q)
        SELECT id, array_to_string(t, ' ') AS terms, array_to_string(list_transform(t, lambda x: '"' || x || '"'), ' OR ') AS query FROM t""",
    "question_key": r"SELECT trim(regexp_replace(lower(coalesce(question, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, count(*) AS n FROM usage_questions GROUP BY 1",
    "is_upperish": f"""SELECT id, regexp_replace(coalesce(title, ''), '[^A-Za-z]', '', 'g') <> '' AND regexp_replace(coalesce(title, ''), '[^A-Za-z]', '', 'g') = upper(regexp_replace(coalesce(title, ''), '[^A-Za-z]', '', 'g')) AS upper,
        {_TITLE} AS title FROM rulebooks_rules""",
    "metadata_lines": f"""WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents), x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l),
        t AS (SELECT doc_id, i, {terms_sql('l[i]')} AS t FROM x), m AS (SELECT doc_id, string_agg(array_to_string(t, ' '), chr(10) ORDER BY i) AS meta FROM t WHERE len(t) > 0 GROUP BY doc_id)
        SELECT l.doc_id, array_to_string(l.l, chr(10)) AS lines, coalesce(m.meta, '') AS meta FROM l LEFT JOIN m ON m.doc_id = l.doc_id""",
}
