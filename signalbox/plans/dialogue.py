"""Questions in conversation: a model's questions in order stand for one conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalbox.functions import text as T
from signalbox.operators import qa
from signalbox.tables import load

SETTINGS = ("v3", "local", "chat", "embed", 4, 4000, 0.3, 0.55, 3, 0.5, 0.5, 0.6, 0.2, 400)
CONTEXT_CHARS = 4000


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Questions by model and month, in order of id: a long log is many conversations."""
    q = load(spark, d, "usage_questions", "id", "question", "model", "at").distinct()
    return q.select("id", "question", F.concat_ws("/", "model", F.date_format("at", "yyyy-MM")).alias("conv"))


def followup_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Questions made independent of the one before."""
    return qa.follow_ups(_turns(spark, d), "conv", ["id"], "question").select("id", "standalone")


def history_block(spark: SparkSession, d: str) -> DataFrame:
    """The history before each question; the model's name stands for the answer."""
    turns = _turns(spark, d)
    return qa.history_blocks(turns, "conv", ["id"], "question", F.col("conv"), most=2, chars=1200).select("id", "history")


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The passages of each source that fit into a context, in order."""
    c = load(spark, d, "rag_chunks", "id", "source", "page", "chunk_index", "content")
    block = F.concat(qa.heading(F.col("rank"), F.lit(""), F.col("source"), F.col("source"), F.lit(""), F.col("page")), F.lit("\n"), F.col("content"))
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("page", "chunk_index", "id")))
    return qa.pack(ranked, "source", ["rank"], block, CONTEXT_CHARS).select("id", "source", "rank", "used")


def answer_cache_key(spark: SparkSession, d: str) -> DataFrame:
    """The cache key of every question."""
    q = load(spark, d, "usage_questions", "id", "question").distinct()
    return q.select("id", T.cache_key(SETTINGS, F.col("question"), F.col("question")).alias("key"))


def bare_term_task(spark: SparkSession, d: str) -> DataFrame:
    """Keywords and captions that are bare terms."""
    docs = load(spark, d, "documents", "doc_id", "caption")
    return docs.where(T.is_bare_term(F.col("caption"))).select("doc_id")


def strip_thinking(spark: SparkSession, d: str) -> DataFrame:
    """Passages as answers, with their page's reasoning before them in one of four forms."""
    c = load(spark, d, "rag_chunks", "id", "page", "content")
    forms = [F.concat(F.lit("<think>plan</think>"), F.col("content")), F.concat(F.lit("plan</think>"), F.col("content")), F.concat(F.col("content"), F.lit("<think>cut")), F.concat(F.lit("Let me see. "), F.col("content"))]
    form = F.element_at(F.array(*forms), (F.col("page") % 4 + 1).cast("int"))
    return c.select("id", T.strip_thinking(form).alias("answer"))


def clean_answer(spark: SparkSession, d: str) -> DataFrame:
    """Passages as answers with markers, cleaned with the labels of their source."""
    c = load(spark, d, "rag_chunks", "id", "source", "content")
    return c.select("id", T.clean_answer(F.concat(F.lit("As [1] and [7] say , "), F.col("content"), F.lit(" [1][2]")), F.array("source")).alias("answer"))


def cacheable_gate(spark: SparkSession, d: str) -> DataFrame:
    """Passages that could be kept as answers."""
    c = load(spark, d, "rag_chunks", "id", "content")
    return c.where(T.is_cacheable(F.col("content"), F.lit(False))).select("id")


def token_replay(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every passage as an answer is replayed."""
    c = load(spark, d, "rag_chunks", "id", "content")
    return c.select("id", F.posexplode(T.answer_tokens(F.col("content"))).alias("seq", "token"))


def keywords_distinct_join(spark: SparkSession, d: str) -> DataFrame:
    """The distinct keywords of each office's documents, in order of document."""
    docs = load(spark, d, "documents", "doc_id", "source", "keywords").where("keywords <> '' AND source IS NOT NULL")
    ordered = docs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "keywords"))).alias("k"))
    return ordered.select("source", qa.distinct_keywords(F.col("k.keywords")).alias("keywords"))


_FUNCTIONS = (followup_rewrite, history_block, context_pack, answer_cache_key, bare_term_task, strip_thinking, clean_answer, cacheable_gate, token_replay, keywords_distinct_join)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_RE2 = lambda p: p.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("'", "''")
_TURNS = "SELECT id, question, concat_ws('/', model, strftime(\"at\", '%Y-%m')) AS conv FROM (SELECT DISTINCT id, question, model, \"at\" FROM usage_questions)"
_KEY = r"trim(regexp_replace(lower(coalesce(question, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"
_HEAD = f"regexp_replace(content, '{_RE2(T.FILLER)}', '')"
_CLEAN = "regexp_replace(v, '\\[\\d+\\](?:\\s*\\[\\d+\\])+', '', 'g')"

SQL = {
    "followup_rewrite": f"""WITH t AS ({_TURNS}), p AS (SELECT id, question, trim(coalesce(lag(question) OVER (PARTITION BY conv ORDER BY id), ''), ' ') AS prior FROM t)
        SELECT id, CASE WHEN prior <> '' AND prior <> question AND (regexp_matches(question, '{_RE2(T.FOLLOW_UP)}') OR (regexp_matches(question, '{_RE2(T.BACK_REFERENCE)}') AND length(question) < {T.FOLLOW_UP_CHARS}))
          THEN prior || ' — ' || question ELSE question END AS standalone FROM p""",
    "history_block": f"""WITH t AS ({_TURNS}), q AS (SELECT id, conv, trim(substring(coalesce(question, ''), 1, 500), ' ') AS q FROM t),
        l AS (SELECT id, conv, CASE WHEN q <> '' THEN 'Q: ' || q || chr(10) || 'A: ' || CASE WHEN trim(substring(conv, 1, 800), ' ') <> '' THEN trim(substring(conv, 1, 800), ' ') ELSE '(no answer)' END END AS line FROM q),
        a AS (SELECT id, conv, last_value(line IGNORE NULLS) OVER (PARTITION BY conv ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l0, count(line) OVER (PARTITION BY conv ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM l),
        k AS (SELECT conv, line, row_number() OVER (PARTITION BY conv ORDER BY id) AS k FROM l WHERE line IS NOT NULL)
        SELECT a.id, concat_ws(chr(10) || chr(10), CASE WHEN length(a.l0) + length(k.line) <= 1200 THEN k.line END, a.l0) AS history FROM a LEFT JOIN k ON k.conv = a.conv AND k.k = a.n - 1""",
    "context_pack": f"""WITH r AS (SELECT id, source, page, content, row_number() OVER (PARTITION BY source ORDER BY page, chunk_index, id) AS rank FROM rag_chunks),
        b AS (SELECT id, source, CAST(rank AS INT) AS rank, CAST(sum(length(concat_ws(' | ', 'Passage ' || rank || ',', 'File: ' || source, CASE WHEN coalesce(page, 0) <> 0 THEN 'Page: ' || page END) || chr(10) || content)) OVER (PARTITION BY source ORDER BY rank) AS BIGINT) AS used FROM r)
        SELECT id, source, rank, used FROM b WHERE used <= {CONTEXT_CHARS}""",
    "answer_cache_key": f"SELECT id, sha256('{'|'.join(str(s) for s in SETTINGS)}' || chr(10) || {_KEY} || chr(10) || {_KEY}) AS key FROM (SELECT DISTINCT id, question FROM usage_questions)",
    "bare_term_task": rf"""SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(trim(coalesce(caption, ''), ' '), '\s+'), lambda w: w <> '')) BETWEEN 1 AND 3 AND NOT contains(coalesce(caption, ''), '?')
        AND NOT regexp_matches(trim(coalesce(caption, ''), ' '), '{_RE2(T.QUESTION_WORDS)}')""",
    "strip_thinking": rf"""SELECT id, regexp_replace(CASE page % 4 WHEN 3 THEN '' ELSE content END, '^\s+|\s+$', '', 'g') AS answer FROM rag_chunks""",
    "cacheable_gate": f"""SELECT id FROM (SELECT id, content, {_HEAD} AS head FROM rag_chunks WHERE trim(content, ' ') <> '')
        WHERE NOT regexp_matches(head, '{_RE2(T.REASONING)}') AND NOT ({" OR ".join(f"starts_with(regexp_replace(lower(head), '[^a-z0-9]+', '', 'g'), '{p}')" for p in T.REASONING_GLUED)})""",
    "token_replay": r"SELECT id, CAST(i - 1 AS INT) AS seq, t[i] AS token FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT id, regexp_extract_all(content, '([^\s\x{000b}]+[\s\x{000b}]*)', 1) AS t FROM rag_chunks))",
    "keywords_distinct_join": """WITH p AS (SELECT source, doc_id, i, trim(k[i], ' ') AS k FROM (SELECT source, doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM (SELECT source, doc_id, string_split(keywords, ',') AS k FROM documents WHERE keywords <> '' AND source IS NOT NULL))),
        f AS (SELECT source, k, min(doc_id * 100000 + i) AS place FROM p WHERE k <> '' GROUP BY source, k)
        SELECT source, string_agg(k, ', ' ORDER BY place) AS keywords FROM f GROUP BY source""",
}
