"""The pN_ queries of the language-model problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm import byte_bpe, collapse, leakage, quality, scan_noise, sentences, vectors
from signalbox.tables import load


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    chunks = load(spark, d, "rag_chunks", "id", "source", "page", "chunk_index", "content")
    rules = load(spark, d, "rulebooks_rules", "id", "book", "body")
    return scan_noise.passages(chunks, "rag_chunks", "id", "source", "content", ["page", "chunk_index", "content"]).unionAll(
        scan_noise.passages(rules, "rulebooks_rules", "id", "book", "body", ["id"])
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of scan noise in passages and rules of prose."""
    return scan_noise.find_noise(_scanned(spark, d), quality.common_by_language(load(spark, d, "common_words")))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Passages and rules of prose as continuous paragraphs."""
    return scan_noise.repair(_scanned(spark, d), quality.common_by_language(load(spark, d, "common_words")))


def p2_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and verdict of every indexed file."""
    common = quality.common_by_language(load(spark, d, "common_words"))
    out = quality.document_quality(load(spark, d, "rag_chunks", "source", "content"), "source", "content", common)
    return out.withColumnRenamed("document", "source")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that are mostly not natural prose."""
    return p2_stats(spark, d).where("NOT prose").select("source")


def _embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, d, "rag_chunks", "id", "embedding", "embedding_model", "dimensions")
    return vectors.prepare(rows, "id", "embedding", "dimensions", ["embedding_model"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passages in each other's lists of twenty with a cosine of at least 0.95."""
    reps, members = _embeddings(spark, d)
    return vectors.similar_pairs(reps, members, 20, 0.95)


def p5_lists(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most similar rows of every row whose id is divisible by 50, against all rows."""
    reps, members = _embeddings(spark, d)
    asked = load(spark, d, "rag_chunks", "id").where(F.col("id") % 50 == 0)
    return vectors.similar_rows(reps, members, asked, 20).select("id", "other", "rank", F.round("cosine", 6).alias("cosine"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct question with its number of copies."""
    classes, _, singles = collapse.collapse(load(spark, d, "usage_questions", "id", "question"), "id", "question")
    return classes.unionAll(singles).select("class_id", "copies")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each copy of a question beside the smallest id of its class."""
    _, members, _ = collapse.collapse(load(spark, d, "usage_questions", "id", "question"), "id", "question")
    return members.where("id > class_id").select(F.col("class_id").alias("id_a"), F.col("id").alias("id_b"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return byte_bpe.encode_column(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they contain and the longest shared run."""
    docs, items = load(spark, d, "documents", "doc_id", "text"), load(spark, d, "benchmark", "item_id", "text")
    return leakage.leaks(docs, "doc_id", "text", items, "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they contain."""
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of every document."""
    return sentences.split_sentences(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {
    "p10_found": p10_found,
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_stats": p2_stats,
    "p5_found": p5_found,
    "p5_lists": p5_lists,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
}

SQL: dict[str, str] = {}
