"""Hybrid retrieval for a set of questions: vectors, keywords and metadata, fused, capped and cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalbox.functions.text import is_readable, metadata_text, terms
from signalbox.operators import ranking, vectors
from signalbox.session import cut


@dataclass(frozen=True)
class RetrievalConfig:
    """Limits and weights of a retrieval."""

    top_k: int = 4
    min_score: float = 0.3
    pool: int = 16
    vector_weight: float = 0.5
    keyword_weight: float = 0.5
    metadata_boost: float = 0.6
    gap: float = 0.55
    per_document: int = 3
    metadata_weight: float = 8.0


def question_terms(questions: DataFrame) -> DataFrame:
    """(query, term) of (query, text)."""
    return questions.select("query", F.explode(terms(F.col("text"))).alias("term"))


def relative(hits: DataFrame) -> DataFrame:
    """The best hits of each query, scored against the best."""
    best = F.max("score").over(Window.partitionBy("query"))
    return hits.select("query", "doc", F.when(best > 0, F.least(F.lit(1.0), F.col("score") / best)).otherwise(F.lit(1.0)).alias("score"))


def keyword_scores(asked: DataFrame, chunks: DataFrame, pool: int, stem: bool = False) -> DataFrame:
    """(query, id, score) of chunks by their own words."""
    return relative(ranking.best_hits(asked, chunks, "id", "content", pool, stem=stem)).withColumnRenamed("doc", "id")


def metadata_scores(asked: DataFrame, docs: DataFrame, pool: int, weight: float) -> DataFrame:
    """(query, filename, document_id, score) of documents by number, caption and keywords."""
    texts = docs.select("filename", "doc_id", metadata_text(F.col("document_number"), F.col("caption"), F.col("keywords")).alias("meta")).where("meta <> ''")
    names = docs.select(F.col("doc_id").alias("doc"), "filename")
    return relative(ranking.best_hits(asked, texts, "doc_id", "meta", pool, weight=weight)).join(names, "doc").select("query", "filename", F.col("doc").alias("document_id"), "score")


def candidates(questions: DataFrame, chunks: DataFrame, docs: DataFrame, config: RetrievalConfig) -> DataFrame:
    """(query, id, source, score): fused, at most ``per_document`` chunks of a source, twice ``top_k`` in all.

    Three score lists are united and summed by id: one shuffle, no outer joins. Metadata reaches chunks by two equi-joins,
    by source and by document id, whose larger score counts. A chunk without a vector has no vector score, and no other
    loss; a vector is compared with those of its ``grp`` (its model) where the chunks have that column.

    Of the vector scores only those that can matter leave their block: the best under the cap by vector alone, and those
    of chunks that words or metadata found. That is exact: whatever else ranks below the best does so in the sum as well.
    """
    asked = question_terms(questions)
    ids = chunks.select("id", "source", "document_id")
    grp = ["grp"] if "grp" in chunks.columns and "grp" in questions.columns else []
    qs = questions.select("query", *grp, F.col("vector").alias("qv"))
    vs = chunks.select("id", "source", *grp, F.col("embedding").alias("v")).where("v IS NOT NULL")
    units = lambda df, v: df.withColumn(v, vectors.unit(F.col(v)))
    near = vectors.score_queries(units(qs, "qv"), units(vs, "v"), least=config.min_score, best=config.top_k * 2, cap=("source", config.per_document))
    key = keyword_scores(asked, chunks, config.pool).select("query", "id", (F.col("score") * config.keyword_weight).alias("score"))
    meta = metadata_scores(asked, docs, config.pool, config.metadata_weight)
    by_source = meta.join(ids, meta.filename == ids.source).select("query", "id", "score")
    by_id = meta.join(ids, "document_id").select("query", "id", "score")
    lifted = by_source.unionAll(by_id).groupBy("query", "id").agg((F.max("score") * config.metadata_boost).alias("score"))
    found = cut(key.unionAll(lifted).groupBy("query", "id").agg(F.sum("score").alias("words")))
    same = [F.col("grp").eqNullSafe(F.col("q_grp"))] if grp else []
    asked_vectors = qs.select(F.col("query").alias("q"), "qv", *[F.col("grp").alias("q_grp") for _ in grp])
    exact = found.select("query", "id").join(vs, "id").join(asked_vectors, [F.col("query") == F.col("q"), *same]).select("query", "id", vectors.dot(vectors.unit(F.col("qv")), vectors.unit(F.col("v"))).alias("score"))
    vec = near.unionAll(exact).where(F.col("score") >= config.min_score).groupBy("query", "id").agg(F.max("score").alias("score"))
    vec = vec.select("query", "id", (vectors.scaled(F.col("score"), config.min_score) * config.vector_weight).alias("score"))
    fused = vec.unionAll(found.select("query", "id", "words")).groupBy("query", "id").agg(F.round(F.sum("score"), 6).alias("score"))
    scored = fused.join(chunks.select("id", "source"), "id")
    return vectors.top_k(scored, config.top_k * 2, cap=("source", config.per_document)).select("query", "id", "source", "score")


def retrieve(questions: DataFrame, chunks: DataFrame, docs: DataFrame, config: RetrievalConfig | None = None) -> DataFrame:
    """(query, rank, id, source, page, score, title, document_number): the passages a question is answered from.

    The gap cut compares with the best candidate before unreadable passages are dropped.
    """
    config = config or RetrievalConfig()
    found = candidates(questions, chunks, docs, config)
    best = F.max("score").over(Window.partitionBy("query"))
    kept = found.withColumn("best", best).join(chunks.select("id", "page", "content"), "id")
    kept = kept.where(is_readable(F.col("content")) & (F.round("score", 4) >= F.col("best") * config.gap))
    named = docs.groupBy("filename").agg(F.first("caption").alias("caption"), F.first("document_number").alias("document_number"))
    rich = kept.join(named, kept.source == named.filename, "left")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = rich.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_k)
    blank = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), other)
    return ranked.select("query", "rank", "id", "source", "page", F.round("score", 4).alias("score"), blank("caption", F.col("source")).alias("title"), blank("document_number", F.lit("")).alias("document_number"))
