"""An index pass: which files to read, their pages, chunks, vectors and the new state of the index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalbox.functions.text import embedding_text
from signalbox.operators.chunking import build_chunks
from signalbox.operators.embedding import Embedder, embed
from signalbox.operators.merge import replace_partitions, upsert

#: Characters and number of passages that a reviewer may save for a file.
SAVED_CHARS, SAVED_CHUNKS = 20_000, 500


@dataclass(frozen=True)
class Index:
    """The tables of an index."""

    documents: DataFrame
    chunks: DataFrame


def index_pages(index: Index, pages: DataFrame, metadata: DataFrame, model: str, embedder: Embedder | None = None) -> Index:
    """The index after (source, page, text) were read: each file's chunks are replaced, its record is put in, and a final
    mark stays. metadata: (source, document_id, title, document_number, keywords). Files without readable text have a
    record of status ``no-text`` and no chunks; chunks of a file that could not be read stay as they are."""
    cut = build_chunks(pages, "source", "page", "text")
    rich = cut.join(metadata, "source", "left")
    said = rich.withColumn("__text", embedding_text(F.col("document_number"), F.col("title"), F.col("keywords"), F.col("content")))
    made = embed(said, "__text", embedder).select("source", "document_id", "page", "chunk_index", "content", "embedding", F.lit(model).alias("embedding_model"), F.size("embedding").alias("dimensions"))
    chars = pages.groupBy("source").agg(F.countDistinct("page").cast("int").alias("page_count"), F.sum(F.length("text")).cast("bigint").alias("content_chars"))
    n = cut.groupBy("source").agg(F.count("*").cast("int").alias("chunk_count"))
    records = chars.join(n, "source", "left").join(metadata, "source", "left").select(
        "source", "document_id", "title", "document_number", "keywords", "page_count", "content_chars",
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.when(F.col("chunk_count") > 0, "indexed").otherwise("no-text").alias("status"), F.lit(model).alias("embedding_model"), F.lit(0).alias("final"),
    )
    emptied = index.chunks.join(records.select("source"), "source", "left_anti")
    return Index(upsert(index.documents, records, ["source"], keep=["final"]), replace_partitions(emptied, made, "source"))


def reviewed_chunks(rows: DataFrame) -> DataFrame:
    """(source, page, content) as a reviewer saved them, cleaned: line ends made uniform, trimmed, empty ones dropped,
    numbered, within the limits of a review."""
    content = F.substring(F.trim(F.regexp_replace("content", r"\r\n?", "\n")), 1, SAVED_CHARS)
    page = F.when((F.col("page") > 0) & (F.abs(F.col("page")) < float("inf")), F.round("page").cast("int")).otherwise(0)
    kept = rows.select("source", page.alias("page"), content.alias("content"), F.monotonically_increasing_id().alias("__o")).where("content <> ''")
    w = Window.partitionBy("source").orderBy("page", "__o")
    return kept.withColumn("chunk_index", F.row_number().over(w) - 1).where(F.col("chunk_index") < SAVED_CHUNKS).drop("__o")


def remove_files(index: Index, gone: DataFrame) -> Index:
    """The index without the sources in ``gone``."""
    return Index(*[t.join(gone.select("source").distinct(), "source", "left_anti") for t in (index.documents, index.chunks)])
