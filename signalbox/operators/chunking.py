"""Packing pages of text into overlapping chunks that fit an embedding window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.functions.text import collapse, hard_split, is_readable, sentences

CHUNK_CHARS, OVERLAP, MAX_CHUNKS = 1400, 200, 500


def chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP) -> Column:
    """The chunks of one page: sentences are packed until one does not fit; the next chunk begins with the last
    ``overlap`` characters. A left fold over the sentences, without Python."""
    pieces = F.flatten(F.transform(sentences(collapse(text)), lambda s: hard_split(s, size)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, piece: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + 1 + F.length(piece) > size)
        tail = F.substring(acc["open"], -overlap, overlap) if overlap > 0 else F.lit("")
        begun = F.when(full, tail).otherwise(acc["open"])
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(begun != "", F.concat(begun, F.lit(" "), piece)).otherwise(piece).alias("open"),
        )

    packed = F.aggregate(pieces, start, add, lambda acc: F.array_append(acc["done"], acc["open"]))
    return F.filter(F.transform(packed, collapse), lambda c: c != "")


def build_chunks(pages: DataFrame, source: str, page: str, text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP, most: int = MAX_CHUNKS) -> DataFrame:
    """(source, page, chunk_index, content): the readable chunks of each file in page order, numbered from 0.

    ``most`` is the file limit of the index, counted over readable chunks.
    """
    cut = pages.select(F.col(source).alias("source"), F.col(page).alias("page"), F.posexplode(chunks(F.col(text), size, overlap)).alias("seq", "content"))
    order = Window.partitionBy("source").orderBy("page", "seq")
    numbered = cut.where(is_readable(F.col("content"))).withColumn("chunk_index", F.row_number().over(order) - 1)
    return numbered.where(F.col("chunk_index") < most).select("source", "page", "chunk_index", "content")
