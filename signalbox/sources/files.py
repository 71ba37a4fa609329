"""Files as tables: folder scans, event streams of text, page readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.functions.text import is_stamp_only, normalize_extracted

#: Characters of a file after which no further page is read.
MAX_CHARS = 1_500_000


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(source, path, size, modified_ms) of a folder's files, without hidden ones; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("source"), "path", F.col("length").alias("size"), F.round(F.unix_millis("modificationTime")).cast("bigint").alias("modified_ms")).where(~F.startswith("source", F.lit(".")))


def watch_folder(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """The same as a stream of files that appear."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), "path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), "content")


def read_pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(source, page, text): the pages of (source, content), by a reader that is a plug-in (PDF, OCR, …).

    Files that cannot be read give one row with page 0 and the error; stamps and blank pages are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for source, content in zip(pdf["source"], pdf["content"], strict=True):
                try:
                    rows += [(source, i + 1, text, None) for i, text in enumerate(reader(bytes(content)))]
                except Exception as e:  # noqa: BLE001 - any reader's failure is that file's
                    rows.append((source, 0, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "page", "text", "error"]).astype({"page": "int32"})

    pages = files.select("source", "content").mapInPandas(run, "source string, page int, text string, error string")
    clean = pages.withColumn("text", F.when(F.col("text").isNotNull(), normalize_extracted(F.col("text"))))
    return clean.where(F.col("error").isNotNull() | ~is_stamp_only(F.col("text")))


def within_budget(pages: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """Pages until a file's characters reach ``limit``; the page that crosses it is the last. A limit of the index."""
    w = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("__before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).where(F.col("__before") < limit).drop("__before")


def glyph_lines(runs: DataFrame, group: list[str], order: str = "seq", gap: int = 3) -> DataFrame:
    """(group…, line_no, line): text lines from glyph runs (y, text): a run more than ``gap`` off the line's first one
    begins a new line. The line's first height is carried by a fold over the page's ordered runs."""
    packed = runs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, F.round("y").cast("int").alias("y"), "text"))).alias("r"))
    start = F.struct(F.lit(None).cast("int").alias("y"), F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, r):  # noqa: ANN001, ANN202
        new = acc["y"].isNotNull() & (F.abs(r["y"] - acc["y"]) > gap)
        return F.struct(
            F.when(acc["y"].isNull() | new, r["y"]).otherwise(acc["y"]).alias("y"),
            F.when(new, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(new, r["text"]).otherwise(F.concat(acc["open"], r["text"])).alias("open"),
        )

    lines = F.aggregate("r", start, add, lambda acc: F.array_append(acc["done"], acc["open"]))
    kept = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return packed.select(*group, F.posexplode(kept).alias("line_no", "line"))


def read_chat_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(content, done, reason) of lines of JSON as a chat model streams them; broken lines are left out."""
    parsed = F.from_json(F.col(value), "message struct<content:string>, done boolean, done_reason string")
    rows = lines.withColumn("j", parsed).where("j IS NOT NULL AND (j.message IS NOT NULL OR j.done IS NOT NULL)")
    return rows.select(F.coalesce("j.message.content", F.lit("")).alias("content"), F.coalesce("j.done", F.lit(False)).alias("done"), F.col("j.done_reason").alias("reason"))


def read_sse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(data) of the data lines of a server-sent event stream, without the end mark."""
    data = F.regexp_extract(F.regexp_replace(value, "\r$", ""), r"^data: ?(.*)$", 1)
    return lines.select(data.alias("data")).where("data <> '' AND data <> '[DONE]'")
