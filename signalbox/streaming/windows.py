"""Tumbling counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, key: str, width: str = "1 day", late: str = "6 days", once: str | None = None) -> DataFrame:
    """(key, bucket, n): events per key and bucket; on a stream, later ones than ``late`` are dropped, and so are repeats of
    the id in the column ``once`` within ``late`` of its first event. Events without an id are all kept."""
    rows = events.withColumn("__at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__at", late)
        if once:
            # An event without an id gets one of its own.
            rows = rows.withColumn("__once", F.coalesce(F.col(once).cast("string"), F.concat(F.lit("null-"), F.expr("uuid()")))).dropDuplicatesWithinWatermark(["__once"])
    return rows.groupBy(F.window("__at", width).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("bucket"), "n")


def run_once(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process all that a stream has now into a Parquet folder in ``append`` mode, and read it."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def closed(spark: SparkSession, stream: DataFrame, at: str, last: DataFrame, folder: str, after: str = "8 days") -> DataFrame:
    """A stream with one more row, all null but ``at``, that lies ``after`` the largest ``at`` of ``last`` (all that the
    stream has now): it moves the watermark on, so that the buckets of the last days come out. Its own never does."""
    end = last.agg((F.max(F.col(at).cast("timestamp")) + F.expr(f"INTERVAL {after}")).alias("e")).where("e IS NOT NULL")
    row = end.select(*[(F.col("e") if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema])
    row.coalesce(1).write.parquet(folder)
    return stream.unionAll(spark.readStream.schema(stream.schema).parquet(folder))
