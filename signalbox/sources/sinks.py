"""Writing tables: whole snapshots, touched partitions, appended events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace(df: DataFrame, path: str) -> None:
    """Replace a table by a new snapshot."""
    df.write.mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Append rows, such as events."""
    df.write.mode("append").parquet(path)


def question_event(df: DataFrame) -> DataFrame:
    """Questions as they are logged: text up to 1,000 and model up to 120 characters, durations rounded, impossible ones null."""
    ms = F.col("duration_ms").cast("double")
    return df.withColumns({
        "question": F.substring("question", 1, 1000),
        "model": F.substring("model", 1, 120),
        "duration_ms": F.when(~F.isnan(ms) & (F.abs(ms) < float("inf")), F.round(ms).cast("bigint")),
    })
