"""Embedding texts by a plug-in model, in batches, with a deterministic default for tests and offline use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.text import text_of
from signalbox.operators.vectors import unit

Embedder = Callable[[list[str]], np.ndarray]
BATCH, MAX_BATCH = 16, 100


def test_vector(text: Column) -> Column:
    """Eight numbers that depend on the text's length alone: the offline default."""
    n = F.length(text_of(text)) % 8
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == n, F.lit(1.0)).otherwise(F.lit(0.5)).cast("float"))


def model_stamp(provider: str, model: str, revision: int = 3) -> str:
    """The name under which vectors are stored: texts are embedded again when it changes."""
    return f"{provider}:{model}|v{revision}"


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, batch: int = BATCH, prefix: str = "", column: str = "embedding", retries: int = 2) -> DataFrame:
    """``df`` with unit vectors of a text column. The plug-in gets at most ``batch`` texts at once and must give as many
    vectors; a failing call is repeated ``retries`` times before the task fails (and Spark runs it again)."""
    if embedder is None:
        return df.withColumn(column, unit(test_vector(F.col(text))))
    size = max(1, min(MAX_BATCH, batch))

    def call(texts: list[str]) -> np.ndarray:
        for attempt in range(retries + 1):
            try:
                out = np.asarray(embedder(texts), np.float32)
                break
            except Exception:
                if attempt == retries:
                    raise
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [prefix + (t or "") for t in pdf[text]]
            vectors = [v for i in range(0, len(texts), size) for v in call(texts[i : i + size])]
            yield pdf.assign(**{column: vectors})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column)
    return df.drop(column).mapInPandas(run, f"{fields}, `{column}` array<float>")
