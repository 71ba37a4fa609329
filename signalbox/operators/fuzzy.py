"""Typo-tolerant matching of search terms with optimal string alignment distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.functions.text import search_text


def osa(a: str, b: str) -> int:
    """Edits that turn ``a`` into ``b``, a swap of neighbours being one; no part is edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


def allowed(term: Column) -> Column:
    """Edits a term of this length may differ by."""
    return F.when(F.length(term) <= 4, 1).when(F.length(term) <= 8, 2).otherwise(3)


@F.pandas_udf(T.IntegerType())
def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def similar_words(terms: DataFrame, words: DataFrame, share: float = 0.34) -> DataFrame:
    """(term, word): words that a term may be a misspelling of.

    Candidates are found by length and by the built-in edit distance (which is at most twice the wanted one) on the
    distinct vocabulary; only those reach Python. Terms with digits or under three letters match nothing fuzzily.
    """
    asked = terms.where((F.length("term") >= 3) & ~F.col("term").rlike("[0-9]")).withColumn("edits", allowed(F.col("term")))
    near = asked.withColumn("size", F.explode(F.sequence(F.length("term") - F.col("edits"), F.length("term") + F.col("edits"))))
    pairs = words.withColumn("size", F.length("word")).join(F.broadcast(near), "size")  # a query's terms: at most a dozen each
    close = pairs.where(F.levenshtein("term", "word") <= F.col("edits") * 2)
    exact = close.withColumn("d", _osa(F.col("term"), F.col("word")))
    return exact.where((F.col("d") <= F.col("edits")) & (F.col("d") / F.greatest(F.length("term"), F.length("word")) <= share)).select("term", "word").distinct()


def search(catalog: DataFrame, row_id: str, fields: list[str], query: str, order: list[Column], limit: int = 50) -> DataFrame:
    """Rows in which every term of the query occurs, as part of the text or as a misspelling of one of its words;
    rows with more terms as they are come first, then ``order``."""
    spark = catalog.sparkSession
    wanted = [t for t in dict.fromkeys(spark.range(1).select(search_text(F.lit(query)).alias("q")).first().q.split(" ")) if t]
    text = search_text(F.concat_ws(" ", *[F.col(f) for f in fields]))
    rows = catalog.withColumn("__text", text)
    if not wanted:
        return rows.orderBy(*order).limit(limit).drop("__text").withColumn("exact", F.lit(0))
    vocabulary = rows.select(F.explode(F.array_distinct(F.split("__text", " "))).alias("word")).where("word <> ''").distinct()
    near = similar_words(spark.createDataFrame([(t,) for t in wanted], "term string"), vocabulary)
    forms = near.groupBy("term").agg(F.collect_list("word").alias("words"))  # bounded by words within three edits of a term
    by_term = {r.term: r.words for r in forms.collect()}
    tokens = F.split("__text", " ")
    whole = [F.contains(F.col("__text"), F.lit(t)) for t in wanted]
    match = [w | (F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in by_term[t]])) if by_term.get(t) else F.lit(False)) for t, w in zip(wanted, whole, strict=True)]
    keep = match[0]
    for m in match[1:]:
        keep = keep & m
    exact = sum((w.cast("int") for w in whole), F.lit(0))
    return rows.where(keep).withColumn("exact", exact).drop("__text").orderBy(F.desc("exact"), *order).limit(limit)
