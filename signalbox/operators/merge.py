"""Table maintenance as whole new snapshots: upserts, overlays, pruning, page merges, change detection.

Each operator returns the new state of a table; writing it is one atomic overwrite (``sinks.replace``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; columns in ``keep`` hold their old value where there was a row.

    Columns that ``new`` lacks stay; rows of either side alone stay as they are.
    """
    n = new.select(*key, *[F.col(c).alias(f"__n_{c}") for c in new.columns if c not in key], F.lit(True).alias("__new"))
    joined = old.withColumn("__old", F.lit(True)).join(n, list(key), "full")
    out = []
    for c in old.columns:
        if c in key or c not in new.columns:
            out.append(F.col(c))
        elif c in keep:
            out.append(F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__n_{c}")).alias(c))
        else:
            out.append(F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old, list(key), "left_anti"), allowMissingColumns=True)


def replace_partitions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with every partition that ``new`` touches replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def last_wins(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(order.desc())
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def newest(rows: DataFrame, order: str, keep: int) -> DataFrame:
    """The ``keep`` newest rows."""
    return rows.orderBy(F.desc(order)).limit(keep)


def rename(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """A value renamed, as in a cascade to referring tables."""
    return rows.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def overlay(rules: DataFrame, edits: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rules with edits laid over: an edited value wins, an edit without its rule adds one; ``edited`` tells."""
    e = edits.select(*key, *[F.col(c).alias(f"__e_{c}") for c in columns], F.lit(True).alias("__edited"))
    joined = rules.select(*key, *columns).join(e, list(key), "full")
    return joined.select(*key, *[F.when(F.col("__edited"), F.col(f"__e_{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.coalesce(F.col("__edited"), F.lit(False)).alias("edited"))


def clear_edit(rules: DataFrame, edits: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rules with edits taken back: the original values return, and rules that an edit added vanish."""
    e = edits.select(*key, *[F.col(f"orig_{c}").alias(f"__o_{c}") for c in columns], F.lit(True).alias("__edited"))
    joined = rules.join(e, list(key), "left")
    back = joined.where(F.col("__edited").isNull() | F.col(f"__o_{columns[0]}").isNotNull())
    return back.select(*[F.when(F.col("__edited"), F.col(f"__o_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rules.columns])


def merge_pages(layer: DataFrame, read: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Pages of a text layer joined with pages read from images; a page in both has both texts, layer first."""
    a = layer.select(*key, F.col(text).alias("__a"))
    b = read.select(*key, F.col(text).alias("__b"))
    return a.join(b, list(key), "full").select(*key, F.concat_ws("\n", "__a", "__b").alias(text))


def missing_pages(files: DataFrame, pages: DataFrame, source: str, count: str, page: str) -> DataFrame:
    """(source, page) of pages 1..count without a row."""
    every = files.where(F.col(count) > 0).select(source, F.explode(F.sequence(F.lit(1), F.col(count))).alias(page))
    return every.join(pages.select(source, page), [source, page], "left_anti")


def index_actions(files: DataFrame, index: DataFrame, source: str = "source") -> DataFrame:
    """(source, action) of an index pass: what to do with every file and every index record.

    files: (source, size, modified_ms, model); the first that holds: a vanished file is removed unless its record is
    final, a final record stays, an indexed record of the same size, time and model is unchanged, the rest is indexed.
    """
    f = files.select(source, F.col("size").alias("f_size"), F.col("modified_ms").alias("f_ms"), F.col("model").alias("f_model"), F.lit(True).alias("on_disk"))
    i = index.select(source, "size", "modified_ms", "embedding_model", "status", F.coalesce(F.col("final"), F.lit(0)).alias("final"), F.lit(True).alias("known"))
    j = f.join(i, source, "full")
    same = (F.col("status") == "indexed") & F.col("f_size").eqNullSafe(F.col("size")) & F.col("f_ms").eqNullSafe(F.col("modified_ms")) & F.col("f_model").eqNullSafe(F.col("embedding_model"))
    action = (
        F.when(F.col("on_disk").isNull() & (F.col("final") == 1), "keep")
        .when(F.col("on_disk").isNull(), "remove")
        .when(F.col("known").isNotNull() & (F.col("final") == 1), "final")
        .when(F.col("known").isNotNull() & same, "unchanged")
        .otherwise("index")
    )
    return j.select(source, action.alias("action"))
