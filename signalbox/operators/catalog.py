"""Browsing a library: access by type, filters, pages, natural order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.functions.text import natural_key, search_text

#: Rows a table of types may have to be broadcast.
MAX_TYPES = 10_000


def with_access(docs: DataFrame, types: DataFrame, type_col: str = "document_type", ignore_case: bool = False) -> DataFrame:
    """``docs`` with ``restricted``: whether its type asks for a login. Rows without a known type are open."""
    fold = F.lower if ignore_case else (lambda c: c)
    named = types.groupBy(fold(F.col("name")).alias("__name")).agg(F.max("requires_login").alias("__login"))
    if types.count() <= MAX_TYPES:
        named = F.broadcast(named)
    joined = docs.join(named, fold(F.col(type_col)) == F.col("__name"), "left")
    return joined.withColumn("restricted", F.coalesce(F.col("__login"), F.lit(0)) == 1).drop("__name", "__login")


def of_type(docs: DataFrame, types: DataFrame, wanted: str, type_col: str = "document_type") -> DataFrame:
    """Rows of a type, looked up without case and compared by its proper name; an unknown type filters nothing."""
    known = types.where(F.lower("name") == wanted.lower()).select("name").limit(1).collect()
    return docs.where(F.col(type_col) == known[0].name) if known else docs


def containing(docs: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows in whose fields every word of the query occurs as a part."""
    terms = F.filter(F.split(search_text(F.lit(query)), " "), lambda t: t != "")
    text = search_text(F.concat_ws(" ", *[F.col(f) for f in fields]))
    return docs.withColumn("__t", text).where(F.forall(terms, lambda t: F.contains(F.col("__t"), t))).drop("__t")


def page(docs: DataFrame, order: list[Column], number: int = 1, size: int = 60) -> DataFrame:
    """One page of the ordered rows, with their place and the totals. Only the rows up to the page's end are sorted."""
    size = max(1, min(120, size))
    total = docs.count()
    pages = max(1, -(-total // size))
    number = max(1, min(pages, number))
    part = docs.orderBy(*order).limit(number * size)
    place = part.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > (number - 1) * size)
    return place.withColumn("total", F.lit(total).cast("bigint")).withColumn("pages", F.lit(pages).cast("bigint"))


def natural_order(column: str) -> list[Column]:
    """Ascending by text with numbers compared by value."""
    return [natural_key(F.col(column)), F.col(column)]
