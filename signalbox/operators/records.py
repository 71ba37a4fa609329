"""Small record operations around the library: back-fills, validation, edits with their originals, fall-back answers.

Nulls never pass a check and are never back-filled over; empty tables give empty results; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a question and an answer that a conversation's memory keeps, and its turns.
QUESTION_CHARS, ANSWER_CHARS, TURNS = 1000, 4000, 6


def backfill_by_prefix(rows: DataFrame, column: str, by: str, prefixes: Mapping[str, str]) -> DataFrame:
    """``rows`` with ``column`` filled in, where it is empty, from the first prefix that ``by`` has, whatever the case of
    its ASCII letters; null stays null."""
    folded = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.lit(None).cast("string")
    for prefix, value in reversed(list(prefixes.items())):
        found = F.when(F.startswith(folded(F.col(by)), folded(F.lit(prefix))), F.lit(value)).otherwise(found)
    return rows.withColumn(column, F.when(F.col(column) == "", F.coalesce(found, F.col(column))).otherwise(F.col(column)))


def clean_history(turns: Column) -> Column:
    """The last TURNS of (question, answer) turns, trimmed and cut, without those that ask nothing; null gives none."""
    part = lambda c, n: F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""), 1, n)
    last = F.slice(turns, F.greatest(F.lit(1), F.size(turns) - TURNS + 1), TURNS)
    cut = F.transform(last, lambda t: F.struct(part(t["question"], QUESTION_CHARS).alias("question"), part(t["answer"], ANSWER_CHARS).alias("answer")))
    return F.coalesce(F.filter(cut, lambda t: t["question"] != ""), F.array().cast("array<struct<question:string,answer:string>>"))


def valid_question(question: Column) -> Column:
    """Whether a question, trimmed, has from one to QUESTION_CHARS characters."""
    return F.coalesce(F.length(F.regexp_replace(question, r"(?U)^\s+|\s+$", "")).between(1, QUESTION_CHARS), F.lit(False))


def valid_edit(chapter: Column, number: Column, title: Column, body: Column, max_chapter: Column | int) -> Column:
    """What is wrong with an edit of a rule, or null."""
    top = F.lit(max_chapter) if isinstance(max_chapter, int) else max_chapter
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(chapter.isNull() | ~chapter.between(1, top), "chapter")
        .when(~F.coalesce(F.trim(number).rlike(r"^\d{1,2}\.\d{1,2}$"), F.lit(False)), "number")
        .when(blank(title), "title").when(blank(body), "body")
    )


def set_edits(rules: DataFrame, edits: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rules, edits) after one edit of each key in ``new``: an edit keeps the ``orig_`` columns of the first one of its
    key, or takes what the rule said before it; a rule that is not in the book is added. Columns beside ``key`` and
    ``columns`` are left out. Every key meets others of its kind only once, so a hot book is no hot key."""
    keys, orig = list(key), [f"orig_{c}" for c in columns]
    was = rules.select(*keys, *[F.col(c).alias(f"__was_{c}") for c in columns])
    old = edits.select(*keys, *orig, F.lit(True).alias("__old"))
    first = new.select(*keys, *columns).join(old, keys, "left").join(was, keys, "left")
    kept = [F.when(F.col("__old"), F.col(o)).otherwise(F.col(f"__was_{c}")).alias(o) for c, o in zip(columns, orig, strict=True)]
    now = first.select(*keys, *columns, *kept)
    rest = edits.select(*keys, *columns, *orig).join(new.select(*keys), keys, "left_anti")
    unchanged = rules.select(*keys, *columns).join(new.select(*keys), keys, "left_anti")
    return unchanged.unionByName(new.select(*keys, *columns)), rest.unionByName(now)


def edits_with_rules(edits: DataFrame, rules: DataFrame, key: Sequence[str]) -> DataFrame:
    """``edits`` with ``rule_exists``: how many rules have the edit's own key."""
    n = rules.groupBy(*key).agg(F.count("*").alias("rule_exists"))
    return edits.join(n, list(key), "left").withColumn("rule_exists", F.coalesce("rule_exists", F.lit(0).cast("bigint")))


def concat_pages(layer: DataFrame, read: DataFrame) -> DataFrame:
    """All pages of both kinds, repeats kept, for a folder whose readings are not merged; order by page to list them."""
    return layer.unionByName(read)


def fallback_answer(sources: Column, start: str = "No clean answer could be composed just now.", found: str = " Perhaps in these documents: ", other: str = " Please ask in more words.") -> Column:
    """What is said when no answer could be composed: the first three sources that have a number or a title, by page."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    label = lambda s: F.when(blank(s["number"]) != "", s["number"]).otherwise(blank(s["title"]))
    named = F.transform(F.slice(sources, 1, 3), lambda s: F.when(label(s) != "", F.when(F.coalesce(s["page"], F.lit(0)) != 0, F.concat(label(s), F.lit(", page "), s["page"].cast("string"))).otherwise(label(s))))
    names = F.filter(F.coalesce(named, F.array().cast("array<string>")), lambda n: n.isNotNull())
    return F.concat(F.lit(start), F.when(F.size(names) > 0, F.concat(F.lit(found), F.array_join(names, "; "), F.lit("."))).otherwise(F.lit(other)))


def ids_from_json(spark: SparkSession, ids: str) -> DataFrame:
    """(id) of a JSON array of numbers; what is no number gives no row."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(ids), "array<bigint>")).alias("id")).where("id IS NOT NULL")


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether the catalogue has a table or view of this name."""
    return spark.catalog.tableExists(name)


def clamp(limit: int | None, default: int = 40, most: int = 100) -> int:
    """A wanted number of rows within its bounds; none and zero mean the default."""
    return min(max(limit or default, 1), most)
