"""Rule books: parsing lines into chapters and rules with windows, outlines, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.functions.text import is_upperish, plain_quotes, roman_chapter

_HEADING = r"(?i)^(?:GR\.)?([0-9]{1,2})\.([0-9]{1,2})\.?(?:\s+(.+))?$"
_CHAPTER = r"^CHAPTER\s+([A-Za-z]+|[0-9]{1,2})\.?$"


def strip_furniture(lines: DataFrame, book: str = "book", page: str = "page", pos: str = "pos", line: str = "line") -> DataFrame:
    """Lines without page numbers at the top, repeated titles, table heads and correction footers."""
    w = Window.partitionBy(book, page)
    place = F.row_number().over(w.orderBy(pos)) - 1
    size = F.count("*").over(w)
    first = F.first(line).over(w.orderBy(pos))
    marked = lines.withColumn("__i", place).withColumn("__n", size).withColumn("__first", first)
    l = F.col(line)  # noqa: E741
    drop = (
        (l.rlike(r"(?i)^(?:[ivxlc]+|[0-9]{1,4})$") & (F.col("__i") < 2))
        | ((F.col("__i") == 1) & (l == F.col("__first")))
        | l.rlike(r"(?i)^(?:rule no|subject|page no)")
        | (l.rlike(r"(?i)\(correction memo no\.?\s*[0-9./]+") & (F.col("__i") > F.col("__n") - 3))
    )
    return marked.where(~drop).drop("__i", "__n", "__first")


def parse(lines: DataFrame, book: str = "book", pos: str = "pos", line: str = "line", max_chapter: int = 99, title_lines: int = 3) -> tuple[DataFrame, DataFrame]:
    """(chapters, rules) of ordered lines: (book, number, title) and (book, chapter, number, title, body).

    Chapters carry forward over the lines; a heading opens a rule when its chapter is the current one and its number
    is larger than any before in the chapter; capitals right below a heading continue its title; all else is the rule's
    body. All by windows over the book's lines, no driver loop.
    """
    w = Window.partitionBy("book").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(F.col(book).alias("book"), F.col(pos).alias("pos"), F.trim(line).alias("line")).where("line <> ''")
    rows = rows.withColumn("opens", F.when(F.col("line").rlike(_CHAPTER), roman_chapter(F.regexp_extract("line", _CHAPTER, 1))))
    rows = rows.withColumn("chapter", F.last("opens", ignorenulls=True).over(so_far))
    rows = rows.withColumn("title_of", F.lag("opens").over(w))
    major, minor = F.regexp_extract("line", _HEADING, 1), F.regexp_extract("line", _HEADING, 2)
    heads = (major != "") & (major.try_cast("int") == F.col("chapter")) & (F.col("chapter") <= max_chapter) & F.col("opens").isNull()
    rows = rows.withColumn("minor", F.when(heads, minor.try_cast("int")))
    in_chapter = Window.partitionBy("book", "chapter").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("starts", F.col("minor").isNotNull() & (F.col("minor") > F.coalesce(F.max("minor").over(in_chapter), F.lit(0))))
    rows = rows.withColumn("rule", F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(so_far))
    # A chapter marker that repeats the current chapter is a running header; its title line is the chapter's.
    earlier = F.max("chapter").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new_chapter", F.col("opens").isNotNull() & (F.coalesce(earlier, F.lit(0)) != F.col("opens")))
    fresh = F.coalesce(F.lag("new_chapter").over(w), F.lit(False))
    titles = rows.where(F.col("opens").isNotNull()).groupBy("book", F.col("opens").alias("number")).agg(F.min("pos").alias("__pos"))
    named = rows.withColumn("fresh", fresh).where(F.col("fresh") & F.col("opens").isNull() & ~F.col("starts")).select("book", F.col("title_of").alias("number"), "line", "pos")
    first = named.groupBy("book", "number").agg(F.min_by("line", "pos").alias("title"))
    chapters = titles.join(first, ["book", "number"], "left").select("book", "number", F.coalesce(plain_quotes(F.col("title")), F.concat(F.lit("Chapter "), F.col("number").cast("string"))).alias("title"))
    # Lines of a rule: its heading, capitals that continue it, its body. Chapter markers and titles belong to none.
    own = rows.withColumn("fresh", fresh).where((F.col("rule") > 0) & F.col("opens").isNull() & (~F.col("fresh") | F.col("starts")))
    r = Window.partitionBy("book", "rule").orderBy("pos")
    own = own.withColumn("k", F.row_number().over(r) - 1)
    upper = is_upperish(F.col("line")) & ~F.col("line").rlike(r"^\([0-9]+\)")
    own = own.withColumn("runs", F.min(F.when(F.col("k") == 0, is_upperish(F.regexp_extract("line", _HEADING, 3))).otherwise(upper)).over(r.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("k") == 0, "head").when(F.col("runs") & (F.col("k") <= title_lines), "title").otherwise("body")
    own = own.withColumn("part", part)
    joined = lambda what, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == what, F.struct("pos", "line")))), lambda x: x["line"]), sep)
    grouped = own.groupBy("book", "rule").agg(F.min("chapter").alias("chapter"), F.min_by("line", "pos").alias("head"), joined("title", " ").alias("more"), joined("body", "\n\n").alias("body"))
    title = F.regexp_replace(plain_quotes(F.concat_ws(" ", F.regexp_extract("head", _HEADING, 3), F.col("more"))), r"[\s:.–—-]+$", "")
    number = F.concat(F.regexp_extract("head", _HEADING, 1), F.lit("."), F.regexp_extract("head", _HEADING, 2))
    return chapters, grouped.select("book", "chapter", number.alias("number"), title.alias("title"), "body")


def rule_order(number: Column) -> list[Column]:
    """Rule numbers by chapter and rule as numbers."""
    parts = F.split(number, r"\.")
    return [parts[0].try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")]


def outline(rules: DataFrame) -> DataFrame:
    """(book, chapter, rules): each chapter's rules in order, as an array of (number, title)."""
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(rule_order(F.col("number")))], F.col("number"), F.col("title"))
    packed = F.transform(F.array_sort(F.collect_list(key)), lambda x: F.struct(x["number"].alias("number"), x["title"].alias("title")))
    return rules.groupBy("book", "chapter").agg(packed.alias("rules"))


def counts(rules: DataFrame) -> DataFrame:
    """(book, chapters, rules)."""
    return rules.groupBy("book").agg(F.countDistinct("chapter").alias("chapters"), F.count("*").alias("rules"))
