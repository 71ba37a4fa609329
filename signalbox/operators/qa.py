"""Around a question: history, packed context, prompts, answer cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.functions.text import is_bare_term, standalone_question, text_of


def follow_ups(turns: DataFrame, conversation: str, order: list[str], question: str) -> DataFrame:
    """``turns`` with ``standalone``: each question made independent of the one before."""
    w = Window.partitionBy(conversation).orderBy(*order)
    return turns.withColumn("__prev", F.lag(question).over(w)).withColumn("standalone", standalone_question(F.col(question), F.col("__prev"))).drop("__prev")


def history_blocks(turns: DataFrame, conversation: str, order: list[str], question: str, answer: Column, most: int = 2, chars: int = 1200) -> DataFrame:
    """``turns`` with ``history``: up to ``most`` turns before it that have a question, newest first while they fit
    into ``chars`` (the newest always does), told oldest first."""
    asked = F.trim(F.substring(text_of(F.col(question)), 1, 500))
    said = F.trim(F.substring(text_of(answer), 1, 800))
    line = F.when(asked != "", F.concat(F.lit("Q: "), asked, F.lit("\nA: "), F.when(said != "", said).otherwise(F.lit("(no answer)"))))
    w = Window.partitionBy(conversation).orderBy(*order)
    # Blank questions take no place, so the window must be the conversation so far, of which the last ``most`` lines are kept.
    rows = turns.withColumn("__line", line)
    told = rows.where("__line IS NOT NULL")
    for i in range(most):
        told = told.withColumn(f"__l{i}", F.lag("__line", i).over(w))
    before = rows.withColumn("__n", F.count("__line").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    lines = told.withColumn("__n", F.count("__line").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(conversation, "__n", *[f"__l{i}" for i in range(most)])
    joined = before.join(lines, [conversation, "__n"], "left")
    used, kept, open_ = F.lit(0), [], F.lit(True)
    for i in range(most):
        c = F.col(f"__l{i}")
        fits = c.isNotNull() & open_ & ((used + F.length(c) <= chars) | F.lit(i == 0))
        kept.append(F.when(fits, c))
        used, open_ = used + F.when(fits, F.length(c)).otherwise(0), fits
    return joined.withColumn("history", F.concat_ws("\n\n", *reversed(kept))).drop("__line", "__n", *[f"__l{i}" for i in range(most)])


def pack(passages: DataFrame, query: str, order: list, block: Column, chars: int = 4000) -> DataFrame:
    """Passages of each query while their blocks fit into ``chars`` together; the first that does not ends the list."""
    w = Window.partitionBy(query).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return passages.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(w)).where(F.col("used") <= chars)


def heading(rank: Column, number: Column, title: Column, source: Column, keywords: Column, page: Column) -> Column:
    """The heading line of a passage in a prompt."""
    named = (text_of(title) != "") & (title != source)
    part = lambda when, label, c: F.when(when, F.concat(F.lit(label), c.cast("string")))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Passage "), rank.cast("string"), F.lit(",")),
        part(text_of(number) != "", "document number: ", number),
        part((text_of(number) == "") & ~named, "File: ", source),
        part(named, "Caption: ", title),
        part(text_of(keywords) != "", "Keywords: ", keywords),
        part(F.coalesce(page, F.lit(0)) != 0, "Page: ", page),
    )


TERM_TASK = "\n\nOnly one term is asked for: give its meaning, then what these passages tell of it."


def prompt(question: Column, blocks: Column, history: Column, intro: str = "Answer the question using only these passages from the library.") -> Column:
    """The prompt of a question: history, passages, question, and a task line for a bare term."""
    head = F.when(text_of(history) != "", F.concat(F.lit("Earlier in this conversation:\n"), history, F.lit("\n"))).otherwise(F.lit(""))
    task = F.when(is_bare_term(question), F.lit(TERM_TASK)).otherwise(F.lit(""))
    return F.concat_ws("\n", head, F.lit(intro), F.lit(""), F.array_join(blocks, "\n\n---\n\n"), F.lit(""), F.concat(F.lit("Question: "), question, task))


def distinct_keywords(keywords: Column) -> Column:
    """Keywords of all sources, split at commas, each once in order of appearance, joined again."""
    parts = F.flatten(F.transform(keywords, lambda k: F.transform(F.split(text_of(k), ","), lambda p: F.trim(p))))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), ", ")


def cache_lookup(questions: DataFrame, cache: DataFrame, key: str, now_ms: Column, ttl_ms: int | None) -> DataFrame:
    """Questions with their cached answer, if there is one that is not too old; broken sources count as none."""
    ok = cache.where(F.try_parse_json("sources").isNotNull())
    if ttl_ms is not None:
        ok = ok.where(now_ms - F.col("created_ms") <= ttl_ms)
    return questions.join(ok, key, "left")


def cache_prune(cache: DataFrame, keep: int, now_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The ``keep`` most recently used entries that are not too old; 0 keeps none."""
    rows = cache if ttl_ms is None or now_ms is None else cache.where(F.col("created_ms") > now_ms - ttl_ms)
    return rows.orderBy(F.desc("used_ms"), "key").limit(keep)
