"""Per-document text quality statistics and the verdict prose or not (problem 2).

Statistics are Catalyst expressions over each passage. Whether a passage is natural prose is decided by an ordered
rule list; the rules were induced by incremental reduced-error pruning (``rulelist.fit``) on labelled passages, and
are applied natively as a SQL CASE expression. A document is prose when the larger part of its characters stands in
passages of prose. Passages are weighed by their length, summed before the shuffle, so a source with a third of all
passages costs no more than any other.

Defined results
---------------
* null and blank passages have no statistics and no weight; a source with nothing else is no case;
* a passage without any word has mean word length and shares 0;
* ties (exactly half of the characters) count as prose; repeated passages weigh as often as they are stored;
* empty tables give no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.rulelist import RULES, case_expression

#: Entries the table of common words may have, as it goes into the expression itself.
MAX_COMMON = 10_000

FEATURES = (
    "words",
    "mean_word_length",
    "symbol_ratio",
    "digit_ratio",
    "line_end_ratio",
    "common_ratio",
    "words_per_line",
    "sentence_ratio",
    "vowel_ratio",
)


def common_by_language(table: DataFrame) -> dict[str, list[str]]:
    """The table of common words (lang, word) as lists; refuses a table too large to be one of function words."""
    rows = table.where("word IS NOT NULL").select("lang", F.lower("word").alias("word")).distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.word)
    return {k: sorted(v) for k, v in sorted(out.items())}


_PRE = "__q_"  # prefix of working columns, against clashes with the caller's
_VOWELS = "aeiouyáéíóúàèìòùâêîôûäëïöü"


def with_statistics(rows: DataFrame, text_col: str, common: Mapping[str, Sequence[str]]) -> DataFrame:
    """``rows`` with each statistic of the text as a column ``__q_<name>``.

    Characters are counted as differences of lengths, which is far cheaper than matching them one by one; shared
    intermediates are columns of their own, so that each is computed once.
    """
    every = sorted({w for ws in common.values() for w in ws}) or [""]
    c = lambda name: F.col(_PRE + name)
    per = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    base = rows.select(
        "*",
        F.lower(F.col(f"`{text_col}`")).alias(_PRE + "low"),
        F.regexp_replace(F.col(f"`{text_col}`"), r"\p{L}+", "").alias(_PRE + "rest"),
    )
    counted = base.select(
        "*",
        (F.length(c("low")) - F.length(c("rest"))).alias(_PRE + "letters"),
        (F.length(c("rest")) - F.length(F.regexp_replace(c("rest"), r"\p{N}+", ""))).alias(_PRE + "digits"),
        F.length(F.regexp_replace(c("rest"), r"[\p{N}\s]+", "")).alias(_PRE + "symbols"),
        F.filter(F.split(c("low"), r"[^\p{L}]+"), lambda w: w != "").alias(_PRE + "list"),
        (F.length(c("low")) - F.length(F.regexp_replace(c("low"), f"[{_VOWELS}]+", ""))).alias(_PRE + "vowels"),
        F.size(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda line: F.trim(line) != "")).alias(_PRE + "lines"),
        F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[\p{L}\p{N})\"”»’][ \u00a0\u202f]?[.!?…][\"'”“»)]*[ \t]*(?:\n|$)")).alias(_PRE + "ends"),
        F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"\p{L}[\"'”“»)]*\s?[.!?…][\"'”“»)]*(?=\s|$)")).alias(_PRE + "stops"),
    )
    sized = counted.select(
        "*",
        F.size(c("list")).cast("double").alias(_PRE + "words"),
        (c("letters") + c("digits") + c("symbols")).alias(_PRE + "visible"),
        F.size(F.filter(c("list"), lambda w: w.isin(every))).alias(_PRE + "common"),
    )
    stats = {
        "mean_word_length": per(c("letters"), c("words")),
        "symbol_ratio": per(c("symbols"), c("visible")),
        "digit_ratio": per(c("digits"), c("visible")),
        "line_end_ratio": per(c("ends"), c("lines")),
        "common_ratio": per(c("common"), c("words")),
        "words_per_line": per(c("words"), c("lines")),
        "sentence_ratio": per(c("stops"), c("words")),
        "vowel_ratio": per(c("vowels"), c("letters")),
    }
    return sized.select(*[F.col(f"`{n}`") for n in rows.columns], c("words"), *[v.alias(_PRE + k) for k, v in stats.items()])


def passage_statistics(passages: DataFrame, text_col: str, common: Mapping[str, Sequence[str]]) -> DataFrame:
    """``passages`` with its text's statistics and ``__q_prose`` (boolean); null and blank texts are left out."""
    stats = with_statistics(passages.where(F.col(f"`{text_col}`").rlike(r"\S")), text_col, common)
    return stats.select("*", F.expr(case_expression(RULES, _PRE)).alias(_PRE + "prose"))


def document_quality(passages: DataFrame, doc_col: str, text_col: str, common: Mapping[str, Sequence[str]]) -> DataFrame:
    """(document, words, mean_word_length, symbol_ratio, line_end_ratio, common_ratio, prose_share, prose) per document."""
    rows = passage_statistics(passages.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).alias("document"), F.col(text_col).alias("__text")), "__text", common)
    chars = F.length("__text").cast("double")
    s = lambda name: F.col(_PRE + name)
    weighed = lambda value, weight: F.sum(value * weight) / F.sum(weight)
    return rows.groupBy("document").agg(
        F.sum(s("words")).cast("bigint").alias("words"),
        F.try_divide(F.sum(s("mean_word_length") * s("words")), F.sum(s("words"))).alias("mean_word_length"),
        weighed(s("symbol_ratio"), chars).alias("symbol_ratio"),
        weighed(s("line_end_ratio"), chars).alias("line_end_ratio"),
        F.try_divide(F.sum(s("common_ratio") * s("words")), F.sum(s("words"))).alias("common_ratio"),
        (F.sum(F.when(F.col(_PRE + "prose"), chars).otherwise(0.0)) / F.sum(chars)).alias("prose_share"),
    ).withColumn("prose", F.col("prose_share") >= 0.5)
