"""Noise in text from scanned pages (problem 1): find it, and repair the text into continuous paragraphs.

* ``hyphen``: a letter, a dividing sign attached to it, a line end, a letter.
* ``page_no``: a line with nothing but a page number in one of the usual forms.
* ``header``: a line of its own, in the shape of a title (a document code, a separating sign, capitals), that recurs
  apart from case, spacing and end marks in other passages of the group; digits are masked to judge the shape. Running
  text that happens to recur begins in lower case, ends a sentence or has words in lower case like any sentence.
* ``chars``: words are grouped, in the language of their sentence, by a skeleton in which confusable glyphs look alike
  (strokes of letters); a word is misread if its group holds a far more frequent form from which known confusions lead
  to it and which its context supports: how often each word stands beside which class of neighbours is counted with the
  vocabulary, and the neighbours of the rare word must not speak against the form more than its rarity speaks for it.
  The sentence's language is context as well: a frequent word of one language is a misreading in another.

Only the vocabulary (distinct words with their counts) and title-shaped lines are shuffled, never the texts, until the
repair regroups the lines of a passage. Counting is partial, so no group or word is hot.

Defined results
---------------
* only passages of running prose (the verdict of problem 2) are cases; null and blank ones never;
* passages stored again count as one when lines recur and words are counted, but each is a case of its own;
* a word of a single sign is a code (a unit, an initial, a letter of a list) and never misread;
* a null group has no recurring lines; repeated rows of an id give one row per noise; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.llm.quality import passage_statistics
from signalbox.llm.spread import bounded_broadcast, spread
from signalbox.session import cut

#: Signs that divide a word at a line end; the hyphen, the soft hyphen, the not sign that stands for it, and U+2010.
SIGNS = "-­¬‐"
# The sign comes first in the pattern, as it is rare; the letter before it is looked back at.
HYPHEN = rf"[{SIGNS}](?<=\p{{L}}[{SIGNS}])[^\S\n]*\n[^\S\n]*(?=\p{{L}})"
PAGE_LINE = (
    r"(?iU)^\s*(?:[-–—\[(]\s*)?(?:(?:page|seite|página|pagina|pág|pag|p|s)\b\.?\s*)?\d{1,4}"
    r"(?:\s*(?:/|of|von|de|sur)\s*\d{1,4})?(?:\s*[-–—\])])?\s*\.?\s*$"
)
#: The same anywhere in a passage, in one search.
PAGE_ANYWHERE = (
    r"(?im)^[^\S\n]*(?:[-–—\[(][^\S\n]*)?(?:(?:page|seite|p[áÁ]gina|pagina|p[áÁ]g|pag|p|s)\b\.?[^\S\n]*)?\d{1,4}"
    r"(?:[^\S\n]*(?:/|of|von|de|sur)[^\S\n]*\d{1,4})?(?:[^\S\n]*[-–—\])])?[^\S\n]*\.?[^\S\n]*$"
)
#: Lines that may be titles, in one search: a capital or digit first, no end of a sentence (``_title`` judges the rest).
_TITLES = r"(?m)^[^\S\n]*([\"“„«\[(]?[\p{Lu}\p{Lo}\p{N}][^\n]*+)(?<!\S[.!?,;:…][\"”»)]{0,3})$"
# Ranges and plain signs, which are matched far faster than \s and single signs beyond Latin-1.
_MARKS = r" \t\n\x0B\f\r.,;:()\"«»?!¿¡/\[\]=_–—“-„…"
#: What lies between words: marks, and the sign in a mail address, which joins a word to a code.
BETWEEN = rf"[{_MARKS}][{_MARKS}'’-]*+|['’-]++(?:[{_MARKS}][{_MARKS}'’-]*+|$)|@(?=\p{{L}}{{2,}}\d)"
#: A misread word's correct form is at least so many times as frequent, and occurs at least so often.
RATIO, LEAST = 10, 5
#: Classes of neighbours by hash, on either side.
CONTEXT = 64
#: Occurrences that the usual neighbours weigh beside a form's own; share of neighbours that tell nothing, as they are
#: misread themselves; what speaks for a misreading before its neighbours are seen (as a logarithm).
SMOOTHING, STRAY, PRIOR = 8.0, 0.1, 2.5
#: Rows of the table of misread words, or of passages stored again (some 60 bytes each), that may be broadcast.
BROADCAST_ROWS = 300_000

# Glyphs that recognition confuses, as (read correctly, misread).
CONFUSIONS = (
    ("", "·"), ("a", "@"), ("b", "6"), ("b", "h"), ("c", "e"), ("cl", "d"), ("d", "cl"), ("e", "c"), ("g", "9"), ("h", "b"), ("h", "li"),
    ("i", "1"), ("i", "l"), ("i", "|"), ("in", "m"), ("l", "1"), ("l", "i"), ("l", "|"), ("li", "h"), ("m", "in"), ("m", "rn"), ("n", "ñ"),
    ("o", "0"), ("rn", "m"), ("s", "5"), ("t", "+"), ("u", "ii"), ("ü", "ii"), ("ú", "ii"), ("û", "ii"), ("ù", "ii"), ("vv", "w"), ("w", "vv"),
    ("é", "6"), ("é", "e"), ("é", "c"), ("è", "c"), ("ê", "c"), ("è", "e"), ("ê", "e"), ("í", "|"), ("î", "|"), ("í", "1"), ("î", "1"),
    ("á", "@"), ("à", "@"), ("â", "@"), ("ä", "@"), ("ó", "0"), ("ô", "0"), ("ö", "0"), ("fi", "ﬁ"), ("fl", "ﬂ"),
)


def skeleton(word: Column) -> Column:
    """The word in strokes: glyphs that are confused give the same strokes, however they are cut."""
    plain = F.translate(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "·", ""), "ﬁ", "fi"), "ﬂ", "fl"),
        "@+|01l59éèêëcáàâäíìîïrjóòôöñúùûü",
        "atioiisgeeeeeaaaaiiiiiioooonuuuu",
    )
    for letter, strokes in (("[nuhb]", "ii"), ("m", "iii"), ("d", "ei"), ("w", "vv")):
        plain = F.regexp_replace(plain, letter, strokes)
    return plain


def explained(correct: str, seen: str) -> bool:
    """Whether confusions alone lead from ``correct`` to ``seen``."""
    reach = {0: {0}}
    for i in range(len(correct) + 1):
        for j in sorted(reach.get(i, ())):
            grown = {(i + 1, j + 1)} if i < len(correct) and j < len(seen) and correct[i] == seen[j] else set()
            grown |= {(i + len(a), j + len(b)) for a, b in CONFUSIONS if correct.startswith(a, i) and seen.startswith(b, j)}
            for x, y in grown:
                if x == i:  # an inserted sign: stay at the same letter
                    stack = [y]
                    while stack:
                        y = stack.pop()
                        if y not in reach[i]:
                            reach[i].add(y)
                            if i < len(correct) and y < len(seen):
                                if correct[i] == seen[y]:
                                    reach.setdefault(i + 1, set()).add(y + 1)
                                for a, b in CONFUSIONS:
                                    if correct.startswith(a, i) and seen.startswith(b, y):
                                        if a:
                                            reach.setdefault(i + len(a), set()).add(y + len(b))
                                        else:
                                            stack.append(y + len(b))
                else:
                    reach.setdefault(x, set()).add(y)
    return len(seen) in reach.get(len(correct), ())


def passages(df: DataFrame, table: str, row_id: str, group: str, content: str, copy: Sequence[str]) -> DataFrame:
    """A table's passages in the form the other functions take; ``copy`` names what a passage stored again shares."""
    return df.select(
        F.lit(table).alias("table_name"),
        F.col(row_id).cast("bigint").alias("row_id"),
        F.col(group).alias("grp"),
        F.xxhash64(*copy).alias("copy"),
        F.when(F.contains(F.col(content), F.lit("\r")), F.regexp_replace(content, "\r\n?", "\n")).otherwise(F.col(content)).alias("content"),
    )


def judged(rows: DataFrame, common: Mapping[str, Sequence[str]], texts: bool = False) -> DataFrame:
    """Passages with ``prose``, ``hyphen``, ``page_no`` and ``titles``, the title-shaped lines in their normal form; the
    text only where it is prose, or everywhere with ``texts``; ``at`` numbers the rows. Everything that needs the text
    of all passages happens in this one pass."""
    known = passage_statistics(rows, "content", common)
    prose = F.col("__q_prose")
    return known.select(
        *[c for c in rows.columns if c != "content"],
        prose.alias("prose"),
        (prose & F.col("content").rlike(HYPHEN)).alias("hyphen"),
        (prose & F.col("content").rlike(PAGE_ANYWHERE)).alias("page_no"),
        F.filter(F.transform(title_lines("content"), _norm), lambda x: x != "").alias("titles"),
        (F.col("content") if texts else F.when(prose, F.col("content"))).alias("content"),
        F.monotonically_increasing_id().alias("at"),
    )


# --- words -----------------------------------------------------------------------------------------------------


def words(rows: DataFrame, common: Mapping[str, Sequence[str]]) -> DataFrame:
    """(table_name, row_id, first, lang, t): the words of each sentence of each passage in lower case, divided words
    joined, with the sentence's language ('*' where no common word tells it). The columns are cut once and read twice."""
    joined = F.lower(F.when(F.col("hyphen"), F.regexp_replace("content", HYPHEN, "")).otherwise(F.col("content")))
    sentences = F.split(joined, r"[.!?…][\"”»“)]*\s+|\n\s*\n")
    own = ["table_name", "row_id", "first"]
    said = rows.select(*own, F.explode(sentences).alias("s"))
    said = said.select(*own, F.split("s", BETWEEN).alias("t"))
    # Few words are common: the languages are told apart among those only.
    every = sorted({w for ws in common.values() for w in ws}) or [""]
    said = said.select(*own, "t", F.filter("t", lambda w: w.isin(every)).alias("c"))
    # One number tells count and language, so that nothing is computed twice; it is never null, or a filter on that
    # would be pushed down and compute it once more.
    known = lambda ws: F.size(F.filter("c", lambda w: w.isin(list(ws))))
    step = len(common) + 1
    hits = [known(ws) * step + i for i, ws in enumerate(common.values(), 1)]
    said = said.select(*own, "t", F.coalesce(F.greatest(*hits, F.lit(0), F.lit(0)), F.lit(0)).alias("code"))
    names = F.array(*[F.lit(x) for x in ("*", *common)])
    lang = F.coalesce(F.get(names, F.when(F.col("code") >= step, F.col("code") % step).otherwise(0)), F.lit("*"))
    return said.select(*own, lang.alias("lang"), "t")


def vocabulary(sentences: DataFrame) -> DataFrame:
    """(lang, word, n, beside): each word's count, and how often it stands beside which class of neighbours.

    Neighbours fall into CONTEXT classes by their hash, on either side, and the edge of a sentence is a class too;
    ``beside`` has at most 2 * (CONTEXT + 1) entries (class, count). All counting is partial before the shuffle.
    """
    edge = F.array(F.lit(""))
    before, after = F.concat(edge, "t"), F.concat(F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))), edge)
    flat = sentences.select("lang", F.inline(F.arrays_zip(F.col("t").alias("word"), before.alias("p"), after.alias("q"))))
    # A single sign is a letter of a list, an initial or a unit: a code, and no word.
    flat = flat.where(F.length("word") >= 2)
    kind = lambda c: F.when(F.col(c) == "", CONTEXT).otherwise(F.pmod(F.xxhash64(c), F.lit(CONTEXT)).cast("int"))
    flat = flat.select("lang", "word", kind("p").alias("p"), kind("q").alias("q"))
    sides = flat.select("lang", "word", F.explode(F.array(F.col("p"), F.col("q") + CONTEXT + 1)).alias("b"))
    counted = sides.groupBy("lang", "word", "b").agg(F.count("*").alias("c")).where(F.col("word").rlike(r"\p{L}"))
    return counted.groupBy("lang", "word").agg(F.sum(F.when(F.col("b") <= CONTEXT, F.col("c"))).alias("n"), F.collect_list(F.struct("b", "c")).alias("beside"))


def support(seen: np.ndarray, form: np.ndarray, usual: np.ndarray) -> float:
    """How far the neighbours of a word speak for its being a misreading of a form: the logarithm of how much likelier
    they are beside the form than beside any word of the language. Three rows of counts by class of neighbour."""
    total = 0.0
    for side in (slice(0, CONTEXT + 1), slice(CONTEXT + 1, 2 * (CONTEXT + 1))):
        chance = (usual[side] + 1) / (usual[side].sum() + CONTEXT + 1)
        beside = (form[side] + SMOOTHING * chance) / (form[side].sum() + SMOOTHING)
        total += float(seen[side] @ np.log((1 - STRAY) * beside / chance + STRAY))
    return total


def misread(counted: DataFrame) -> DataFrame:
    """(lang, word, correct) of misread words, from a vocabulary."""
    # Sentences without a common word may be of any language, so a word's occurrences there count as well.
    unknown = F.sum(F.when(F.col("lang") == "*", F.col("n")).otherwise(0)).over(Window.partitionBy("word"))
    counted = counted.withColumn("n", F.when(F.col("lang") == "*", F.col("n")).otherwise(F.col("n") + unknown))
    # A six may stand for b or for é: such a word belongs to two groups.
    spelled = F.when(F.col("word").contains("6"), F.array(skeleton(F.replace("word", F.lit("6"), F.lit("b"))), skeleton(F.replace("word", F.lit("6"), F.lit("e"))))).otherwise(F.array(skeleton(F.col("word"))))
    grouped = counted.select("lang", "word", "n", "beside", F.explode(F.array_distinct(spelled)).alias("skel"))
    forms = grouped.where((F.col("n") >= LEAST) & F.col("word").rlike(r"^[\p{L}'’-]+$"))
    forms = forms.select("lang", "skel", F.col("word").alias("correct"), F.col("n").alias("m"), F.col("beside").alias("form"))
    pairs = grouped.join(forms, ["lang", "skel"]).where((F.col("m") >= F.col("n") * RATIO) & (F.col("word") != F.col("correct")))
    # What is usual beside any word: one row for each language of the common words and class of neighbour.
    usual: dict[str, np.ndarray] = {}
    for r in counted.select("lang", F.inline("beside")).groupBy("lang", "b").agg(F.sum("c").alias("c")).collect():
        usual.setdefault(r.lang, np.zeros(2 * (CONTEXT + 1)))[r.b] = r.c

    def counts(entries: Sequence[Mapping[str, int]]) -> np.ndarray:
        out = np.zeros(2 * (CONTEXT + 1))
        for e in entries:
            out[e["b"]] = e["c"]
        return out

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for x in pdf.itertuples(index=False):
                if explained(x.correct, x.word):
                    score = PRIOR + math.log(x.m / x.n) + support(counts(x.beside), counts(x.form), usual[x.lang])
                    if score > 0:
                        rows.append((x.lang, x.word, x.correct, score))
            yield pd.DataFrame(rows, columns=["lang", "word", "correct", "score"])

    checked = pairs.select("lang", "word", "correct", "n", "m", "beside", "form").mapInPandas(check, "lang string, word string, correct string, score double")
    best = checked.groupBy("lang", "word").agg(F.max_by("correct", F.struct("score", "correct")).alias("correct"), F.max("score").alias("score"))
    # Where no common word tells the language, a word is misread there by itself, or if it is so wherever else it occurs.
    known = counted.where("lang <> '*'").select("lang", "word").join(best, ["lang", "word"], "left")
    anywhere = known.groupBy("word").agg(F.max_by("correct", F.struct("score", "correct")).alias("correct"), F.bool_and(F.col("correct").isNotNull()).alias("always"))
    every = best.select("lang", "word", "correct").unionByName(anywhere.where("always").select(F.lit("*").alias("lang"), "word", "correct"))
    return every.groupBy("lang", "word").agg(F.min("correct").alias("correct"))


def with_first(rows: DataFrame) -> DataFrame:
    """``rows`` with ``first``: whether a row is that of its (table_name, grp, copy) with the smallest ``at``; texts stay
    where they are unless more passages are stored again than may be broadcast."""
    key = ["table_name", "grp", "copy"]
    seen = rows.groupBy(*key).agg(F.min("at").alias("a"), F.max("at").alias("b"))
    again = cut(seen.where("a <> b").select(*[F.col(c).alias(f"a_{c}") for c in key], "a"))
    same = (F.col("table_name") == F.col("a_table_name")) & F.col("grp").eqNullSafe(F.col("a_grp")) & (F.col("copy") == F.col("a_copy"))
    joined = rows.join(bounded_broadcast(again, again.count(), BROADCAST_ROWS), same, "left")
    return joined.select(*rows.columns, F.coalesce(F.col("a") == F.col("at"), F.lit(True)).alias("first"))


def misread_words(rows: DataFrame, common: Mapping[str, Sequence[str]]) -> DataFrame:
    """(table_name, row_id, word, correct): each misread word of each passage, once."""
    sentences = cut(words(with_first(rows), common))
    # One vocabulary for all tables, of all different passages: a passage stored many times must not make its misread
    # words frequent.
    wrong = cut(misread(cut(vocabulary(sentences.where("first")))))
    flat = sentences.select("table_name", "row_id", "lang", F.explode("t").alias("word"))
    found = flat.join(bounded_broadcast(wrong, wrong.count(), BROADCAST_ROWS), ["lang", "word"])
    # A passage in two languages may have two corrections of one word.
    return found.groupBy("table_name", "row_id", "word").agg(F.min("correct").alias("correct"))


# --- lines -----------------------------------------------------------------------------------------------------


def _norm(line: Column) -> Column:
    squeezed = F.regexp_replace(F.lower(line), r"(?U)\s+", " ")
    return F.regexp_replace(squeezed, r"^ +|[ .,;:!?…]+$", "")


def _title(masked: Column) -> Column:
    """Whether a line, trimmed and with its digits masked, can be a running header rather than a line of text."""
    starts = masked.rlike(r"^[\"“„«\[(]?[\p{Lu}\p{Lo}9]")
    ends_text = masked.rlike(r"\S[.!?,;:…][\"”»)]*$") & ~masked.rlike(r"\s[.!?…]$")
    coded = masked.rlike(r"(?:\p{L}{2,}-?9{4,}|\s[—–·|]\s+\S)|\S(?:\s{2,}|\t)\S")
    capitals = ~masked.rlike(r"\p{Ll}") & masked.rlike(r"\p{Lu}{3}")
    titled = ~masked.rlike(r"(?:^|\s)\p{Ll}{4,}") & masked.rlike(r"\p{Lu}\p{Ll}+\s+(?:\p{Ll}{1,3}\s+)*\p{Lu}")
    return starts & ~ends_text & (coded | capitals | titled) & ~masked.rlike(PAGE_LINE)


def _masked(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), r"\p{N}", "9")


def title_shaped(line: Column) -> Column:
    """Whether a line can be a running header rather than a line of text."""
    return _title(_masked(line))


def title_lines(content: str) -> Column:
    """The title-shaped lines of a text. Digits are masked once for each line that begins and ends as a title may."""
    lines = F.regexp_extract_all(content, F.lit(_TITLES), 1)
    both = F.transform(lines, lambda x: F.struct(x.alias("line"), _masked(x).alias("masked")))
    return F.transform(F.filter(both, lambda x: _title(x["masked"])), lambda x: x["line"])


def recurring_headers(known: DataFrame) -> DataFrame:
    """(table_name, grp, norm): title-shaped lines that stand in more than one passage of a group."""
    own = known.where("grp IS NOT NULL").select("table_name", "grp", "copy", F.explode("titles").alias("norm"))
    # Smallest and largest copy differ exactly when there is more than one; that needs no distinct.
    seen = own.groupBy("table_name", "grp", "norm").agg(F.min("copy").alias("a"), F.max("copy").alias("b"))
    return seen.where("a <> b").select("table_name", "grp", "norm")


def with_headers(known: DataFrame) -> DataFrame:
    """(table_name, row_id) of prose that holds a line recurring in its group."""
    own = known.where("prose AND grp IS NOT NULL").select("table_name", "row_id", "grp", F.explode("titles").alias("norm"))
    return own.join(recurring_headers(known), ["table_name", "grp", "norm"], "left_semi").select("table_name", "row_id").distinct()


def find_noise(every: DataFrame, common: Mapping[str, Sequence[str]]) -> DataFrame:
    """(table_name, row_id, noise) of the passages of prose, one row per kind of noise."""
    known = cut(judged(spread(every), common))
    prose = known.where("prose")
    kind = lambda df, name: df.select("table_name", "row_id", F.lit(name).alias("noise"))
    return (
        kind(known.where("hyphen"), "hyphen")
        .unionAll(kind(known.where("page_no"), "page_no"))
        .unionAll(kind(with_headers(known), "header"))
        .unionAll(kind(misread_words(prose, common), "chars"))
        .distinct()
    )


def repair(every: DataFrame, common: Mapping[str, Sequence[str]]) -> DataFrame:
    """(table_name, row_id, text, repaired): each passage of prose as continuous paragraphs, divided by blank lines; the
    others as they are stored, with ``repaired`` false.

    Page numbers and recurring headers are left out, divided words joined, misread words replaced by their correct
    forms (a capital at the start is kept), and lines reflowed: a window over the passage's lines numbers its paragraphs.
    """
    known = cut(judged(spread(every), common, texts=True))
    key = ["table_name", "row_id"]
    # A row delivered several times is one; of several texts under one id, the one with the smallest hash counts.
    own = Window.partitionBy(*key)
    lines = known.select(*key, "grp", "prose", "at", F.struct(F.xxhash64("content"), "at").alias("as"), F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    lines = lines.where(~F.col("prose") | ~F.col("line").rlike(PAGE_LINE)).withColumn("norm", F.when(F.col("prose") & title_shaped(F.col("line")), _norm(F.col("line"))))
    headers = recurring_headers(known).withColumn("header", F.lit(True))
    kept = lines.join(headers, ["table_name", "grp", "norm"], "left").where("header IS NULL").drop("norm", "header")
    kept = kept.withColumn("chosen", F.min("as").over(own)).where("`as` = chosen")
    by_pos = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim("line") == ""
    numbered = kept.select(*key, "prose", "pos", F.when(F.col("prose"), F.trim("line")).otherwise(F.col("line")).alias("line"), F.count_if(F.col("prose") & blank).over(by_pos).alias("par")).where("NOT prose OR line <> ''")
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    paragraphs = numbered.groupBy(*key, "prose", "par").agg(text_of.alias("text"))
    flowed = paragraphs.select(*key, "prose", "par", F.when(F.col("prose"), F.regexp_replace(F.regexp_replace("text", HYPHEN, ""), r"\s+", " ")).otherwise(F.col("text")).alias("text"))
    whole = flowed.groupBy(*key, "prose").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    wrong = misread_words(known.where("prose"), common).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "correct"))).alias("fix"))
    # Pieces are words and what lies between them, so that putting them together again loses nothing.
    edge = rf"[{_MARKS}]|@(?=\p{{L}}{{2,}}\d)"
    pieces = F.split("text", rf"(?<={edge})|(?={edge})")
    cased = lambda w, fix: F.when(F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)), F.concat(F.upper(F.substring(fix, F.lit(1), F.lit(1))), F.substring(fix, F.lit(2), F.length(fix)))).otherwise(fix)
    mended = F.transform(pieces, lambda w: F.coalesce(cased(w, F.element_at("fix", F.lower(w))), w))
    return whole.join(wrong, key, "left").select(*key, F.when(F.col("fix").isNull(), F.col("text")).otherwise(F.array_join(mended, "")).alias("text"), F.col("prose").alias("repaired"))
