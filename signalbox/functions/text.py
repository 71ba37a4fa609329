"""Text functions as Column expressions: normalising, terms, readability, stamps, answers.

ASCII classes are written out (``[A-Za-z0-9_]``, ``[ \\t\\n\\r\\f\\x0b]``) because ``\\w``, ``\\s`` and ``\\b`` differ
between regex engines. Null texts behave like empty ones unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms.
STOPWORDS = (
    "the a an of in on for to is are was were be been and or what which who whom how why when where does do did can could should "
    "would will shall may might must give tell show list find any its it his her their there that this these those from with as at "
    "by per not no yes about into over under please"
).split()
MAX_TERMS = 12

# Stamps that scanning programs leave on a page.
STAMPS = (
    r"(?i)(?<![A-Za-z0-9_])Scanned (?:by|with) CamScanner(?![A-Za-z0-9_])",
    r"(?i)(?<![A-Za-z0-9_])CamScanner(?![A-Za-z0-9_])",
    r"(?i)(?<![A-Za-z0-9_])Scan.{0,3}ed? with (?:a )?(?:Scanner|Adobe Scan)(?![A-Za-z0-9_])",
    r"(?i)(?<![A-Za-z0-9_])Adobe Scan(?![A-Za-z0-9_])",
    r"(?i)^\s*(?:Generated by|Powered by) .{0,40}(?:Scanner|Scan)\s*$",
    r"-{2,}\s*Page \d+\s*-{2,}",
)
STAMP_PAGE_CHARS, STAMP_LEFT_CHARS = 60, 8
READABLE_SHARE, READABLE_MEAN = 0.6, 3.0

# Openings that refer back to the question before.
FOLLOW_UP = r"(?i)^(?:and|also|its|it's|it|they|their|them|that|this|those|these|same|so|then|what about|how about)(?![A-Za-z0-9_])"
BACK_REFERENCE = r"(?i)(?<![A-Za-z0-9_])(?:it|its|itself|their|them|same|above|earlier|aforementioned)(?![A-Za-z0-9_])"
FOLLOW_UP_CHARS = 150
# How reasoning that leaked into an answer begins.
REASONING = (
    r"(?i)^\s*(?:(?:let me|the user|i need to|i should|i'll|i will)(?![A-Za-z0-9_])|first(?:ly)?(?![A-Za-z0-9_])[,:\s]*(?:i|we|let)(?![A-Za-z0-9_])"
    r"|looking at (?:the )?(?:passages?|context)(?![A-Za-z0-9_])|to answer (?:this |the )?question(?![A-Za-z0-9_]))"
)
FILLER = r"(?i)^\s*(?:okay+|alright|hm+|sure|well)(?![A-Za-z0-9_])[^A-Za-z0-9_\n]*\s*"
REASONING_GLUED = (
    "letme theuser ineedto ishould iwill firsti firstwe firstlet lookingatthe lookingatpassages lookingatcontext "
    "toanswerthisquestion toanswerthequestion tacklethisquestion"
).split()
QUESTION_WORDS = (
    r"(?i)^(?:what|who|whom|whose|which|why|how|when|where|explain|describe|define|list|summarize|summarise|compare|give|tell|show|"
    r"state|mention|is|are|was|were|does|do|did|can|could|should|would|will)(?![A-Za-z0-9_])"
)


def text_of(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", " "))


def normalize_extracted(c: Column) -> Column:
    """Line ends, blanks and blank lines of extracted text made uniform."""
    out = F.regexp_replace(text_of(c), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\u00a0]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def search_text(c: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", " "))


def question_key(c: Column) -> Column:
    """Lower case, everything but letters and digits of any script as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), r"[^\p{L}\p{N}]+", " "))


def terms(c: Column, limit: int | None = MAX_TERMS) -> Column:
    """The distinct search terms in order of appearance: two characters or more, no stopwords."""
    pieces = F.filter(
        F.split(F.lower(text_of(c)), "[^a-z0-9]+"),
        lambda t: (F.length(t) >= 2) & (t.rlike("[0-9]") | ~t.isin(STOPWORDS)),
    )
    once = F.array_distinct(pieces)
    return once if limit is None else F.slice(once, 1, limit)


def or_query(c: Column) -> Column:
    """The terms as a keyword query: quoted and joined by OR."""
    return F.array_join(F.transform(terms(c), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(text_of(c)), r"\s+"), lambda w: w != "")


def readable_share(c: Column) -> Column:
    """Share of words of two characters or more that are mostly letters and digits."""
    long = F.filter(_words(c), lambda w: F.length(w) >= 2)
    good = F.filter(long, lambda w: F.length(F.regexp_replace(w, r"[^a-z0-9ऀ-ॿ؀-ۿ]", "")) * 10 >= F.length(w) * 6)
    return F.when(F.size(long) > 0, F.size(good).cast("double") / F.size(long)).otherwise(F.lit(0.0))


def is_readable(c: Column) -> Column:
    """Whether a text reads as words and not as recognition noise."""
    words = _words(c)
    mean = F.length(F.array_join(words, "")).cast("double") / F.size(words)
    return F.when(F.size(words) == 0, F.lit(False)).otherwise((readable_share(c) >= READABLE_SHARE) & (mean >= READABLE_MEAN))


def is_stamp_only(c: Column) -> Column:
    """Whether a page's text is nothing but stamps of a scanning program."""
    value = F.trim(text_of(c))
    left = value
    for pattern in STAMPS:
        left = F.regexp_replace(left, pattern, " ")
    left = F.trim(F.regexp_replace(left, r"[\s\-–—_=*~]+", " "))
    short = (F.length(value) <= STAMP_PAGE_CHARS) & ~is_readable(left)
    return (F.length(left) < STAMP_LEFT_CHARS) | short


def hard_split(c: Column, size: int) -> Column:
    """Slices of ``size`` characters."""
    return F.when(F.length(c) <= size, F.array(c)).otherwise(
        F.transform(F.sequence(F.lit(0), F.length(c) - 1, F.lit(size)), lambda i: F.substring(c, i + 1, F.lit(size)))
    )


def sentences(c: Column) -> Column:
    """Runs up to end marks, collapsed; a text without any run is its own sentence."""
    runs = F.regexp_extract_all(text_of(c), F.lit(r"([^.!?\n]+[.!?]*\s*)"), 1)
    whole = F.when(F.size(runs) > 0, runs).otherwise(F.array(text_of(c)))
    return F.filter(F.transform(whole, collapse), lambda s: s != "")


def metadata_lines(number: Column, title: Column, keywords: Column) -> Column:
    """One line for each metadata field that is set."""
    line = lambda label, c: F.when(text_of(c) != "", F.concat(F.lit(f"{label}: "), c))
    return F.array_compact(F.array(line("Document number", number), line("Title", title), line("Keywords", keywords)))


def metadata_text(number: Column, title: Column, keywords: Column, limit: int | None = MAX_TERMS) -> Column:
    """The searchable terms of each metadata line, one line each; all of them where ``limit`` is None."""
    lines = F.transform(metadata_lines(number, title, keywords), lambda x: F.array_join(terms(x, limit), " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def embedding_text(number: Column, title: Column, keywords: Column, content: Column) -> Column:
    """Metadata lines before the content."""
    return F.array_join(F.concat(metadata_lines(number, title, keywords), F.array(text_of(content))), "\n")


def has_reasoning_head(c: Column) -> Column:
    """Whether an answer opens like reasoning, after a filler word or glued together as well."""
    head = F.regexp_replace(text_of(c), FILLER, "")
    glued = F.regexp_replace(F.lower(head), "[^a-z0-9]+", "")
    return head.rlike(REASONING) | F.exists(F.array(*[F.lit(p) for p in REASONING_GLUED]), lambda p: F.startswith(glued, p))


def strip_thinking(c: Column) -> Column:
    """An answer without its reasoning: tagged, half-tagged, or untagged."""
    value = F.regexp_replace(text_of(c), r"(?is)<think>.*?</think>", "")
    closed = F.regexp_replace(value, r"(?is)^.*?</think>", "")
    opened = F.regexp_replace(value, r"(?is)<think>.*$", "")
    out = (
        F.when(value.rlike("(?i)</think>"), closed)
        .when(value.rlike("(?i)<think>"), opened)
        .when(value.rlike(REASONING), F.lit(""))
        .otherwise(value)
    )
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def clean_answer(c: Column, labels: Column) -> Column:
    """An answer without reasoning and markers: ``[n]`` becomes the n-th label, clusters vanish, punctuation is mended."""
    value = F.regexp_replace(strip_thinking(c), r"\[\d+\](?:\s*\[\d+\])+", "")
    numbered = F.zip_with(labels, F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda label, i: F.struct(label.alias("label"), i.alias("i")))
    value = F.aggregate(numbered, value, lambda acc, x: F.replace(acc, F.concat(F.lit("["), x["i"].cast("string"), F.lit("]")), text_of(x["label"])))
    for pattern, by in (
        (r"\[\d+\]", ""),
        (r"\s+([,.;:])", "$1"),
        (r",\s*(?=[,.;:])", ""),
        (r",\s*,", ", "),
        (r"(?i)(?<![A-Za-z0-9_])(are|is|was|were)\s*,\s*(?=[a-z])", "$1 "),
        (r"[ \t]{2,}", " "),
    ):
        value = F.regexp_replace(value, pattern, by)
    return F.trim(value)


def is_cacheable(answer: Column, truncated: Column) -> Column:
    """Whether an answer may be served again: not empty, not cut off, no reasoning."""
    value = F.trim(text_of(answer))
    return (value != "") & ~F.coalesce(truncated, F.lit(False)) & ~has_reasoning_head(value)


def standalone_question(question: Column, previous: Column) -> Column:
    """A question that leans on the one before gets it in front."""
    prior = F.trim(text_of(previous))
    leans = question.rlike(FOLLOW_UP) | (question.rlike(BACK_REFERENCE) & (F.length(question) < FOLLOW_UP_CHARS))
    return F.when((prior != "") & (prior != question) & leans, F.concat(prior, F.lit(" — "), question)).otherwise(question)


def is_bare_term(c: Column) -> Column:
    """Whether a question is one to three words and no question."""
    words = F.size(F.filter(F.split(F.trim(text_of(c)), r"\s+"), lambda w: w != ""))
    return words.between(1, 3) & ~F.contains(text_of(c), F.lit("?")) & ~F.trim(text_of(c)).rlike(QUESTION_WORDS)


def answer_tokens(c: Column) -> Column:
    """Words with the space after them, as an answer is replayed."""
    return F.regexp_extract_all(text_of(c), F.lit(r"(\S+\s*)"), 1)


def cache_key(settings: Sequence[object], search: Column, question: Column) -> Column:
    """SHA-256 over the settings and both normalised questions."""
    head = "|".join(str(s) for s in settings)
    return F.sha2(F.concat(F.lit(head + "\n"), question_key(search), F.lit("\n"), question_key(question)), 256)


def is_upperish(c: Column) -> Column:
    """Whether there are letters and all are capitals."""
    letters = F.regexp_replace(text_of(c), "[^A-Za-z]", "")
    return (letters != "") & (letters == F.upper(letters))


def roman_chapter(c: Column, most: int = 18) -> Column:
    """A chapter's roman numeral (an L read for an I counts as one) or number, up to ``most``; else null."""
    word = F.replace(F.translate(F.upper(F.trim(text_of(c))), "L", "I"), F.lit("."), F.lit(""))
    numerals = F.array(*[F.lit(_roman(i)) for i in range(1, most + 1)])
    at = F.array_position(numerals, word)
    return F.when(at > 0, at.cast("int")).when(word.rlike("^[0-9]{1,2}$"), word.cast("int"))


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + sign, n - value
    return out


def plain_quotes(c: Column) -> Column:
    """Curly quotes and no-break spaces as plain ones, white space collapsed."""
    return collapse(F.translate(text_of(c), "‘’“”\u00a0", "''\"\" "))


def natural_key(c: Column) -> Column:
    """A key that sorts numbers inside text by value: digit runs padded to twelve places, letters in lower case."""
    runs = F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]+$"), F.lpad(r, 12, "0")).otherwise(r)), "")
