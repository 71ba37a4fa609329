"""Sentence boundaries across languages and scripts (problem 10).

Document-centred disambiguation. Whether a full stop after a word ends a sentence is told by what the same document
says where it is not ambiguous: a word whose stop is followed by a word in lower case is an abbreviation, one whose stop
ends a paragraph can end a sentence, and a word with a capital in the middle of a sentence is a name. Where the document
says nothing, the corpus does (``corpus_evidence``): every word before a stop is counted with what follows the stop, and a
word whose stops end a paragraph, or precede a usual first word, far less often than those of other words is an
abbreviation, of the kind that stands
before names and numbers or of the kind that only lower case follows. There are no lists of abbreviations. Where the
corpus is too small to tell, the word's shape decides: initials, words with stops inside, short words without a vowel,
short words before a number. Each script has its own terminators; Thai, which has none, ends a unit at a space.

Defined results
---------------
* null, empty and blank texts have no units; units never begin or end with white space, never overlap and are given in
  code points of the text from 0, the end exclusive;
* a blank line ends a unit, a single line break does not; if the first line of a paragraph is a list entry, each of its
  entries, with its marker and any line that continues it, is a unit;
* quoted speech with the words that introduce or follow it is one unit; brackets around a sentence belong to it;
* a quotation or bracket that is never closed reaches to the end of the text if it opens in its last paragraph, and is
  an ordinary sign elsewhere;
* repeated rows of an id are segmented each on its own; empty tables give no rows; whole texts, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.llm.spread import bounded_broadcast, spread
from signalbox.session import cut

#: An abbreviation's stops end a paragraph or precede a usual first word in at most this share of cases, and as many stops
#: as it has would do so that seldom, if it were any other word, with at most this chance.
MAX_ENDS, CHANCE = 0.01, 1e-4
#: A usual first word opens paragraphs at least this many times as often as it follows stops (as shares of either).
STARTS = 0.25
#: A short word, or one with stops inside, ends sentences if its stops do so for certain in this share of cases.
MIN_ENDS = 0.05
#: Words of the corpus evidence (some 20 bytes each) that may be broadcast; more are joined to the texts.
BROADCAST_WORDS = 200_000

# Months, which follow an ordinal number.
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember january february march may june july october "
    "december jänner jan feb mär apr jun jul aug sep sept okt oct nov dez dec".split()
)
# Verbs that follow quoted speech and its speaker.
SPEECH = frozenset("asked said shouted replied answered cried called added whispered says asks fragte sagte rief dit demanda répondit cria preguntó dijo gritó respondió".split())

_OPEN, _CLOSE = "“«„「『(（[《〈【‹", "”»“」』)）]》〉】›"
_PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "〈": "〉", "【": "】", "‹": "›"}
_STOPS = ".!?…。．！？｡؟।॥۔"
_SIGNS = regex.compile(rf"[{_STOPS}]+|[{regex.escape(_OPEN + _CLOSE)}\"]|(?<=[\p{{Thai}}])[^\S\n]+\n?[^\S\n]*(?=\p{{L}})")
_BLANK = regex.compile(r"\r?\n[^\S\n]*\n\s*")
_ENTRY = regex.compile(r"[^\S\n]*(?:[-•*‣◦▪–]|\(?\d{1,3}[.)]|\(?[A-Za-z]\))[^\S\n]+(?=\S)")
_WORD = regex.compile(r"[\p{L}\p{M}’'-]+")
_PART = regex.compile(r"[\p{L}\p{M}\p{N}.’'ªº-]")
_CHINESE_TAIL = regex.compile(r"[\p{Han}]*[说问道喊叫答](?!\p{Han})")
_LOWER_AFTER = regex.compile(r"(?<![\p{L}\p{M}\p{N}.-])([\p{L}\p{M}\p{N}.ªº-]*+)(?<=[\p{L}\p{M}]\.)\s+\p{Ll}")
_CLOSING = regex.compile(r"(?<![\p{L}\p{M}\p{N}.-])([\p{L}\p{M}\p{N}.ªº-]*+)(?<=[\p{L}\p{M}]\.)[^\S\n]*\r?\n[^\S\n]*\n")
_NO_VOWEL = regex.compile(r"[bcdfghjklmnpqrstvwxzß]{1,4}")
_NAME_INSIDE = regex.compile(r"\p{Ll}[,;]?\s+(\p{Lu}[\p{L}\p{M}’'-]+)")


#: What is known of a word before a stop: it stands before names and numbers, stands inside sentences, or ends them.
TITLE, INSIDE, ENDS = "title", "inside", "ends"


def _key(word: str) -> str:
    """A word before a stop as the evidence has it: in lower case, without the elision before it (l’art.)."""
    low = word.lower().removesuffix(".").strip("-'’")
    return regex.split("[’']", low)[-1] if "’" in low or "'" in low else low


def _closed(stack: list[tuple[str, int]], sign: str) -> int | None:
    """The place in the stack that ``sign`` closes."""
    for i in range(len(stack) - 1, -1, -1):
        if sign == '"' and stack[i][0] == '"' or sign in _PAIRS.get(stack[i][0], ""):
            return i
    return None


class Segmenter:
    """Finds the units of texts; ``evidence`` is that of the corpus: TITLE, INSIDE or ENDS by word in lower case."""

    def __init__(self, evidence: Mapping[str, str] | None = None):
        self.corpus = evidence or {}

    def units(self, text: str | None, evidence: Mapping[str, str] | None = None) -> list[tuple[int, int]]:
        """(start, end) of each unit; ``evidence`` stands for that of the corpus if it comes with the text."""
        if not text or text.isspace():
            return []
        if evidence is not None:
            self.corpus = evidence
        self.here = {_key(w) for w in _LOWER_AFTER.findall(text)}
        self.closing = {_key(w) for w in _CLOSING.findall(text)}
        self.names: set[str] | None = None
        self.last_word = (-1, -1)
        self.text = text
        out, at = [], 0
        for gap in [*_BLANK.finditer(text), None]:
            end = gap.start() if gap else len(text)
            self._paragraph(at, end, gap is None or not text[gap.end() :].strip(), out)
            at = gap.end() if gap else end
        return out

    def _add(self, a: int, b: int, out: list[tuple[int, int]]) -> None:
        t = self.text
        while a < b and t[a].isspace():
            a += 1
        while b > a and t[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))

    def _paragraph(self, a: int, b: int, last: bool, out: list[tuple[int, int]]) -> None:
        t = self.text
        while a < b and t[a].isspace():
            a += 1
        if _ENTRY.match(t, a, b):
            starts = [a]
            at = t.find("\n", a, b)
            while at >= 0:
                if _ENTRY.match(t, at + 1, b):
                    starts.append(at + 1)
                at = t.find("\n", at + 1, b)
            # A single entry of several lines is a paragraph that begins with a dash or number.
            if len(starts) > 1 or t.find("\n", a, b) < 0:
                for x, y in zip(starts, [*starts[1:], b], strict=True):
                    self._add(x, y, out)
                return
        self._running(a, b, last, out)

    def _running(self, a: int, b: int, last: bool, out: list[tuple[int, int]]) -> None:
        t, begin = self.text, a
        stack: list[tuple[str, int]] = []
        ignored: set[int] = set()
        if not last:
            ignored = self._unclosed(a, b)
        stopped = False  # the last sign but closing ones was a terminator inside the quotation or bracket now closing
        for m in _SIGNS.finditer(t, a, b):
            i, sign = m.start(), m.group()
            if i < begin or i in ignored:
                continue
            if sign[0] in _STOPS:
                end = m.end()
                if stack:
                    stopped = self._closes_next(end, b)
                    continue
                if self._ends(sign, i, end, begin, b):
                    self._add(begin, end, out)
                    begin = end
            elif sign[0].isspace():
                if not stack and "\n" not in sign:
                    self._add(begin, i, out)
                    begin = m.end()
            else:
                at = _closed(stack, sign)
                if sign == '"' and at is None and i > a and (t[i - 1].isdigit() or t[i - 1].isalpha()):
                    continue  # an inch sign or a stray quote
                if at is not None:
                    opened, where = stack[at]
                    del stack[at:]
                    if stack or not stopped:
                        continue
                    stopped = False
                    whole = not t[begin:where].strip()
                    if self._ends_after_quote(m.end(), b, whole, opened):
                        self._add(begin, m.end(), out)
                        begin = m.end()
                elif sign == '"' or sign in _OPEN:
                    stack.append((sign, i))
                    stopped = False
        self._add(begin, b, out)

    def _closes_next(self, end: int, b: int) -> bool:
        t = self.text
        while end < b and t[end].isspace():
            end += 1
        return end < b and t[end] in _CLOSE + '"'

    def _unclosed(self, a: int, b: int) -> set[int]:
        """Opening signs without a partner in the paragraph."""
        t, stack = self.text, []
        for m in _SIGNS.finditer(t, a, b):
            sign = m.group()
            if sign[0] in _STOPS or sign[0].isspace():
                continue
            at = _closed(stack, sign)
            if at is not None:
                del stack[at:]
            elif sign == '"' and m.start() > a and t[m.start() - 1].isalnum():
                continue
            elif sign == '"' or sign in _OPEN:
                stack.append((sign, m.start()))
        return {i for _, i in stack}

    def _ends_after_quote(self, end: int, b: int, whole: bool, opened: str) -> bool:
        t, at = self.text, end
        while at < b and t[at].isspace():
            at += 1
        if at >= b:
            return True
        n = t[at]
        if n.islower() or n in ",;:，、；：–—-と":
            return False
        if n in _STOPS:
            return False
        if opened in "([（":
            return True
        if whole and opened not in "（([":
            # Words that follow the speech: a speaker and a verb of saying.
            if n.isupper() and self._speaker(at, b):
                return False
            # A text cut off in the speaker's name or the verb.
            rest = t[at:b].split()
            if n.isupper() and b == len(t) and len(rest) <= 2 and rest[0].isalpha() and (len(rest) == 1 or any(v.startswith(rest[1]) for v in SPEECH)):
                return False
            if _CHINESE_TAIL.match(t, at, b):
                return False
        return True

    def _speaker(self, at: int, b: int) -> bool:
        """Whether a verb of saying is among the second to fourth words, before any mark."""
        for k, m in enumerate(_WORD.finditer(self.text, at, b)):
            if k > 3 or k and not self.text[last:m.start()].isspace():
                return False
            if k and m.group() in SPEECH:
                return True
            last = m.end()
        return False

    def _word_start(self, i: int, begin: int) -> int:
        """Where the run of letters, digits and joining marks before ``i`` begins; runs with many stops are walked once."""
        t, j = self.text, i
        while j > begin and ((c := t[j - 1]).isalnum() or c in ".’'-" or not c.isascii() and _PART.match(c)):
            j -= 1
            if j == self.last_word[0]:
                j = max(begin, self.last_word[1])
                break
        self.last_word = (i, j)
        return j

    def _evidence(self, low: str) -> str | None:
        """What document and corpus say of the stops of a word."""
        known = self.corpus.get(low)
        if low in self.here:
            return known if known == TITLE else INSIDE
        return ENDS if low in self.closing else known

    def _ends(self, sign: str, i: int, end: int, begin: int, b: int) -> bool:
        t, at = self.text, end
        while at < b and t[at].isspace():
            at += 1
        if at >= b:
            return True
        n = t[at]
        if n in _CLOSE and n not in _OPEN:
            return False
        if sign[0] in "。．！？｡؟।॥۔":
            return n not in ",，、"
        if n.islower() or n in ",;:)":
            return False
        if sign[0] in "!?":
            return at > end or n.isupper() or n in _OPEN + '"¿¡' or (n.isalpha() and not n.isupper())
        if "…" in sign or len(sign) > 1 and sign == "." * len(sign):
            return n.isalpha() or n in _OPEN + '"¿¡'
        return self._stop_ends(i, at, at == end, begin, b)

    def _stop_ends(self, i: int, at: int, touching: bool, begin: int, b: int) -> bool:
        t, n = self.text, self.text[at]
        start = self._word_start(i, begin)
        word = t[start:i].strip("-'’")
        low = _key(word)
        digits = low[-1:].isdigit()
        if touching:
            if n.isdigit() or n in "_@/-+=&%#\\":
                return False
            short = self._evidence(low) in (TITLE, INSIDE)
            if digits or "." in low or len(low) < 2 or not word[-1].islower() and n.isascii() or short:
                return not n.isascii() and n.isalpha() and len(low) > 1 and not short
            return n.isalpha() or n in _OPEN + '"¿¡'
        if not low:
            return True
        if "ऀ" <= low[-1] <= "ॿ":
            return False  # a stop after Devanagari marks an abbreviation; sentences end with the danda
        follows = _WORD.match(t, at)
        after = follows.group().lower() if follows else ""
        if low.isdigit() or digits and low.rstrip("0123456789") == "":
            if not t[begin:start].strip():
                return False  # the number of a heading
            if after in MONTHS:
                return False
            at_word = start
            while at_word > begin and t[at_word - 1].isspace():
                at_word -= 1
            before = t[self._word_start(at_word, begin) : at_word].lower()
            return not (before in ("am", "vom", "zum", "bis", "im", "der", "die", "das", "dem", "den", "des", "beim", "ab") and n.isupper())
        if len(low) == 1 and "a" <= low <= "z" and n.isupper() and t[max(begin, i - 2) : i - 1] == " " and t[max(begin, i - 3) : i - 2].isdigit():
            return True  # a unit after a number
        known = self._evidence(low)
        if known == ENDS:
            return True
        if known == TITLE:
            return False
        if known == INSIDE:
            if n.isdigit():
                return False
            if self.names is None:
                self.names = set(_NAME_INSIDE.findall(t))
            return not (follows and follows.group() in self.names)
        # Nothing is known: shapes of abbreviations.
        if len(low) == 1 or "." in low or _NO_VOWEL.fullmatch(low):
            return False
        return not (n.isdigit() and len(low) <= 4)


#: A word before a stop, and the word or sign after it or nothing at the end of the text; the first word of a paragraph.
_STOPPED = r"(?<![\p{L}\p{M}\p{N}.’'ªº-])([\p{L}\p{M}\p{N}.’'ªº-]*+(?<=[\p{L}\p{M}]\.)(?:\s+(?:[\p{L}\p{M}]+|\S)|\s*$))"
_OPENING = r"(?:\A|\n[^\S\n]*\n)\s*([\p{Lu}][\p{L}\p{M}]*)"


def _stopped(rows: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """(keys, word, kind, next) of each word before a stop in a text, as ``_key`` has it, once: the stop ends a paragraph,
    comes before lower case, or before another sign or word, the ``next`` one."""
    found = rows.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(_STOPPED), 1))).alias("m"))
    # The raw matches are taken apart after the explosion, where expressions are compiled and shared.
    cut_ = found.select(*keys, "m", F.lower(F.regexp_extract("m", r"^(.*?)\.(?:\s|$)", 1)).alias("w"), F.regexp_extract("m", r"\.\s+(\S+)$", 1).alias("next"))
    bare = F.when(F.col("w").rlike(r"['’-]"), F.regexp_replace("w", r"^.*['’](?=.)|^[-'’]+|[-'’]+$", "")).otherwise(F.col("w"))
    blank = F.contains("m", F.lit("\n")) & F.col("m").rlike(r"\n[^\S\n]*\n")
    kind = F.when((F.col("next") == "") | blank, "end").when(F.col("next").rlike(r"^\p{Ll}"), "low").otherwise("other")
    out = cut_.select(*keys, bare.alias("word"), kind.alias("kind"), "next")
    return out.select(*keys, "word", "kind", F.when(F.col("kind") == "other", F.col("next")).alias("next"))


def corpus_evidence(df: DataFrame, text_col: str) -> DataFrame:
    """(word, verdict): what the stops of all texts say of a word, where they say anything.

    A text counts once for a word and what follows it, and the copies of a text count as one together. A stop before a
    word that opens paragraphs about as often as it follows stops ends a sentence as well.
    """
    key = F.xxhash64(text_col)
    again = cut(df.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"))
    texts = df.select(key.alias("key"), F.col(text_col).alias("text"))
    weighed = texts.join(bounded_broadcast(again, again.count(), BROADCAST_WORDS), "key", "left").select((1 / F.coalesce("copies", F.lit(1))).alias("weight"), "text")
    opening = weighed.select("weight", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_OPENING), 1))).alias("next"))
    seen = _stopped(weighed, "text", "weight").unionAll(opening.select("weight", F.lit("").alias("word"), F.lit("open").alias("kind"), "next"))
    counted = cut(seen.groupBy("word", "kind", "next").agg(F.sum("weight").alias("n")))
    total = {r.kind: r.n for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    opens, stops = total.pop("open", 0.0), sum(total.values())
    by = lambda k: F.sum(F.when(k, F.col("n")).otherwise(0.0))
    words = counted.where(F.col("next").rlike(r"^\p{Lu}")).groupBy("next").agg(by(F.col("kind") == "open").alias("o"), by(F.col("kind") == "other").alias("f"))
    starters = words.where((F.col("o") >= 3) & (F.col("o") * stops >= F.col("f") * opens * STARTS)).select("next", F.lit(True).alias("starts"))
    marked = counted.where("kind <> 'open'").join(starters, "next", "left")
    ends = (F.col("kind") == "end") | F.col("starts").isNotNull()
    words = cut(marked.groupBy("word").agg(F.sum("n").alias("n"), by(ends).alias("ends"), by(F.col("kind") == "low").alias("low")))
    cased = F.col("word").rlike(r"\p{Ll}")
    # How often any word's stops end a sentence for certain, in scripts with and without case: two rows.
    usual = {r.cased: r.ends / r.n for r in words.groupBy(cased.alias("cased")).agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).collect()}
    rate = lambda c: math.log(1 - min(usual.get(c, 0.0), 0.99))
    seldom = F.col("n") * F.when(cased, rate(True)).otherwise(rate(False)) <= math.log(CHANCE)
    few = F.col("ends") <= F.col("n") * MAX_ENDS
    kind = F.when(few & seldom, F.when(F.col("n") - F.col("ends") - F.col("low") > F.col("n") * 0.05, TITLE).otherwise(INSIDE))
    short = (F.length("word") <= 4) | F.contains("word", F.lit("."))
    kind = kind.otherwise(F.when(short & (F.col("ends") >= 2) & (F.col("ends") >= F.col("n") * MIN_ENDS), ENDS))
    return words.select("word", kind.alias("verdict")).where("verdict IS NOT NULL AND word <> ''")


def split_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, start_pos, end_pos) of each unit of each text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"\S"))
    evidence = cut(corpus_evidence(rows, "text"))
    shared = None
    if evidence.count() <= BROADCAST_WORDS:
        shared = df.sparkSession.sparkContext.broadcast({r.word: r.verdict for r in evidence.collect()})
        rows = spread(rows)
    else:  # each text takes along what is known of its own words
        keyed = rows.withColumn("key", F.xxhash64("text"))
        own = _stopped(keyed, "text", "key").select("key", "word").distinct()
        own = own.join(evidence, "word").groupBy("key").agg(F.collect_list(F.struct("word", "verdict")).alias("evidence"))
        rows = keyed.join(own, "key", "left").select("id", "text", "evidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Segmenter(shared.value if shared else None).units
        for batch in batches:
            take, starts, ends = [], [], []
            known = [None] * len(batch) if shared else [{x["word"]: x["verdict"] for x in e or ()} for e in batch.column(2).to_pylist()]
            for i, text in enumerate(batch.column(1).to_pylist()):
                for a, b in units(text, known[i]):
                    take.append(i)
                    starts.append(a)
                    ends.append(b)
            ids = batch.column(0).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "start_pos", "end_pos"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start_pos int, end_pos int").withColumnRenamed("id", id_col)
