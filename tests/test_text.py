import pytest
from pyspark.sql import functions as F

from signalbox.functions import text as T
from signalbox.functions.porter import stem
from signalbox.operators import chunking, fuzzy


def one(spark, build, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(build(*[F.col(n) for n in names]).alias("x")).first().x


def test_terms(spark):
    assert one(spark, T.terms, "What is the VCB of SMI-900, the VCB?") == ["vcb", "smi", "900"]
    assert one(spark, T.or_query, "oil pump") == '"oil" OR "pump"'
    assert one(spark, T.terms, None) == []


def test_readable(spark):
    assert not one(spark, T.is_readable, "4) A =F न > iv) ¢ eC")
    assert one(spark, T.is_readable, "Bearing caps are checked with feeler gauges.")
    assert not one(spark, T.is_readable, "")


def test_stamps(spark):
    for text, want in (("Scanned by CamScanner Scanned by CamScanner", True), ("-- Page 4 --", True), ("", True), ("Scanned by CamScanner\nBearing caps are checked during routine exams.", False)):
        assert one(spark, T.is_stamp_only, text) is want


def test_metadata(spark):
    build = lambda n, t, k: T.embedding_text(n, t, k, F.lit("page"))
    assert one(spark, build, "SMI-900", "Power transformer", "oil, winding") == "Document number: SMI-900\nTitle: Power transformer\nKeywords: oil, winding\npage"
    assert {"900", "transformer", "winding"} <= set(one(spark, T.metadata_text, "SMI-900", "Power transformer", "oil, winding").split())
    assert one(spark, build, None, "", None) == "page"


@pytest.mark.parametrize(("answer", "cacheable"), [("The VCB is the breaker.", True), ("", False), ("Let me think about it", False), (",letmetacklethisquestion.Theuser", False), ("Okay, I need to see", False), ("Okay, DGA stands for gas analysis.", True)])
def test_cacheable(spark, answer, cacheable):
    assert one(spark, lambda c: T.is_cacheable(c, F.lit(False)), answer) is cacheable
    assert one(spark, lambda c: T.is_cacheable(c, F.lit(True)), answer) is False


def test_answers(spark):
    assert one(spark, T.strip_thinking, "<think>a</think> b") == "b"
    assert one(spark, T.strip_thinking, "a</think> b") == "b"
    assert one(spark, T.strip_thinking, "b <think> cut") == "b"
    assert one(spark, lambda c: T.clean_answer(c, F.array(F.lit("SMI-1"))), "As [1] says , it is [1][2] so [9].") == "As SMI-1 says, it is so."
    assert one(spark, T.is_bare_term, "VCB test") and not one(spark, T.is_bare_term, "What is it")


def test_follow_up(spark):
    assert one(spark, T.standalone_question, "and its torque?", "What is VCB?") == "What is VCB? — and its torque?"
    assert one(spark, T.standalone_question, "What is DGA?", "What is VCB?") == "What is DGA?"
    assert one(spark, T.standalone_question, "and its torque?", None) == "and its torque?"


def test_cache_key_ignores_wording(spark):
    key = lambda c: T.cache_key(("v3", 1), c, c)
    assert one(spark, key, "What is VCB?") == one(spark, key, "what is  vcb") != one(spark, key, "what is dga")


def test_roman_and_natural(spark):
    assert [one(spark, T.roman_chapter, x) for x in ("l", "IV", "XVIII", "XX", "7")] == [1, 4, 18, None, 7]
    assert sorted(["A-10", "a-9", "B"], key=lambda x: one(spark, T.natural_key, x)) == ["a-9", "A-10", "B"]


def model_chunks(text, size, overlap):
    import re

    text = re.sub(r"\s+", " ", text).strip()
    out, cur = [], ""
    for s in [re.sub(r"\s+", " ", m).strip() for m in re.findall(r"[^.!?\n]+[.!?]*\s*", text)]:
        for p in [s[i : i + size] for i in range(0, len(s), size)]:
            if cur and len(cur) + 1 + len(p) > size:
                out.append(cur)
                cur = (cur[-overlap:] + " " + p) if overlap else p
            else:
                cur = f"{cur} {p}" if cur else p
    return [re.sub(r"\s+", " ", c).strip() for c in [*out, cur] if c.strip()]


@pytest.mark.parametrize("overlap", [0, 5, 20])
def test_chunks(spark, overlap):
    for text in ("Rule 1.01 applies. " * 9, "x" * 95, "", "A. Bb! Ccc? " * 20 + "tail without end", "   "):
        assert one(spark, lambda c: chunking.chunks(c, 40, overlap), text) == model_chunks(text, 40, overlap)


def test_osa_and_search(spark):
    assert fuzzy.osa("teh", "the") == 1 and fuzzy.osa("ca", "abc") == 3 and fuzzy.osa("", "abc") == 3
    docs = spark.createDataFrame([(1, "brake valve"), (2, "Brake pad"), (3, "SMI-900 valve"), (4, None)], "id int, t string")
    found = lambda q: [r.id for r in fuzzy.search(docs, "id", ["t"], q, [F.col("id")]).collect()]
    assert found("brkae") == [1, 2] and found("valve brake") == [1] and found("901") == [] and found("900") == [3]


def test_stems():
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "conditional", "adjustment", "oscillators", "is")] == ["caress", "poni", "relat", "hop", "condit", "adjust", "oscil", "is"]
