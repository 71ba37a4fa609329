import pytest
from pyspark.sql import functions as F

from signalbox.llm import scan_noise as S

COMMON = {"en": ["the", "of", "and", "is", "in", "was", "for"], "fr": ["le", "la", "de", "est", "en"]}


def rows(spark, data):
    df = spark.createDataFrame(data, "id bigint, source string, page int, chunk_index int, content string, lang string")
    return S.passages(df, "t", "id", "source", "content", ["page", "chunk_index", "content"])


def sentence(i):
    return f"The brake valve of the coach number {i} was tested and the valve is sound. The guard of the train is in the coach."


def base(n=40):
    return [(1000 + i, f"s{i}", 1, 0, sentence(i), "clash") for i in range(n)]


def found(spark, extra):
    out = {}
    for r in S.find_noise(rows(spark, base() + extra), COMMON).collect():
        if r.row_id < 1000:
            out.setdefault(r.row_id, set()).add(r.noise)
    return out


def test_each_kind_and_traps(spark):
    text = sentence(1)
    got = found(
        spark,
        [
            (1, "a", 1, 0, "The brake va-\nlve of the coach is sound and was tested.", "x"),
            (2, "a", 1, 1, "The guard –\nunless he is in the coach – is sound and was tested for the day.", "x"),
            (3, "b", 1, 0, "The brakc va|ve of the coach was tested and is sound.", "x"),
            (4, "c", 1, 0, "Depot Library · SWI-00000001\n" + text + "\nPage 3 of 7", "x"),
            (5, "c", 2, 0, text.replace("number 1", "number 77") + "\nDEPOT LIBRARY ·  SWI-00000001 .", "x"),
            (6, "d", 1, 0, "Rare Title · SWI-00000002\n" + text, "x"),
            (7, "d", 1, 0, "Rare Title · SWI-00000002\n" + text, "x"),  # the same passage stored again
            (8, "e", 1, 0, "- item\n- other item\n- third 9\n- 4\nPage 3", "x"),
            (9, None, None, None, None, None),
            (10, "f", 1, 0, "   ", "x"),
            (11, None, 1, 0, "- 12 -\n" + text, "x"),
        ],
    )
    assert got == {1: {"hyphen"}, 3: {"chars"}, 4: {"header", "page_no"}, 5: {"header"}, 11: {"page_no"}}


def test_repeated_rows_and_empty(spark):
    twice = [(1, "a", 1, 0, "The brake va-\nlve of the coach is sound and was tested.", "x")] * 2
    out = S.find_noise(rows(spark, base() + twice), COMMON)
    assert out.where("row_id = 1").count() == 1
    assert S.find_noise(rows(spark, []), COMMON).count() == 0


def test_repair(spark):
    text = "Depot Library · SWI-00000001\nThe brakc va-\nlve of the coach was tested and\nis sound.\n\nPage 2\nThe guard is in the coach."
    data = base() + [(1, "a", 1, 0, text, "x"), (2, "a", 2, 0, "Depot Library · SWI-00000001\n" + sentence(3), "x")]
    got = {r.row_id: r.text for r in S.repair(rows(spark, data), COMMON).where(F.col("row_id") < 1000).collect()}
    assert got[1] == "The brake valve of the coach was tested and is sound.\n\nThe guard is in the coach."
    assert got[2] == sentence(3)


@pytest.mark.parametrize(("a", "b", "want"), [("between", "bctween", True), ("motor", "rnotor", True), ("head", "bead", True), ("bearing", "bearmg", True), ("décider", "d6cider", True), ("brake", "b·r@ke", True), ("brake", "brave", False), ("light", "lighten", False), ("", "", True)])
def test_explained(a, b, want):
    assert S.explained(a, b) is want


def test_very_long_passage(spark):
    text = " ".join(sentence(i) for i in range(2000)) + "\nThe end is in the coa-\nch of the train."
    assert found(spark, [(1, "a", 1, 0, text, "x")]) == {1: {"hyphen"}}


def test_hot_copies_count_once(spark):
    damaged = "The brakc va|ve of the coach was tested and is sound."
    hot = [(i, "hot", 1, 0, damaged, "x") for i in range(1, 31)] + [(31, None, 1, 0, damaged, "x"), (32, None, 1, 0, damaged, "x")]
    other = [(40, "other", 1, 0, "The guard of the coach and the brakc va|ve is in the train.", "x")]
    data = hot + other
    assert found(spark, data) == {i: {"chars"} for i in [*range(1, 33), 40]}
    got = {r.row_id: r.text for r in S.repair(rows(spark, base() + data), COMMON).where(F.col("row_id") < 1000).collect()}
    assert got[1] == got[32] == "The brake valve of the coach was tested and is sound."
    assert got[40] == "The guard of the coach and the brake valve is in the train."


def test_first_copies(spark, monkeypatch):
    df = spark.createDataFrame([("t", "a", 1, 0), ("t", "a", 1, 5), ("t", None, 1, 1), ("t", None, 1, 2), ("u", "a", 1, 3), ("t", "a", 2, 4)], "table_name string, grp string, copy bigint, at bigint")
    for limit in (S.BROADCAST_ROWS, 0):
        monkeypatch.setattr(S, "BROADCAST_ROWS", limit)
        assert sorted(r.at for r in S.with_first(df).where("first").collect()) == [0, 1, 3, 4]


def test_repair_of_repeated_rows_long_words_and_other_passages(spark):
    text = "The brakc valve is sound and\nwas tested."
    listed = "- item\n- other item\n- third 9\n\n- 4\nPage 3"
    data = base() + [(1, "a", 1, 0, text, "x")] * 3 + [(2, "b", 1, 0, listed, "x")] * 2 + [(3, "c", 1, 0, None, "x")]
    rows_ = S.repair(rows(spark, data), COMMON).where(F.col("row_id") < 1000).collect()
    assert sorted((r.row_id, r.text, r.repaired) for r in rows_) == [(1, "The brake valve is sound and was tested.", True), (2, listed, False)]


def test_long_header(spark):
    title = "Depot Library of the Northern Division · SWI-00000001 · " + "Traction And Rolling Stock · " * 8 + "Volume"
    assert len(title) > 250
    got = found(spark, [(1, "c", 1, 0, title + "\n" + sentence(1), "x"), (2, "c", 2, 0, title + "\n" + sentence(77), "x")])
    assert got == {1: {"header"}, 2: {"header"}}


def test_context_decides(spark, monkeypatch):
    """300 rare words look like a frequent form: half of them stand where the form stands and are misread, half stand
    elsewhere and are words. Without context all are taken for misreadings."""
    letters = "bcdfgjkpqrstvz"
    stems = [a + "a" + b + "o" + c for a in letters[:8] for b in letters[:8] for c in letters[8:]][:300]
    data = []
    for i, stem in enumerate(stems):
        form, rare = stem + "ehl", stem + "chl"
        known = f"The guard of the train is at the {form} valve{i} and is in the coach. "
        data += [(10_000 + 20 * i + j, "g", i, j, known * 11, "x") for j in range(4)]
        odd = known.replace(form, rare) if i % 2 else f"Some {rare} sings in the wood{i} for the day and is in the hall. "
        data += [(10_000 + 20 * i + 15, "g", i, 99, odd * 4, "x")]
    data += [(900_000 + i, "h", i, 0, "Some old bird sings in the wood for the day and is in the hall. " * 10, "x") for i in range(200)]
    every = S.judged(rows(spark, data), COMMON).where("prose")
    count = lambda: {r.word for r in S.misread_words(every, COMMON).select("word").distinct().collect()}
    want = {s + "chl" for i, s in enumerate(stems) if i % 2}
    got = count()
    assert len(got & want) > 140 and len(got - want) < 15
    monkeypatch.setattr(S, "support", lambda *_: 0.0)
    assert len(count()) > 290


def test_mail_address(spark):
    got = found(spark, [(1, "a", 1, 0, sentence(3) + " The guard of the train is at va|ve@yard50 and the coach is in the yard. " + sentence(4), "x")])
    assert got == {1: {"chars"}}


def test_hot_passage_in_two_languages(spark):
    text = "The brakc valve is in the coach. Le brakc est en la gare de Lyon et la gare est en fer."
    fr = [(2000 + i, f"f{i}", 1, 0, "Le brake est en la gare de Lyon et la gare est en fer.", "x") for i in range(30)]
    got = {r.row_id: r.text for r in S.repair(rows(spark, base() + fr + [(1, "a", 1, 0, text, "x")]), COMMON).where(F.col("row_id") < 1000).collect()}
    assert got[1] == text.replace("brakc", "brake")
