import pytest

from signalbox.operators.packed import split_packed

CASES = [
    ("a,b", ["a", "b"]),
    ('"a,b"; c', ["a,b", "c"]),
    ('3/4" hose, x', ['3/4" hose', "x"]),
    ("driver's desk | 'a | b'", ["driver's desk", "a | b"]),
    ('drawing 1222,3/4" hose', ["drawing 1222", '3/4" hose']),
    ("drawing 1222,12,75 kV", ["drawing 1222", "12,75 kV"]),
    ('"valve ""C"" seat"\t«c;d»\n“e”', ['valve "C" seat', "c;d", "e"]),
    ('"unclosed, b', ['"unclosed', "b"]),
    ('  "x" ,, y', ["x", "y"]),
    ('"" ; z', ["z"]),
    ("AC/DC / Q&A", ["AC/DC", "Q&A"]),
    ("A;a;A", ["A", "a", "A"]),
    ("x、y，z • w · v", ["x", "y", "z", "w", "v"]),
    ("1234567890123,5 mm, x", ["1234567890123,5 mm", "x"]),
    ("1,2,3", ["1,2,3"]),
    (";" + " " * 90 + '"p, q"; r', ["p, q", "r"]),
    (" " * 90 + '"p, q"', ["p, q"]),
    ("a\ue000b, \uf8ff;\ue001\ue000\ue002", ["a\ue000b", "\uf8ff", "\ue001\ue000\ue002"]),
    ("\"it''s\", 'so \"\"x'' y'", ["it''s", "so \"\"x' y"]),
    ("", []),
    ("  ;, ", []),
    (None, []),
    ("x" * 60_000 + ';"' + "y" * 60_000 + '"', ["x" * 60_000, "y" * 60_000]),
]


def test_pieces(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, t string")
    got = {}
    for r in split_packed(df, "t").collect():
        got.setdefault(r.id, []).append((r.pos, r.value))
    for i, (text, want) in enumerate(CASES):
        assert sorted(got.get(i, [])) == list(enumerate(want, 1)), text


def test_clashing_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([("k", "a,b", "old", 9)] * 2, "`my id` string, t string, value string, pos int")
    out = split_packed(df, "t")
    assert out.columns == ["my id", "t", "pos", "value"] and out.count() == 4
    assert split_packed(df.limit(0), "t").count() == 0


@pytest.mark.parametrize("quote", ['"', "'"])
def test_round_trip(spark, quote):
    values = ["a b", "c, d", "e;f|g", "h"]
    text = " ; ".join(f"{quote}{v}{quote}" for v in values)
    rows = split_packed(spark.createDataFrame([(text,)], "t string"), "t").orderBy("pos").collect()
    assert [r.value for r in rows] == values
