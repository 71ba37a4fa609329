import numpy as np
from pyspark.sql import functions as F

from signalbox.llm import collapse as C


def canon(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.c for r in df.select("i", C.canonical(F.col("t")).alias("c")).orderBy("i").collect()]


def test_canonical_forms(spark):
    a = canon(spark, "Who signs  SWI-1?", "who signs swi_1", "WHO SIGNS SWI 1!", "who signs 1 swi")
    assert a[0] == a[1] == a[2] != a[3]
    b = canon(spark, "unit: A-1 | part: oil pump | to: X", "to=X; part = Oil Pump;unit=a 1;", "PART: OIL PUMP\nTO: X\nUNIT: A-1", "unit: A-1 | part: X | to: oil pump", "unit: A-1 part: oil pump to: X")
    assert b[0] == b[1] == b[2] and b[3] != b[0] and b[4] != b[0]
    assert canon(spark, None, "", " ?!", "straße", "STRASSE")[:3] == [None, None, None] and len(set(canon(spark, "straße", "STRASSE"))) == 1


def run(spark, rows, sized=None):
    df = spark.createDataFrame(rows, "id bigint, question string, canonical string, class_id int")
    classes, members, singles = C.collapse(df, "id", "question", sized)
    return {r.class_id: r.copies for r in classes.collect()}, sorted((tuple(r) for r in members.collect()), key=str), {r.class_id for r in singles.collect()}


def test_classes_members_singles(spark):
    rows = [(5, "A b?"), (2, "a  B"), (9, "c"), (9, "c"), (7, None), (8, "..."), (None, "d"), (None, "D")]
    rows = [(*r, "x", 0) for r in rows]
    for sized in (None, 1, 2_000_000):
        classes, members, singles = run(spark, rows, sized)
        assert classes == {2: 2, None: 2} and members == [(2, 2), (2, 5), (None, None), (None, None)] and singles == {9}


def test_exact_whatever_the_filter(spark):
    rows = [(i, f"q {i % 700}" if i % 3 == 0 else f"one {i}", "", 0) for i in range(3000)] + [(10_000 + i, "hot question", "", 0) for i in range(1500)]
    want = {}
    for i, q, *_ in rows:
        want.setdefault(q, []).append(i)
    pairs = {(min(v), x) for v in want.values() if len(v) > 1 for x in v}
    for sized in (1, 500_000):
        classes, members, singles = run(spark, rows, sized)
        assert set(members) == pairs and singles == {v[0] for v in want.values() if len(v) == 1}


def test_empty(spark):
    assert run(spark, []) == ({}, [], set())


def test_sizes():
    assert C.sizes(0) == (1, 1) and C.sizes(1_000_000) == (1, 128) and C.sizes(10**9)[1] == C.MAX_SEGMENTS
    for rows in (10**6, 10**9, 10**11):
        ranges, segments = C.sizes(rows)
        assert ranges * segments * C.SEGMENT_BITS >= rows * C.BITS_PER_ROW * 0.99 and segments <= C.MAX_SEGMENTS


def test_ranges_of_hashes(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_SEGMENTS", 1)
    rows = [(i, f"Q {i % 700}" if i % 2 else f"q, {i % 500}!", "", 0) for i in range(2000)]
    want = {}
    for i, q, *_ in rows:
        want.setdefault(q.lower().replace(",", "").replace("!", ""), []).append(i)
    classes, members, singles = run(spark, rows, 30_000)
    assert C.sizes(30_000)[0] > 2
    assert set(members) == {(v[0], x) for v in want.values() if len(v) > 1 for x in v} and singles == {v[0] for v in want.values() if len(v) == 1}


def test_packed_bits_round_trip():
    bits = np.zeros(C.SEGMENT_BITS // 8, np.uint8)
    for at in ([], [0, 7, 8, 65_535], list(range(0, 65_536, 3))):
        C._set(bits, np.array(at, np.int64))
        assert C._get(bits, np.array(at, np.int64)).all() and (C._unpack(C._pack(bits)) == bits).all()
