import datetime as dt

from signalbox.operators.orphans import Edge, Relation, orphan_cascade, orphan_report

T = lambda day: dt.datetime(2024, 1, day)


def graph(spark, parents, children, grand):
    p = spark.createDataFrame(parents, "id bigint, born timestamp_ntz, period string, extra string")
    c = spark.createDataFrame(children, "id bigint, parent bigint, until timestamp_ntz, period string, extra string")
    g = spark.createDataFrame(grand, "id bigint, parent bigint, period string")
    relations = {"p": Relation("p", p, "id", "period"), "c": Relation("c", c, "id", "period"), "g": Relation("g", g, "id", "period")}
    return relations, [Edge("c", "parent", "p", "id", born="born", until="until"), Edge("g", "parent", "c", "id")]


def test_direct_late_and_inherited(spark):
    r, e = graph(
        spark,
        [(1, T(1), "a", None), (2, T(9), "a", None), (3, None, "a", None)],
        [(10, 1, T(5), "m", None), (11, 2, T(5), "m", None), (12, 3, T(5), "m", None), (13, 99, None, "m", None), (14, None, T(5), "m", None), (15, 2, None, "m", None), (13, 99, None, "m", None)],
        [(20, 10, "n"), (21, 11, "n"), (22, 13, "n"), (23, 77, "n"), (24, None, "n")],
    )
    got = {(x.table_name, x.row_key): (x.kind, x.level) for x in orphan_cascade(r, e).collect()}
    assert got == {("c", "11"): ("direct", 0), ("c", "13"): ("direct", 0), ("g", "23"): ("direct", 0), ("g", "21"): ("inherited", 1), ("g", "22"): ("inherited", 1)}
    report = {(x.table_name, x.period): (x.direct, x.inherited) for x in orphan_report(orphan_cascade(r, e)).collect()}
    assert report == {("c", "m"): (2, 0), ("g", "n"): (1, 2)}


def test_empty_tables(spark):
    r, e = graph(spark, [], [(10, 1, T(5), "m", "x")], [])
    assert [x.row_key for x in orphan_cascade(r, e).collect()] == ["10"]
    r, e = graph(spark, [], [], [])
    assert orphan_cascade(r, e).count() == 0


def test_cycle_ends(spark):
    n = spark.createDataFrame([(1, 2, "m"), (2, 1, "m"), (3, 9, "m"), (4, 3, "m"), (5, 4, "m")], "id bigint, next bigint, period string")
    got = {x.row_key: x.level for x in orphan_cascade({"n": Relation("n", n, "id", "period")}, [Edge("n", "next", "n", "id")]).collect()}
    assert got == {"3": 0, "4": 1, "5": 2}


def test_long_chain(spark):
    n = spark.createDataFrame([(i, i - 1, "m") for i in range(1, 9)], "id bigint, next bigint, period string")
    got = {x.row_key: x.level for x in orphan_cascade({"n": Relation("n", n, "id", "period")}, [Edge("n", "next", "n", "id")]).collect()}
    assert got == {str(i): i - 1 for i in range(1, 9)}
