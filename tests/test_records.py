from pyspark.sql import functions as F

from signalbox.operators import records as R


def test_backfill(spark):
    df = spark.createDataFrame([(1, "", "smi-1"), (2, "", "MS 2"), (3, "x", "MS 2"), (4, "", "zz"), (5, "", None), (6, None, "MS")], "id int, kind string, number string")
    got = {r.id: r.kind for r in R.backfill_by_prefix(df, "kind", "number", {"SMI": "A", "ms": "B", "M": "C"}).collect()}
    assert got == {1: "A", 2: "B", 3: "x", 4: "", 5: "", 6: None}


def test_history(spark):
    turns = [(f" q{i} ", "a" * 5000) for i in range(8)] + [("  ", "x"), (None, None)]
    df = spark.createDataFrame([(1, turns), (2, None), (3, [])], "id int, t array<struct<question:string,answer:string>>")
    got = {r.id: [(x.question, len(x.answer)) for x in r.h] for r in df.select("id", R.clean_history(F.col("t")).alias("h")).collect()}
    assert got == {1: [(f"q{i}", 4000) for i in (4, 5, 6, 7)], 2: [], 3: []}


def test_validation(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, "x" * 1001), (3, " "), (4, None)], "id int, q string")
    assert {r.id: r.v for r in df.select("id", R.valid_question(F.col("q")).alias("v")).collect()} == {1: True, 2: False, 3: False, 4: False}
    e = spark.createDataFrame([(1, "1.02", "t", "b"), (0, "1.02", "t", "b"), (1, "1.002", "t", "b"), (1, "1.02", " ", "b"), (1, "1.02", "t", None), (None, None, None, None)], "c int, n string, t string, b string")
    assert [r.x for r in e.select(R.valid_edit(F.col("c"), F.col("n"), F.col("t"), F.col("b"), 5).alias("x")).collect()] == [None, "chapter", "number", "title", "body", "chapter"]


def test_set_edits_keeps_first_originals_and_adds_rules(spark):
    rules = spark.createDataFrame([(1, "k", "a"), (2, "l", "b")], "book int, number string, body string")
    edits = spark.createDataFrame([(2, "l", "b", "first")], "book int, number string, body string, orig_body string")
    new = spark.createDataFrame([(1, "k", "A"), (2, "l", "B"), (3, "m", "C")], "book int, number string, body string")
    r, e = R.set_edits(rules, edits, new, ["book", "number"], ["body"])
    assert {tuple(x) for x in r.collect()} == {(1, "k", "A"), (2, "l", "B"), (3, "m", "C")}
    assert {(x.book, x.body, x.orig_body) for x in e.collect()} == {(1, "A", "a"), (2, "B", "first"), (3, "C", None)}
    assert {x.book: x.rule_exists for x in R.edits_with_rules(e, rules, ["book", "number"]).collect()} == {1: 1, 2: 1, 3: 0}


def test_small_ones(spark):
    s = "array<struct<number:string,title:string,page:int>>"
    df = spark.createDataFrame([(1, [("N-1", "t", 3), (None, "T", 0), (None, None, 1), ("N-4", "", 1)]), (2, None)], f"id int, s {s}")
    got = {r.id: r.a for r in df.select("id", R.fallback_answer(F.col("s"), "S.", " F: ", " O").alias("a")).collect()}
    assert got == {1: "S. F: N-1, page 3; T.", 2: "S. O"}
    assert [r.id for r in R.ids_from_json(spark, "[3, 1, null]").collect()] == [3, 1] and R.ids_from_json(spark, "broken").count() == 0
    assert [R.clamp(x) for x in (None, 0, -5, 7, 1000)] == [40, 40, 1, 7, 100] and not R.table_exists(spark, "no_such_table")
