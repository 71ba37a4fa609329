from pyspark.sql import functions as F

from signalbox.operators import catalog, merge, qa, usage


def test_merges(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 0)], "k string, v string, final int")
    new = spark.createDataFrame([("a", "n", 0), ("c", "z", 0)], "k string, v string, final int")
    got = {r.k: (r.v, r.final) for r in merge.upsert(old, new, ["k"], keep=["final"]).collect()}
    assert got == {"a": ("n", 1), "b": ("y", 0), "c": ("z", 0)}
    assert {r.k for r in merge.insert_missing(old, new, ["k"]).collect()} == {"a", "b", "c"}
    assert {(r.k, r.v) for r in merge.replace_partitions(old, new, "k").collect()} == {("a", "n"), ("b", "y"), ("c", "z")}


def test_overlay_and_back(spark):
    rules = spark.createDataFrame([("1.01", "t", "b"), ("1.02", "u", "c")], "n string, title string, body string")
    edits = spark.createDataFrame([("1.01", "T", "B", "t", "b"), ("9.09", "new", "N", None, None)], "n string, title string, body string, orig_title string, orig_body string")
    laid = merge.overlay(rules, edits, ["n"], ["title", "body"])
    assert {(r.n, r.title, r.edited) for r in laid.collect()} == {("1.01", "T", True), ("1.02", "u", False), ("9.09", "new", True)}
    back = merge.clear_edit(laid.drop("edited"), edits, ["n"], ["title", "body"])
    assert {(r.n, r.title) for r in back.collect()} == {("1.01", "t"), ("1.02", "u")}


def test_pages(spark):
    a = spark.createDataFrame([("f", 1, "layer"), ("f", 2, "two")], "s string, p int, t string")
    b = spark.createDataFrame([("f", 1, "image"), ("f", 3, "three")], "s string, p int, t string")
    assert {r.p: r.t for r in merge.merge_pages(a, b, ["s", "p"], "t").collect()} == {1: "layer\nimage", 2: "two", 3: "three"}
    files = spark.createDataFrame([("f", 4), ("g", 0)], "s string, n int")
    assert [r.p for r in merge.missing_pages(files, a, "s", "n", "p").orderBy("p").collect()] == [3, 4]


def test_access(spark):
    types = spark.createDataFrame([("Drawings", 1), ("Notes", 0)], "name string, requires_login int")
    docs = spark.createDataFrame([(1, "Drawings"), (2, "drawings"), (3, None), (4, "Notes")], "id int, document_type string")
    shut = lambda **k: {r.id for r in catalog.with_access(docs, types, **k).where("restricted").collect()}
    assert shut() == {1} and shut(ignore_case=True) == {1, 2}
    assert catalog.of_type(docs, types, "notes").count() == 1 and catalog.of_type(docs, types, "?").count() == 4


def test_history_and_packing(spark):
    t = spark.createDataFrame([("c", 1, "a?"), ("c", 2, ""), ("c", 3, "b?"), ("c", 4, "c?"), ("d", 1, "x" * 2000)], "conv string, n int, q string")
    h = {(r.conv, r.n): r.history for r in qa.history_blocks(t, "conv", ["n"], "q", F.lit("yes"), most=2, chars=40).collect()}
    assert h["c", 1] == "" and h["c", 3] == "Q: a?\nA: yes" and h["c", 4] == "Q: a?\nA: yes\n\nQ: b?\nA: yes"
    p = spark.createDataFrame([(1, i, "x" * 10) for i in range(5)], "q int, r int, t string")
    assert qa.pack(p, "q", ["r"], F.col("t"), 25).count() == 2


def test_usage(spark):
    hits = spark.createDataFrame([("a", "2024-01-02", 3)], "name string, d string, hour int").select("name", F.to_date("d").alias("day"), "hour")
    asked = spark.createDataFrame([("q", "2024-01-01", 3, None, 7)], "question string, d string, hour int, cached int, duration_ms bigint").select("question", F.to_date("d").alias("day"), "hour", "cached", "duration_ms")
    days = usage.daily(hits, asked, "2024-01-02", 3).orderBy("day").collect()
    assert [(r.hits, r.questions) for r in days] == [(0, 0), (0, 1), (1, 0)]
    assert usage.hourly(hits, asked, "2024-01-02").count() == 24
    assert usage.totals(hits, asked, "2024-01-01").first().mean_ms_today == 7
