import random

from signalbox.llm import leakage as L


def words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def brute(doc, item, span):
    runs = {tuple(item[i : i + span]) for i in range(len(item) - span + 1)}
    return any(tuple(doc[i : i + span]) in runs for i in range(len(doc) - span + 1))


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "id bigint, body string, item_id string")
    t = spark.createDataFrame(items, "id bigint, body string, doc_id string")
    return {(r.doc_id, r.item_id) for r in L.leaks(d, "id", "body", t, "id", "body").collect()}


def test_every_shared_span_and_no_other(spark):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randint(5, 40))) for i in range(30)]
    docs = []
    for i in range(200):
        doc = words(rng, rng.randint(0, 60))
        _, it = rng.choice(items)
        n = rng.randint(8, 16)
        if len(it) >= n:
            a = rng.randrange(len(it) - n + 1)
            doc[5:5] = it[a : a + n]
        docs.append((i, doc))
    want = {(i, j) for i, d in docs for j, it in items if brute(d, it, L.SPAN)}
    sep = lambda: rng.choice((" ", ", ", "\n", " - ", "...  "))
    text = lambda ws: "".join(rng.choice((str.upper, str.lower))(w) + sep() for w in ws)
    got = run(spark, [(i, text(d), "x") for i, d in docs], [(j, text(it), "x") for j, it in items])
    assert got == want and want


def test_nulls_repeats_long_and_empty(spark):
    item = " ".join(f"a{i}" for i in range(12))
    docs = [(1, None, "x"), (2, "", "x"), (3, "x " * 50_000 + item + " y" * 50_000, "x"), (4, item, "x"), (4, item, "x"), (5, item.replace("a5", "a5 z"), "x")]
    assert run(spark, docs, [(1, item, "x"), (2, None, "x"), (3, "", "x")]) == {(3, 1), (4, 1)}
    assert run(spark, [], [(1, item, "x")]) == set() and run(spark, docs, []) == set()


def test_shuffled_when_the_test_side_is_large(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    item = " ".join(f"a{i}" for i in range(14))
    assert run(spark, [(1, "x " + item, "x"), (2, "other", "x")], [(7, item, "x")]) == {(1, 7)}


def test_common_passage_of_many_items(spark):
    shared = " ".join(f"a{i}" for i in range(13))
    items = [(j, f"{shared} own{j} " + " ".join(f"i{j}x{n}" for n in range(14)), "x") for j in range(30)]
    docs = [(1, "z " + shared + " y", "x"), (2, " ".join(f"a{i}" for i in range(7)) + " y", "x"), (3, items[4][1], "x")]
    assert run(spark, docs, items) == {(1, j) for j in range(30)} | {(3, j) for j in range(30)}
