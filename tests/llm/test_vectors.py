import numpy as np
from pyspark.sql import functions as F

from signalbox.llm import vectors as V


def table(spark, x, model="m", extra=()):
    rows = [(int(i), v.tolist(), model, len(v)) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id bigint, embedding array<float>, model string, dim int")


def prepared(spark, df):
    return V.prepare(df, "id", "embedding", "dim", ["model"])


def test_estimates_stay_in_their_bounds():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    code, scalar, four, range_ = V.encode(x)
    est, bound = V.estimate(four, range_, code, scalar)
    assert np.mean(np.abs(est - x @ x.T) <= bound + 0.02) > 0.95


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 32))
    x[300:400] = x[:100] + 0.05 * rng.standard_normal((100, 32))
    x[400:410] = x[:10] * 3.0  # the same direction
    x[410:420] = x[:10]  # the same vector
    extra = [(900, None, "m", 32), (901, [1.0] * 31, "m", 32), (902, [0.0] * 32, "m", 32), (903, [float("nan")] * 32, "m", 32), (904, x[0].tolist(), "other", 32), (None, x[0].tolist(), "m", 32), (5, x[5].tolist(), "m", 32)]
    reps, members = prepared(spark, table(spark, x, extra=extra))
    got = {tuple(r) for r in V.similar_pairs(reps, members, 20, 0.95).collect()}
    f = x.astype(np.float32).astype(float)
    u = f / np.linalg.norm(f, axis=1)[:, None]
    i, j = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))


def test_stated_queries_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1000, 64))
    reps, members = prepared(spark, table(spark, x))
    asked = spark.range(0, 1000, 50)
    out = V.similar_rows(reps, members, asked, 10).toPandas()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q, g in out.groupby("id"):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(g["other"]) & set(np.argsort(-s)[:10].tolist()))
    assert out["id"].nunique() == 20 and hits / 200 >= 0.9


def test_empty(spark):
    reps, members = prepared(spark, table(spark, np.zeros((0, 4))))
    assert V.similar_pairs(reps, members, 5, 0.9).count() == 0


def test_crowded_cell_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    rng = np.random.default_rng(3)
    x = np.ones((300, 16)) + 0.01 * rng.standard_normal((300, 16))
    reps, _ = prepared(spark, table(spark, x))
    out = V.similar_lists(reps, 5, None).groupBy("id").agg(F.count("*").alias("n"))
    assert out.count() == 300 and out.where("n <> 5").count() == 0


def brute_lists(x, k):
    f = x.astype(np.float32).astype(float)
    u = f / np.linalg.norm(f, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_copies_are_listed_first_and_hot_vectors_are_linear(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    x[100:200] = x[0]  # a third of all rows
    x[250] = x[240]
    reps, members = prepared(spark, table(spark, x))
    got = {}
    for r in V.similar_rows(reps, members, spark.range(0, 300, 10), 5).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    hot = [0, *range(100, 200)]
    assert set(got) == set(range(0, 300, 10)) and all(len(v) == 5 for v in got.values())
    for i in (0, 100, 190):
        assert [o for _, o in sorted(got[i])] == [h for h in hot if h != i][:5]
    assert sorted(got[240])[0] == (1, 250) and sorted(got[250])[0] == (1, 240)
    pairs = V.similar_pairs(reps, members, 5, 0.99).count()
    assert pairs == 15 + 95 * 5 + 1  # each row's list of five, never all pairs of the class


def test_recall_of_lists_with_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 20)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 32))
    x = centres[rng.integers(0, 60, 4000)] + 0.7 * rng.standard_normal((4000, 32))
    reps, _ = prepared(spark, table(spark, x))
    assert sum(len(t.leaves) for t in V.fit_trees(reps).values()) > 150
    out = V.similar_lists(reps, 10).toPandas()
    want = brute_lists(x, 10)
    hits = sum(len(set(g["other"]) & set(want[i].tolist())) for i, g in out.groupby("id"))
    assert hits / want.size >= 0.9


def test_many_small_groups_are_a_cell_each(spark):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((1200, 8)), 2, axis=0)
    x[1::2] *= 1.5
    rows = [(i, v.tolist(), f"m{i // 2}", 8) for i, v in enumerate(x)]
    reps, members = prepared(spark, spark.createDataFrame(rows, "id bigint, embedding array<float>, model string, dim int"))
    assert {tuple(r) for r in V.similar_pairs(reps, members, 5, 0.99).collect()} == {(i, i + 1) for i in range(0, 2400, 2)}
