"""Exact vector operators: unit length, dot products, threshold scaling, top-k of a stated query set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product over the shorter length, accumulated in doubles."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    by = lambda n: F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))
    return F.transform(F.array(norm(v)), by)[0]  # the length is found once, not for every element


def scaled(score: Column, least: float) -> Column:
    """A score over ``least`` scaled to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - F.lit(least)) / F.lit((1 - least) or 1.0)))


#: Rows of either side in a block of ``score_queries``, and the best columns that are looked at before all of a row.
BLOCK, FIRST = 16_384, 128


def score_queries(queries: DataFrame, vectors: DataFrame, least: float | None = None, best: int | None = None, cap: tuple[str, int] | None = None) -> DataFrame:
    """(query, id, score) of each query against every vector of its group: (query, qv, grp) x (id, v, grp); ``grp`` may be
    left out. Of those with a score from ``least`` on, or what ``top_k`` needs to find the ``best`` of each query under
    the ``cap``: as many leave each block (and those that tie with them to six places, beside the query itself).

    A stated query set meets all rows in blocks of bounded size, one matrix product each, accumulated in doubles; other
    pairs never leave their block. Lengths may differ: products go over the shorter one. Null vectors score nowhere.
    """
    q, v = queries.where(F.col("qv").isNotNull()), vectors.where(F.col("v").isNotNull())
    nq, nv = max(1, -(-q.count() // BLOCK)), max(1, -(-v.count() // BLOCK))
    kinds = {**dict(queries.dtypes), **dict(vectors.dtypes)}
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = lambda df: F.col("grp") if "grp" in df.columns else F.lit(0)
    own = F.xxhash64(cap[0]) if cap else F.lit(0).cast("bigint")
    left = v.select(group(v).alias("g"), F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("b"), span(nq).alias("c"), "id", own.alias("own"), F.col("v").cast("array<double>").alias("v"))
    right = q.select(group(q).alias("q_g"), span(nv).alias("q_b"), F.pmod(F.xxhash64("query"), F.lit(nq)).cast("int").alias("q_c"), "query", F.col("qv").cast("array<double>").alias("qv"))
    limit = cap[1] if cap else None

    def matrix(rows: pd.Series, width: int) -> np.ndarray:
        out = np.zeros((len(rows), width))
        for i, x in enumerate(rows):
            out[i, : len(x)] = x
        return out

    def chosen(row: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Columns of one query that can be among its best: the query itself and ties need room."""
        order = np.flatnonzero(row > -np.inf)
        if len(order) > 2 * max(FIRST, 2 * best):  # mostly the first few say what the others have to reach
            first = order[np.argpartition(-row[order], (m := max(FIRST, 2 * best)))[:m]]
            first = first[np.argsort(-row[first], kind="stable")]
            need = row[first[best]] if limit is None else _floor(first, row, own, best, limit)
            order = order[row[order] >= need - 2e-6]
        order = order[np.argsort(-row[order], kind="stable")]
        if limit is not None:  # the place of each within its own kind, best first
            kind = own[order]
            by = np.argsort(kind, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(kind[by]) != 0]) if len(by) else by
            sizes = np.diff(np.r_[first, len(by)])
            floor = np.repeat(row[order[by[np.minimum(first + limit, first + sizes - 1)]]], sizes)
            keep = np.zeros(len(order), bool)
            keep[by] = row[order[by]] >= floor - 2e-6
            order = order[keep]
        if len(order) <= best:
            return order
        return order[row[order] >= row[order[best]] - 2e-6] if limit is None else order[: _reach(order, row, own, best, limit)]

    def meet(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query": q["query"].iloc[:0], "id": v["id"].iloc[:0], "score": np.zeros(0)})
        width = max(v["v"].map(len).max(), q["qv"].map(len).max())
        m, kind, out = matrix(v["v"], width), v["own"].to_numpy(), []
        for at in range(0, len(q), 256):
            part = q.iloc[at : at + 256]
            s = matrix(part["qv"], width) @ m.T
            if best is not None:
                s = np.where(s >= least, s, -np.inf) if least is not None else s
                picked = [chosen(row, kind) for row in s]
                i, j = np.repeat(np.arange(len(picked)), [len(x) for x in picked]), np.concatenate(picked)
            else:
                i, j = np.nonzero(s >= least) if least is not None else np.nonzero(np.ones_like(s, bool))
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[i], "id": v["id"].to_numpy()[j], "score": s[i, j]}))
        return pd.concat(out)

    grouped = left.groupBy("g", "b", "c").cogroup(right.groupBy("q_g", "q_b", "q_c"))
    return grouped.applyInPandas(meet, f"query {kinds['query']}, id {kinds['id']}, score double")


def _floor(order: np.ndarray, row: np.ndarray, own: np.ndarray, best: int, limit: int) -> float:
    """The score at which ``order`` has ``best`` under the cap, and one more; minus infinity where it has not."""
    taken: dict[int, int] = {}
    total = 0
    for j, kind in zip(order.tolist(), own[order].tolist(), strict=True):
        if taken.get(kind, 0) < limit:
            taken[kind] = taken.get(kind, 0) + 1
            total += 1
            if total > best:
                return float(row[j])
    return -np.inf


def _reach(order: np.ndarray, row: np.ndarray, own: np.ndarray, best: int, limit: int) -> int:
    """How many of ``order`` it takes until ``best`` under the cap, and one more, and their ties are among them."""
    need = _floor(order, row, own, best, limit)
    return len(order) if need == -np.inf else int(np.searchsorted(-row[order], -(need - 2e-6), side="right"))


def top_k(scores: DataFrame, k: int, cap: tuple[str, int] | None = None) -> DataFrame:
    """The k best of each query; with ``cap`` = (column, n), at most n of each value of the column, best first."""
    order = [F.desc("score"), F.col("id")]
    if cap:
        column, n = cap
        scores = scores.withColumn("__own", F.row_number().over(Window.partitionBy("query", column).orderBy(*order))).where(F.col("__own") <= n).drop("__own")
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
