"""Most similar vectors for every vector (problem 5).

Randomly rotated one-bit codes. Each unit vector is padded to ``BITS`` dimensions, rotated by a random orthogonal
matrix and reduced to its signs, packed into bits, with one correction scalar: the inner product of the vector with
its own code. A query keeps its rotated form in four bits a dimension. The estimate of an inner product is the query's
product with the code divided by the scalar; its error is bounded with high probability by
``ERROR * sqrt((1 - s^2) / s^2 / (BITS - 1))``, and only pairs whose bound reaches the threshold, or the k-th best
lower bound of the query, are reranked with the exact vectors.

Every vector is stored in the nearest cell of a two-level tree of centroids, fitted on a bounded sample, and looks into
its nearest cells, the more the more there are (``probes_for``); cells are cut into blocks of bounded size, so a crowded cell is many tasks and no task
or group grows with the data. Equal vectors are collapsed first to one representative (the smallest id).

Defined results
---------------
* comparable are rows of equal group columns whose vector is present, has exactly the stated length, no null, NaN or
  infinite value and is not all zero; all other rows have no neighbours and are nobody's;
* the length of a vector does not matter; ties in a list are broken by the smaller id;
* a row delivered several times (same id and vector) is one row; null ids are left out;
* empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.llm.spread import bounded_broadcast, spread
from signalbox.session import cut

BITS = 128
ERROR = 1.9
#: Vectors, over all groups, on which the centroids are fitted (a sample by hash of the id): one in CELL / PER_CENTROID of
#: them, but at least SAMPLE (25 MB at 64 dimensions) where there are so many, and at most MAX_SAMPLE.
SAMPLE, MAX_SAMPLE = 100_000, 1_000_000
#: Vectors wished in a cell, sample vectors needed for a centroid, and the most vectors of either side in a block.
CELL, PER_CENTROID, BLOCK = 1_000, 16, 4_096
#: Cells a vector looks into, at least; more where there are many leaves (half the root of their number).
PROBES = 8
_SEED = 20_240
#: Ids (8 bytes) of candidates that may be broadcast.
BROADCAST_IDS = 2_000_000
#: Vectors that several rows share (256 bytes each at 64 dimensions) that may be broadcast.
BROADCAST_VECTORS = 100_000
#: Cells (some 20 bytes each) whose numbers of blocks may be broadcast.
BROADCAST_CELLS = 500_000


def usable(vector: Column, length: Column) -> Column:
    """Whether a vector can be compared."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == length) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that no square overflows or vanishes.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(bits: int) -> np.ndarray:
    """The random orthogonal matrix that all tasks use."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((bits, bits)))
    return q * np.sign(np.diag(r))


def _width(dim: int) -> int:
    return max(BITS, -(-dim // 64) * 64)


@dataclass
class Tree:
    """Two levels of centroids; leaves are numbered over all branches."""

    top: np.ndarray
    leaves: np.ndarray  # all leaf centroids, ordered by branch
    starts: np.ndarray  # first leaf of each branch, and the number of leaves

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest leaves of each row, best first."""
        probes = min(probes, len(self.leaves))
        if len(self.leaves) <= 1_024:  # every leaf is looked at; above, those of the nearest branches
            s = x @ self.leaves.T
        else:
            branches = min(len(self.top), 2 * probes)
            near = np.argpartition(-(x @ self.top.T), branches - 1, axis=1)[:, :branches]
            s = np.full((len(x), len(self.leaves)), -2, np.float32)
            for b in range(len(self.top)):
                rows = np.flatnonzero((near == b).any(axis=1))
                a, z = self.starts[b], self.starts[b + 1]
                s[rows, a:z] = x[rows] @ self.leaves[a:z].T
        best = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
        order = np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable")
        return np.take_along_axis(best, order, 1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        seen = np.bincount(at, minlength=k)
        total[seen == 0] = x[rng.choice(len(x), int((seen == 0).sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def fit_tree(sample: np.ndarray, rows: int) -> Tree:
    """A tree for ``rows`` vectors from a sample of unit vectors."""
    rng = np.random.default_rng(_SEED)
    leaves = int(max(1, min(rows // CELL, len(sample) // PER_CENTROID)))
    top = _kmeans(sample, max(1, round(leaves**0.5)), rng)
    at = (sample @ top.T).argmax(axis=1)
    parts, starts = [], [0]
    for b in range(len(top)):
        own = sample[at == b]
        k = max(1, round(leaves * len(own) / len(sample)))
        parts.append(_kmeans(own, min(k, len(own)), rng) if len(own) else top[b : b + 1])
        starts.append(starts[-1] + len(parts[-1]))
    return Tree(top, np.concatenate(parts), np.array(starts))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: packed codes, correction scalars, queries in four bits a dimension (two to a byte), and the
    query's (lowest, step)."""
    bits = _width(x.shape[1])
    y = (x @ rotation(bits)[: x.shape[1]]).astype(np.float32)
    code = np.packbits(y > 0, axis=1)
    scalar = (np.abs(y).sum(axis=1) / np.sqrt(bits)).astype(np.float32)
    low = y.min(axis=1, keepdims=True)
    step = np.maximum((y.max(axis=1, keepdims=True) - low) / 15, 1e-12)
    four = np.rint((y - low) / step).astype(np.uint8)
    return code, scalar, (four[:, ::2] << 4) | four[:, 1::2], np.concatenate([low, step], axis=1).astype(np.float32)


def estimate(four: np.ndarray, range_: np.ndarray, code: np.ndarray, scalar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes) and the error bound of each code."""
    bits = code.shape[1] * 8
    q = np.empty((len(four), bits), np.float32)
    q[:, ::2], q[:, 1::2] = four >> 4, four & 15
    q = q * range_[:, 1:] + range_[:, :1]
    sign = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    bound = ERROR * np.sqrt(np.maximum(1 - scalar**2, 0) / scalar**2 / (bits - 1))
    return (q @ sign.T) / (np.sqrt(bits) * scalar), bound


_CODED = "id bigint, slots array<bigint>, code binary, query binary"


def probes_for(leaves: int) -> int:
    """Cells that a vector looks into: a fixed number loses neighbours as the leaves grow finer."""
    return max(PROBES, math.ceil(0.5 * leaves**0.5))


def code_vectors(vectors: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Codes of (grp, id, vec), with the slots (cells numbered over all groups) a vector looks into, its own first.

    A code is the packed signs and the scalar; a query the packed four-bit values, lowest and step: one binary value
    each, as these rows are the bulk of what is shuffled. A group without a tree is one cell, numbered by its hash.
    """
    first, at = {}, 0
    for g in sorted(trees):
        first[g] = at
        at += len(trees[g].leaves)
    shared = vectors.sparkSession.sparkContext.broadcast((trees, first))  # bounded by SAMPLE / PER_CENTROID centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, offset = shared.value
        for batch in batches:
            grp, ids = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for g, d in sorted(set(zip(grp.tolist(), sizes.tolist(), strict=True))):
                at = np.flatnonzero((grp == g) & (sizes == d))
                flat = batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                x = _unit(flat.reshape(len(at), d).astype(np.float64)).astype(np.float32)
                code, scalar, four, range_ = encode(x)
                cells = known[g].nearest(x, probes_for(len(known[g].leaves))) + offset[g] if g in known else np.full((len(at), 1), g, np.int64)
                joined = lambda *parts: np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(len(at), -1) for p in parts], axis=1)  # noqa: B023, E731
                fixed = lambda a: pa.FixedSizeBinaryArray.from_buffers(pa.binary(a.shape[1]), len(a), [None, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())
                offsets = pa.array(np.arange(len(at) + 1) * cells.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel(), pa.int64())), fixed(joined(code, scalar)), fixed(joined(four, range_))],
                    names=["id", "slots", "code", "query"],
                )

    return vectors.select("grp", "id", "vec").mapInArrow(run, _CODED)


def _raw(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def meet(base: DataFrame, asks: DataFrame, run: Callable[..., tuple[np.ndarray, ...]], schema: str, extra: Sequence[str] = ()) -> DataFrame:
    """What ``run`` yields of each block of (slot, id, code) and of (slot, id, query, extra) that share a slot.

    Each cell is cut into as many blocks as its rows need, on either side. ``run`` gets, for some queries at a time,
    their rows, the ids of the block, the estimates and their bounds, and gives the columns of ``schema``.
    """
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("bigint")
    n_base = base.groupBy("slot").agg(F.count("*").alias("nb"))
    n_asks = asks.groupBy("slot").agg(F.count("*").alias("nq"))
    sizes = cut(n_base.join(n_asks, "slot").select("slot", blocks("nb").alias("nb"), blocks("nq").alias("nq")))
    plan = bounded_broadcast(sizes, sizes.count(), BROADCAST_CELLS)
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = base.join(plan, "slot").select("slot", at("nb").alias("bb"), span("nq").alias("qb"), "id", "code")
    right = asks.join(plan, "slot").select("slot", span("nb").alias("bb"), at("nq").alias("qb"), "id", "query", *extra)
    # Both sides come from one table; new names keep their columns apart.
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in ("slot", "bb", "qb", "id", "query", *extra)])
    names = [c.split()[0] for c in schema.split(", ")]

    def block(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(q):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        packed, bid = _raw(b["code"]), b["id"].to_numpy(np.int64)
        code, scalar = np.ascontiguousarray(packed[:, :-4]), np.ascontiguousarray(packed[:, -4:]).view(np.float32)[:, 0]
        found = []
        for a in range(0, len(q), 1024):
            part = q.iloc[a : a + 1024]
            asked = _raw(part["q_query"])
            est, bound = estimate(np.ascontiguousarray(asked[:, :-8]), np.ascontiguousarray(asked[:, -8:]).view(np.float32), code, scalar)
            found.append(run(part, bid, est, bound))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(names, zip(*found, strict=True), strict=True)})

    return left.groupBy("slot", "bb", "qb").cogroup(right.groupBy("q_slot", "q_bb", "q_qb")).applyInPandas(block, schema)


def candidates(coded: DataFrame, k: int, min_cosine: float | None) -> DataFrame:
    """(id, other) pairs that share a cell and that the codes cannot rule out."""

    def run(part: pd.DataFrame, bid: np.ndarray, est: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        qid, high = part["q_id"].to_numpy(np.int64), est + bound
        other = qid[:, None] != bid
        keep = other if min_cosine is None else (high >= min_cosine) & other
        if min_cosine is None and len(bid) > k + 1:
            low = np.where(other, est - bound, -9)
            keep = keep & (high >= np.partition(low, len(bid) - k, axis=1)[:, len(bid) - k, None])
        i, j = np.nonzero(keep)
        return qid[i], bid[j]

    base = coded.select(F.col("slots")[0].alias("slot"), "id", "code")
    return meet(base, coded.select(F.explode("slots").alias("slot"), "id", "query"), run, "id bigint, other bigint")


def best_estimates(base: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(id, other): for each query the k others with the largest estimates; at most k rows leave a block for a query."""

    def run(part: pd.DataFrame, bid: np.ndarray, est: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, ...]:
        qid = part["q_id"].to_numpy(np.int64)
        est = np.where(qid[:, None] != bid, est, -9)
        j = np.argpartition(est, -k, axis=1)[:, -k:] if len(bid) > k else np.tile(np.arange(len(bid)), (len(qid), 1))
        near = np.take_along_axis(est, j, 1)
        keep = near.ravel() > -9
        return np.repeat(qid, j.shape[1])[keep], bid[j].ravel()[keep], near.ravel()[keep].astype(np.float64)

    found = meet(base, asks, run, "id bigint, other bigint, est double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("est"), "other")))
    return ranked.where(F.col("rank") <= k).select("id", "other")


def above(base: DataFrame, asks: DataFrame) -> DataFrame:
    """(id, other): the pairs whose bound reaches the query's own ``least`` cosine."""

    def run(part: pd.DataFrame, bid: np.ndarray, est: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        qid = part["q_id"].to_numpy(np.int64)
        i, j = np.nonzero((est + bound >= part["q_least"].to_numpy()[:, None]) & (qid[:, None] != bid))
        return qid[i], bid[j]

    return meet(base, asks, run, "id bigint, other bigint", ["least"])


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def prepare(df: DataFrame, id_col: str, vec_col: str, length_col: str, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """(representatives, members): (grp, id, vec) of distinct usable vectors, scaled to unit length in doubles' range,
    and (rep, id) of every row of a vector that several rows share."""
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vec_col), F.col(length_col))).select(
        F.xxhash64(*groups, length_col).alias("grp"), F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")
    )
    reps = rows.groupBy("grp", "vec").agg(F.min("id").alias("id"), F.max("id").alias("__last"))
    reps = cut(reps.select("grp", "id", "vec", (F.col("id") != F.col("__last")).alias("__shared")))
    shared = reps.where("__shared").select("grp", "vec", F.col("id").alias("rep"))
    members = cut(rows.join(bounded_broadcast(shared, shared.count(), BROADCAST_VECTORS), ["grp", "vec"]).select("rep", "id").distinct())
    return reps.select("grp", "id", "vec"), members


def fit_trees(reps: DataFrame) -> dict[int, Tree]:
    """A tree for each group with enough vectors in the sample; the groups without one are a cell each."""
    total = reps.count()
    share = min(1.0, min(max(SAMPLE, total * PER_CENTROID // CELL), MAX_SAMPLE) / max(total, 1))
    least = F.lit(min(int(-(2.0**63) + share * 2.0**64), 2**63 - 1))
    rows = reps.where(F.xxhash64("id", F.lit(_SEED)) <= least).limit(MAX_SAMPLE * 2).select("grp", "vec").toArrow()
    grp, vec, out = rows.column("grp").to_numpy(), rows.column("vec").combine_chunks(), {}
    seen, counts = np.unique(grp, return_counts=True)
    large = [int(g) for g, n in zip(seen, counts, strict=True) if n >= 4 * PER_CENTROID]  # at most MAX_SAMPLE / 32
    if not large:
        return out
    known = reps.sparkSession.createDataFrame([(g,) for g in large], "grp bigint")
    sizes = reps.select("grp").join(F.broadcast(known), "grp").groupBy("grp").agg(F.count("*").alias("n"))
    for g, n in ((r.grp, r.n) for r in sizes.collect()):
        flat = vec.take(pa.array(np.flatnonzero(grp == g))).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        tree = fit_tree(_unit(flat.reshape(int((grp == g).sum()), -1)).astype(np.float32), n)
        if len(tree.leaves) > 1:
            out[g] = tree
    return out


def rerank(pairs: DataFrame, reps: DataFrame, k: int, min_cosine: float | None, both_ways: bool) -> DataFrame:
    """(id, other, cosine): exact cosines of the candidate pairs, at most k for an id."""
    if both_ways:
        pairs = pairs.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"))
    pairs = cut(pairs.distinct())
    # Only vectors of candidates are moved; their ids are broadcast to the scan where their counted number allows.
    ids = cut(pairs.select("id").unionAll(pairs.select("other")).distinct())
    needed = reps.select("id", "vec").join(bounded_broadcast(ids, ids.count(), BROADCAST_IDS), "id", "left_semi")
    a, b = needed.withColumnRenamed("vec", "va"), needed.select(F.col("id").alias("other"), F.col("vec").alias("vb"))
    exact = pairs.join(a, "id").join(b, "other").select("id", "other", _cosine(F.col("va"), F.col("vb")).alias("cosine"))
    if min_cosine is not None:
        exact = exact.where(F.col("cosine") >= min_cosine)
    if both_ways:
        exact = exact.select(F.explode(F.array(F.struct("id", "other", "cosine"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), "cosine"))).alias("e")).select("e.*")
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other")))
    return ranked.where(F.col("rank") <= k)


def similar_lists(reps: DataFrame, k: int = 20, min_cosine: float | None = None) -> DataFrame:
    """(id, other, cosine, rank): for every representative its k most similar others (of those over ``min_cosine``)."""
    coded = cut(code_vectors(spread(reps), fit_trees(reps)))
    return rerank(candidates(coded, k, min_cosine), reps, k, min_cosine, both_ways=True)


def _exact(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, other, cosine) of (id, other); the vectors of queries go to those of the others, which move once."""
    asked = pairs.select("id").distinct().join(reps.select("id", F.col("vec").alias("va")), "id")
    other = reps.select(F.col("id").alias("other"), F.col("vec").alias("vb"))
    return pairs.join(asked, "id").join(other, "other").select("id", "other", _cosine(F.col("va"), F.col("vb")).alias("cosine"))


def similar_to(reps: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
    """(id, other, cosine, rank): for each representative in ``asked`` the k most similar of all others.

    The stated query set meets all codes in blocks, twice. First the k best estimates of each query are reranked; their
    least exact cosine is one that the list surely reaches. Then all pairs whose bound reaches it are candidates. Nothing
    is left out, so only the codes' error bound can lose a neighbour.
    """
    coded = cut(code_vectors(spread(reps), {}))
    base = coded.select(F.col("slots")[0].alias("slot"), "id", "code")
    asks = cut(coded.join(asked.select("id").distinct(), "id", "left_semi").select(F.col("slots")[0].alias("slot"), "id", "query"))
    first = _exact(best_estimates(base, asks, k), reps).groupBy("id").agg(F.min("cosine").alias("least"), F.count("*").alias("n"))
    # Rounding of a cosine of single precision; a query with fewer than k others takes them all.
    first = cut(first.select("id", F.when(F.col("n") >= k, F.col("least") - 1e-6).otherwise(-9.0).alias("least")))
    exact = _exact(cut(above(base, asks.join(first, "id"))), reps)
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other")))
    return ranked.where(F.col("rank") <= k)


def member_lists(ranked: DataFrame, reps: DataFrame, members: DataFrame, asked: DataFrame | None = None, k: int = 20) -> DataFrame:
    """(id, other, cosine, rank): the lists of rows from those of representatives: the rows that share a vector are each
    other's nearest, and every listed representative stands for all rows that share its vector.

    A list needs at most the k + 1 smallest ids of a class, so a vector shared by a third of all rows costs no more than
    any other: its rows all take the same k + 1 entries and leave themselves out.
    """
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1)
    first = cut(first.select("rep", F.col("id").alias("member")))
    own = first.select("rep", F.col("member").alias("other"), F.lit(1.0).alias("cosine"))
    theirs = ranked.select(F.col("id").alias("asker"), F.col("other").alias("rep"), "cosine").join(first, "rep", "left")
    entries = own.unionAll(theirs.select(F.col("asker").alias("rep"), F.coalesce("member", "rep").alias("other"), "cosine"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other"))), 1, k + 1)
    lists = entries.groupBy("rep").agg(best.alias("entries"))  # at most (k + 1) ** 2 entries before the cut
    rows = reps.select(F.col("id").alias("rep"), "id").join(members.select("id"), "id", "left_anti").select("rep", "id").unionAll(members.select("rep", "id"))
    if asked is not None:
        rows = rows.join(asked.select("id").distinct(), "id", "left_semi")
    mine = rows.join(lists, "rep").select("id", F.slice(F.filter("entries", lambda x: x["other"] != F.col("id")), 1, k).alias("e"))
    return mine.select("id", F.posexplode("e").alias("pos", "x")).select("id", F.col("x.other").alias("other"), (-F.col("x.far")).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def similar_rows(reps: DataFrame, members: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
    """(id, other, cosine, rank): for each id in ``asked`` the k most similar of all other rows."""
    wanted = asked.select("id").distinct()
    mine = reps.select("id").join(wanted, "id", "left_semi").unionAll(members.join(wanted, "id", "left_semi").select(F.col("rep").alias("id")))
    return member_lists(cut(similar_to(reps, mine, k)), reps, members, asked, k)


def similar_pairs(reps: DataFrame, members: DataFrame, k: int, min_cosine: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of rows in the lists of k, of a cosine of at least ``min_cosine``."""
    lists = member_lists(cut(similar_lists(reps, k, min_cosine)), reps, members, None, k)
    return lists.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
