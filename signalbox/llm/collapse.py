"""Duplicates hidden by formatting differences (problem 7).

Canonical form: letter case, punctuation and spacing vanish, leaving the words in order; a text that is a
set of labelled fields (``label: value`` or ``label = value`` between separators) becomes its fields, sorted,
each value still bound to its label.

Collapsing billions of rows must not shuffle the singletons' texts. So, in a first pass over the hashes alone,
every task builds a blocked Bloom filter of hashes seen once and one of hashes seen repeatedly; the filters of
all tasks are merged segment by segment (a hash is possibly repeated if it was in one task's repeats or in the
once-filters of two). In the second pass only rows whose hash is possibly repeated are shuffled for exact
grouping by the canonical text; all others are singletons at once. The filter has no false negatives, so the
result is exact whatever its size.

The filter is sized from the number of rows. Where it would outgrow what may be broadcast, the rows are written once
to the shared folder, divided by ranges of their hashes, and each range has a filter of its own that meets only its rows.

Defined results
---------------
* null texts and texts without any word belong to no class and give no row;
* a row delivered several times (same id, same text) is one copy; a null id is a copy of its own;
* the class id is the smallest id of its copies;
* empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.session import cut, scratch

#: Bits of a segment (8 KiB) and probes per hash, all inside one segment.
SEGMENT_BITS = 1 << 16
PROBES = 4
#: Segments of one filter at most: 64 MiB, the bound of what is broadcast. Bits of filter for each row.
MAX_SEGMENTS = 8192
BITS_PER_ROW = 8
#: Tasks' filters of a segment that are merged at once, in two steps: those of tasks with equal number modulo PARTS first.
PARTS = 64

_LABEL = r"^[^\p{L}\p{N}\n]*[\p{L}\p{N}]+(?:[ \p{Zs}\t-]+[\p{L}\p{N}]+){0,2}\s*[:=]"


def _words(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1), " ")


def canonical(text: Column) -> Column:
    """The canonical form; null where there is no word."""
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))  # capitals have no ß
    flat = _words(folded)
    parts = F.filter(
        F.split(folded, r"[|;&]+|\r?\n(?=[^\p{L}\p{N}\n]*[\p{L}\p{N}]+\s*[:=])"), lambda p: p.rlike(r"[\p{L}\p{N}]")
    )
    field = lambda p: F.concat(
        _words(F.regexp_extract(p, r"^([^:=]*)[:=]", 1)), F.lit("\x01"), _words(F.regexp_replace(p, r"^[^:=]*[:=]", ""))
    )
    fields = F.when(
        folded.rlike(r"[:=]") & (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(_LABEL)),
        F.array_join(F.array_sort(F.transform(parts, field)), "\x02"),
    )
    return F.when(flat != "", F.coalesce(fields, flat))


def _positions(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and probe positions of signed 64-bit hashes (the same arithmetic as ``_maybe_repeated``)."""
    seg = (h & (segments - 1)).astype(np.int64)
    rest = h >> 13
    step = ((h >> 29) & (SEGMENT_BITS - 1)) | 1
    return seg, np.stack([(rest + i * step) & (SEGMENT_BITS - 1) for i in range(PROBES)], axis=1)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    """Set the bits at the positions ``at`` of a packed array."""
    at = np.unique(at)
    byte, value = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
    first = np.flatnonzero(np.diff(byte, prepend=-1))
    bits[byte[first]] |= np.bitwise_or.reduceat(value, first) if len(first) else value


def _get(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _pack(bits: np.ndarray) -> bytes:
    """A segment's bits, or their positions in two bytes each where these are fewer bytes."""
    at = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    return at.astype(np.uint16).tobytes() if len(at) * 2 < len(bits) else bits.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if len(data) == SEGMENT_BITS // 8:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(SEGMENT_BITS // 8, np.uint8)
    _set(bits, np.frombuffer(data, np.uint16).astype(np.int64))
    return bits


def _filters(segments: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)
        twice = np.zeros_like(once)
        used = np.zeros(segments, bool)
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            if not len(h):
                continue
            seg, at = _positions(h, segments)
            at = seg[:, None] * SEGMENT_BITS + at
            again = (n > 1) | _get(once, at).all(axis=1)
            _set(twice, at[again].ravel())
            _set(once, at.ravel())
            used[seg] = True
        rows = np.flatnonzero(used)
        # The same task gives the same rows whenever it runs, so that none is lost when it runs again.
        part = TaskContext.get().partitionId() % PARTS
        packed = lambda a: pa.array([_pack(x) for x in a.reshape(segments, -1)[rows]], pa.binary())
        yield pa.RecordBatch.from_pydict({"seg": pa.array(rows, pa.int32()), "part": pa.array(np.full(len(rows), part), pa.int32()), "once": packed(once), "twice": packed(twice)})

    return build


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once = np.zeros(SEGMENT_BITS // 8, np.uint8)
    twice = np.zeros(SEGMENT_BITS // 8, np.uint8)
    for a, b in zip(pdf["once"], pdf["twice"], strict=True):
        o = _unpack(a)
        twice |= _unpack(b) | (once & o)
        once |= o
    return pd.DataFrame({"seg": pdf["seg"].iloc[:1], "part": [0], "once": [_pack(once)], "twice": [_pack(twice)]})


def _as_words(pdf: pd.DataFrame) -> pd.DataFrame:
    out = _merge(pdf)
    return pd.DataFrame({"seg": out["seg"], "words": [np.ascontiguousarray(_unpack(out["twice"].iloc[0])).view(np.int64)]})


def repeated_filter(hashes: DataFrame, segments: int) -> DataFrame:
    """(seg, words): for each used segment the merged filter of possibly repeated hashes, as 64-bit words."""
    if segments & (segments - 1) or not 1 <= segments <= MAX_SEGMENTS:
        raise ValueError(f"segments must be a power of two up to {MAX_SEGMENTS}")
    schema = "seg int, part int, once binary, twice binary"
    parts = hashes.mapInArrow(_filters(segments), schema)
    # Merged in two steps, so that no task sees more than a share of all tasks' filters of a segment at first.
    halfway = parts.groupBy("seg", "part").applyInPandas(_merge, schema)
    return cut(halfway.groupBy("seg").applyInPandas(_as_words, "seg int, words array<bigint>"))


def _maybe_repeated(h: Column, words: Column) -> Column:
    rest, step = F.shiftright(h, 13), F.shiftright(h, 29).bitwiseAND(F.lit(SEGMENT_BITS - 1)).bitwiseOR(F.lit(1))
    test = F.lit(True)
    for i in range(PROBES):
        at = (rest + step * i).bitwiseAND(F.lit(SEGMENT_BITS - 1)).cast("int")
        word = F.get(words, F.shiftright(at, 6))
        test = test & (F.call_function("getbit", word, at.bitwiseAND(F.lit(63))) == 1)
    return test


def sizes(rows: int) -> tuple[int, int]:
    """(ranges, segments): the ranges of hashes and the segments of the filter of each, for so many rows."""
    wanted = max(1, rows * BITS_PER_ROW // SEGMENT_BITS)
    ranges = -(-wanted // MAX_SEGMENTS)
    return ranges, min(MAX_SEGMENTS, 1 << (-(-wanted // ranges) - 1).bit_length())


def _by_range(hashed: DataFrame, ranges: int) -> list[DataFrame]:
    """The rows of each range of hashes; more than one are written once, without a shuffle."""
    if ranges == 1:
        return [hashed]
    path = scratch(hashed.sparkSession, "collapse")
    hashed.withColumn("__range", F.pmod(F.shiftright("__h", 48), F.lit(ranges)).cast("int")).write.partitionBy("__range").parquet(path)
    written = hashed.sparkSession.read.schema(f"{', '.join(f'{n} {t}' for n, t in hashed.dtypes)}, __range int").parquet(path)
    return [written.where(F.col("__range") == r).drop("__range") for r in range(ranges)]


def _marked(hashed: DataFrame, segments: int) -> DataFrame:
    filters = repeated_filter(hashed.select("__h"), segments)  # at most MAX_SEGMENTS rows of 8 KiB
    tested = hashed.withColumn("__seg", F.col("__h").bitwiseAND(F.lit(segments - 1)).cast("int")).join(
        F.broadcast(filters.withColumnRenamed("seg", "__seg")), "__seg", "left"
    )
    return tested.select("id", "canonical", F.coalesce(_maybe_repeated(F.col("__h"), F.col("words")), F.lit(False)).alias("__maybe"))


def collapse(df: DataFrame, id_col: str, text_col: str, rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, members, singles) of the texts.

    classes: (class_id, canonical, copies) of texts with several copies; members: (class_id, id) of them;
    singles: (class_id, canonical, copies = 1) of the others. Extra columns of ``df`` play no part. ``rows``, counted by
    default, sizes the filter and changes no result.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ranges, segments = sizes(texts.where("text IS NOT NULL").count() if rows is None else rows)
    hashed = texts.select("id", canonical(F.col("text")).alias("canonical")).where(F.col("canonical").isNotNull()).withColumn("__h", F.xxhash64("canonical"))
    marked = reduce(DataFrame.unionAll, [_marked(part, segments) for part in _by_range(hashed, ranges)])
    # A copy is an id; repeats of a row (same id) are dropped before counting, rows without an id are a copy each. Both
    # keys take part in the shuffle, so a class with a third of all rows spreads over all tasks.
    copies = marked.where("__maybe").groupBy("id", "canonical").agg(F.count("*").alias("n"))
    copies = cut(copies.select("id", "canonical", F.when(F.col("id").isNull(), F.col("n")).otherwise(1).alias("n")))
    groups = copies.groupBy("canonical").agg(F.min("id").alias("class_id"), F.sum("n").alias("copies"))
    classes = groups.where("copies > 1")
    members = copies.join(classes.select("canonical", "class_id"), "canonical").select("class_id", "id", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("class_id", "id")
    singles = (
        marked.where("NOT __maybe").select(F.col("id").alias("class_id"), "canonical", F.lit(1).cast("bigint").alias("copies"))
        .unionAll(groups.where("copies = 1").select("class_id", "canonical", "copies"))
    )
    return classes.select("class_id", "canonical", "copies"), members, singles
