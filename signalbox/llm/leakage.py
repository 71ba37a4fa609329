"""Evaluation texts leaking into training text (problem 9).

Winnowing over words: of every ``window`` neighbouring ``k``-word hashes the smallest is kept, so any span of at
least ``k + window - 1`` words shared by two texts leaves a shared fingerprint. Training and test fingerprints are
joined; each (document, item) that meets is then extended word by word from the shared k-grams to its longest shared
span, which is exact. Fingerprints of the corpus are never gathered: they are streamed past the test items' (the
test side is broadcast only if its counted size is within a bound, else both sides are shuffled by hash).

Defined results
---------------
* words are runs of letters and digits, compared without case; punctuation and spacing between them do not matter;
* a pair is reported when at least ``span`` consecutive words of the item stand in the document;
* null, empty and short texts share nothing; repeated rows of an id count once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.spread import bounded_broadcast, spread
from signalbox.session import cut

SPAN, K = 12, 6
#: Fingerprints (8 bytes and an id) of the test side that may be broadcast; documents beside whose ids may be.
BROADCAST_ROWS = 1_000_000
#: Bytes of the texts of items that met a document that may be broadcast.
BROADCAST_BYTES = 64 << 20
_REMEMBER = 1_000_000

words_of = regex.compile(r"[\p{L}\p{N}]+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            if len(known) >= _REMEMBER:
                known.clear()
            h = known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def gram_hashes(words: list[str], k: int, known: dict[str, int]) -> np.ndarray:
    """The hash of each run of k words."""
    h = _word_hashes(words, known)
    if len(h) < k:
        return h[:0]
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * _BASE + h[i : len(h) - k + 1 + i]
    out ^= out >> np.uint64(29)
    return out * _BASE


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """The distinct minima of the sliding windows; of a shorter row of grams, the minimum."""
    if len(grams) <= window:
        return grams[:0] if not len(grams) else grams.min(keepdims=True)
    least = grams[: len(grams) - window + 1]
    for i in range(1, window):
        least = np.minimum(least, grams[i : len(grams) - window + 1 + i])
    return np.unique(least)


def fingerprints(df: DataFrame, id_col: str, text_col: str, span: int = SPAN, k: int = K) -> DataFrame:
    """(id, fp): the winnowed fingerprints of each text of at least ``span`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, fps = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text.casefold()) if text else []
                if len(words) >= span:
                    found = winnow(gram_hashes(words, k, known), span - k + 1)
                    fps.append(found.view(np.int64))
                    ids.append(np.full(len(found), i))
            take = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64), pa.int64())
            fp = pa.array(np.concatenate(fps) if fps else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), fp], names=["id", "fp"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp bigint")


def longest_shared(doc: list[str], item: list[str], k: int = K) -> int:
    """Words of the longest run shared by two texts, if it has at least k words: seeds of k words, extended."""
    starts: dict[tuple[str, ...], list[int]] = {}
    for j in range(len(item) - k + 1):
        starts.setdefault(tuple(item[j : j + k]), []).append(j)
    best, n, m = 0, len(doc), len(item)
    reached: dict[int, int] = {}  # diagonal -> end of the last run on it, so that no run is walked twice
    for i in range(n - k + 1):
        for j in starts.get(tuple(doc[i : i + k]), ()):
            if reached.get(i - j, -1) > i:
                continue
            end = k
            while i + end < n and j + end < m and doc[i + end] == item[j + end]:
                end += 1
            reached[i - j] = i + end - k + 1
            best = max(best, end)
    return best


def leaks(
    docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, span: int = SPAN, k: int = K
) -> DataFrame:
    """(doc_id, item_id, words): documents that hold at least ``span`` consecutive words of an item, with the longest run."""
    corpus = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("doc_text")).where(F.col(doc_text).isNotNull()))
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).where(F.col(item_text).isNotNull())
    test_fps = cut(fingerprints(tests, "item_id", "item_text", span, k).select(F.col("id").alias("item_id"), "fp").distinct())
    test_rows = test_fps.count()
    # Items that share a fingerprint share its row, so that a common one meets each document once.
    by_fp = test_fps.groupBy("fp").agg(F.collect_set("item_id").alias("items")) if test_rows <= BROADCAST_ROWS else None
    doc_fps = fingerprints(corpus, "doc_id", "doc_text", span, k).select(F.col("id").alias("doc_id"), "fp")
    if by_fp is not None:
        met = doc_fps.join(F.broadcast(by_fp), "fp").select("doc_id", F.explode("items").alias("item_id"))
    else:
        met = doc_fps.join(test_fps, "fp").select("doc_id", "item_id")
    met = cut(met.distinct())
    # Only documents that met an item are read again, each once with all its items, and extended against them. Only the
    # items that met a document are needed; their texts are broadcast by their counted bytes.
    held = cut(met.groupBy("doc_id").agg(F.collect_list("item_id").alias("held")))  # no more than there are items
    suspects = corpus.join(bounded_broadcast(held, held.count(), BROADCAST_ROWS), "doc_id")
    needed = cut(tests.join(met.select("item_id").distinct(), "item_id", "left_semi").distinct())
    size = needed.agg(F.count("*").alias("n"), F.sum(F.octet_length("item_text")).alias("bytes")).first()
    within = max(size.n * 64, size.bytes or 0) <= BROADCAST_BYTES
    if within:
        texts: dict[object, list[str]] = {}
        for r in needed.collect():
            texts.setdefault(r.item_id, []).append(r.item_text)
        shared = docs.sparkSession.sparkContext.broadcast(texts)
        pairs = suspects.select("doc_id", "doc_text", "held")
    else:
        pairs = suspects.select("doc_id", "doc_text", F.explode("held").alias("item_id")).join(needed, "item_id").select("doc_id", "doc_text", F.array("item_id").alias("held"), "item_text")

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split: dict[str, list[str]] = {}
        for pdf in frames:
            rows, last, doc = [], None, []
            for at, (doc_id, text, items_) in enumerate(zip(pdf["doc_id"], pdf["doc_text"], pdf["held"], strict=True)):
                if text is not last:
                    last, doc = text, words_of(text.casefold())
                for item_id in items_:
                    for item in shared.value[item_id] if within else (pdf["item_text"].iloc[at],):
                        if item not in split:
                            if len(split) > 10_000:
                                split.clear()
                            split[item] = words_of(item.casefold())
                        rows.append((doc_id, item_id, longest_shared(doc, split[item], k)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words"]).astype({"words": np.int32})

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    runs = pairs.mapInPandas(
        extend, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, words int"
    )
    return runs.where(F.col("words") >= span).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
