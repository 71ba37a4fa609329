import math
import random
import sqlite3

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from signalbox.operators import fts, ranking, retrieval, rulebooks, vectors
from signalbox.plans import search

DOCS = ["the brake valve was tested and the brake held", "oil pump and valve", "été à la gare, valve", "nothing here", "", "pump pump pump oil"]


def index(spark, docs=DOCS):
    df = spark.createDataFrame(list(enumerate(docs)), "id bigint, t string")
    return df, fts.token_rows(df, "id", "t"), fts.lengths(df, "id", "t")


def test_bm25_equals_sqlite(spark):
    _, rows, lens = index(spark)
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(i + 1, t) for i, t in enumerate(DOCS)])
    terms = ["pump", "valve", "ete"]
    want = {r[0] - 1: -r[1] for r in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (" OR ".join(terms),))}
    got = fts.bm25(spark.createDataFrame([(1, t) for t in terms], "query int, term string"), fts.postings(rows), lens)
    got = {r.doc: r.score for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_best_hits_equal_all_scores(spark):
    df, rows, lens = index(spark, [*DOCS, *DOCS, "Pumps and valves", None])
    q = spark.createDataFrame([(1, "pump"), (1, "valve"), (1, "valve"), (2, "valve"), (2, "valve"), (2, "pump"), (3, "gare"), (4, "none"), (None, "oil")], "query int, term string")
    want = fts.top_hits(fts.bm25(q.where("query IS NOT NULL"), fts.postings(rows), lens, weight=2.0).withColumn("score", F.round("score", 6)), 3)
    got = ranking.best_hits(q, df, "id", "t", 3, weight=2.0)
    order = ["query", "doc", "rank", "score"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect())) and got.count() == 8
    stems = ranking.best_hits(q.where("query = 3").withColumn("term", F.lit("valves")), df, "id", "t", 9, stem=True)
    assert {r.doc for r in stems.collect()} == {0, 1, 2, 6, 7, 8, 12}


def test_best_hits_of_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "oil pump"), (1, "valve"), (2, "pump pump"), (None, "oil"), (3, None)], "id bigint, t string")
    q = spark.createDataFrame([(7, "pump"), (7, "oil")], "query int, term string")
    got = {r.doc: r.score for r in ranking.best_hits(q, df, "id", "t", 5).collect()}
    part = lambda tf, n, df: max(math.log((5 - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 1.2))
    want = {1: sum(part(1, n, 2) * 2 for n in (2, 1)), 2: part(2, 2, 2)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_a_large_block_leaves_nothing_out():
    rng, n, terms = random.Random(3), 20_000, 60
    held = [{t: rng.choice((1, 1, 2, 5)) for t in range(terms) if rng.random() < 0.5 / (t + 1) + 0.001} for _ in range(n)]
    lens = [sum(h.values()) + rng.randrange(9) for h in held]
    df = np.array([sum(t in h for h in held) for t in range(terms)])
    idf, mean = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6), sum(lens) / n
    docs = pa.table({"doc": list(range(n)), "lens": [[x] for x in lens], "codes": pa.array([[t for t in h for _ in range(h[t])] for h in held], pa.list_(pa.int32()))})
    asked = [sorted(rng.choices(range(terms), k=rng.randint(1, 6))) for _ in range(40)]
    got = ranking._meet(docs, pa.table({"set": list(range(40)), "codes": pa.array(asked, pa.list_(pa.int32()))}), idf, mean, 1.0, 5)
    got = {r["set"]: [(h["worse"], h["doc"]) for h in r["hits"]] for r in got.to_pylist()}
    for i, codes in enumerate(asked):
        every = []
        for d, h in enumerate(held):
            s = sum(idf[t] * h[t] * 2.2 / (h[t] + 1.2 * (0.25 + 0.75 * lens[d] / mean)) for t in codes if t in h)
            if s:
                every.append((-math.floor(s * 1e6 + 0.5), d))
        assert got.get(i, []) == sorted(every)[:5]


def library(spark, path):
    words = [f"w{chr(97 + i)}" for i in range(14)]
    spark.createDataFrame([(1, "which valve"), (50, "pumps"), (7, " ".join(words))], "id bigint, question string").write.parquet(f"{path}/usage_questions.parquet")
    spark.createDataFrame([(3, "valve of the pump"), (4, "nothing"), (5, words[13])], "id bigint, content string").write.parquet(f"{path}/rag_chunks.parquet")
    spark.createDataFrame([(8, "V 1", "valve", ""), (9, "", "Oil", ", ".join([f"x{i}y" for i in range(12)] + ["pumps"]))], "doc_id bigint, document_number string, caption string, keywords string").write.parquet(f"{path}/documents.parquet")


def test_every_question_is_asked_with_all_its_terms(spark, tmp_path):
    library(spark, tmp_path)
    assert {(r.query, r.id) for r in search.bm25_or_topn(spark, str(tmp_path)).collect()} == {(1, 3), (7, 5)}
    assert {(r.query, r.id) for r in search.bm25_porter(spark, str(tmp_path)).collect()} == {(1, 3), (50, 3), (7, 5)}
    assert {(r.query, r.id) for r in search.bm25_weighted8(spark, str(tmp_path)).collect()} == {(1, 8), (50, 9)}


def test_the_best_of_a_long_row_are_those_of_all_scores(spark):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, int(i % 97 if i > 400 else 1), [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(1500)], "id int, kind int, v array<double>")
    q = v.where("id < 6").select(F.col("id").alias("query"), F.col("v").alias("qv"))
    for cap in (None, ("kind", 2)):
        best = lambda s: sorted(map(tuple, vectors.top_k(s.withColumn("score", F.round("score", 6)).join(v.select("id", "kind"), "id"), 5, cap=cap).select("query", "id", "score").collect()))  # noqa: B023, E731
        assert best(vectors.score_queries(q, v, best=5, cap=cap)) == best(vectors.score_queries(q, v))


def test_every_term_stems_phrases_and_snippets(spark):
    df, rows, lens = index(spark)
    q = spark.createDataFrame([(1, "pump"), (1, "oil")], "query int, term string")
    assert {r.doc for r in fts.bm25(q, fts.postings(rows), lens, every_term=True).collect()} == {1, 5}
    s = fts.bm25(fts.stemmed(spark.createDataFrame([(1, "pumps")], "query int, term string")), fts.postings(fts.stemmed(rows)), lens)
    assert {r.doc for r in s.collect()} == {1, 5}
    assert [(r.doc, r.pos) for r in fts.phrase_hits(rows, ["pump", "pump"]).orderBy("pos").collect()] == [(5, 0), (5, 1)]
    snip = {r.id: r.snippet for r in fts.snippet(df, "t", ["valve"], width=2).collect()}
    assert snip[4] == "" and "[[valve]]" in snip[0] and "[[valve]]" in snip[2]


def test_top_k_cap_and_zero_vectors(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "b", [0.5, 0.5]), (4, "b", [0.0, 0.0])], "id bigint, label string, v array<float>")
    u = v.select("id", "label", vectors.unit(F.col("v")).alias("v"))
    s = vectors.score_queries(u.where("id = 1").select(F.col("id").alias("query"), F.col("v").alias("qv")), u).join(u.select("id", "label"), "id")
    assert [r.id for r in vectors.top_k(s, 3, cap=("label", 1)).orderBy("rank").collect()] == [1, 3]


def test_retrieval_prefers_metadata_and_readable(spark):
    vec = [1.0] + [0.0] * 7
    chunks = spark.createDataFrame(
        [(1, "scan.pdf", 1, 1, "This scanned page holds generic workshop notes and weather remarks.", vec), (2, "text.pdf", 2, 1, "Bearing caps are checked with feeler gauges during routine exams.", vec), (3, "text.pdf", 2, 2, "4) A =F > iv) eC", vec)],
        "id bigint, source string, document_id bigint, page int, content string, embedding array<float>",
    )
    docs = spark.createDataFrame([(1, "scan.pdf", "SMI-900", "Power transformer maintenance manual", "transformer, oil"), (2, "text.pdf", "SMI-901", "Ordinary text document", "")], "doc_id bigint, filename string, document_number string, caption string, keywords string")
    asked = spark.createDataFrame([(7, "transformer manual", vec), (8, "SMI-900", vec)], "query bigint, text string, vector array<float>")
    out = retrieval.retrieve(asked, chunks, docs).collect()
    assert {r.id for r in out if r["rank"] == 1} == {1} and 3 not in {r.id for r in out}


def test_retrieval_finds_passages_without_a_vector(spark):
    vec = [1.0] + [0.0] * 7
    chunks = spark.createDataFrame(
        [(1, "a.pdf", 1, 1, "Bearing caps are checked with feeler gauges during routine exams.", None), (2, "b.pdf", 2, 1, "The weather was fine on the day of the visit to the depot.", vec), (3, "c.pdf", 3, 1, "This scanned page holds generic workshop notes and remarks.", None)],
        "id bigint, source string, document_id bigint, page int, content string, embedding array<float>",
    )
    docs = spark.createDataFrame([(3, "c.pdf", "SMI-900", "Power transformer maintenance manual", "transformer, oil")], "doc_id bigint, filename string, document_number string, caption string, keywords string")
    asked = spark.createDataFrame([(7, "feeler gauges", vec), (8, "SMI-900 transformer", vec)], "query bigint, text string, vector array<float>")
    config = retrieval.RetrievalConfig()
    assert {(r.query, r.id): r.score for r in retrieval.candidates(asked, chunks, docs, config).collect()} == {(7, 1): 0.5, (7, 2): 0.5, (8, 2): 0.5, (8, 3): 0.6}
    assert {(r.query, r.id) for r in retrieval.retrieve(asked, chunks, docs).collect()} == {(7, 1), (7, 2), (8, 2), (8, 3)}


def test_rulebook_parse(spark):
    lines = ["CHAPTER l", "SIGNALS", "1.01 Short title", "body one", "see 2.01 there", "1.03 NEXT RULE", "WRAPPED TITLE", "text", "1.02 not a heading", "CHAPTER II", "TRAINS", "2.01 Stops", "CHAPTER II", "more"]
    df = spark.createDataFrame([("b", i, x) for i, x in enumerate(lines)], "book string, pos bigint, line string")
    chapters, rules = rulebooks.parse(df)
    assert {(r.number, r.title) for r in chapters.collect()} == {(1, "SIGNALS"), (2, "TRAINS")}
    got = {r.number: (r.chapter, r.title, r.body) for r in rules.collect()}
    assert got == {"1.01": (1, "Short title", "body one\n\nsee 2.01 there"), "1.03": (1, "NEXT RULE WRAPPED TITLE", "text\n\n1.02 not a heading"), "2.01": (2, "Stops", "more")}
