import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbox.functions import replies as R
from signalbox.operators import embedding, ingest


def test_index_pass(spark):
    docs = spark.createDataFrame([("a.pdf", 1, "old", "n", "k", 1, 1, 1, "indexed", "m", 1), ("b.pdf", 2, "b", "n", "k", 1, 1, 1, "indexed", "m", 0)], "source string, document_id bigint, title string, document_number string, keywords string, page_count int, content_chars bigint, chunk_count int, status string, embedding_model string, final int")
    chunks = spark.createDataFrame([("a.pdf", 1, 1, 0, "old text", [1.0], "m", 1), ("b.pdf", 2, 1, 0, "kept", [1.0], "m", 1)], "source string, document_id bigint, page int, chunk_index int, content string, embedding array<float>, embedding_model string, dimensions int")
    pages = spark.createDataFrame([("a.pdf", 1, "Bearing caps are checked with gauges."), ("a.pdf", 2, "Every cap is checked twice a year."), ("c.pdf", 1, "§ | ~")], "source string, page int, text string")
    meta = spark.createDataFrame([("a.pdf", 1, "New title", "SMI-1", "caps")], "source string, document_id bigint, title string, document_number string, keywords string")
    new = ingest.index_pages(ingest.Index(docs, chunks), pages, meta, "test:m|v3")
    got = {r.source: (r.title, r.status, r.chunk_count, r.final) for r in new.documents.collect()}
    assert got == {"a.pdf": ("New title", "indexed", 2, 1), "b.pdf": ("b", "indexed", 1, 0), "c.pdf": (None, "no-text", 0, 0)}
    kept = {(r.source, r.chunk_index, r.dimensions) for r in new.chunks.collect()}
    assert kept == {("a.pdf", 0, 8), ("a.pdf", 1, 8), ("b.pdf", 0, 1)}
    gone = ingest.remove_files(new, spark.createDataFrame([("b.pdf",)], "source string"))
    assert {r.source for r in gone.chunks.collect()} == {"a.pdf"}


def test_plug_in_batches(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(40)], "id int, t string").coalesce(1)

    def model(texts):
        assert len(texts) <= 7
        return np.array([[len(t), 1.0] for t in texts])

    out = embedding.embed(df, "t", model, batch=7, prefix="q: ").orderBy("id").collect()
    assert len(out) == 40 and abs(sum(x * x for x in out[9].embedding) - 1) < 1e-6
    with pytest.raises(Exception, match="vectors for"):
        embedding.embed(df, "t", lambda texts: np.ones((1, 2))).collect()


def test_reviewed(spark):
    rows = spark.createDataFrame([("s", 1.4, " a\r\nb "), ("s", -1.0, "x"), ("s", float("nan"), "y"), ("s", 2.0, "  "), ("s", None, None)], "source string, page double, content string")
    assert sorted((r.page, r.content) for r in ingest.reviewed_chunks(rows).collect()) == [(0, "x"), (0, "y"), (1, "a\nb")]


def test_replies(spark):
    df = spark.createDataFrame([([(True, "hm"), (False, "The "), (None, "answer")], 429, "x", 2)], "p array<struct<thought:boolean,text:string>>, s int, m string, n int")
    r = df.select(R.reply_text(F.col("p")).alias("t"), R.error_class(F.col("s"), F.col("m")).alias("k"), R.retry_delay(F.col("n"), F.lit(None).cast("bigint")).alias("d"), R.number_or(F.col("m"), 4).alias("v")).first()
    assert (r.t, r.k, r.d, r.v) == ("The answer", "quota", 4000, 4.0)
