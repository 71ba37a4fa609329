import random

from pyspark.sql import functions as F

from signalbox.plans import streams
from signalbox.sources import files, sinks
from signalbox.streaming import answers, limiter, windows


def test_limiter_exact_and_batch(spark):
    times = [i * 1000 for i in range(13)] + [60_000]
    ok = spark.createDataFrame([(times,)], "t array<bigint>").select(limiter.accepted(F.col("t")).alias("x")).first().x
    assert ok == times[:12] + [60_000]
    rng = random.Random(3)
    rows = [(k, t) for k in "ab" for t in sorted(rng.randrange(600_000) for _ in range(80))]
    out = limiter.limit_batch(spark.createDataFrame(rows, "k string, ms bigint"), "k", "ms", limit=3, period=30_000)
    got = sorted((r.k, r.ms, r.ok) for r in out.collect())
    want = []
    for k in "ab":
        t = [x for c, x in rows if c == k]
        want += list(zip([k] * len(t), t, limiter._decide(t, [], 3, 30_000)[0], strict=True))
    assert got == sorted(want)


def test_answer_machine_at_every_split():
    text = "<think>hm, let me see</think>Okay, the VCB is the vacuum circuit breaker used in traction. It is tested."
    for i in range(len(text)):
        assert "".join(answers.clean_fragments([text[:i], text[i:]])) == "the VCB is the vacuum circuit breaker used in traction. It is tested.", i
    assert "".join(answers.clean_fragments(["Let me think about ", "this question for the user."])) == ""
    assert "".join(answers.clean_fragments(["yes"])) == "yes" and answers.clean_fragments([]) == []


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(s), i, c, i == 3) for s in range(4) for i, c in enumerate(["<thi", "nk>x</think>The ans", "wer is long enough to pass the head's limit of chars, ", f"no {s}."])]
    df = spark.createDataFrame(rows, "stream_id string, seq bigint, content string, done boolean")
    df.write.parquet(str(tmp_path / "in"))
    stream = answers.clean_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    got = windows.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    want = answers.clean_batch(df)
    join = lambda d: {r[0]: r[1] for r in d.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "")).collect()}
    assert join(got) == join(want) == {str(s): f"The answer is long enough to pass the head's limit of chars, no {s}." for s in range(4)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one\x0ctwo")
    (tmp_path / ".b.pdf").write_bytes(b"x")
    (tmp_path / "bad.pdf").write_bytes(b"%")
    assert {r.source for r in files.scan_folder(spark, str(tmp_path)).collect()} == {"a.PDF", "bad.pdf"}

    def reader(data):
        if not data:
            raise ValueError("empty file")
        return data.decode().split("\x0c") + ["a page of text that is long enough to be kept here"]

    raw = spark.createDataFrame([("a.PDF", b"one\x0ctwo"), ("bad.pdf", b"")], "source string, content binary")
    pages = {(r.source, r.page): r.error for r in files.read_pages(raw, reader).collect()}
    assert pages == {("a.PDF", 3): None, ("bad.pdf", 0): "empty file"}
    runs = spark.createDataFrame([(1, 0, 10.0, "He"), (1, 1, 11.0, "llo"), (1, 2, 30.2, "there")], "page int, seq int, y double, text string")
    assert [r.line for r in files.glyph_lines(runs, ["page"]).orderBy("line_no").collect()] == ["Hello", "there"]
    lines = spark.createDataFrame([('{"message":{"content":"hi"},"done":false}',), ("broken",), ('{"done":true,"done_reason":"stop"}',)], "value string")
    assert [(r.content, r.done) for r in files.read_chat_lines(lines).collect()] == [("hi", False), ("", True)]
    p = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), p, "k")
    sinks.replace_partitions(spark.createDataFrame([("a", 2)], "k string, v int"), p, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(p).collect()} == {("a", 2), ("b", 1)}


def test_tumbling_stream_drops_repeats_and_closes_the_last_day(spark, tmp_path):
    hits = [(1, "a", "2026-01-01 10:00:00"), (1, "a", "2026-01-01 10:00:00"), (2, "a", "2026-01-01 11:00:00"), (3, "b", "2026-01-20 10:00:00"), (None, "b", "2026-01-20 11:00:00"), (None, "b", "2026-01-20 12:00:00")]
    df = spark.createDataFrame(hits, "id bigint, name string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "usage_page_hits.parquet"))
    got = {tuple(r) for r in streams.tumbling_counts_stream(spark, str(tmp_path)).collect()}
    assert got == {("a", "2026-01-01", 2), ("b", "2026-01-20", 3)}
