import os
import random

import pytest

from signalbox.llm import byte_bpe as B

pytestmark = pytest.mark.skipif(not os.path.exists(B.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def known():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(B.VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_equals_the_library(known):
    e, rng = B.encoder(), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz ABC.,'\n\té中文字ไทยहि👷🏽 " + " 　​"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert e.encode(s) == known(s)
    for s in ("a" * 50_000, "ab" * 20_000, "ไ" * 20_000, "<|endoftext|>", "don't we'll I'VE", "   x", "x   "):
        assert e.encode(s) == known(s)


def test_column(spark, known):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x"), (None, " ", "x")]
    out = B.encode_column(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in out) == sorted([(1, tuple(known("Hello world")))] * 2 + [(2, ()), (3, ()), (0, tuple(known(" ")))])
    assert B.encode_column(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
