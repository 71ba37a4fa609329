import numpy as np

from signalbox.llm import quality as Q
from signalbox.llm import rulelist as R

COMMON = {"en": ["the", "of", "and", "is"]}
PROSE = "The brake valve of the coach was tested and it is sound. The guard of the train waited until the lamp went out."
TABLE = "Item;Code;Qty\nvalve;TP-1;3\nhose;TP-2;9\nlamp;TP-3;12\npump;TP-4;1"


def test_statistics(spark):
    df = spark.createDataFrame([("The cat is 12!\nA dog",)], "t string")
    r = Q.with_statistics(df, "t", COMMON).first().asDict()
    assert r["__q_words"] == 5 and abs(r["__q_mean_word_length"] - 12 / 5) < 1e-9 and abs(r["__q_common_ratio"] - 2 / 5) < 1e-9
    assert abs(r["__q_digit_ratio"] - 2 / 15) < 1e-9 and abs(r["__q_symbol_ratio"] - 1 / 15) < 1e-9 and r["__q_line_end_ratio"] == 0.5


def test_verdicts_nulls_ties_and_names(spark):
    data = [("p", PROSE), ("p", "12 34 §§"), ("t", TABLE), ("t", "yes."), ("n", None), ("b", "  "), (None, PROSE), ("q", PROSE), ("q", PROSE), ("l", PROSE * 2000)]
    df = spark.createDataFrame([(s, t, "x", 1) for s, t in data], "source string, content string, document string, words int")
    got = {r.document: r.prose for r in Q.document_quality(df.select("source", "content", "document", "words"), "source", "content", COMMON).collect()}
    assert got == {"p": True, "t": False, "q": True, "l": True}
    assert Q.document_quality(df.limit(0), "source", "content", COMMON).count() == 0


def test_rule_learning_and_sql(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.uniform(0, 1, 3000), "b": rng.uniform(0, 1, 3000)}
    y = ((x["a"] > 0.7) & (x["b"] <= 0.5)) | (x["b"] > 0.9)
    rules = R.fit({k: v[:2000] for k, v in x.items()}, y[:2000])
    said = rules.predict({k: v[2000:] for k, v in x.items()})
    assert np.mean(said == y[2000:]) > 0.97
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x["a"][2000:], x["b"][2000:])], "a double, b double")
    sql = [r[0] for r in df.selectExpr(R.case_expression(rules)).collect()]
    assert sql == said.tolist()


def test_learned_rules_on_held_out_passages(spark):
    from signalbox.llm.quality_training import labelled

    texts = ["The brake valve is tested. The guard of the train waits in the cab. Nobody opens the door of the shed.\n\nThe lamp is lit and the line is free. It is enough."] * 3
    rows = spark.createDataFrame(labelled(texts, 1000, seed=99), "text string, prose boolean")
    got = Q.passage_statistics(rows, "text", COMMON).selectExpr("avg(IF(prose = __q_prose, 1, 0))").first()[0]
    assert got > 0.95
