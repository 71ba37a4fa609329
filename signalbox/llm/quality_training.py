"""Trains the rule list of the quality verdict: ``python -m signalbox.llm.quality_training TABLES_DIR``.

Labelled passages are made here. Prose: runs of sentences from documents.text in the languages of the common words,
wrapped at random widths, with scan damage as problem 1 describes it, some cut down to a line or two. Not prose: lists,
tables, outlines and key-value sheets of the nouns in the same texts, and unreadable matter of several kinds. A third is
held out and its accuracy printed.
"""

from __future__ import annotations

import random
import re
import string
import sys
import textwrap

import numpy as np

from signalbox.llm import rulelist
from signalbox.llm.quality import _PRE, FEATURES, common_by_language, with_statistics

#: Documents whose texts are taken, in order of a hash of doc_id.
SAMPLE = 4000
_SLIPS = (("e", "c"), ("a", "@"), ("t", "+"), ("o", "0"), ("s", "5"), ("l", "1"), ("m", "rn"), ("u", "ii"), ("h", "b"), ("d", "cl"))


def _prose(rng: random.Random, sentences: list[str]) -> str:
    at = rng.randrange(len(sentences))
    text = " ".join(sentences[at : at + rng.choice((1, 1, 2, 3, 4, 5, 6, 8))])
    if rng.random() < 0.4:
        words = text.split(" ")
        for _ in range(rng.randint(1, 1 + len(words) // 6)):
            i = rng.randrange(len(words))
            words[i] = words[i].replace(*rng.choice(_SLIPS), 1)
        text = " ".join(words)
    if rng.random() < 0.7:
        lines = textwrap.wrap(text, rng.randint(30, 95)) or [text]
        for i in range(len(lines) - 1):
            if rng.random() < 0.12 and len(lines[i].rsplit(" ", 1)[-1]) > 5:
                lines[i] = lines[i][:-3] + rng.choice("-¬") + "\n" + lines[i][-3:]
        if rng.random() < 0.3:
            code = "".join(rng.choices(string.ascii_uppercase, k=3)) + f"-{rng.randrange(10**8):08d}"
            lines.insert(rng.randint(0, len(lines)), rng.choice((f"{code}  Rev B  Title Line", f"Page {rng.randint(1, 70)} of 70", f"- {rng.randint(1, 99)} -", f"DEPOT LIBRARY · {code}")))
        text = "\n".join(lines)
    return text


def _nouns(rng: random.Random, sentences: list[str]) -> list[str]:
    out = []
    for s in rng.sample(sentences, min(len(sentences), 40)):
        w = s.split(" ")
        i = rng.randrange(max(1, len(w) - 3))
        out.append(re.sub(r"[.!?,;:]", "", " ".join(w[i : i + rng.choice((1, 2, 2, 3))])))
    return out


def _code(rng: random.Random) -> str:
    return "".join(rng.choices(string.ascii_uppercase, k=rng.randint(1, 3))) + f"-{rng.randint(1, 400)}"


def _not_prose(rng: random.Random, sentences: list[str]) -> str:
    nouns, n = _nouns(rng, sentences), rng.randint(3, 22)
    item = lambda: rng.choice(nouns) + rng.choice(("", "", "", f", {rng.randint(2, 900)} pcs", f" x {rng.randint(2, 99)}", f" ({rng.randint(2, 99)})", f" – {rng.randint(2, 99)}", " " + _code(rng), ";", "."))
    number = lambda: f"{rng.uniform(0, 15):.{rng.randint(0, 2)}f}"
    kind = rng.randrange(12)
    if kind < 3:
        mark = rng.choice(("- ", "* ", "• ", "", "{}. ", "{}) ", "{a}) "))
        return "\n".join(mark.format(i + 1, a=string.ascii_lowercase[i % 26]) + item() for i in range(n))
    if kind < 5:
        sep, width = rng.choice((",", ";", "\t", " | ", "   ")), rng.randint(3, 5)
        head = [sep.join(("Item", "Code", "Qty", "Limit", "Unit")[:width])] if rng.random() < 0.5 else []
        cell = lambda i: rng.choice(nouns) if i == 0 and rng.random() < 0.6 else rng.choice((_code(rng), number(), str(rng.randint(1, 900))))
        return "\n".join(head + [sep.join(cell(i) for i in range(width)) for _ in range(n)])
    if kind == 5:
        sep = rng.choice((": ", " = ", " ..... ", "\t", " : "))
        return "\n".join(f"{rng.choice(nouns)}{sep}{number()} {rng.choice(('mm', 'kPa', 'V', 'Nm', 'kg'))}" for _ in range(n))
    if kind == 6:
        return "\n".join(" ".join(str(rng.randrange(10)) + rng.choice(("", "", ",", ".", "%", "O", "l", "#")) for _ in range(rng.randint(6, 22))) for _ in range(rng.randint(2, 9)))
    if kind == 7:
        return "\n".join("".join(rng.choices(string.ascii_letters + string.digits + "+/", k=60)) for _ in range(rng.randint(2, 8)))
    if kind == 8:
        return " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(1, 7))) for _ in range(rng.randint(15, 70)))
    if kind == 9:
        return " ".join("".join(rng.choices("äöüéñ§°“–�Ÿ", k=rng.randint(1, 4))).encode().decode("cp1252", "replace") for _ in range(rng.randint(15, 60)))
    if kind == 10:
        return "\n".join(rng.choice((". ", "_", "=", "- ", ".")) * rng.randint(15, 50) + rng.choice(("", "", f" {rng.randint(2, 300)}")) for _ in range(n))
    bits = ["|", "§", "¢", "°o", "rn", "iv", "ii", "Il", "=F", "eC", "4)", "~", "^", "_", ":", ";", "--", "»", ",,", "(", ")", "\\", "A"]
    return "\n".join(" ".join(rng.choices(bits, k=rng.randint(5, 16))) for _ in range(rng.randint(2, 8)))


def labelled(texts: list[str], n: int = 16_000, seed: int = 11) -> list[tuple[str, bool]]:
    """Labelled passages made from texts of prose."""
    rng = random.Random(seed)
    pools = []
    for t in texts:
        plain = [p.replace("\n", " ") for p in t.split("\n\n") if not re.search(r"(?m)^(?:[-•*]|\d+[.)]|[a-z]\)) ", p) and re.search(r"[.!?]", p)]
        s = [x for p in plain for x in re.findall(r"[^.!?]+(?:[.!?](?!\s)[^.!?]*)*[.!?]+[”\"»]?", p)]
        if len(s) >= 3:
            pools.append([x.strip() for x in s])
    return [(_prose(rng, rng.choice(pools)), True) if i % 2 else (_not_prose(rng, rng.choice(pools)), False) for i in range(n)]


def main(folder: str) -> None:
    from pyspark.sql import functions as F

    from signalbox.session import get_spark
    from signalbox.tables import load

    spark = get_spark(master="local[*]")
    common = common_by_language(load(spark, folder, "common_words"))
    docs = load(spark, folder, "documents", "doc_id", "text", "lang").where(F.lower("lang").isin(list(common)) & F.col("text").rlike(r"\S"))
    texts = [r.text for r in docs.orderBy(F.xxhash64("doc_id")).limit(SAMPLE).collect()]
    rows = spark.createDataFrame(labelled(texts), "text string, prose boolean")
    data = with_statistics(rows, "text", common).toPandas().rename(columns=lambda c: c.removeprefix(_PRE))
    y, x = data["prose"].to_numpy(), {f: data[f].to_numpy() for f in FEATURES}
    held = np.arange(len(y)) % 3 == 0
    rules = rulelist.fit({f: v[~held] for f, v in x.items()}, y[~held])
    said = rules.predict({f: v[held] for f, v in x.items()})
    print(f"held out: {held.sum()} passages, accuracy {np.mean(said == y[held]):.4f}, rules {len(rules.rules)}")
    for i in np.flatnonzero(said != y[held])[:12]:
        print(y[held][i], repr(data["text"][held].iloc[i][:160]), data[list(FEATURES)][held].iloc[i].round(2).to_dict())
    rulelist.save(rules, rulelist.LEARNED)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
