import pytest

from signalbox.llm import sentences as N
from signalbox.llm.sentences import Segmenter, split_sentences

#: What a corpus would say of the words in CASES; there are no lists in the library.
KNOWN = {w: N.TITLE for w in "mr dr no fig abs nr hr art pág sr dra mme m".split()} | {w: N.INSIDE for w in "dept bzw env aprox c.-à-d p.ej".split()} | {w: N.ENDS for w in "p.m etc usw".split()}

CASES = [
    ["The valve is shut.", "Mr. Smith and Dr. Jones saw it at 20.15 a.m. in the room.", "It costs 3.5 kg."],
    ["It was tested at 41 p.m.", "Do not open it."],
    ["Bring nuts, washers, etc.", "The guard left."],
    ['"Stop! Do not touch it!" shouted the crew in the pit.', "Version 12.4.21 is void!"],
    ['The driver said: "Leave it alone. It was tested."', "The gear is shut."],
    ["“Is the fan loose?” Selholm asked the guard.", "The end."],
    ["(The pump is shown on sheet No. 5.)", "R. K. Gridell took over from J. Eskneric in the Dept. of Rolling Stock."],
    ["Am 3. Mai wurde es geprüft.", "Ersatzteile sind Muttern, Bolzen usw.", "Dr. Kesndell und Hr. Wennstad haben Nr. 250 bzw. Nr. 22 geprüft.", "„Ist es dicht?“, fragte die Prüferin."],
    ["Laut Abs. 33 der Vorschrift, d. h. bei Frost, gilt z. B. Regel 1.550,5 nicht."],
    ["Selon l’art. 25, c.-à-d. par temps froid, M. Roche et Mme Var ont relevé 13,5 bars env. sur le bogie.", "Attention, le relais est usé !", "« Est-ce que la porte est propre ? » demanda le contrôleur."],
    ["El Sr. Ost y la Dra. Bre midieron 4,3 bares aprox. en el relé.", "¿Por qué?", "«¿Está seco?», preguntó el equipo."],
    ["डॉ. Eskbedell ने केबल को जाँचा।", "क्या पंप साफ है?"],
    ["قال د. Yarric إن المضخة جافة.", "هل هي ساخنة؟"],
]


@pytest.mark.parametrize("want", CASES)
def test_units(want):
    text = "  " + " ".join(want) + " "
    assert [text[a:b] for a, b in Segmenter(KNOWN).units(text)] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("“先停车。再紧固车钩。”库管员说。严禁打开主风缸！值班员问：“开裂了吗？”下雨之后，司机必须测量。", ["“先停车。再紧固车钩。”库管员说。", "严禁打开主风缸！", "值班员问：“开裂了吗？”", "下雨之后，司机必须测量。"]),
        ("「送風機は乾いているか。」と運転士が聞いた。圧力は12.3MPaで、触るな！", ["「送風機は乾いているか。」と運転士が聞いた。", "圧力は12.3MPaで、触るな！"]),
        ("ถ้าร้อนให้แจ้งทันที ห้ามแตะต้อง\n\nความดันคือ9.6บาร์", ["ถ้าร้อนให้แจ้งทันที", "ห้ามแตะต้อง", "ความดันคือ9.6บาร์"]),
        ("9. Safety\n\nOne is\nwrapped. Two\n\n1) pump.\n2) case, 3 mm\n3) cock", ["9. Safety", "One is\nwrapped.", "Two", "1) pump.", "2) case, 3 mm", "3) cock"]),
        ("It hardens.Do not open.See www.shed9.example now.", ["It hardens.", "Do not open.", "See www.shed9.example now."]),
        ("It was drained ... and then left. The guard waited… and it was cut of", ["It was drained ... and then left.", "The guard waited… and it was cut of"]),
        ("It is shut. “Is the fan loose?” Sel", ["It is shut.", "“Is the fan loose?” Sel"]),
        ("“Is the fan loose?” Selholm as", ["“Is the fan loose?” Selholm as"]),
        ("", []),
        (None, []),
        (" \n\n ", []),
    ],
)
def test_scripts_lists_and_layout(text, want):
    assert [text[a:b] for a, b in Segmenter().units(text)] == want if text else Segmenter().units(text) == []


def test_document_decides_first():
    assert len(Segmenter().units("The qwx. valve is shut. A qwx. Smith came and Smith left.")) == 2
    # Its stop ends a paragraph here, whatever the corpus says.
    assert len(Segmenter({"dept": N.INSIDE}).units("Ask the dept. The valve is shut.\n\nAsk the dept.\n\nIt is shut.")) == 4
    assert len(Segmenter({"dept": N.INSIDE}).units("Ask the dept. Smith and Smith left. He saw Smith.")) == 2


def test_shapes_where_nothing_is_known():
    for text in ("Mr. Smith left.", "See e.g. Smith.", "J. Smith left.", "See Fig. 3 now."):
        assert len(Segmenter().units(text)) == 1


def corpus():
    rows = [f"The valve{i} is shut. It was seen by Mr. Smith{i} and Abcd. No{i} in the dept. of rolling stock.\n\nIt left at 5 p.m. The guard left." for i in range(300)]
    rows += [f"The guard of hall{i} left at 6 p.m.\n\nIt is shut. Ask Gulu. {i} and the pit. The end of rope{i}.\n\nIt is in the pit." for i in range(300)]
    return rows


def test_evidence_is_learned_and_decides(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(corpus())), "doc_id bigint, body string")
    known = {r.word: r.verdict for r in N.corpus_evidence(df, "body").collect()}
    assert {w: known.get(w) for w in ("mr", "abcd", "dept", "gulu", "p.m", "pit", "shut", "left")} == {"mr": "title", "abcd": "title", "dept": "inside", "gulu": "title", "p.m": "ends", "pit": "ends", "shut": "ends", "left": "ends"}
    full = {tuple(r) for r in split_sentences(df, "doc_id", "body").collect()}
    assert len(full) == 300 * 4 + 300 * 5
    monkeypatch.setattr(N, "BROADCAST_WORDS", 0)
    assert {tuple(r) for r in split_sentences(df, "doc_id", "body").collect()} == full
    none = {(i, *u) for i, t in enumerate(corpus()) for u in Segmenter({}).units(t)}
    assert len(full - none) > 800


@pytest.mark.parametrize("n", [50, 130, 185, 5000])
def test_no_length_changes_an_entry_or_a_speaker(n):
    entry = "- " + "word " * n + "ends. Then more."
    assert len(Segmenter().units(entry)) == 1
    assert len(Segmenter().units("It is shut.\n\n“Is it loose?” " + "S" + "o" * n + " asked the guard. The end.")) == 3
    assert len(Segmenter({"x" * n: N.TITLE}).units("See " + "x" * n + ". Smith now.")) == 1
    assert len(Segmenter().units("“先停车。”" + "员" * n + "说。严禁打开。")) == 2


def test_repeats_nulls_long_and_empty(spark):
    rows = [(i, "The qwx. valve is shut. All is well.", "x") for i in range(6)] + [(9, "See qwx. Valve. Done.", "x"), (9, "See qwx. Valve. Done.", "x"), (10, None, "x"), (11, "", "x"), (12, "Word. " * 20_000, "x"), (13, "a." * 20_000, "x"), (None, "It is.", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, body string, start_pos string")
    out = split_sentences(df, "doc_id", "body").toPandas()
    assert (out["doc_id"] == 12).sum() == 20_000 and set(out["doc_id"].dropna()) == {*range(6), 9, 12, 13} and (out["doc_id"] == 0).sum() == 2 and out["doc_id"].isna().sum() == 1
    assert split_sentences(df.limit(0), "doc_id", "body").count() == 0


def test_units_never_overlap():
    s = Segmenter()
    for text in ('A "b. C. d', "(((. ) A. B", "„x“ y. Z „q", '3/4" hose. Next', "....", "?!", "A.\n\n\n B", "。。「」"):
        at = 0
        for a, b in s.units(text):
            assert at <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace()
            at = b
