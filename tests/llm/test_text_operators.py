import random

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import pairs, reading, scans
from lodestream.llm.splitting import cut_level, oversized, split_sections, split_text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", "Long sentence here.", " ", "\n\n", "\r\n\r\n", "x" * 70, "𝑀", "! "]), max_size=120).map("".join), st.integers(40, 120))
def test_pieces(text, limit):
    got = split_text(text, limit, 10)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got)
    assert all(n[0] == max(0, p[1] - 10) for p, n in zip(got, got[1:], strict=False))
    assert "".join(text[(p[1] if k else 0) : q[1]] for k, (p, q) in enumerate(zip([(0, 0), *got], got, strict=False))) == text
    assert len(got) == 1 or len(text) > limit


def test_levels_and_table(spark):
    s = "Some words here. " * 100
    texts = {1: "short", 2: (s + "\n\n") * 2, 3: s * 3, 4: "word " * 900, 5: "x" * 2001, 6: None, 7: "", 8: "x" * 2000}
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()] + [(1, "short", "clash")], "section_id bigint, content string, piece string")
    pieces = split_sections(df)
    assert rows(oversized(pieces)) == [(2, "paragraph"), (3, "sentence"), (4, "word"), (5, "char")]
    assert sorted(r.section_id for r in pieces.where("piece_no = 0").collect()) == [1, 1, 2, 3, 4, 5, 7, 8]
    assert split_sections(df.limit(0)).count() == 0 and cut_level("a\n \nb", 1) == "paragraph"


def test_no_finer_cut_than_needed():
    r = random.Random(6)
    for _ in range(100):
        text = "".join(("a" * r.randrange(1, 9) + r.choice([". ", " ", "\n\n"])) for _ in range(120)) + "b" * r.randrange(0, 40)
        got = split_text(text, 60, 10)
        units = max(len(u) for u in text.split("\n\n"))
        if units <= 40:  # each paragraph fits beside the overlap
            assert all(text[b - 2 : b] == "\n\n" for _, b in got[:-1])


def kwargs(x):
    import json

    return json.dumps({"gold": x})


def test_defects():
    q, f = "How was zinc oxide prepared before milling?", "Your answer should be one sentence."
    one = lambda r, question=q: (pairs.defects_of(question, f, r) or [None])[0]
    for r in (None, "", " \n", "N/A", "null", "None", "—", "?", "...", '""', "​", [], {}):
        assert one(r) == "empty", r
    for r in ("I can't help with that request.", "Sorry, this cannot be answered without the full paper.", "Ich kann diese Frage leider nicht beantworten.", "Lo siento, no puedo responder.", "죄송합니다. 답변할 수 없습니다.", "REJECT"):
        assert one(r) == "refusal", r
    for r in (q, q.upper(), "Question: " + q, "you ask: how was zinc oxide prepared before milling.", f):
        assert one(r) == "copy", r
    for r in ("The powder was stirred for", '["sol-gel synthesis", "spark plas', "It is attributed to the (as shown in", "The powder was stirred...", "The powder, namely", "A layer of the […]"):
        assert one(r) == "truncated", r
    for r in ("Parce que les grains deviennent plus gros et que les parois se déplacent.", "분말을 눌러 성형한 뒤 소결하였다.", "Weil die Körner mit der Zeit wachsen und nicht mehr haften."):
        assert one(r) == "language", r
    for r in (5, 0, False, ["a"], "zinc oxide", "The powder was dried.", "so-called “glissement” route, a variant of milling", "As to the question of how was zinc oxide prepared before milling: it was dried.", "No reliable value was available since zinc oxide decomposes.", "42"):
        assert one(r) is None, r
    assert one("Porque los granos crecen y quedan menos centros.", "¿Por qué disminuye el campo de zinc oxide?") is None


def test_pairs_table(spark):
    schema = "qa_id bigint, question string, answer_format string, evaluator struct<eval_func:string,eval_kwargs:string>, response string, stat int"
    full = [(k, "What does it do?", None, ("f", kwargs(f"The sample number {k} was fired twice in air.")), None, 1) for k in range(60)]
    odd = [(100, "What does it do?", None, ("f", kwargs("The sample number 3 was fired")), None, 1), (101, None, None, None, None, 1), (102, None, None, ("f", "no json"), None, 1), (103, "q", "f", ("f", kwargs("x" * 50000 + ".")), None, 1), (104, "What?", None, ("f", None), None, 1), (None, "What?", None, ("f", None), None, 1)]
    df = spark.createDataFrame(full + odd, schema)
    assert rows(pairs.first_defect(pairs.pair_defects(df))) == [(100, "truncated"), (101, "empty"), (102, "empty"), (104, "empty")]
    assert pairs.pair_defects(df.limit(0)).count() == 0


BODY = "The average size was calculated from the peak width and is close to the value for all magnetic compositions."


def test_scan_noise(spark):
    clean = [(k, f"{BODY}\n\nThe measured coercivity of the grain-boundary phase depends on temperature.", "x") for k in range(60)]
    page = "The average size was calcu-\nlated from the peak width and is close\n- 17 -\nHARD MAGNET ANNALS\nto the value for all rnagnetic grain-\nboundary compositions. The measured\nArchive copy, do not lend\ncoercivity depends on temperature.\n\n1. first item\n2. second item"
    other = "The average size was calculated from the\nArchive copy, do not lend\npeak width and is close to the value."
    df = spark.createDataFrame([*clean, (100, page, "x"), (101, other, "x"), (102, None, "x"), (103, "", "x"), (104, "a" * 50000, "x"), (101, other, "x")], "section_id bigint, content string, kind string")
    noise = scans.find_noise(df)
    assert rows(scans.noise_kinds(noise)) == [(100, "header"), (100, "hyphen"), (100, "ocr_char"), (100, "page_no"), (101, "header")]
    fixed = {r.section_id: r.repaired for r in scans.repair(df, noise).collect()}
    assert fixed[100].split("\n\n")[0] == "The average size was calculated from the peak width and is close to the value for all magnetic grain-boundary compositions. The measured coercivity depends on temperature."
    assert scans.find_noise(df.limit(0)).count() == 0


def test_number_sequences_and_edges():
    page = lambda text: [x.text for x in scans.lines_of(text) if x.page]
    assert page("a = 1\n\n17\n\nb = 2\n\n18\n\nc = 3") == ["17", "18"]  # no prose near, but they count up
    assert page("a = 1\n\n17\n\nb = 2\n\n90\n\nc = 3") == []
    assert page("The grains of all samples grow.\n17") == ["17"] and page("17") == [] and page("[17]") == []
    assert [scans.number_of(x) for x in ("- l54 -", "xiv", "page 12 of 90", "—", "IX")] == [154, 14, 12, None, 9]
    lines = scans.lines_of("x = 1\n\nHARD MAGNETS\n\ny = 2\n\n\nThe grains of all samples grow.\nHARD MAGNETS\nand they stay.")
    assert [x.edge for x in lines if x.shape] == [False, True]
    assert scans.splits_of(scans.lines_of("they were calcu-\n\n\n\n\n\n\nlated twice")) == [(0, "calcu", "lated", 7)]


LEVEL = {1: ["The magnet can pull the big red key.", "We put it on the desk."], 2: ["The company wants to sell a cheaper motor before the end of the year.", "Makers say the price of the metal has gone up again."], 3: ["The average grain size is estimated from the width of the diffraction peak.", "The curve is fitted with a straight line in the linear region."], 4: ["Magnetocrystalline anisotropy renormalises the interfacial exchange stiffness.", "Deconvolution of hyperfine distributions corroborates sublattice canting."]}


def test_misread_words_of_large_tables(spark):
    data = [(k, "the magnctic moment" if k < 105 else "the magnetic moment") for k in range(2205)]
    noise = scans.find_noise(spark.createDataFrame(data, "section_id bigint, content string"))
    assert {(r.section_id, r.kind, r.a, r.b) for r in noise.collect()} == {(k, "ocr_char", "magnctic", "magnetic") for k in range(105)}


def test_reading_levels(spark):
    r = random.Random(4)
    docs, labels = [], []
    for k in range(200):
        level = 1 + k % 4
        docs.append((k, "A heading\n\n" + " ".join(r.choice(LEVEL[level]) for _ in range(10)), "de", 9))
        if k < 100:
            labels.append((k, level, "a"))
    docs += [(900, None, "en", 1), (901, "", "en", 1), (902, "Das ist der Magnet und er ist nicht sehr stark. " * 10, "en", 1), (903, "1.0 2.0 3.0\n" * 50, "en", 1), (904, "We put it on the desk.", "en", 1), (None, docs[0][1], "en", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, level int")
    lab = spark.createDataFrame([*labels, (1, None, "b"), (7777, 2, "b")], "doc_id bigint, level int, annotator string")
    got = {x.doc_id: x.level for x in reading.reading_levels(d, lab).collect()}
    assert set(got) == set(range(200)) and sum(got[k] == 1 + k % 4 for k in range(100, 200)) >= 97
    assert reading.reading_levels(d, lab.limit(0)).count() == 0 and reading.reading_levels(d.limit(0), lab).count() == 0


def test_held_out_accuracy(spark):
    """Levels fitted on half of the labels against the other half."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/reading_labels.parquet")
    got = {r.doc_id: r.level for r in reading.reading_levels(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [(r.doc_id, r.level) for r in labels.where("doc_id % 2 = 1").collect()]
    assert sum(got.get(i) == level for i, level in held) >= 0.75 * len(held)
