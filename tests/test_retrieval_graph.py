import hashlib
import random

from conftest import rows
from pyspark.sql import functions as F

from lodestream.operators import bundles, communities, edges, retrieval, taxonomy, terms


def test_budget_with_a_quota(spark):
    r = random.Random(4)
    data = [(g, k, r.randrange(1, 60), r.random() < 0.4) for g in "ab" for k in range(150)] + [("c", 0, 900, True), ("c", 1, 5, False)]
    df = spark.createDataFrame(data, "g string, k int, c int, f boolean")
    got = rows(retrieval.budgeted(df, "g", F.col("c"), [F.col("k")], 200, 12, F.col("f"), 2).select("g", "k"))
    want = []
    for g in "abc":
        used = n = flagged = 0
        for _, k, c, f in sorted(x for x in data if x[0] == g):
            if n < 12 and (n == 0 or used + c <= 200) and not (f and flagged >= 2):
                used, n, flagged = used + c, n + 1, flagged + f
                want.append((g, k))
    assert got == sorted(want, key=repr)


EDGE = "edge_id bigint, source string, relation string, target string, source_type string, source_path string, paper_id string, evidence_quote string, confidence double, metadata string"


def edge(i, s, r, t, kind="claim", conf=None, quote=None, meta=None):
    return (i, s, r, t, kind, "a/b.json", "p", quote, conf, meta)


def test_bundle_and_context(spark):
    e = spark.createDataFrame([edge(1, "Exp", "USES_METHOD", "milling", conf=0.9), edge(2, "Exp", "REPORTS_RESULT", "hard milling"), edge(3, "milling", "isA", "method"), edge(4, "method", "isA", "Thing"), edge(5, "Thing", "isA", "Root"), edge(6, "lonely", "isA", "method"), edge(7, "x", "R", "y")], EDGE)
    nodes = spark.createDataFrame([("milling", 1), ("lonely", 2), ("nothing", 3)], "node string, place int")
    got = bundles.node_bundles(e, nodes, ["milling"], depth=2)
    assert rows(got.select("node", "kind", "rank", "edge_id")) == [("lonely", "taxonomy", 1, 6), ("lonely", "taxonomy", 2, 4), ("milling", "edge", 1, 2), ("milling", "edge", 2, 1), ("milling", "taxonomy", 1, 3), ("milling", "taxonomy", 2, 4)]
    costs = e.select("edge_id", F.lit(100).alias("cost"))
    q = got.withColumn("question_id", F.lit("q"))
    shown = bundles.bundle_context(q, costs, 500)
    assert [(r.node, r.edge_id) for r in shown.orderBy("position").collect()] == [("milling", 2), ("milling", 1), ("milling", 3)]
    assert bundles.bundle_context(q, costs, 1).count() == 1 and bundles.bundle_context(q.limit(0), costs, 500).count() == 0
    texts = bundles.node_texts(e)
    assert [r.node for r in bundles.candidate_nodes(texts, ["milling"], 2).orderBy("place").collect()] == ["milling", "hard milling"]
    assert {r.method for r in bundles.candidate_nodes(texts, ["unheard"], 2).collect()} == {"degree_fallback"}
    vectors = spark.createDataFrame([("y", 0.9), ("MILLING", 0.8), ("x", -1.0)], "node string, score double")
    assert [(r.node, r.method) for r in bundles.candidate_nodes(texts, ["milling"], 3, vectors).orderBy("place").collect()] == [("milling", "bm25"), ("y", "embedding"), ("hard milling", "bm25")]


def test_widening_asks_only_open_questions(spark):
    b = spark.createDataFrame([(q, "n", p) for q in "abc" for p in range(1, 7)], "question_id string, node string, place int")

    def answer(part):
        n = part.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
        enough = F.when(F.col("question_id") == "a", 2).when(F.col("question_id") == "b", 4).otherwise(99)
        return n.select("question_id", F.when(F.col("n") >= enough, "yes").otherwise(" [INSUFFICIENT_CONTEXT] ").alias("answer"))

    assert [r[:3] for r in rows(bundles.widened(b, answer))] == [("a", 1, 2), ("b", 2, 4), ("c", 3, 6)]


def test_taxonomy_questions(spark):
    df = spark.createDataFrame([("Which type is it?",), ("name the ontology",), ("How hard?",), (None,)], "q string")
    assert [r[0] for r in df.select(bundles.asks_taxonomy(F.col("q"))).collect()] == [True, True, False, False]


def test_parts_of_a_large_community(spark):
    r = random.Random(8)
    nodes = [f"n{k}" for k in range(60)]
    links = [(a, b, r.randrange(1, 5) / 2) for a in nodes for b in r.sample(nodes, 3) if a != b]
    both = links + [(b, a, w) for a, b, w in links]
    part = communities.split_community(both, nodes, 20)
    sizes = {p: sum(x == p for x in part.values()) for p in part.values()}
    assert set(part) == set(nodes) and max(sizes.values()) <= 20 and all(part[p] == p for p in sizes)
    assert communities.split_community(both, nodes, 60) == dict.fromkeys(nodes, min(nodes)) and communities.split_community([], [], 3) == {}
    lab = spark.createDataFrame([("g", n, "c") for n in nodes] + [("g", "x", "d")], "g string, node string, community string")
    df = spark.createDataFrame([("g", *x) for x in both], "g string, a string, b string, weight double").groupBy("g", "a", "b").agg(F.sum("weight").alias("weight"))
    got = communities.split_large(df, lab, ["g"], 20)
    assert {x.node: x.part for x in got.where("community = 'c'").collect()} == part and rows(got.where("community = 'd'").select("node", "part")) == [("x", "d")]


def test_selected_communities(spark):
    df = spark.createDataFrame([(f"c{k}", k % 2 == 0, 10.0 - k) for k in range(8)], "community string, taxonomy_heavy boolean, score double")
    pick = lambda *a, **k: [r[0] for r in communities.selected_communities(df, *a, **k).orderBy(F.desc("score")).collect()]
    assert pick(4, False) == ["c0", "c1", "c3", "c5"] and pick(4, True) == ["c0", "c1", "c2", "c3"] and pick(4, False, most_taxonomy=0) == ["c1", "c3", "c5", "c7"]
    assert [r[0] for r in communities.selected_communities(df.where("taxonomy_heavy"), 4, False, 0).collect()] == ["c0"]


def test_links_without_circles(spark):
    r = random.Random(1)
    for _ in range(50):
        answers = [(r.choice("abcdefg"), r.choice("abcdefg")) for _ in range(25)]
        taken = taxonomy.safe_links(answers)
        up = {}
        for c, p in taken:
            up.setdefault(c, set()).add(p)
        reach = lambda n, seen: seen | set().union(*(reach(p, seen | {p}) for p in up.get(n, ()) if p not in seen)) if up.get(n) else seen
        assert all(n not in reach(n, set()) for n in "abcdefg") and len(set(taken)) == len(taken)
    assert taxonomy.safe_links([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("b", "a")]) == [("a", "b"), ("b", "c")]
    assert taxonomy.safe_links([("a", "b"), ("a", "c")], destructive=True) == [("a", "c")]
    answers = spark.createDataFrame([("g", o, run, c, p) for o in (1, 2) for run in range(3) for c, p in (("a", "b"), ("b", "a") if o == 2 else ("b", "c"))] + [("g", 1, 0, "z", "a")], "g string, ord int, run int, child string, parent string")
    assert rows(taxonomy.built(answers, ["g"], 3)) == [("g", "a", "b"), ("g", "b", "c")]
    words = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "B")], "synonym string, name string")
    assert rows(taxonomy.built(answers, ["g"], 3, words)) == [("g", "A", "B")]


def test_places_and_lines(spark, tmp_path):
    assert taxonomy.places([("r", None, 0), ("a", "r", 0), ("b", "r", 1), ("c", "a", 0), ("d", "a", 1)]) == [("c", 630.0, 40.0), ("d", 630.0, 84.0), ("a", 330.0, 62.0), ("b", 330.0, 128.0), ("r", 30.0, 95.0)]
    (tmp_path / "t.txt").write_text("b isA a\nno line\nc isA b isA d\n")
    assert rows(taxonomy.read_lines(spark, str(tmp_path)).select("child", "parent")) == [("b", "a"), ("c", "b isA d")]
    links = spark.createDataFrame([("g", "b", "a")], "grp string, child string, parent string")
    assert taxonomy.tree_lines(links).first()["line"] == "b isA a"
    one = spark.createDataFrame([('</a> & "b"',)], "s string")
    assert one.select(taxonomy.for_script(F.col("s")), taxonomy.escaped(F.col("s"))).first()[:] == ('<\\/a> & "b"', "&lt;/a&gt; &amp; &quot;b&quot;")


def test_chunks_categories_and_terms(spark):
    text = "One. Two is here.\n\n[TABLE 1]\nCaption: x\nRows:\n- a=1\n- a=2\n- a=3\n\nThree. Four."
    assert terms.table_chunks(text, 40) == ["One. Two is here.", "[TABLE 1]\nCaption: x\nRows:\n- a=1\n- a=2", "[TABLE 1]\nCaption: x\nRows:\n- a=3", "Three. Four."]
    assert terms.table_chunks(None, 10) == [] and terms.table_chunks("a. b. c.", 5) == ["a. b.", "c."]
    assert terms.spaceless("ab c", "x A bC y abc") == [(2, 6), (9, 12)] and terms.spaceless(" ", "abc") == []
    df = spark.createDataFrame([("Main Category 1: **Magnets**\n  Subcategory 1: Soft\n\n Subcategory 2: Hard\nMain Category 2: Cells",), (None,)], "t string")
    assert [[tuple(x) for x in r[0]] for r in df.select(terms.categories(F.col("t"))).collect()] == [[("Magnets", None), ("Magnets", "Soft"), ("Magnets", "Hard"), ("Cells", None)], []]
    labels = spark.createDataFrame([("**a) Iron  oxide**",), (None,), ("  `x` ",)], "t string")
    assert [r[0] for r in labels.select(terms.label(F.col("t"))).collect()] == ["Iron oxide", "", "x"]
    docs = spark.createDataFrame([(1, "Iron is ferrite, iron.\nferriteiron"), (2, None)], "i bigint, t string")
    words = spark.createDataFrame([("iron",), ("FERRITE",), ("ox",), (None,)], "term string")
    assert rows(terms.occurrences(docs, "i", "t", words)) == [(1, "ferrite", 8, 15, 0), (1, "iron", 17, 21, 0)] or rows(terms.occurrences(docs, "i", "t", words)) == [(1, "ferrite", 8, 15, 0), (1, "iron", 0, 4, 0)]
    assert terms.occurrences(docs, "i", "t", words, bounded=False).count() == 4 and terms.occurrences(docs, "i", "t", words.limit(0)).count() == 0
    acr = spark.createDataFrame([("XRD", "X-ray diffraction"), ("", None)], "acronym string, meaning string")
    assert terms.stated_acronyms(acr, F.lit("By XRD (x-ray diffraction)")).count() == 1


def test_fingerprint_beyond_a_bigint(spark):
    df = spark.range(150_000).select(F.lit("A").alias("source"), F.lit("R").alias("relation"), F.col("id").cast("string").alias("target"), F.lit(None).cast("string").alias("evidence_quote"), F.when(F.col("id") > 9, "p").alias("paper_id"))
    part = lambda k, paper: int(hashlib.sha256(f"a|r|{k}||{paper}".encode()).hexdigest()[:12], 16)
    none, p = sum(part(k, "") for k in range(10)), sum(part(k, "p") for k in range(10, 150_000))
    assert p >= 1 << 63 and none < 1 << 63
    assert rows(edges.fingerprint(df)) == sorted([(None, 10, none), ("p", 149_990, (p + (1 << 63)) % (1 << 64) - (1 << 63))], key=repr)
