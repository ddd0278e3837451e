"""Operators that SQL can't express, against plain Python on small fixtures."""

import json
import random
import re

from conftest import rows
from pyspark.sql import functions as F

from lodestream.functions import parse, scoring, text
from lodestream.operators import documents, edges, evaluation, retrieval, usage
from lodestream.sources import html, readers, sinks


def test_budget_is_greedy(spark):
    r = random.Random(3)
    data = [(g, k, r.randrange(1, 60)) for g in "ab" for k in range(150)] + [("c", 0, 900), ("c", 1, 5)]
    df = spark.createDataFrame(data, "g string, k int, c int")
    got = rows(retrieval.budgeted(df, "g", F.col("c"), [F.col("k")], 200, 12).select("g", "k"))
    want = []
    for g in "abc":
        used = n = 0
        for _, k, c in sorted(x for x in data if x[0] == g):
            if n < 12 and (n == 0 or used + c <= 200):
                used, n = used + c, n + 1
                want.append((g, k))
    assert got == sorted(want, key=repr)


def test_packing_of_sentences(spark):
    def pack(s, limit):
        out, now = [], ""
        for part in [p for p in re.split(r"(?<=[.!?])\s+", s.strip()) if p]:
            for x in [part[i : i + limit] for i in range(0, len(part), limit)]:
                if not now or len(now) + 1 + len(x) <= limit:
                    now = f"{now} {x}" if now else x
                else:
                    out.append(now)
                    now = x
        return out + [now] if now else out

    texts = ["", "One. Two! Three?", "a" * 95 + ". b. c.", None, "x. " * 40]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r[0]: r[1] for r in df.select("k", documents.packed(F.col("t"), 20)).collect()}
    assert all(got[k] == pack(t or "", 20) for k, t in enumerate(texts))


def test_label_propagation():
    links = [("a", "b", 3.0), ("b", "a", 3.0), ("b", "c", 1.0), ("c", "b", 1.0), ("c", "d", 3.0), ("d", "c", 3.0)]
    got = edges.propagate_labels(links)
    assert got["a"] == got["b"] and got["c"] == got["d"] and got["a"] != got["c"] and edges.propagate_labels([]) == {}


def test_labels_of_a_large_group(spark):
    links = [("a", "b", 3.0), ("b", "c", 1.0), ("c", "d", 3.0), ("x", "y", 1.0), ("z", "z", 1.0)]
    df = spark.createDataFrame([("g", *x) for a, b, w in links for x in {(a, b, w), (b, a, w)}] + [("h", "a", "b", 1.0), ("h", "b", "a", 1.0)], "grp string, a string, b string, weight double")
    got = rows(edges.communities(df, largest=2))
    assert got == rows(edges.communities(df)) and len({c for g, n, c in got if g == "g" and n in "abcd"}) == 2


def test_components_of_a_long_chain(spark):
    links = [("g", f"n{k:03}", f"n{k + 1:03}") for k in range(150)] + [("g", "z1", "z2"), ("h", "n000", "n000")]
    got = rows(edges.components(spark.createDataFrame(links, "grp string, a string, b string")))
    assert {c for g, n, c in got if g == "g" and n.startswith("n")} == {"n000"} and ("g", "z2", "z1") in got and ("h", "n000", "n000") in got


def test_scores(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0, 9.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(scoring.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, 0.0]
    e = spark.createDataFrame([(" 12 ", "12"), ("1_000", "1000"), ("12.0", "12"), (None, "1")], "p string, g string")
    assert [r[0] for r in e.select(scoring.int_match(F.col("p"), F.col("g"))).collect()] == [1.0, 1.0, 0.0, 0.0]
    f = spark.createDataFrame([("2.5", "2.5000001", None), ("2.449", "2.45", 1), ("0.0", "0", None), ("x", "1", None)], "p string, g string, n int")
    assert [r[0] for r in f.select(scoring.float_match(F.col("p"), F.col("g"), F.col("n"))).collect()] == [1.0, 1.0, 1.0, 0.0]
    b = spark.createDataFrame([("Yes", "true"), ("f", "TRUE"), ("maybe", "true")], "p string, g string")
    assert [r[0] for r in b.select(scoring.bool_match(F.col("p"), F.col("g"))).collect()] == [1.0, 0.0, 0.0]


def test_text_functions(spark):
    df = spark.createDataFrame([("## 2.1 Experimental setup:",), ("A B S T R A C T",), ("II. METHODOLOGY",), (None,), ("Supporting Information S1",)], "h string")
    assert [r[0] for r in df.select(text.section_label(F.col("h"))).collect()] == ["experimental", "other", "methods", "other", "other"]
    assert [r[0] for r in df.select(text.heading_label(F.col("h"))).collect()][1] == "abstract"
    one = spark.createDataFrame([("Été à Nice!",)], "t string")
    assert one.select(text.slug(F.col("t"))).first()[0] == "été-à-nice" and one.select(text.truncate(F.col("t"), 7)).first()[0] == "Été..."


def test_parsing(spark):
    df = spark.createDataFrame([('```json\n{"a": [1, 2,],}\n```',), ('so: {"a": 3} done',), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(F.try_variant_get(parse.json_object(F.col("t")), "$.a", "string")).collect()]
    assert got[1] == "3" and json.loads(got[0]) == [1, 2] and got[2:] == [None, None]
    lines = spark.createDataFrame([("- a > b > c\n- only\n* d > e > f > g",)], "t string")
    assert [tuple(x) for x in lines.select(parse.triples(F.col("t"))).first()[0]] == [("a", "b", "c")]
    assert spark.createDataFrame([("Winner=answer2",)], "t string").select(parse.winner(F.col("t"))).first()[0] == "answer2"


def test_html_and_xml(spark):
    pages = spark.createDataFrame([(1, '<a href="x.pdf">The <b>file</b></a><a>no</a><table><tr><td>a</td><td> b </td></tr><tr><td></td></tr></table>'), (2, None)], "page_id bigint, html string")
    assert rows(html.links(pages, "page_id", "html")) == [(1, "x.pdf", "The file")]
    assert [list(r[2]) for r in html.tables(pages, "page_id", "html").collect()] == [["a", "b"]]
    x = spark.createDataFrame([("<urlset><url><loc>http://a.org/1</loc></url></urlset>",)], "x string")
    assert x.select(html.locations(F.col("x"))).first()[0] == ["http://a.org/1"]
    u = spark.createDataFrame([("http://notexample.org/a.PDF",), ("http://www.example.org",), (None,)], "u string")
    assert [tuple(r) for r in u.select(html.in_domain(F.col("u"), "example.org"), html.in_domain(F.col("u"), "example.org", True), html.is_pdf(F.col("u"))).collect()] == [(True, False, True), (True, True, False), (False, False, False)]


def test_file_sources_and_sinks(spark, tmp_path):
    d = tmp_path / "kg"
    d.mkdir()
    (d / "g.json").write_text(json.dumps({"edges": [{"source": " a ", "relation": "R", "target": "b", "provenance": {"paper_id": "p"}}, {"source": "", "relation": "R", "target": "b"}]}))
    (d / "bad.json").write_text("{no")
    (d / "p.claims.jsonl").write_text('{"subject": "s", "relation": "R", "object": "o", "source": {"paper_id": "q"}, "confidence": 0.5}\nnot json\n')
    (d / "p1.relationships.csv").write_text('x,R,"y, z"\n')
    (d / "p1.definitions.csv").write_text("VSM,magnetometer\n")
    got = sorted((r.source, r.relation, r.target, r.source_type, r.paper_id) for r in readers.all_edges(spark, str(d)).collect())
    assert got == [("VSM", "DEFINED_AS", "magnetometer", "termo_definition", "p1"), ("a", "R", "b", "relation_graph", "p"), ("s", "R", "o", "relation_claim", "q"), ("x", "R", "y, z", "termo_relationship", "p1")]
    df = spark.createDataFrame([(1, "ü"), (2, None)], "k int, t string")
    sinks.write_json_lines(df, str(tmp_path / "out"))
    assert rows(readers.json_lines(spark, str(tmp_path / "out"), "k int, t string")) == rows(df)
    sinks.write_csv(df, str(tmp_path / "csv"))
    v = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "k string, v int, t string")
    assert rows(sinks.latest(v, "k", "v")) == [("a", 2, "new"), ("b", 1, "x")]


def test_streams_equal_batches(spark, data, tmp_path):
    from lodestream.streaming import usage as streaming

    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.json(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = streaming.records(spark, str(tmp_path / "in"))
    assert rows(run(streaming.tumbling(stream, "1 hour", "3650 days"), "tumble")) == rows(usage.per_window(usage.usage(events), "1 hour"))
    assert rows(run(streaming.sliding(stream, "1 hour", "30 minutes", "3650 days"), "slide")) == rows(usage.per_window(usage.usage(events), "1 hour", "30 minutes"))
    sessions = rows(usage.sessions(usage.usage(events), "model", 600).select("start", "model", "n"))
    assert sum(r[2] for r in rows(run(streaming.by_session(stream, "10 minutes", "3650 days"), "sess"))) == sum(r[2] for r in sessions)


def test_similar_questions_are_exact(spark):
    r = random.Random(1)
    words = [f"word{k}" for k in range(9)]
    qs = [(k, " ".join(r.sample(words, r.randrange(1, 7)))) for k in range(60)] + [(60, None), (61, ""), (62, "word1 word2 word3"), (63, "word1 word2 word3")]
    got = {x[0]: x for x in rows(evaluation.similar_questions(spark.createDataFrame(qs, "qa_id bigint, question string")))}
    sets = {k: frozenset(q.split()) for k, q in qs if q}
    for k, s in sets.items():
        near = {t for t in sets.values() if t != s and len(s & t) / len(s | t) >= 0.64}
        assert got[k][2] == len(near) and got[k][1] == min(i for i, t in sets.items() if t == s)


def test_scores_of_lists_objects_and_logic(spark):
    cases = [
        ("eval_element_list_included", '{"gold": ["a", "b"]}', '["b"]', 1.0), ("eval_element_list_included", '{"gold": ["a", "b"]}', '["b", "c"]', 0.0), ("eval_element_list_overlap", '{"gold": ["a", "b"], "count": 2}', '["b", "b"]', 0.0),
        ("eval_structured_object_exact_match", '{"gold": ["a", 2, 0.5]}', "['a', '2', 0.5]", 1.0), ("eval_structured_object_exact_match", '{"gold": ["a", "b"]}', '["b", "a"]', 0.0), ("eval_structured_object_exact_match", '{"gold": ["a", "b"], "ignore_order": true}', '["b", "a"]', 1.0),
        ("eval_structured_object_exact_match", '{"gold": {"k": [1]}}', '{"k": [1]}', 1.0), ("eval_structured_object_exact_match", '{"gold": {"k": 1}}', "__import__('os')", 0.0), ("eval_structured_object_exact_match", "no json", "[1]", 0.0), ("eval_structured_object_exact_match", '{"gold": [1]}', None, None),
        ("eval_string_fuzzy_match", '{"gold": "cobalt ferrite", "threshold": 90}', "cobalt ferite", 1.0), ("eval_string_fuzzy_match", '{"gold": "cobalt ferrite", "fuzz_method": "token_sort_ratio"}', "Ferrite, cobalt", 1.0), ("eval_paper_relevance_with_reference_answer", '{"question": "q", "reference_answer": ["x", "A Study"]}', "a study", 1.0),
        ("eval_conjunction", '{"eval_func_list": ["eval_int_exact_match", "eval_bool_exact_match"], "eval_kwargs_list": [{"gold": 1}, {"gold": true}]}', "[1, 'yes']", 1.0), ("eval_disjunction", '{"eval_func_list": ["eval_int_exact_match"], "eval_kwargs_list": [{"gold": 1}]}', "[2]", 0.0),
        ("eval_negation", '{"eval_func": "eval_string_exact_match", "eval_kwargs": {"gold": "x"}}', "y", 1.0), ("eval_negation", '{"eval_func": "eval_reference_answer_with_llm", "eval_kwargs": {}}', "y", None), ("eval_reference_answer_with_llm", "{}", "y", None), ("eval_int_exact_match", '{"gold": 26}', "26", 1.0), (None, None, "y", None),
    ]
    df = spark.createDataFrame([(k, (f, kw), a) for k, (f, kw, a, _) in enumerate(cases)], "qa_id bigint, evaluator struct<eval_func string, eval_kwargs string>, answer string")
    assert {r.qa_id: r.score for r in evaluation.scored_all(df).collect()} == {k: c[3] for k, c in enumerate(cases)}


def test_pages_with_nested_and_unclosed_elements():
    page = html.Page('<table><tr><td>a<td><a href=" u ">go <i>on</i></a> x<tr><th>h</th><td><table><tr><td>in</td></tr></table>out</td></tr><tr><td> </td></tr></table><a href="v">end')
    assert page.rows == [["a", "go on x"], ["in"], ["h", "inout"]]
    assert page.links == [("u", "go on")] and html.Page(None).rows == []


def test_labels_are_a_fixed_point():
    r = random.Random(5)
    for _ in range(30):
        w = {}
        for _ in range(40):
            a, b = r.sample("ABCDEabcdefgh", 2)
            w[a, b] = w[b, a] = r.randrange(1, 9) / 2
        label = edges.propagate_labels([(a, b, x) for (a, b), x in w.items()])
        votes = {n: {} for n in label}
        for (a, b), x in w.items():
            votes[a][label[b]] = votes[a].get(label[b], 0) + x
        assert all(label[n] == min(v, key=lambda k, v=v: (-v[k], k)) for n, v in votes.items())


def test_first_of_each_on_a_stream(spark, tmp_path):
    from lodestream.streaming import usage as streaming

    (tmp_path / "in").mkdir()
    lines = [{"event_id": k, "ts": f"2024-01-01T00:00:0{k}", "event_type": t, "value": 1.0, "props": "{}"} for k, t in enumerate("aabab")]
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, lines)))
    stream = streaming.first_of_each(streaming.records(spark, str(tmp_path / "in")), "model", "1 day")
    q = stream.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r.model for r in spark.table("firsts").collect()) == ["a", "b"]


def test_column_names(spark):
    df = spark.createDataFrame([(["a", "", "a", None, "a"],)], "c array<string>")
    assert list(df.select(documents.unique_names(F.col("c"))).first()[0]) == ["a", "Column 2", "a 2", "Column 4", "a 3"]
