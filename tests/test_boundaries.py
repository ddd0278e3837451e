import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestream import models, pipelines
from lodestream.functions import excerpts, parse
from lodestream.operators import plaintext, quality
from lodestream.sources import crawl, readers, sinks


def test_completion_and_vectors(spark):
    def flaky():
        class Flaky:
            """Fails twice, then answers; a prompt with "never" is never answered."""

            calls = 0

            def complete(self, prompt):
                self.calls += 1
                if "never" in prompt or self.calls % 3:
                    raise RuntimeError("busy")
                return prompt.upper()

        return Flaky()

    df = spark.createDataFrame([(1, "a"), (2, "never"), (3, None)], "k int, p string").coalesce(1)
    got = {r.k: r.reply for r in models.completed(df, "p", flaky, wait=0).collect()}
    assert got == {1: "A", 2: "[ERROR]: busy", 3: None}
    v = models.embedded(df, "p", lambda: models.Recorded({}), batch=2).collect()
    assert len(v) == 3 and all(len(r.vector) == 16 for r in v)
    with pytest.raises(Exception, match="as many vectors"):
        models.embedded(df, "p", lambda: type("Short", (), {"embed": lambda self, t: []})()).count()


SCHEMA = "relation string, domain_types array<string>, range_types array<string>"


def test_claims_of_chunks(spark):
    reply = json.dumps({"claims": [
        {"subject": "Exp  1", "subject_type": "Experiment", "relation": "uses_method", "object": "milling", "object_type": "Method", "evidence_quote": "by Milling", "confidence": "0.9"},
        {"subject": "Exp 1", "subject_type": "Experiment", "relation": "uses_method", "object": "firing", "object_type": "Method", "evidence_quote": "not there", "confidence": 0.9},
        {"subject": "Exp 1", "subject_type": "Alien", "relation": "EATS", "object": "data", "object_type": "Method", "confidence": "high"},
    ]})
    make = lambda: models.Recorded(lambda p: f"```json\n{reply}\n```" if "mill" in p else "nothing")
    chunks = spark.createDataFrame([("c1", "p", "made by milling"), ("c2", "p", "empty")], "chunk_id string, paper_id string, text string")
    schema = spark.createDataFrame([("USES_METHOD", ["Experiment"], ["Method"])], SCHEMA)
    got = {r.object: (r.accepted, list(r.errors)) for r in models.extracted_claims(chunks, schema, make).collect()}
    assert got == {"milling": (True, []), "firing": (False, ["quote not in chunk"]), "data": (False, ["unknown subject type", "unknown relation", "low confidence", "generic entity", "quote not in chunk"])}
    assert [r.relation for r in models.extracted_claims(chunks, schema, make).where("accepted").collect()] == ["USES_METHOD"]
    wrong, contexts = spark.createDataFrame([("u",)], "uuid string"), spark.createDataFrame([("u", "made by milling")], "uuid string, context string")
    assert [r.target for r in models.refined(wrong, contexts, schema, make).collect()] == ["milling"]
    examples = spark.createDataFrame([(1, "q", ("f", '{"reference_answer": "x"}'), "x"), (2, "q", ("f", None), None), (3, "q", ("f", None), "never")], "qa_id bigint, question string, evaluator struct<eval_func string, eval_kwargs string>, answer string")
    said = lambda: models.Recorded(lambda p: "```True```" if "Answer: x" in p else "can't say")
    assert rows(models.judged(examples, said)) == [(1, 1.0), (3, None)]


def test_terms_stages_and_quotas(spark):
    replies = {"t": "- iron\n- iron\nnone", "a": "XRD: x-ray diffraction\na: b: c", "d": "- iron: a metal\n- no", "r": "- a > isA > b"}
    make = lambda: models.Recorded(lambda p: replies[p[0]])
    got = models.extracted_terms(spark.createDataFrame([("c", "x")], "chunk_id string, text string"), make, {"terms": "t", "acronyms": "a", "definitions": "d", "relationships": "r"})
    assert {k: [tuple(r) for r in v.collect()] for k, v in got.items()} == {"terms": [("iron",)], "acronyms": [("XRD", "x-ray diffraction")], "definitions": [("iron", "a metal")], "relationships": [("a", "isA", "b")]}
    assert models.refined_text(spark.createDataFrame([("x",)], "s string"), "s", ["one", "two"], lambda: models.Recorded(lambda p: p.replace("\n\n", "+"))).first()["s"] == "two+one+x"
    cand = spark.createDataFrame([(k, "ab"[k % 2], f"{k}") for k in range(20)], "id int, kind string, prompt string")
    quota = spark.createDataFrame([("a", 2), ("b", 1)], "kind string, n int")
    reply = lambda: models.Recorded(lambda p: f"[question]: q{p}\n[answer]: x" if int(p) > 1 else "no")
    assert rows(models.generated(cand, quota, "kind", "prompt", reply).select("id")) == [(2,), (3,), (4,)]
    df = spark.createDataFrame([("True. No: false",), ("x",), (None,)], "r string")
    assert [r[0] for r in df.select(models.verdict(F.col("r"))).collect()] == [False, None, None]
    lines = spark.createDataFrame([("- iron isA metal\ncobalt: metal\nnickel is a metal\nnone",)], "t string")
    assert [tuple(x) for x in lines.select(parse.kinds(F.col("t"))).first()[0]] == [("iron", "metal"), ("cobalt", "metal"), ("nickel", "a metal")]
    assert excerpts.evaluator_of("```json\n{'eval_func': 'f', 'eval_kwargs': {'gold': 1,},}\n```") == {"eval_func": "f", "eval_kwargs": {"gold": 1}} and excerpts.evaluator_of("eval_int_exact_match") == {"eval_func": "eval_int_exact_match", "eval_kwargs": {}} and excerpts.evaluator_of("x") is None
    image = spark.createDataFrame([(bytearray(b"ab"),)], "c binary")
    assert image.select(models.image_message(F.lit("p"), F.col("c"), F.lit("png"))).first()[0]["url"] == "data:image/png;base64,YWI="


def test_flaws_and_excerpts(spark):
    q, f = "What coercivity does the milled barium hexaferrite powder show?", "a number"
    assert excerpts.flaw(q, f, None) == "rejected" and excerpts.flaw("x" * 600, f, "5 K") == "question too long" and excerpts.flaw(q, f, "None reported") == "negative evidence"
    assert excerpts.flaw(q, f, "milled barium hexaferrite powder") == "token leakage" and excerpts.flaw("Is it 350 K?", f, "350 K") == "number leakage"
    assert excerpts.flaw(q, f, "because grains couple") is None and excerpts.flaw(q, f, "because grains couple", True) == "near-duplicate"
    assert excerpts.scalars('{"a": ["x", 2], "b": "<b>y</b> &amp; z"}') == ["x", "2", "y & z"] and excerpts.numbers("BaFe12O19 at 300 K, 3-5 or 12") == {"300 k", "300k", "12"}
    long = " ".join(f"Sentence {k} speaks of nothing at all here." for k in range(60)) + " The coercivity was 350 kA/m after milling."
    assert excerpts.excerpt(long, "coercivity after milling", "350", 300).endswith("The coercivity was 350 kA/m after milling.") and len(excerpts.excerpt(long, "zzz", "yyy", 300)) <= 300
    assert excerpts.reasoning(["- first", "2) second", "", "third", "fourth"], "x") == "1. first 2. second 3. third" and excerpts.reasoning(None, "x").endswith("as: x")
    rows_ = [(1, q, f, "because grains couple"), (2, q.upper(), f, "they do so again"), (3, None, None, None)]
    df = spark.createDataFrame(rows_, "qa_id bigint, question string, answer_format string, answer string")
    assert rows(quality.quality_gate(df)) == [(1, None), (2, "near-duplicate"), (3, "rejected")]


def test_choices_and_pairs(spark):
    body = "The sample was measured at room temperature. " * 12
    s = spark.createDataFrame([("p", 1, "Methods", body), ("p", 2, "Remarks", body), ("q", 3, "Remarks", body), ("q", 4, "Abstract", body), ("q", 5, "References", body), ("q", 6, "Methods", "short")], "g string, i int, t string, c string")
    assert rows(quality.eligible_sections(s, "g", "t", "c").select("i")) == [(1,), (3,)]
    assert {r.i for r in quality.focus_sections(s, "g", "t", "i", "experimental_setup", 1).collect()} == {1, 6}
    assert rows(quality.sample(s, ["g"], 2, 7, "i").select("i")) == rows(quality.sample(s.repartition(3), ["g"], 2, 7, "i").select("i"))
    figs = spark.createDataFrame([("p", 1, "Fig. 2 shows", None), ("p", 2, "Figure S1", "x.png"), ("p", 3, "no", None)], "paper_id string, figure_id int, caption string, image string")
    files = spark.createDataFrame([("p", "f/a_fig2.png"), ("p", "f/figure_2.jpg"), ("p", "f/x.png"), ("q", "f/figure_2.png")], "paper_id string, path string")
    assert rows(quality.figure_files(figs, files).select("figure_id", "path")) == [(1, "f/figure_2.jpg"), (2, "f/x.png"), (3, None)]
    assert [r[0] for r in figs.select(quality.is_figure_caption(F.col("caption"))).collect()] == [True, True, False]
    a, b = (spark.createDataFrame(x, "k string, n bigint") for x in ([("a", 3), ("b", 0)], [("a", 10), ("b", 2)]))
    assert rows(quality.neediest(a, b, "k")) == [("b", 2)]
    w = spark.createDataFrame([(1, "0.2"), (2, "x"), (3, None), (4, "0.9")], "i int, score string")
    assert rows(quality.wrong_cases(w, "i").select("i")) == [(1,), (2,)]
    ex, rec = spark.createDataFrame([("u", 2), ("v", 1), ("w", 3)], "uuid string, ord int"), spark.createDataFrame([("u", 1.0), ("v", 0.0)], "uuid string, score double")
    assert [r.uuid for r in quality.in_order(ex, rec).collect()] == ["v", "u"]


def test_searches_walks_and_downloads(spark, tmp_path):
    from lodestream.sources.rest import SearchSource

    spark.dataSource.register(SearchSource)
    (tmp_path / "a__x__1.json").write_text(json.dumps({"results": [{"title": "t", "doi": "D", "year": 2001}, {"title": "t", "doi": "d"}, "bad"], "next": 2}))
    (tmp_path / "a__x__2.json").write_text(json.dumps({"results": [{"title": "u", "abstract_inverted_index": {"b": [1], "a": [0]}}], "next": 1}))
    read = lambda **o: spark.read.format("search").options(folder=str(tmp_path), sources="a", **o).load()
    assert rows(read(terms="x")) == sorted([("a", "x", "t", "D", 2001, None), ("a", "x", "u", None, None, '{"b": [1], "a": [0]}')], key=repr)
    assert read(terms="x", limit="1").count() == 1 and read(terms="x,y", missing="skip").count() == 2
    with pytest.raises(Exception, match="no recorded page"):
        read(terms="x,y").count()
    base = "https://a.org"
    pages = spark.createDataFrame([(base, '<a href="/one">1</a><a href="p/x.pdf">X 2001</a><a href="https://b.com/z.pdf">Z</a>'), (f"{base}/one", f'<a href="{base}">back</a><a href="/y.pdf">Y 1990</a><a href="two#top">2</a>'), (f"{base}/two", '<a href="/deep.pdf">d</a>'), (f"{base}/map.xml", f"<urlset><url><loc>{base}/m.pdf</loc></url></urlset>")], "url string, html string")
    walk = lambda **k: rows(crawl.site_walk(pages, [base, f"{base}/map.xml"], "a.org", **k).select("url", "level"))
    assert walk() == [(f"{base}/deep.pdf", 2), (f"{base}/m.pdf", 0), (f"{base}/p/x.pdf", 0), (f"{base}/y.pdf", 1)]
    assert walk(depth=0) == [(f"{base}/m.pdf", 0), (f"{base}/p/x.pdf", 0)] and walk(most_pages=1) == [(f"{base}/p/x.pdf", 0)] and (f"{base}/y.pdf", 1) not in walk(years=(2000, 2010)) and len(walk(most_found=2)) == 2
    papers = spark.createDataFrame([("10.1/A", None, None)], "doi string, crossref_pdf_urls array<string>, license_urls array<string>")
    works = spark.createDataFrame([("10.1/a", [("u1.pdf", None), ("u2", "application/pdf"), ("u3", "text/html")], ["l", "l"])], "doi string, links array<struct<url:string,content_type:string>>, licenses array<string>")
    assert tuple(crawl.enriched(papers, works).first()) == ("10.1/A", ["u1.pdf", "u2"], ["l"])

    def make():
        def fetch(url):
            if "down" in url:
                raise TimeoutError
            return (404, "", b"") if "gone" in url else (200, "application/pdf", b"x") if "typed" in url else (200, "text/html", b"%PDF-1" if "bytes" in url else b"<html>")

        return fetch

    cand = spark.createDataFrame([(1, True, ["down", "typed"]), (2, True, ["gone", "page"]), (3, True, []), (4, False, ["typed"]), (5, None, None)], "cand_id bigint, is_oa boolean, urls array<string>")
    got = {r.cand_id: r for r in crawl.downloaded(cand, make, crawl.file_store(str(tmp_path / "pdf"))).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "downloaded", 2: "download_failed", 3: "metadata_only", 4: "skipped_non_oa", 5: "skipped_non_oa"}
    assert open(got[1].path, "rb").read() == b"x" and [a["reason"] for a in json.loads(got[2].attempts)] == ["http 404", "no pdf"]
    checked = crawl.verified(cand.select(F.explode("urls").alias("url")), make)
    assert rows(crawl.first_verified(cand, checked)) == [(1, "typed", True, ""), (2, "page", False, "no pdf"), (4, "typed", True, "")]


def test_runs_caches_and_resumed_answers(spark, tmp_path):
    with pytest.raises(ValueError, match="pool"):
        pipelines.CrawlSettings("q", most=50)
    assert pipelines.CrawlSettings("q", ("Q", "r")).phrases == ["q", "r"] and pipelines.CrawlSettings("q").pool == 80
    assert pipelines.chosen_run("x") == "x" and pipelines.chosen_run(active="a") == "a" and pipelines.chosen_run(active="a", fresh=True).startswith("run_")
    built = []
    make = lambda: built.append(1) or spark.range(3)
    key = pipelines.key_of(version="v1", n=3)
    assert pipelines.cached(spark, str(tmp_path), key, make).count() == pipelines.cached(spark, str(tmp_path), key, make).count() == 3 and built == [1]
    assert key == pipelines.key_of(n=3, version="v1")
    asked = []
    answer = lambda df: asked.append(sorted(r.uuid for r in df.collect())) or df.withColumn("answer", F.upper("question"))
    q = spark.createDataFrame([("u", "a", 1), ("v", "b", 1)], "uuid string, question string, setting int")
    path = str(tmp_path / "answers")
    assert [r.answer for r in pipelines.resumed(spark, q, path, ["question", "setting"], answer).orderBy("uuid").collect()] == ["A", "B"]
    more = spark.createDataFrame([("u", "a", 1), ("v", "c", 1), ("w", None, 1)], "uuid string, question string, setting int")
    assert [r.answer for r in pipelines.resumed(spark, more, path, ["question", "setting"], answer).orderBy("uuid").collect()] == ["A", "C", None] and asked == [["u", "v"], ["v", "w"]]
    state = pipelines.in_sequence([("a", lambda s: 1), ("b", lambda s: s["a"] + 1)], reuse=lambda n: 5 if n == "a" else None)
    assert state == {"a": 5, "b": 6}
    with pytest.raises(RuntimeError, match="stage x"):
        pipelines.in_sequence([("x", lambda s: 1 / 0)])


def test_whole_answering(spark, data):
    from lodestream.operators import edges

    e = edges.distinct_edges(edges.cleaned(spark.read.parquet(f"{data}/graph_edge.parquet")))
    q = spark.read.parquet(f"{data}/qa_example.parquet").where("question is not null").orderBy("qa_id").limit(2)
    make = lambda: models.Recorded(lambda p: "[INSUFFICIENT_CONTEXT]" if "(none)" in p else "yes")
    got = pipelines.answered(q, e, lambda s: [t.lower() for t in s.split() if len(t) > 4], make)
    assert {r.answer for r in got.collect()} <= {"yes", "[INSUFFICIENT_CONTEXT]"} and got.count() == 2
    scores, summary = pipelines.evaluated(q, got)
    assert scores.count() == 2 and summary.count() >= 2
    papers = spark.read.parquet(f"{data}/candidate_paper.parquet")
    assert pipelines.candidate_papers(papers, pipelines.CrawlSettings("strontium hexaferrite", excluded=("erratum",), years=(1990, 2030))).where("position is not null").count() > 0
    assert pipelines.dataset(spark.read.parquet(f"{data}/qa_example.parquet")).count() > 0


def test_sinks_and_readers(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    df = spark.createDataFrame([(1, "ü", "methods", "text"), (2, None, "results", None)], "k int, t string, section string, content string")
    sinks.write_json_document(df, p("d/doc.json"))
    assert [x["k"] for x in json.load(open(p("d/doc.json"), encoding="utf-8"))] == [1, 2]
    with pytest.raises(ValueError, match="at most"):
        sinks.write_json_document(df, p("d/doc.json"), 1)
    sinks.write_sections(df, p("s"))
    assert rows(spark.read.text(p("s/texts")).select("section", "value")) == [("methods", "text"), ("results", "")]
    sinks.write_tables(spark.createDataFrame([("c", ["a"], [{"a": "1"}])], "caption string, columns array<string>, rows array<map<string,string>>"), p("t"))
    assert sorted(r.value for r in spark.read.text(p("t/markdown")).collect()) == ["- a=1", "Caption: c", "Columns: a", "Rows:"]
    for run in ("r1", "r2"):
        sinks.append_log(spark, p("log"), "crawl", run, {"n": 1})
    assert [r.run_id for r in sinks.latest_runs(spark.read.parquet(p("log"))).collect()] == ["r2"]
    sinks.append_usage(spark.createDataFrame([("qa", "m", 3, None)], "component string, model string, prompt_tokens int, completion_tokens int"), p("usage"))
    assert spark.read.json(p("usage")).first()["total_tokens"] == 3
    n, e = spark.createDataFrame([("a", "<A>", "t", 1)], "id string, label string, type string, size int"), spark.createDataFrame([("a", "</x>", "b")], "source string, relation string, target string")
    assert sinks.write_graph(n, e, p("g")) == {"nodes": 1, "edges": 1} and "</x>" not in open(p("g/graph.html"), encoding="utf-8").read()
    fresh = sinks.example_rows(spark.createDataFrame([("q", None)], "question string, tags array<string>")).first()
    assert len(fresh["uuid"]) == 36 and fresh["tags"] == [] and fresh["question"] == "q"
    (tmp_path / "qa.jsonl").write_text('{"uuid": "b"}\n\n{"uuid": "a"}\n')
    assert [r.uuid for r in readers.limited_examples(spark, p("qa.jsonl"), "uuid string", 1).collect()] == ["b"] and readers.limited_examples(spark, p("none.jsonl"), "uuid string").count() == 0
    (tmp_path / "terms").mkdir()
    (tmp_path / "terms/a.terms.csv").write_text("Iron,1,2\niron\n\"a, b\"\n")
    assert [r.term for r in readers.candidate_terms(spark, p("terms")).orderBy("ord").collect()] == ["Iron", "a, b"]
    assets = spark.createDataFrame([(1, "p", " A  loop ", "x.png"), (2, "p", None, None)], "asset_id int, paper_id string, caption string, image_path string")
    assert [r.chunk_id for r in readers.figure_assets(assets).orderBy("chunk_id").collect()] == ["p:figure_caption:1", "p:figure_image:1"]
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt/u.txt").write_bytes("é".encode())
    (tmp_path / "txt/l.txt").write_bytes("é".encode("latin-1"))
    assert sorted(r.text for r in readers.texts(spark, p("txt")).collect()) == ["e", "é"]
    (tmp_path / "seed.txt").write_text("** Main Category 1: Magnets **\nx\nMain Category: a: Cells\n")
    assert [r.category for r in readers.seed_categories(spark, p("seed.txt")).orderBy("ord").collect()] == ["Cells"] or [r.category for r in readers.seed_categories(spark, p("seed.txt")).orderBy("ord").collect()] == ["Magnets", "Cells"]


def test_plain_texts(spark):
    t = "A B S T R A C T\nWe mill.\nIt is hard.\nKeywords: x\nINTRODUCTION\nMagnets are old.\n2. Experimental setup\nWe fired.\nfoot-\nnote\nx\n"
    df = spark.createDataFrame([(1, t), (2, "# Methods\nmilled\n## Results\n\n\\section{Conclusion}\nfine"), (3, None), (4, "Abstract of it\nAll is well.\n1. Start\nText\nResults follow")], "i bigint, t string")
    got = {(r.i, r.section): r.content for r in plaintext.extracted(df, "i", "t", marked=False).collect()}
    assert got[1, "abstract"] == "We mill.\nIt is hard.\nKeywords: x" and got[1, "introduction"] == "Magnets are old." and got[1, "experimental"].startswith("We fired.")
    assert got[4, "abstract"] == "All is well.\n1. Start\nText\nResults follow" and got[4, "introduction"] == "Text"
    marked = {(r.i, r.section): r.content for r in plaintext.extracted(df.where("i = 2"), "i", "t", marked=True).collect()}
    assert marked == {(2, "methods"): "milled", (2, "conclusion"): "fine"}
    line = spark.createDataFrame([("a-\nb\nx\nFootnote 1\nrun\nrun\nrun\n\n\nend",)], "t string")
    assert line.select(plaintext.cleaned(F.col("t"), 2)).first()[0] == "a-\nend" and line.select(plaintext.cleaned(F.col("t"), 9, hyphens=True)).first()[0] == "arun run run end"
    doi = spark.createDataFrame([("see doi:10.1234/AB.c1.",), (None,)], "t string")
    assert [r[0] for r in doi.select(plaintext.doi_in(F.col("t"))).collect()] == ["10.1234/AB.c1", None]
