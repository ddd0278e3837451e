import json

from conftest import rows
from pyspark.sql import functions as F

from lodestream.sources import papers

DOC = {
    "info_from_mineru": {
        "TOC": [
            {"title": "1. Methods", "text": "First we mill.  Then we fire.", "page_number": 1}, {"section_title": "1.1 Milling", "content": "Balls.", "pages": [1, 2]}, {"heading": "2 Results", "text": "It is hard.", "page": 3, "level": "2"},
            {"name": "Author information", "text": "x", "page": 9}, "no object",
        ],
        "tables": [{"table_caption": "Table 1", "columns": ["a", "b"], "rows": [{"a": "1", "b": None}, {"a": "", "b": ""}], "page": 2}, {"caption": "T2", "table_markdown": "| x |", "section": "Discussion"}],
    },
    "figures": [{"figure_caption": "Fig. 1", "page_idx": 3}], "equations": [{"latex": "E=mc", "page_number": 77}], "metadata": {"title": " A  paper ", "authors": "One Author", "year": "2001"},
}


def test_folder_of_papers(spark, tmp_path):
    for name, doc in (("p_1/p_1.json", DOC), ("p_1/other.json", {}), ("q/x.parsed.json", {"paper_id": "own", "TOC": []}), ("q/a.json", {}), ("p_1.json", {}), ("lone.json", DOC), (".hidden/h.json", {}), ("bad/bad.json", None)):
        f = tmp_path / "papers" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(json.dumps(doc) if doc is not None else "{no")
    for name in ("b.PNG", "a.jpg", "notes.txt"):
        f = tmp_path / "papers" / "p_1" / "figures" / name
        f.parent.mkdir(exist_ok=True)
        f.write_text("x")
    root = str(tmp_path / "papers")
    found = papers.discovered(spark, root)
    names = sorted((r.paper_id, r.json_path.split("/")[-1], r.layout, r.collection, r.paper_index) for r in found.collect())
    assert names == [("bad", "bad.json", "folder", "bad", None), ("lone", "lone.json", "flat", "lone", None), ("p_1", "p_1.json", "folder", "p", 1), ("q", "x.parsed.json", "folder", "q", None)]
    assert [(r.paper_id, [p.split("/")[-1] for p in r.figure_paths]) for r in papers.figure_listing(spark, root).collect()] == [("p_1", ["a.jpg", "b.PNG"])]
    files = spark.createDataFrame([(f"{root}/p_1/other.json",), (f"{root}/lone.json",), ("/elsewhere/x.json",)], "json_path string")
    assert [r[1] for r in sorted(map(tuple, papers.paper_of_file(files, found).collect()))] == [None, "lone", "p_1"]
    docs = papers.read_parsed(spark, found, root)
    assert sorted((r.paper_id, r.title, tuple(r.authors), r.year) for r in docs.collect()) == [("lone", "A paper", ("One Author",), 2001), ("own", "", (), None), ("p_1", "A paper", ("One Author",), 2001)]
    one = docs.where("paper_id = 'p_1'")
    sections = papers.sections(one)
    assert rows(sections.select("ord", "title", "section", "level", "page_number", "page_numbers")) == [(0, "1. Methods", "methods", 1, 1, [1]), (1, "1.1 Milling", "methods", 1, 1, [1, 2]), (2, "2 Results", "results", 2, 3, [3]), (3, "Author information", "other", 1, 9, [9])]
    tables = papers.tables(one, sections)
    assert rows(tables.select("ord", "caption", "markdown", "section")) == [(0, "Table 1", "Columns: a | b\nRows:\n- a=1; b=", "methods"), (1, "T2", "| x |", "discussion")]
    assert rows(papers.figures(one, sections).select("caption", "section")) == [("Fig. 1", "results")] and rows(papers.equations(one, sections).select("equation_text", "section")) == [("E=mc", "unknown")]
    chunks = papers.evidence_chunks(sections, tables, 20, excluded=["other"])
    assert rows(chunks.select("chunk_id", "text")) == [
        ("p_1:section:0:0", "First we mill."), ("p_1:section:0:1", "Then we fire."), ("p_1:section:1:0", "Balls."), ("p_1:section:2:0", "It is hard."), ("p_1:table:0:0", "Caption: Table 1 Col"), ("p_1:table:0:1", "umns: a | b Rows: - "), ("p_1:table:0:2", "a=1; b="), ("p_1:table:1:0", "Caption: T2 | x |"),
    ]
    context = papers.enriched_context(sections, ["results", "methods"], tables).first()["context"]
    assert context.startswith("[PAPER=p_1][SECTION=methods]\nFirst we mill. Then we fire.\n\n[PAPER=p_1][SECTION=methods]\nBalls.\n\n[PAPER=p_1][SECTION=results]") and "[TABLE paper_id=p_1 page=2 section=methods table=1]\nCaption: Table 1\nColumns: a | b" in context
    assert papers.enriched_context(sections, ["methods"], None, 90).first()["context"].endswith("capped for cost control.")
    assert papers.sections(docs.limit(0)).count() == 0


def test_pages_and_sections(spark):
    found = spark.createDataFrame([("p", 1, [1], "methods"), ("p", 4, [4, 5], "results"), ("p", 5, [5], "discussion"), ("p", 8, [8], "other")], "paper_id string, page_number int, page_numbers array<int>, section string")
    asked = spark.createDataFrame([("p", k) for k in (0, 1, 3, 4, 5, 6, None)] + [("q", 1)], "paper_id string, page_number int")
    got = {(r.paper_id, r.page_number): r.page_section for r in papers.section_of_page(asked, found).collect()}
    assert got == {("p", 0): "unknown", ("p", 1): "methods", ("p", 3): "methods", ("p", 4): "results", ("p", 5): "discussion", ("p", 6): "unknown", ("p", None): "unknown", ("q", 1): "unknown"}


def test_table_without_columns(spark):
    df = spark.createDataFrame([(None, [{"a": "1"}]), (["x", ""], None), ([], [])], "columns array<string>, rows array<map<string,string>>")
    got = [r[0] for r in df.select(papers.table_markdown(F.coalesce("columns", F.array().cast("array<string>")), F.col("rows"))).collect()]
    assert got == ["Columns: a\nRows:\n- a=1", "Columns: x\nRows:", ""]
