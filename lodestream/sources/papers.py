"""Folders of parsed papers: discovery, normalised sections, tables, figures and equations, evidence chunks, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.operators import documents

# ---- fixed values: keys by which a parsed paper names a thing, section order, limits ----
KEYS = {
    "title": ["title", "section_title", "heading", "name"], "section": ["normalized_section", "section"], "text": ["text", "content"], "pages": ["page_numbers", "pages"], "page": ["page_number", "page", "page_idx"],
    "table_caption": ["table_caption", "caption"], "html": ["table_html", "html"], "markdown": ["table_markdown", "markdown", "text"], "figure_caption": ["figure_caption", "caption"], "equation": ["equation_text", "latex", "text", "content"],
}
SECTION_ORDER = ["abstract", "introduction", "methods", "experimental", "experiments", "evaluation", "results", "discussion", "ablation", "conclusion", "other"]
IMAGES = r"(?i)\.(png|jpe?g|gif|bmp|tiff?|webp)$"
TRUNCATED = "\n\n[TRUNCATED] Enriched context was capped for cost control."
# ---- end of fixed values ----


def _parts(path: Column, root: str) -> Column:
    """The parts of a path below a root folder."""
    base = "/" + root.strip("/").removeprefix("file:").strip("/") + "/"
    return F.split(F.element_at(F.split(path, base.replace(".", r"\."), 2), 2), "/")


def discovered(spark: SparkSession, root: str, flat: bool = True) -> DataFrame:
    """paper_id, json_path, layout, collection, paper_index of the papers of a folder.

    A sub-folder with JSON files is a paper (its file by name: as the folder, then ".parsed", then any
    other, of equal ones the first); a JSON file beside the folders is one too, unless a folder has its name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root).select("path").withColumn("at", _parts(F.col("path"), root))
    name = F.element_at("at", -1)
    stem = F.regexp_replace(name, r"\.json$", "")
    inner = files.where((F.size("at") == 2) & ~F.col("at")[0].startswith(".")).select(F.col("at")[0].alias("paper_id"), "path", name.alias("name"), stem.alias("stem"))
    order = F.when(F.col("stem") == F.col("paper_id"), 0).when(F.col("stem").rlike(r"[._]parsed$"), 1).otherwise(2)
    folders = inner.groupBy("paper_id").agg(F.min_by("path", F.struct(order, F.col("name"))).alias("json_path")).withColumn("layout", F.lit("folder"))
    if flat:
        lone = files.where(F.size("at") == 1).select(stem.alias("paper_id"), F.col("path").alias("json_path"), F.lit("flat").alias("layout"))
        folders = folders.unionByName(lone.join(folders.select("paper_id"), "paper_id", "left_anti"))
    collection, number = F.regexp_extract("paper_id", r"^(.+)_(\d+)$", 1), F.regexp_extract("paper_id", r"^(.+)_(\d+)$", 2)
    return folders.select("paper_id", "json_path", "layout", F.when(F.length(collection) > 0, collection).otherwise(F.col("paper_id")).alias("collection"), number.try_cast("int").alias("paper_index"))


def figure_listing(spark: SparkSession, root: str) -> DataFrame:
    """paper_id, figure_paths: the sorted image files in the figures folders of the papers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").withColumn("at", _parts(F.col("path"), root))
    kept = files.where((F.size("at") == 3) & (F.col("at")[1] == "figures") & F.col("path").rlike(IMAGES))
    return kept.groupBy(F.col("at")[0].alias("paper_id")).agg(F.array_sort(F.collect_list("path")).alias("figure_paths"))


def paper_of_file(files: DataFrame, papers: DataFrame) -> DataFrame:
    """json_path, paper_id: the paper of each file, by its path, else by its folder, else by its stem; null for none."""
    folder, stem = F.element_at(F.split("json_path", "/"), -2), F.regexp_replace(F.element_at(F.split("json_path", "/"), -1), r"\.json$", "")
    named = files.select("json_path", folder.alias("_f"), stem.alias("_s"))
    by_path = papers.select("json_path", F.col("paper_id").alias("_1"))
    by_folder = papers.where("layout = 'folder'").select(F.col("paper_id").alias("_f"), F.col("paper_id").alias("_2"))
    by_stem = papers.where("layout = 'flat'").select(F.col("paper_id").alias("_s"), F.col("paper_id").alias("_3"))
    return named.join(by_path, "json_path", "left").join(by_folder, "_f", "left").join(by_stem, "_s", "left").select("json_path", F.coalesce("_1", "_2", "_3").alias("paper_id"))


def _first(x: Column, keys: list[str], kind: str = "string") -> Column:
    return F.coalesce(*(F.try_variant_get(x, f"$.{k}", kind) for k in keys))


def _listed(doc: Column, key: str) -> Column:
    """A list of a parsed paper: that of the parser's own part, else the one at the top."""
    both = [F.try_variant_get(doc, p, "array<variant>") for p in (f"$.info_from_mineru.{key}", f"$.{key}")]
    return F.coalesce(*both, F.array().cast("array<variant>"))


def parsed(files: DataFrame) -> DataFrame:
    """paper_id, json_path, title, authors, year, doc of JSON files (paper_id, json_path, value); files that hold no object are left out."""
    docs = files.select("paper_id", "json_path", F.try_parse_json("value").alias("doc")).where(F.schema_of_variant("doc").startswith("OBJECT"))
    get = lambda p, kind="string": F.try_variant_get("doc", p, kind)
    own = [F.nullif(text.clean(get(p)), F.lit("")) for p in ("$.paper_id", "$.paper_assets.paper_id")]
    author = F.coalesce(get("$.metadata.authors", "array<string>"), get("$.info_from_mineru.metadata.authors", "array<string>"), F.array_compact(F.array(F.coalesce(get("$.metadata.authors"), get("$.info_from_mineru.metadata.authors")))))
    title = text.clean(F.coalesce(get("$.metadata.title"), get("$.info_from_mineru.metadata.title")))
    authors = F.filter(F.transform(author, text.clean), lambda a: F.length(a) > 0)
    return docs.select(F.coalesce(*own, "paper_id").alias("paper_id"), "json_path", title.alias("title"), authors.alias("authors"), F.coalesce(get("$.metadata.year", "int"), get("$.info_from_mineru.metadata.year", "int")).alias("year"), "doc")


def read_parsed(spark: SparkSession, papers: DataFrame, root: str) -> DataFrame:
    """The parsed files of discovered papers (see ``parsed``)."""
    body = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("json_path"))
    bare = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    return parsed(papers.withColumn("k", bare(F.col("json_path"))).join(body.select("value", bare(F.col("json_path")).alias("k")), "k").select("paper_id", "json_path", "value"))


def _entries(docs: DataFrame, key: str) -> DataFrame:
    rows = docs.select("paper_id", F.posexplode(_listed(F.col("doc"), key)).alias("ord", "x"))
    return rows.where(F.schema_of_variant("x").startswith("OBJECT"))


def sections(docs: DataFrame) -> DataFrame:
    """paper_id, ord, title, section, text, level, page_number, page_numbers of parsed papers; unnamed sections inherit by their number."""
    x = F.col("x")
    many = F.coalesce(F.try_variant_get(x, "$.page_numbers", "array<int>"), F.try_variant_get(x, "$.pages", "array<int>"), F.array_compact(F.array(_first(x, KEYS["pages"], "int"))))
    pages = F.array_distinct(F.array_compact(F.concat(F.coalesce(many, F.array().cast("array<int>")), F.array(_first(x, KEYS["page"], "int")))))
    title, given = text.clean(_first(x, KEYS["title"])), text.clean(_first(x, KEYS["section"]))
    rows = _entries(docs, "TOC").select("paper_id", "ord", title.alias("title"), given.alias("given"), text.clean(_first(x, KEYS["text"])).alias("text"), F.coalesce(F.try_variant_get(x, "$.level", "int"), F.lit(1)).alias("level"), pages.alias("page_numbers"))
    label = F.when(F.col("given").isin(SECTION_ORDER), F.col("given")).otherwise(text.section_label(F.col("title")))
    named = documents.inherit(rows.withColumn("label", label), "label", F.col("title"), ["paper_id"], ["ord"])
    return named.select("paper_id", "ord", "title", F.col("label").alias("section"), "text", "level", F.try_element_at("page_numbers", F.lit(1)).alias("page_number"), "page_numbers")


def section_of_page(rows: DataFrame, found: DataFrame, page: str = "page_number") -> DataFrame:
    """rows (paper_id, page) with ``page_section``: the one named section that has the page, else the one that runs over it.

    found: paper_id, page_number, page_numbers, section. A section runs from its first page to the
    first page of the next; the last one has its first page only. Pages are joined by equality: each
    page that is asked for meets the starts of its paper once, by a window over both. Of sections that
    start on one page the last in text order runs on.
    """
    named = found.where(F.col("section").isNotNull() & (F.col("section") != "other"))
    exact = named.select("paper_id", F.explode("page_numbers").alias(page), "section").groupBy("paper_id", page).agg(F.min("section").alias("_a"), F.max("section").alias("_b"))
    starts = named.where(F.col("page_number").isNotNull()).groupBy("paper_id", "page_number").agg(F.max("section").alias("_s"))
    last = starts.groupBy("paper_id").agg(F.max("page_number").alias("_last"))
    asked = rows.select("paper_id", F.col(page).alias("page_number")).where(F.col(page).isNotNull()).distinct().withColumn("_s", F.lit(None).cast("string")).withColumn("_ask", F.lit(1))
    both = starts.withColumn("_ask", F.lit(0)).unionByName(asked)
    run = Window.partitionBy("paper_id").orderBy("page_number", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_near", F.last("_s", ignorenulls=True).over(run)).where("_ask = 1").join(last, "paper_id", "left")
    over = near.select("paper_id", F.col("page_number").alias(page), F.when(F.col("page_number") <= F.col("_last"), F.col("_near")).alias("_r"))
    joined = rows.join(exact, ["paper_id", page], "left").join(over, ["paper_id", page], "left")
    return joined.withColumn("page_section", F.coalesce(F.when(F.col("_a") == F.col("_b"), F.col("_a")), "_r", F.lit("unknown"))).drop("_a", "_b", "_r")


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with ``section``: the one the entry names, else the one of its page."""
    told = rows.withColumn("_told", text.clean(_first(F.col("x"), ["section", "normalized_section"]))).withColumn("page_number", _first(F.col("x"), KEYS["page"], "int"))
    labels = told.select("_told").where(F.length("_told") > 0).distinct().withColumn("_label", text.section_label(F.col("_told")))
    named = F.when(F.col("_label") != "other", F.col("_label")).otherwise(F.nullif("_told", F.lit("")))
    paged = section_of_page(told.join(labels, "_told", "left"), found)
    return paged.withColumn("section", F.coalesce(named, "page_section")).drop("page_section", "_told", "_label")


def tables(docs: DataFrame, found: DataFrame) -> DataFrame:
    """paper_id, ord, caption, markdown, html, page_number, section of the tables of parsed papers."""
    x = F.col("x")
    cells = F.coalesce(F.try_variant_get(x, "$.rows", "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    columns = F.coalesce(F.try_variant_get(x, "$.columns", "array<string>"), F.array().cast("array<string>"))
    told = text.clean(_first(x, KEYS["markdown"]))
    rows = _placed(_entries(docs, "tables"), found)
    return rows.select("paper_id", "ord", text.clean(_first(x, KEYS["table_caption"])).alias("caption"), F.when(F.length(told) > 0, told).otherwise(table_markdown(columns, cells)).alias("markdown"), text.clean(_first(x, KEYS["html"])).alias("html"), "page_number", "section")


def figures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """paper_id, ord, caption, page_number, section of the figures of parsed papers."""
    return _placed(_entries(docs, "figures"), found).select("paper_id", "ord", text.clean(_first(F.col("x"), KEYS["figure_caption"])).alias("caption"), "page_number", "section")


def equations(docs: DataFrame, found: DataFrame) -> DataFrame:
    """paper_id, ord, equation_text, page_number, section of the equations of parsed papers."""
    return _placed(_entries(docs, "equations"), found).select("paper_id", "ord", text.clean(_first(F.col("x"), KEYS["equation"])).alias("equation_text"), "page_number", "section")


def table_markdown(columns: Column, rows: Column) -> Column:
    """A table as "Columns: a | b", "Rows:" and a line a row; blank column names and empty rows left out, without columns those of the first row."""
    named = F.filter(F.transform(F.when(F.size(columns) > 0, columns).otherwise(F.coalesce(F.map_keys(F.try_element_at(rows, F.lit(1))), F.array().cast("array<string>"))), text.clean), lambda c: F.length(c) > 0)
    line = lambda r: F.transform(named, lambda c: F.concat(c, F.lit("="), text.clean(F.try_element_at(r, c))))
    full = F.filter(F.coalesce(rows, F.array().cast("array<map<string,string>>")), lambda r: F.exists(named, lambda c: F.length(text.clean(F.try_element_at(r, c))) > 0))
    lines = F.transform(full, lambda r: F.concat(F.lit("- "), F.array_join(line(r), "; ")))
    head = F.array(F.concat(F.lit("Columns: "), F.array_join(named, " | ")), F.lit("Rows:"))
    return F.when(F.size(named) > 0, F.array_join(F.concat(head, lines), "\n")).otherwise("")


def allowed(section: Column, included: list[str], excluded: list[str]) -> Column:
    """A section that isn't excluded and, where some are asked for, is one of these."""
    inside = F.lit(True) if not included else section.isin(included)
    return ~section.isin(excluded) & inside if excluded else inside


def evidence_chunks(found: DataFrame, tabled: DataFrame | None = None, limit: int = 12_000, included: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """chunk_id, paper_id, source_type, section, title, page_number, text: sections and tables of papers cut at sentences.

    found: paper_id, ord, section, title, text, page_number; tabled: paper_id, ord, section, caption,
    markdown, page_number. Blank texts have no chunk; white space is one space.
    """

    def cut(rows: DataFrame, kind: str) -> DataFrame:
        kept = rows.where(allowed(F.lower(F.coalesce("section", F.lit("unknown"))), included or [], excluded or []))
        parts = kept.select("paper_id", "ord", F.lower(F.coalesce("section", F.lit("unknown"))).alias("section"), "title", "page_number", F.posexplode(documents.packed(text.clean(F.col("text")), limit)).alias("k", "text"))
        return parts.select(F.concat_ws(":", "paper_id", F.lit(kind), F.col("ord").cast("string"), F.col("k").cast("string")).alias("chunk_id"), "paper_id", F.lit(kind).alias("source_type"), "section", "title", "page_number", "text")

    named = found.withColumn("title", F.coalesce(F.nullif(text.clean(F.col("title")), F.lit("")), F.lower("section")))
    out = cut(named, "section")
    if tabled is None:
        return out
    caption = text.clean(F.col("caption"))
    body = F.concat_ws(" ", F.when(F.length(caption) > 0, F.concat(F.lit("Caption: "), caption)), F.nullif(text.clean(F.col("markdown")), F.lit("")))
    lines = tabled.withColumn("text", body).withColumn("title", F.when(F.length(caption) > 0, caption).otherwise(F.concat(F.lit("Table "), (F.col("ord") + 1).cast("string"))))
    return out.unionByName(cut(lines, "table"))


def enriched_context(found: DataFrame, wanted: list[str], tabled: DataFrame | None = None, limit: int = 60_000) -> DataFrame:
    """paper_id, context: sections of the wanted names in canonical order, then tables, with markers, cut at ``limit`` characters.

    Repeated sections (name, title, text) stand once. A block takes at least the length of its
    marker, so only so many first blocks of a paper are gathered as can fit.
    """
    order = [s for s in SECTION_ORDER if s in {w.strip().lower() for w in wanted}]
    body = F.trim(F.coalesce("text", F.lit("")))
    rows = found.where(F.col("section").isin(order) & (F.length(body) > 0)).groupBy("paper_id", "section", F.coalesce("title", F.lit("")).alias("title"), body.alias("text")).agg(F.min("ord").alias("ord"))
    block = F.concat(F.lit("[PAPER="), "paper_id", F.lit("][SECTION="), "section", F.lit("]\n"), "text")
    blocks = rows.select("paper_id", F.array_position(F.array(*(F.lit(s) for s in order)), F.col("section")).alias("a"), F.col("ord").cast("bigint").alias("b"), block.alias("block"))
    if tabled is not None:
        head = F.concat(F.lit("[TABLE paper_id="), "paper_id", F.lit(" page="), F.coalesce(F.col("page_number").cast("string"), F.lit("unknown")), F.lit(" section="), F.coalesce("section", F.lit("unknown")), F.lit(" table="), (F.col("ord") + 1).cast("string"), F.lit("]"))
        told = F.concat_ws("\n", head, F.concat(F.lit("Caption: "), F.coalesce("caption", F.lit(""))), F.when(F.length("markdown") > 0, F.col("markdown")))
        blocks = blocks.unionByName(tabled.select("paper_id", F.lit(len(order) + 1).cast("bigint").alias("a"), F.col("ord").cast("bigint").alias("b"), told.alias("block")))
    place = Window.partitionBy("paper_id").orderBy("a", "b", "block")
    first = blocks.withColumn("k", F.row_number().over(place)).where(F.col("k") <= limit // 20 + 1)
    joined = first.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.substring("block", 1, limit + 1).alias("s")))), lambda x: x["s"]), "\n\n").alias("c"))
    return joined.select("paper_id", F.when(F.length("c") <= limit, F.col("c")).otherwise(F.concat(F.rtrim(F.substring("c", 1, max(0, limit - len(TRUNCATED)))), F.lit(TRUNCATED))).alias("context"))


def from_records(section_rows: DataFrame, table_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, tables) in the shape of parsed papers from section and table records (paper_id, heading, section, content; caption, columns, rows, page)."""
    title = text.clean(F.coalesce(F.nullif(F.trim("heading"), F.lit("")), "section"))
    label = F.when(F.col("section").isin(SECTION_ORDER), F.col("section")).otherwise(text.section_label(title))
    pages = F.array().cast("array<int>")
    found = section_rows.select("paper_id", F.col("section_id").alias("ord"), title.alias("title"), label.alias("section"), text.clean(F.col("content")).alias("text"), F.lit(1).alias("level"), F.lit(None).cast("int").alias("page_number"), pages.alias("page_numbers"))
    tabled = table_rows.select("paper_id", F.col("record_id").alias("ord"), text.clean(F.col("caption")).alias("caption"), table_markdown(F.coalesce("columns", F.array().cast("array<string>")), F.col("rows")).alias("markdown"), F.col("page").alias("page_number"), F.lit("unknown").alias("section"))
    return found, tabled
