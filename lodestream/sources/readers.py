"""File sources: parsed papers, relation graphs, claims, term tables, taxonomies, usage logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text

EDGE = "source string, relation string, target string, source_path string, source_type string, paper_id string, evidence_quote string, confidence double"
#: Endings by which a file name tells its paper, in order.
ENDINGS = [".relationships.csv", ".definitions.csv", ".terms.csv", ".acronyms.csv", ".claims.jsonl", ".graph.json", ".tree.parquet", ".json", ".jsonl", ".csv"]


def paper_of(path):
    """Paper id of a file: its name without a known ending, cut at ".processed."."""
    name = F.element_at(F.split(path, "/"), -1)
    for e in ENDINGS:
        name = F.regexp_replace(name, re.escape(e) + "$", "")
    return F.split(name, r"\.processed\.")[0]


def relation_graphs(spark: SparkSession, root: str) -> DataFrame:
    """Edges of all *.json graph files below a folder; files that hold no JSON and edges with a blank end are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    edges = files.select("path", F.from_json("value", "edges array<struct<source:string,relation:string,target:string,evidence_quote:string,confidence:double,provenance:struct<paper_id:string>>>").alias("g"))
    flat = edges.select("path", F.explode("g.edges").alias("e"))
    rows = flat.select(text.clean(F.col("e.source")).alias("source"), text.clean(F.col("e.relation")).alias("relation"), text.clean(F.col("e.target")).alias("target"), F.col("path").alias("source_path"), F.lit("relation_graph").alias("source_type"), F.col("e.provenance.paper_id").alias("paper_id"), F.col("e.evidence_quote").alias("evidence_quote"), F.col("e.confidence").alias("confidence"))
    return rows.where((F.length("source") > 0) & (F.length("relation") > 0) & (F.length("target") > 0))


def relation_claims(spark: SparkSession, root: str) -> DataFrame:
    """Edges of all *.jsonl claim files below a folder; lines that are no JSON object are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root).select("value", F.col("_metadata.file_path").alias("path"))
    got = lines.select("path", F.from_json("value", "subject string, relation string, object string, evidence_quote string, confidence double, source struct<paper_id:string>").alias("c"))
    rows = got.select(text.clean(F.col("c.subject")).alias("source"), text.clean(F.col("c.relation")).alias("relation"), text.clean(F.col("c.object")).alias("target"), F.col("path").alias("source_path"), F.lit("relation_claim").alias("source_type"), F.col("c.source.paper_id").alias("paper_id"), F.col("c.evidence_quote").alias("evidence_quote"), F.col("c.confidence").alias("confidence"))
    return rows.where((F.length("source") > 0) & (F.length("relation") > 0) & (F.length("target") > 0))


def term_tables(spark: SparkSession, root: str) -> DataFrame:
    """Edges of *.relationships.csv (three columns) and *.definitions.csv (two) files, without header."""

    def read(glob: str, schema: str) -> DataFrame:
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", True).option("escape", '"').schema(schema).csv(root).withColumn("path", F.col("_metadata.file_path"))

    links = read("*.relationships.csv", "a string, r string, b string").select("a", "r", "b", "path", F.lit("termo_relationship").alias("kind"))
    meanings = read("*.definitions.csv", "a string, b string").select("a", F.lit("DEFINED_AS").alias("r"), "b", "path", F.lit("termo_definition").alias("kind"))
    both = links.unionByName(meanings)
    rows = both.select(text.clean(F.col("a")).alias("source"), text.clean(F.col("r")).alias("relation"), text.clean(F.col("b")).alias("target"), F.col("path").alias("source_path"), F.col("kind").alias("source_type"), paper_of(F.col("path")).alias("paper_id"), F.lit(None).cast("string").alias("evidence_quote"), F.lit(None).cast("double").alias("confidence"))
    return rows.where((F.length("source") > 0) & (F.length("relation") > 0) & (F.length("target") > 0))


def all_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of all loaders of a folder."""
    return relation_graphs(spark, root).unionByName(relation_claims(spark, root)).unionByName(term_tables(spark, root))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; lines that don't parse are dropped."""
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def picked_json(papers: DataFrame) -> DataFrame:
    """paper_id, kind, collection, paper_index: which of the namings a paper's JSON file has, and the split of its id."""
    stem = F.regexp_extract("json_path", r"([^/]+)\.json$", 1)
    kind = F.when(stem == F.col("paper_id"), 0).when(stem.rlike(r"[._]parsed$"), 1).otherwise(2)
    collection, number = F.regexp_extract("paper_id", r"^(.+)_(\d+)$", 1), F.regexp_extract("paper_id", r"^(.+)_(\d+)$", 2)
    return papers.select("paper_id", kind.alias("kind"), F.when(F.length(collection) > 0, collection).otherwise(F.col("paper_id")).alias("collection"), number.try_cast("int").alias("paper_index"))


def figures(papers: DataFrame) -> DataFrame:
    """paper_id, figures: the image files of a paper, sorted, one text."""
    kinds = r"(?i)\.(png|jpe?g|gif|bmp|tiff?|webp)$"
    found = F.array_sort(F.filter(F.coalesce("figure_paths", F.array().cast("array<string>")), lambda p: p.rlike(kinds)))
    return papers.select("paper_id", F.array_join(found, " ").alias("figures"), F.size(found).alias("n"))


def limited_examples(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """The first rows of JSON lines in their order, with it (ord); a line that doesn't parse is an error, a missing file is empty."""
    from lodestream.pipelines import exists

    if not exists(spark, path):
        return spark.createDataFrame([], schema + ", ord bigint")
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).withColumn("ord", F.monotonically_increasing_id())
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x"), "ord").select("x.*", "ord")
    return rows if most is None else rows.orderBy("ord").limit(most)


def last_answers(lines: DataFrame, key: str = "uuid", value: str = "answer") -> DataFrame:
    """key, value: the last non-null value of each non-blank key of rows with ``ord``."""
    kept = lines.where((F.length(F.trim(key)) > 0) & F.col(value).isNotNull())
    return kept.groupBy(key).agg(F.max_by(value, "ord").alias(value))


def candidate_terms(spark: SparkSession, root: str, most: int = 10_000) -> DataFrame:
    """term, ord: the first columns of all *.terms.csv files in file order, each term once (case aside), the first ``most``."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.terms.csv").option("escape", '"').schema("term string, a string, b string, c string").csv(root)
    named = rows.select(text.clean(F.col("term")).alias("term"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")).where(F.length("term") > 0)
    first = named.groupBy(F.lower("term").alias("low")).agg(F.min(F.struct("at", "term")).alias("x"))
    return first.orderBy("x.at").limit(most).select("x.term", F.monotonically_increasing_id().alias("ord"))


def figure_assets(rows: DataFrame, captions: bool = True, images: bool = True, most: int | None = None) -> DataFrame:
    """chunk_id, paper_id, source_type, text, image_path: a caption and/or an image chunk for each asset (asset_id, paper_id, caption, image_path)."""
    kept = rows.orderBy("asset_id").limit(most) if most is not None else rows
    told = text.clean(F.col("caption"))
    parts = []
    if captions:
        parts.append(F.when(F.length(told) > 0, F.struct(F.lit("figure_caption").alias("source_type"), told.alias("text"), F.lit(None).cast("string").alias("image_path"))))
    if images:
        parts.append(F.when(F.length(F.trim("image_path")) > 0, F.struct(F.lit("figure_image").alias("source_type"), told.alias("text"), F.col("image_path").alias("image_path"))))
    each = kept.select("asset_id", "paper_id", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("asset_id", "paper_id", "x.*")
    return each.select(F.concat_ws(":", "paper_id", "source_type", F.col("asset_id").cast("string")).alias("chunk_id"), "paper_id", "source_type", "text", "image_path")


def texts(spark: SparkSession, root: str) -> DataFrame:
    """path, text of all files below a folder: UTF-8, else Latin-1 with accents off."""
    import unicodedata

    def run(frames):
        for df in frames:
            out = []
            for b in df["content"]:
                try:
                    out.append(bytes(b).decode("utf-8"))
                except UnicodeDecodeError:
                    out.append(unicodedata.normalize("NFKD", bytes(b).decode("latin-1")).encode("ascii", "ignore").decode())
            yield df[["path"]].assign(text=out)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content").mapInPandas(run, "path string, text string")


def seed_categories(spark: SparkSession, path: str) -> DataFrame:
    """category, ord: what follows the last colon of "Main Category" lines (asterisks off)."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.when(F.trim("value").startswith("*"), F.replace("value", F.lit("*"), F.lit(""))).otherwise(F.col("value")).alias("v"))
    return rows.where(F.col("v").startswith("Main Category")).select(F.trim(F.regexp_extract("v", "([^:]*)$", 1)).alias("category"), "ord")


def qa_metadata(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """paper_id, title, abstract of parsed papers: the title given, else the first long section title; the abstract given, else the section of that name."""
    low = F.lower("title")
    named = sections.where((F.length("title") > 20) & ~F.contains(low, F.lit("abstract"))).groupBy("paper_id").agg(F.min_by("title", "ord").alias("_t"))
    told = sections.where(F.contains(low, F.lit("abstract"))).groupBy("paper_id").agg(F.min_by("text", "ord").alias("_a"))
    given = F.nullif(text.clean(F.try_variant_get("doc", "$.metadata.abstract", "string")), F.lit(""))
    both = docs.join(named, "paper_id", "left").join(told, "paper_id", "left")
    return both.select("paper_id", F.coalesce(F.nullif("title", F.lit("")), "_t", "paper_id").alias("title"), F.coalesce(given, "_a", F.lit("")).alias("abstract"))


def used_ids(examples: DataFrame) -> DataFrame:
    """id, kind of all that examples refer to: other examples (from), papers (anchor, reference)."""
    none = F.array().cast("array<string>")
    papers = F.concat(F.coalesce("anchor_pdf", none), F.coalesce("reference_pdf", none))
    return examples.select(F.explode(F.coalesce("from_uuids", none)).alias("id"), F.lit("example").alias("kind")).union(examples.select(F.explode(papers), F.lit("paper"))).distinct()


def tagged(examples: DataFrame, tag: str) -> DataFrame:
    """The ids of the examples with a tag."""
    return examples.where(F.array_contains("tags", tag)).select("uuid")
