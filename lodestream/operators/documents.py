"""Sections and tables: spans, inherited labels, evidence chunks, caps, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import text

# ---- fixed values: which sections come first ----
CHUNK_PRIORITY = {"results": 0, "discussion": 1, "ablation": 1, "evaluation": 1, "experimental": 2, "experiments": 2, "methods": 2, "conclusion": 3}
# ---- end of fixed values ----


def inherit(rows: DataFrame, label: str, title: Column, keys: list[str], order: list[str]) -> DataFrame:
    """rows whose titles name no section ("other") with the label of the last one before with the same first number."""
    numbered = rows.withColumn("_root", text.number_root(title))
    own = F.when((F.col(label) != "other") & F.col("_root").isNotNull(), F.struct("_root", F.col(label).alias("_label")))
    last = numbered.withColumn("_last", F.last(own, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    takes = (F.col(label) == "other") & F.col("_root").isNotNull() & (F.col("_last._root") == F.col("_root"))
    return last.withColumn(label, F.when(takes, F.col("_last._label")).otherwise(F.col(label))).drop("_root", "_last")


def inherited_labels(sections: DataFrame) -> DataFrame:
    """section_id, label: titles that name no section take the label of the last one with the same first number."""
    rows = sections.select("section_id", "paper_id", "start_line", "heading", text.section_label(F.col("heading")).alias("label"))
    return inherit(rows, "label", F.col("heading"), ["paper_id"], ["start_line", "section_id"]).select("section_id", "label")


def spans(sections: DataFrame) -> DataFrame:
    """section_id, first_line, next_line: from a heading to the next one of the paper; first of each section only."""
    order = Window.partitionBy("paper_id").orderBy("start_line", "section_id")
    ahead = sections.select("section_id", "paper_id", "section", F.col("start_line").alias("first_line"), F.lead("start_line").over(order).alias("next_line"), "start_line")
    first = F.row_number().over(Window.partitionBy("paper_id", "section").orderBy("start_line", "section_id"))
    return ahead.withColumn("k", first).where("k = 1").select("section_id", "first_line", "next_line")


def pruned_spans(sections: DataFrame) -> DataFrame:
    """section_id of the line spans that no earlier span of the paper holds."""
    order = Window.partitionBy("paper_id").orderBy("start_line", F.desc("end_line"), "section_id").rowsBetween(Window.unboundedPreceding, -1)
    held = sections.withColumn("reach", F.max("end_line").over(order))
    return held.where("reach is null or end_line > reach").select("section_id")


def packed(content: Column, limit: int) -> Column:
    """Sentences packed into chunks of at most ``limit`` characters, longer sentences cut hard; array of chunks."""
    parts = F.filter(F.split(F.trim(F.coalesce(content, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)
    hard = F.flatten(F.transform(parts, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda k: F.substring(s, k * limit + 1, F.lit(limit)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        fits = (F.length(acc["now"]) == 0) | (F.length(acc["now"]) + 1 + F.length(s) <= limit)
        joined = F.when(F.length(acc["now"]) == 0, s).otherwise(F.concat(acc["now"], F.lit(" "), s))
        return F.when(fits, F.struct(acc["done"].alias("done"), joined.alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), s.alias("now")))

    return F.aggregate(hard, start, step, lambda a: F.when(F.length(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def chunks(sections: DataFrame, limit: int = 12_000) -> DataFrame:
    """chunk_id, section_id, paper_id, section, text: the evidence chunks of all sections with text."""
    cut = sections.select("section_id", "paper_id", "section", F.posexplode(packed(text.clean(F.col("content")), limit)).alias("k", "text"))
    return cut.select(F.concat_ws(":", F.coalesce("paper_id", F.lit("")), F.lit("section"), "section_id", "k").alias("chunk_id"), "section_id", "paper_id", "section", "text")


def capped(chunked: DataFrame, most: int) -> DataFrame:
    """The first chunks of each paper by section priority and length, at most ``most``."""
    rank = F.lit(9)
    for name, p in CHUNK_PRIORITY.items():
        rank = F.when(F.col("section") == name, F.lit(p)).otherwise(rank)
    order = Window.partitionBy("paper_id").orderBy(rank, F.length("text"), "chunk_id")
    return chunked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def repeated_lines(docs: DataFrame, id_col: str, content: str, times: int) -> DataFrame:
    """id, line, n: non-blank lines that stand more than ``times`` times in one text."""
    lines = docs.select(id_col, F.explode(F.split(F.coalesce(content, F.lit("")), "\r\n|\n|\r")).alias("line")).select(id_col, F.trim("line").alias("line")).where(F.length("line") > 0)
    return lines.groupBy(id_col, "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > times)


def table_text(columns: Column, row: Column) -> Column:
    """One table row as "a=1; b=2" in column order; missing cells are empty."""
    return F.array_join(F.transform(columns, lambda c: F.concat(c, F.lit("="), F.coalesce(F.try_element_at(row, c), F.lit("")))), "; ")


def unique_names(names: Column) -> Column:
    """Column names made unique: a repeated one gets " 2", " 3", a blank one its place."""
    filled = F.transform(names, lambda c, i: F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) == 0, F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(F.trim(c)))
    return F.transform(filled, lambda c, i: F.when(F.size(F.filter(F.slice(filled, F.lit(1), i), lambda p: p == c)) > 0, F.concat(c, F.lit(" "), (F.size(F.filter(F.slice(filled, F.lit(1), i), lambda p: p == c)) + 1).cast("string"))).otherwise(c))
