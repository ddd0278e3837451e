"""File sinks: JSON lines and documents, header-less CSV, texts, graphs, logs, latest-wins tables."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, null fields left out; an existing folder is replaced."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", False).option("escape", '"').csv(path)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """id, type of every end: the type first met in edge order, sources before targets."""
    ends = edges.select("edge_id", F.posexplode(F.array(F.struct(F.col("source").alias("id"), F.col("source_kind").alias("type")), F.struct(F.col("target").alias("id"), F.col("target_kind").alias("type")))).alias("k", "x"))
    return ends.select("edge_id", "k", "x.*").groupBy("id").agg(F.min_by("type", F.struct("edge_id", "k")).alias("type"))


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key of an append-only table."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_k = 1").drop("_k")


def write_json_document(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """Rows as one pretty JSON list in one file; more than ``most`` are refused (use ``write_json_lines``)."""
    got = rows.toJSON().take(most + 1)
    if len(got) > most:
        raise ValueError(f"a document of at most {most} rows is expected")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(x) for x in got], f, ensure_ascii=False, indent=2)


def write_sections(sections: DataFrame, path: str) -> None:
    """Section records as JSON lines, and their texts by section name beside."""
    sections.write.mode("overwrite").json(f"{path}/records")
    sections.select("section", F.coalesce("content", F.lit("")).alias("value")).write.mode("overwrite").partitionBy("section").text(f"{path}/texts")


def write_tables(tables: DataFrame, path: str) -> None:
    """Table records as JSON lines, and as markdown beside."""
    from lodestream.sources.papers import table_markdown

    tables.write.mode("overwrite").json(f"{path}/records")
    columns = F.coalesce("columns", F.array().cast("array<string>"))
    tables.select(F.concat_ws("\n", F.concat(F.lit("Caption: "), F.coalesce("caption", F.lit(""))), table_markdown(columns, F.col("rows"))).alias("value")).write.mode("overwrite").text(f"{path}/markdown")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A table without the keys of another: what a delete leaves."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def example_rows(rows: DataFrame) -> DataFrame:
    """Examples with the defaults of a fresh one where a field is missing (uuid, question, tags, evaluator ...)."""
    none = F.array().cast("array<string>")
    defaults = {"uuid": F.expr("uuid()"), "question": F.lit(""), "answer_format": F.lit(""), "tags": none, "anchor_pdf": none, "reference_pdf": none, "conference": none, "annotator": F.lit("human"), "evaluator": F.struct(F.lit("eval_string_exact_match").alias("eval_func"), F.lit("{}").alias("eval_kwargs"))}
    return rows.withColumns({k: F.coalesce(F.col(k), v) if k in rows.columns else v for k, v in defaults.items()})


def append_log(spark: SparkSession, path: str, pipeline: str, run_id: str, facts: dict) -> None:
    """One record of a run in an append-only log."""
    row = spark.createDataFrame([(pipeline, run_id, json.dumps(facts, sort_keys=True))], "pipeline string, run_id string, facts string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_runs(log: DataFrame) -> DataFrame:
    """The last record of each pipeline."""
    return latest(log.withColumn("_v", F.struct("at", "run_id")), "pipeline", "_v").drop("_v")


def append_usage(rows: DataFrame, path: str) -> None:
    """Usage records (component, model, prompt_tokens, completion_tokens) with their time, appended as JSON lines; total_tokens is their sum where it is missing."""
    total = F.coalesce("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))) if "total_tokens" in rows.columns else F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    rows.withColumn("total_tokens", total).withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, most: int = 20_000) -> dict:
    """graph.json and graph.html of a graph that is to be looked at (nodes: id, label, type, size; edges: source, target, relation); larger ones are refused."""
    parts = {}
    for name, df in (("nodes", nodes), ("edges", edges)):
        got = df.toJSON().take(most + 1)
        if len(got) > most:
            raise ValueError(f"at most {most} {name} can be drawn")
        parts[name] = [json.loads(x) for x in got]
    os.makedirs(folder, exist_ok=True)
    data = json.dumps(parts, ensure_ascii=False)
    with open(os.path.join(folder, "graph.json"), "w", encoding="utf-8") as f:
        f.write(data)
    rows = "".join(f"<li>{html.escape(str(e.get('source')))} - {html.escape(str(e.get('relation')))} - {html.escape(str(e.get('target')))}</li>" for e in parts["edges"])
    with open(os.path.join(folder, "graph.html"), "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset='utf-8'><title>Graph</title><ul>{rows}</ul><script type='application/json' id='graph'>" + data.replace("</", "<\\/") + "</script>")
    return {k: len(v) for k, v in parts.items()}
