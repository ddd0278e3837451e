"""Scoring answers and summarising scores; pairing, quotas, near-duplicate questions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import evaluators, scoring
from lodestream.session import checkpoint


def scored(examples: DataFrame) -> DataFrame:
    """qa_id, eval_func, score of the stored answers by the exact evaluators; others have a null score (skipped)."""
    kw, pred = F.col("evaluator.eval_kwargs"), F.col("answer")
    gold = F.get_json_object(kw, "$.gold")
    name = F.col("evaluator.eval_func")
    score = (
        F.when(name == "eval_string_exact_match", scoring.string_match(pred, gold, F.get_json_object(kw, "$.lowercase") == "true"))
        .when(name == "eval_bool_exact_match", scoring.bool_match(pred, gold))
        .when(name == "eval_int_exact_match", scoring.int_match(pred, gold))
        .when(name == "eval_float_exact_match", scoring.float_match(pred, gold, F.get_json_object(kw, "$.ndigits").try_cast("int")))
    )
    return examples.select("qa_id", name.alias("eval_func"), F.when(pred.isNotNull(), score).alias("score"))


def scored_all(examples: DataFrame) -> DataFrame:
    """qa_id, eval_func, score by all evaluators that need no model: those of ``scored`` and of ``evaluators``; others have null."""
    held = examples.select("qa_id", F.col("evaluator.eval_func").alias("eval_func"), F.col("evaluator.eval_kwargs").alias("kw"), "answer")

    def run(frames):
        for df in frames:
            got = [evaluators.evaluate(*x) for x in zip(df["eval_func"], df["kw"], df["answer"], strict=True)]
            yield pd.DataFrame({"qa_id": df["qa_id"], "eval_func": df["eval_func"], "score": pd.Series(got, dtype="float64")})

    python = F.col("evaluator.eval_func").isin(*evaluators.PYTHON)
    deep = held.where(F.col("eval_func").isin(*evaluators.PYTHON)).mapInPandas(run, "qa_id bigint, eval_func string, score double")
    return scored(examples.where(~F.coalesce(python, F.lit(False)))).unionByName(deep)


def summary(scores: DataFrame) -> DataFrame:
    """Counts and mean score by evaluator and over all (null evaluator)."""
    return scores.rollup("eval_func").agg(F.count(F.lit(1)).alias("evaluated"), F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("mean_score"), F.grouping("eval_func").alias("total"))


def apportioned(counts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Largest-remainder split of ``total`` by weight; leftovers to the largest remainder, then weight, then key."""
    whole = Window.partitionBy(F.lit(0))
    exact = F.col(weight) * F.lit(float(total)) / F.sum(weight).over(whole)
    base = counts.select(key, weight, exact.alias("exact")).withColumn("base", F.floor("exact")).withColumn("rest", F.round(F.col("exact") - F.col("base"), 9))
    left = base.withColumn("left", F.lit(total) - F.sum("base").over(whole)).withColumn("k", F.row_number().over(whole.orderBy(F.desc("rest"), F.desc(weight), key)))
    return left.select(key, (F.col("base") + F.when(F.col("k") <= F.col("left"), 1).otherwise(0)).cast("bigint").alias("share"))


def similar_questions(examples: DataFrame, threshold: float = 0.64) -> DataFrame:
    """qa_id, class_id, links: the token set of each question and how many other sets are near-duplicates of it.

    Questions with one token set are one class. Sets meet on shared tokens of their prefixes (rarest
    first), which is exact for a Jaccard of at least ``threshold``: no pair that reaches it can miss.
    """
    token = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce("question", F.lit(""))), F.lit(r"[A-Za-z0-9_.+%µμ°×^-]+"), F.lit(0)), lambda t: F.length(t) >= 3))
    rows = examples.select("qa_id", F.array_sort(token).alias("toks")).where(F.size("toks") > 0).withColumn("sig", F.array_join("toks", " "))
    classes = checkpoint(rows.groupBy("sig").agg(F.min("qa_id").alias("class_id"), F.first("toks").alias("toks")))
    words = classes.select("class_id", F.explode("toks").alias("tok"), F.size("toks").alias("n"))
    df = words.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    placed = words.join(df, "tok").withColumn("k", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "tok")))
    prefix = checkpoint(placed.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("class_id", "tok", "n"))
    a, b = prefix.select(F.col("class_id").alias("a"), "tok", F.col("n").alias("na")), prefix.select(F.col("class_id").alias("b"), "tok", F.col("n").alias("nb"))
    pairs = a.join(b, "tok").where((F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))).select("a", "b").distinct()
    full = classes.select("class_id", "toks")
    both = pairs.join(full.select(F.col("class_id").alias("a"), F.col("toks").alias("ta")), "a").join(full.select(F.col("class_id").alias("b"), F.col("toks").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    near = both.where(shared >= threshold * (F.size("ta") + F.size("tb") - shared) - 1e-9)
    links = near.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return rows.join(classes.select("sig", "class_id"), "sig").join(links, "class_id", "left").select("qa_id", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
