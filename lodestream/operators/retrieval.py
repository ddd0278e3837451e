"""Ranking documents for a question: BM25, cosine, fusion, interleaving, greedy budgets."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import scoring, text
from lodestream.session import checkpoint, spread


def _frequency(token: str) -> Column:
    """How often a token stands in the column toks."""
    return F.size(F.filter("toks", lambda t: t == F.lit(token)))


def bm25(docs: DataFrame, id_col: str, content: Column, query: list[str]) -> DataFrame:
    """id and BM25 score of every row for the tokens of a query; texts are read once.

    Only the frequencies of the query's tokens are counted, per row with built-in functions, so
    nothing is exploded or shuffled but one row of sums a task; statistics and scores come from these
    counts. Repeated query tokens count repeatedly; an empty query scores 0 everywhere.
    """
    terms = Counter(query)
    held = spread(docs.select(F.col(id_col), content.alias("body"))).select(F.col(id_col), text.tokens_a(F.col("body")).alias("toks")).select(id_col, F.size("toks").alias("len"), *(_frequency(q).alias(f"tf{k}") for k, q in enumerate(terms)))
    held = checkpoint(held)
    sums = held.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *(F.sum((F.col(f"tf{k}") > 0).cast("int")).alias(f"df{k}") for k in range(len(terms)))).first()
    score = F.lit(0.0)
    for k, times in enumerate(terms.values()):
        score = score + times * scoring.bm25_term(F.col(f"tf{k}"), F.col("len"), sums["n"], sums[f"df{k}"] or 0, sums["mean"])
    return held.select(id_col, score.alias("score"))


def bm25_okapi(docs: DataFrame, id_col: str, content: Column, query: list[str]) -> DataFrame:
    """id and score by the Okapi variant: idf = ln(N - df + .5) - ln(df + .5), negative ones a quarter of the mean idf."""
    rows = spread(docs.select(F.col(id_col), content.alias("body"))).select(F.col(id_col), text.tokens_c(F.col("body")).alias("toks")).withColumn("toks", F.when(F.size("toks") == 0, F.array(F.lit("_empty_"))).otherwise(F.col("toks")))
    terms = Counter(query)
    held = checkpoint(rows.select(id_col, F.size("toks").alias("len"), *(_frequency(q).alias(f"tf{k}") for k, q in enumerate(terms))))
    sums = held.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *(F.sum((F.col(f"tf{k}") > 0).cast("int")).alias(f"df{k}") for k in range(len(terms)))).first()
    n, mean = sums["n"] or 0, sums["mean"] or 1.0
    df = rows.select(F.explode(F.array_distinct("toks")).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    floor = 0.25 * (df.agg(F.avg(F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0)
    score = F.lit(0.0)
    for k, times in enumerate(terms.values()):
        if held_by := sums[f"df{k}"]:
            idf = math.log(n - held_by + 0.5) - math.log(held_by + 0.5)
            tf = F.col(f"tf{k}")
            score = score + times * (floor if idf < 0 else idf) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * F.col("len") / F.lit(float(mean))))
    return held.select(id_col, score.alias("score"))


def top(scored: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The best rows by the score rounded to 6 places, equal ones by id, with their rank."""
    best = scored.select(id_col, F.round("score", 6).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def interleave(first: DataFrame, second: DataFrame, id_col: str, limit: int) -> DataFrame:
    """id, method, rank, position: two ranked lists taken in turn, an id counting where it comes first.

    Of each list only the first ``limit`` positive scores can matter.
    """

    def ranked(df: DataFrame, name: str, shift: int) -> DataFrame:
        best = top(df.where("score > 0"), id_col, limit)
        return best.select(id_col, F.lit(name).alias("method"), "rank", (2 * F.col("rank") - shift).alias("pos"))

    both = ranked(first, "bm25", 1).unionByName(ranked(second, "embedding", 0))
    one = both.groupBy(id_col).agg(F.min_by(F.struct("method", "rank"), "pos").alias("m"), F.min("pos").alias("pos"))
    return one.orderBy("pos").limit(limit).select(id_col, "m.method", "m.rank", F.row_number().over(Window.orderBy("pos")).alias("position"))


def budgeted(rows: DataFrame, group: str, cost: Column, tie: list[Column], budget: int, most: int, flag: Column | None = None, most_flagged: int = 0) -> DataFrame:
    """Rows picked greedily in each group: in the given order, skipping what doesn't fit the rest of the budget.

    Of rows of one cost the picked ones are the first: once one doesn't fit, no later one of the
    same cost does. So only the first ``most`` of each cost can matter, and the list that the fold
    walks over is bounded whatever the size of the group. The first row is picked even if it is too
    large; ``most`` rows at most are picked, of those with ``flag`` at most ``most_flagged`` (a row
    beyond is skipped for good, so the bound holds by cost and flag).
    """
    marked = rows.withColumn("_cost", cost.cast("int")).withColumn("_flag", F.lit(False) if flag is None else F.coalesce(flag, F.lit(False)))
    order = Window.partitionBy(group, "_cost", "_flag").orderBy(*tie)
    kept = marked.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    place = kept.withColumn("_ord", F.row_number().over(Window.partitionBy(group).orderBy(*tie)))
    lists = place.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_ord", "_cost", "_flag"))).alias("_list"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(0).alias("flagged"), F.array().cast("array<int>").alias("picked"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] < most) & ((acc["n"] == 0) | (acc["used"] + x["_cost"] <= budget)) & (~x["_flag"] | (acc["flagged"] < most_flagged))
        grown = F.struct((acc["used"] + x["_cost"]).alias("used"), (acc["n"] + 1).alias("n"), (acc["flagged"] + x["_flag"].cast("int")).alias("flagged"), F.concat(acc["picked"], F.array(x["_ord"])).alias("picked"))
        return F.when(fits, grown).otherwise(acc)

    picked = lists.select(group, F.explode(F.aggregate("_list", start, step)["picked"]).alias("_ord"))
    return place.join(picked, [group, "_ord"], "left_semi").drop("_k", "_ord", "_cost", "_flag")
