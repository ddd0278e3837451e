"""Usage records: priced by model prefix, rolled up, windowed in time, cut at a stop rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_of(model: Column, prices: list[tuple[str, float, float]]) -> tuple[Column, Column]:
    """Rates in and out: of the exact name, else of the first name that is a prefix, else 0."""
    rate_in, rate_out = F.lit(0.0), F.lit(0.0)
    for name, a, b in reversed(prices):
        rate_in, rate_out = F.when(model.startswith(name), F.lit(a)).otherwise(rate_in), F.when(model.startswith(name), F.lit(b)).otherwise(rate_out)
    for name, a, b in prices:
        rate_in, rate_out = F.when(model == name, F.lit(a)).otherwise(rate_in), F.when(model == name, F.lit(b)).otherwise(rate_out)
    return rate_in, rate_out


def usage(events: DataFrame) -> DataFrame:
    """Events as usage records: model, prompt and completion tokens, time."""
    done = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.coalesce(F.floor("value"), F.lit(0)).cast("bigint").alias("prompt"), done.alias("completion"))


def cost(rows: DataFrame, prices: list[tuple[str, float, float]]) -> DataFrame:
    """Records, tokens and cost by model and over all (null model)."""
    rate_in, rate_out = price_of(F.col("model"), prices)
    priced = rows.withColumn("cost", (F.col("prompt") * rate_in + F.col("completion") * rate_out) / 1e6)
    return priced.rollup("model").agg(F.count(F.lit(1)).alias("records"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.round(F.sum("cost"), 6).alias("cost"))


def per_window(rows: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Records and tokens by model in tumbling (or sliding) windows; runs on a batch and on a stream alike."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "model").agg(F.count(F.lit(1)).alias("records"), F.sum("prompt").alias("prompt")).select(F.col("w.start").alias("start"), "model", "records", "prompt")


def sessions(rows: DataFrame, key: str, gap_seconds: int, block_seconds: int = 86_400) -> DataFrame:
    """key, start, n of runs of records no further apart than the gap.

    A key is cut into blocks of time, so that a hot one spreads: runs are found in each block, then
    those that touch the ends of blocks are joined. Only one row a run meets in the second window.
    """
    cut = rows.withColumn("_b", F.floor(F.col("ts").cast("double") / block_seconds))
    order = Window.partitionBy(key, "_b").orderBy("ts", "event_id")
    fresh = cut.withColumn("_new", F.when(F.col("ts").cast("double") - F.lag("ts").over(order).cast("double") <= gap_seconds, 0).otherwise(1)).withColumn("_s", F.sum("_new").over(order))
    runs = fresh.groupBy(key, "_b", "_s").agg(F.min("ts").alias("start"), F.max("ts").alias("_end"), F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy(key).orderBy("start")
    joined = runs.withColumn("_new", F.when(F.col("start").cast("double") - F.lag("_end").over(along).cast("double") <= gap_seconds, 0).otherwise(1)).withColumn("_t", F.sum("_new").over(along))
    return joined.groupBy(key, "_t").agg(F.min("start").alias("start"), F.sum("n").alias("n")).drop("_t")


def until_stop(rows: DataFrame, group: str, good: Column, most: int, pool: int, target: int) -> DataFrame:
    """Rows of each group in order, up to the first at which ``most`` rows, or ``pool`` rows with ``target`` good ones, are reached."""
    order = Window.partitionBy(group).orderBy("event_id")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("n", F.count(F.lit(1)).over(run)).withColumn("v", F.sum(good.cast("int")).over(run))
    stop = (F.col("n") >= most) | ((F.col("n") >= pool) & (F.col("v") >= target))
    before = counted.withColumn("stops", F.coalesce(F.sum(stop.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return before.where("stops = 0").drop("stops")
