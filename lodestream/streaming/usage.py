"""Streaming twins of the batch operators on usage records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import usage

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Usage records of the JSON files that arrive in a folder."""
    return usage.usage(spark.readStream.schema(SCHEMA).json(folder))


def tumbling(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Tumbling windows; a record later than ``late`` behind the newest is dropped."""
    return usage.per_window(stream.withWatermark("ts", late), width)


def sliding(stream: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    return usage.per_window(stream.withWatermark("ts", late), width, slide)


def by_session(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Records of each model in sessions divided by gaps."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "model").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "model", "n")


def first_of_each(stream: DataFrame, key: str, late: str) -> DataFrame:
    """The first record of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
