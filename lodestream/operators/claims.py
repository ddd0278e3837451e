"""Relation claims: validation against a schema, caps, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import scoring, text

# ---- fixed values: names too general for an entity ----
GENERIC = ["experimental", "experiment", "experiments", "method", "methods", "measurement", "measurements", "result", "results", "discussion", "study", "sample", "samples", "analysis", "data"]
EVENT_WORDS = ["analysis", "calculation", "calculations", "characterization", "comparison", "experiment", "experiments", "measurement", "measurements", "preparation", "simulation", "study", "test", "tests"]
# ---- end of fixed values ----


def generic_name(name: Column, entity_type: Column) -> Column:
    """A name that says nothing, or an experiment named by an event word in up to three words."""
    words = F.split(F.lower(text.clean(name)), " ")
    event = (entity_type == "Experiment") & (F.size(words) <= 3) & F.arrays_overlap(words, F.array(*(F.lit(w) for w in EVENT_WORDS)))
    return F.lower(text.clean(name)).isin(GENERIC) | F.coalesce(event, F.lit(False))


def quote_in(quote: Column, content: Column) -> Column:
    """A non-empty quote stands in a text, white space and case aside."""
    q = F.lower(text.clean(quote))
    return (F.length(q) > 0) & F.contains(F.lower(text.clean(content)), q)


def validated(claims: DataFrame, schema: DataFrame, least: float = 0.65) -> DataFrame:
    """Claims with an array of reasons against each, in fixed order; an empty one means accepted.

    claims: subject, subject_type, relation, object, object_type, confidence. "*" allows any type. A type
    is known if a relation of the schema allows it; with an unknown relation no reason of domain or range is given.
    """
    named = schema.select(F.explode(F.concat(F.coalesce("domain_types", F.array().cast("array<string>")), F.coalesce("range_types", F.array().cast("array<string>")))).alias("t"))
    types = named.agg(F.collect_set("t").alias("_types"))  # as many as the schema names
    rules = schema.select(F.col("relation").alias("rule"), F.col("domain_types"), F.col("range_types"))
    joined = claims.join(F.broadcast(rules), F.col("relation") == F.col("rule"), "left").crossJoin(F.broadcast(types))  # one row
    strange = lambda c: (F.length(F.coalesce(c, F.lit(""))) == 0) | (~F.array_contains("_types", c) & ~F.array_contains("_types", "*"))
    allows = lambda types, t: F.array_contains(types, "*") | F.array_contains(types, t)
    known = F.col("rule").isNotNull()
    blank = (F.length(text.clean(F.col("subject"))) == 0) | (F.length(text.clean(F.col("object"))) == 0)
    reasons = [
        F.when(blank, "missing endpoint"),
        F.when(strange(F.col("subject_type")), "unknown subject type"),
        F.when(strange(F.col("object_type")), "unknown object type"),
        F.when(~known, "unknown relation"),
        F.when(known & ~F.coalesce(allows(F.col("domain_types"), F.col("subject_type")), F.lit(False)), "domain mismatch"),
        F.when(known & ~F.coalesce(allows(F.col("range_types"), F.col("object_type")), F.lit(False)), "range mismatch"),
        F.when(F.coalesce("confidence", F.lit(0.0)) < least, "low confidence"),
        F.when(generic_name(F.col("subject"), F.col("subject_type")) | generic_name(F.col("object"), F.col("object_type")), "generic entity"),
    ]
    return joined.withColumn("errors", F.array_compact(F.array(*reasons))).drop("rule", "domain_types", "range_types", "_types")


def capped(claims: DataFrame, group: str, most: int) -> DataFrame:
    """The first ``most`` claims of each group by relation priority, confidence and id; the rest marked rejected."""
    order = Window.partitionBy(group).orderBy(F.desc(scoring.claim_priority(F.col("relation"))), F.desc(F.coalesce("confidence", F.lit(0.0))), "edge_id")
    return claims.withColumn("accepted", F.row_number().over(order) <= most)


def merged(claims: DataFrame) -> DataFrame:
    """One claim for each triple (case ignored): the most confident, of equal ones the earliest."""
    key = [F.lower(F.col(c)).alias(f"k_{c}") for c in ("source", "relation", "target")]
    best = claims.groupBy(*key).agg(F.max_by("edge_id", F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("edge_id"))).alias("edge_id"), F.count(F.lit(1)).alias("merged"))
    return best.select("edge_id", "merged")
