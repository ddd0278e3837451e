"""Communities of a graph: their edges, splitting of large ones, reports and selection."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import scoring, text
from lodestream.operators import bundles


def inner_edges(edges: DataFrame, labels: DataFrame, keys: list[str], node: str = "node", community: str = "community") -> DataFrame:
    """The edges with both ends in one community (of one group, by ``keys``), with its name."""
    one = edges.join(labels.select(*keys, F.col(node).alias("source"), F.col(community).alias("_c")), [*keys, "source"])
    both = one.join(labels.select(*keys, F.col(node).alias("target"), F.col(community).alias("_d")), [*keys, "target"])
    return both.where(F.col("_c") == F.col("_d")).withColumnRenamed("_c", community).drop("_d")


def ordered_edges(inner: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first edges of each community: taxonomy last, then hint, confidence, relation, source and id, with their rank."""
    order = [F.col("relation") == "isA", F.desc(scoring.relation_hint(F.col("relation"))), F.desc(F.coalesce("confidence", F.lit(0.0))), F.col("relation"), F.col("source"), F.col("edge_id")]
    return inner.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def weight() -> Column:
    """What an edge counts in a community."""
    return F.when(F.col("relation") == "isA", 0.75).when(F.col("relation") == "DEFINED_AS", 1.0).otherwise(2.0 + F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))


def split_community(links: list[tuple[str, str, float]], nodes: list[str], most: int) -> dict[str, str]:
    """Node -> first node of its part: parts of at most ``most`` nodes, each grown breadth first from the strongest node left.

    Neighbours are taken by weight, then name; of equally strong nodes the one of most neighbours,
    then of the last name, begins a part.
    """
    if len(nodes) <= most:
        return dict.fromkeys(nodes, min(nodes)) if nodes else {}
    known = set(nodes)
    table = pd.DataFrame([x for x in links if x[0] in known and x[1] in known], columns=["a", "b", "w"]).groupby(["a", "b"], as_index=False, sort=False)["w"].sum()
    # the neighbours of a node in the order in which they are taken
    table = table.assign(low=table["b"].str.lower()).sort_values(["w", "low", "b"], ascending=[False, True, True], kind="stable")
    near: dict[str, list[tuple[str, float]]] = {a: list(zip(g["b"], g["w"], strict=True)) for a, g in table.groupby("a", sort=False)}
    free = set(nodes)
    strength = {n: math.fsum(w for _, w in near.get(n, ())) for n in nodes}
    part: dict[str, str] = {}
    while free:
        seed = max(free, key=lambda n: (strength[n], len(near.get(n, ())), n.lower(), n))
        line = [seed]  # nodes in the order in which they come up; all before ``at`` are taken
        met = {seed}
        at = 0
        while at < min(len(line), most):
            n = line[at]
            at += 1
            free.discard(n)
            part[n] = seed
            room = max(1, 2 * most - len(line))
            fresh = [m for m, _ in near.get(n, ()) if m in free and m not in met][:room]
            line += fresh
            met.update(fresh)
        for n in line[:at]:  # who is left loses a neighbour
            for m, _ in near.get(n, ()):
                if m in free:
                    strength[m] = math.fsum(w for k, w in near[m] if k in free)
    return part


def split_large(links: DataFrame, labels: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, node, community, part: communities of over ``most`` nodes in parts; links: keys, a, b, weight in both directions.

    The order of the growth makes the parts, so a community that is too large is held by one task; others are not touched.
    """
    size = labels.groupBy(*keys, "community").agg(F.count(F.lit(1)).alias("_n"))
    sized = labels.join(size, [*keys, "community"])
    small = sized.where(F.col("_n") <= most).select(*keys, "node", "community", F.col("community").alias("part"))
    large = sized.where(F.col("_n") > most).select(*keys, "node", "community")
    inside = links.join(large.withColumnRenamed("node", "a"), [*keys, "a"]).join(large.select(*keys, F.col("node").alias("b"), F.col("community").alias("_d")), [*keys, "b"]).where(F.col("community") == F.col("_d"))
    alone = large.select(*keys, "community", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("weight"))
    rows = inside.select(*keys, "community", "a", "b", "weight").unionByName(alone)
    kinds = dict(labels.dtypes)

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        real = df[df["b"].notna()]
        got = split_community(list(real[["a", "b", "weight"]].itertuples(index=False, name=None)), sorted(df["a"].unique()), most)
        return pd.DataFrame([(*key[:-1], n, key[-1], p) for n, p in got.items()], columns=[*keys, "node", "community", "part"])

    shape = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", node string, community string, part string"
    return small.unionByName(rows.groupBy(*keys, "community").applyInPandas(run, shape))


def reports(inner: DataFrame, labels: DataFrame, keys: list[str], examples: int = 4) -> DataFrame:
    """One row for each community: nodes, edges, papers, importance, taxonomy_heavy, title and summary.

    importance is the weight of its edges (a self-loop counts twice in both directions, so once here);
    title and summary name its nodes by degree and its relations by count, equal ones by name.
    Communities without an edge have a row with their nodes.
    """
    by = [*keys, "community"]
    counts = inner.groupBy(*by, "relation").agg(F.count(F.lit(1)).alias("n"), F.sum(weight()).alias("w"))
    rel = Window.partitionBy(*by).orderBy(F.desc("n"), "relation")
    told = counts.withColumn("k", F.row_number().over(rel)).groupBy(*by).agg(
        F.sum("n").alias("edges"), F.round(F.sum("w"), 6).alias("importance"), (F.sum(F.when(F.col("relation") == "isA", F.col("n")).otherwise(0)) >= 0.6 * F.sum("n")).alias("taxonomy_heavy"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "relation")))), lambda x: x["relation"]), ", ").alias("top_relations"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 6, F.struct("k", F.concat("relation", F.lit("="), "n").alias("s"))))), lambda x: x["s"]), ", ").alias("relations"),
    )
    degree = inner.select(*by, F.explode(F.array("source", "target")).alias("node")).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("d"))
    ranked = degree.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("d"), "node"))).where("k <= 30")
    named = ranked.withColumn("ok", ~F.lower("node").isin(scoring.ROOTS) & (F.length("node") > 2)).groupBy(*by).agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("k", "node")))), lambda x: x["node"]), 1, 4).alias("title_nodes"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: text.truncate(x["node"], 80)), 1, 8).alias("top_nodes"),
    )
    order = [F.desc(scoring.relation_hint(F.col("relation"))), F.desc(F.coalesce("confidence", F.lit(0.0))), F.length(bundles.statement()), F.lower("source"), F.col("edge_id")]
    shown = inner.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("k") <= examples)
    lines = shown.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.truncate(bundles.statement(), 180).alias("s")))), lambda x: x["s"]), " | ").alias("examples"))
    papers = inner.groupBy(*by).agg(F.countDistinct("paper_id").alias("papers"))
    nodes = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"))
    full = nodes.join(told, by, "left").join(named, by, "left").join(lines, by, "left").join(papers, by, "left")
    label = F.coalesce("top_relations", F.lit(""))
    title = F.concat(F.when(F.size(F.coalesce("title_nodes", F.array().cast("array<string>"))) > 0, F.array_join("title_nodes", "; ")).otherwise("Graph community"), F.lit(" ("), label, F.lit(")"))
    edges = F.coalesce("edges", F.lit(0))
    summary = F.concat(
        F.lit("This community connects "), "nodes", F.lit(" nodes through "), edges, F.lit(" graph edges. Representative nodes: "), F.coalesce(F.array_join("top_nodes", ", "), F.lit("")),
        F.lit(". Relations: "), F.coalesce("relations", F.lit("")), F.lit(". Representative edges: "), F.coalesce("examples", F.lit("")), F.lit("."),
    )
    return full.select(*by, "nodes", edges.alias("edges"), F.coalesce("papers", F.lit(0)).alias("papers"), F.coalesce("importance", F.lit(0.0)).alias("importance"), F.coalesce("taxonomy_heavy", F.lit(False)).alias("taxonomy_heavy"), title.alias("title"), summary.alias("summary"))


def first_communities(reported: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` communities of each group by importance, size and name, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("importance"), F.desc("nodes"), F.lower("community"), "community")
    return reported.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def selected_communities(scored: DataFrame, most: int, asks: bool, most_taxonomy: int = 1) -> DataFrame:
    """The communities shown for a question, by score: of taxonomy-heavy ones at most ``most_taxonomy`` unless it asks for them; the best if none is left."""
    order = Window.orderBy(F.desc("score"), "community")
    heavy = F.sum(F.col("taxonomy_heavy").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # of each kind only the first ``most`` can matter: cut them before the rows meet in one window
    cut = scored.where("taxonomy_heavy").orderBy(F.desc("score"), "community").limit(max(1, most)).unionByName(scored.where("not taxonomy_heavy").orderBy(F.desc("score"), "community").limit(max(1, most)))
    allowed = F.lit(True) if asks else ~F.col("taxonomy_heavy") | (heavy <= max(0, most_taxonomy))
    kept = cut.withColumn("_all", F.row_number().over(order)).withColumn("_ok", allowed)
    ranked = kept.withColumn("_n", F.sum(F.col("_ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_any", F.max("_ok").over(Window.partitionBy(F.lit(0))))
    return ranked.where((F.col("_ok") & (F.col("_n") <= most)) | (~F.col("_any") & (F.col("_all") == 1))).drop("_all", "_ok", "_n", "_any")
