"""Building, reading and drawing taxonomies: votes, cycle-safe links, lines, levels, layouts, filters."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def majority(votes: DataFrame, keys: list[str], least: Column | int) -> DataFrame:
    """keys, child, parent, passed: of the parents with at least ``least`` votes the last in text order. Self-links (case aside) and "None" don't count."""
    real = votes.where((F.lower("child") != F.lower("parent")) & (F.col("child") != "None") & (F.col("parent") != "None"))
    counted = real.groupBy(*keys, "child", "parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counted.groupBy(*keys, "child").agg(F.max("parent").alias("parent"), F.count(F.lit(1)).alias("passed"))


def safe_links(answers: list[tuple[str, str]], destructive: bool = False) -> list[tuple[str, str]]:
    """(child, parent) answers taken one after the other, but for those that close a circle, repeat or reverse a link.

    ``destructive``: a child that is taken leaves its earlier parents.
    """
    up: dict[str, set[str]] = defaultdict(set)
    taken: list[tuple[str, str]] = []
    for child, parent in answers:
        if child == parent or parent in up[child] or child in up[parent]:
            continue
        seen, todo = {parent}, [parent]
        while todo:  # is the child above the parent?
            for x in up[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        if child in seen:
            continue
        if destructive:
            taken = [t for t in taken if t[0] != child]
            up[child] = set()
        up[child].add(parent)
        taken.append((child, parent))
    return taken


def insert_safely(answers: DataFrame, keys: list[str], destructive: bool = False) -> DataFrame:
    """keys, child, parent of the answers (keys, ord, child, parent) that make no circle, taken in order of ord, child, parent.

    What is taken depends on what was taken before, so a group is walked by one task, whatever its
    size: it is meant for answers on one taxonomy, not for whole edge tables.
    """
    kinds = dict(answers.dtypes)

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        got = safe_links(list(df.sort_values(["ord", "child", "parent"])[["child", "parent"]].itertuples(index=False, name=None)), destructive)
        return pd.DataFrame([(*key, *x) for x in got], columns=[*keys, "child", "parent"])

    shape = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return answers.groupBy(*keys).applyInPandas(run, f"{shape}, child string, parent string")


def built(answers: DataFrame, keys: list[str], runs: int, words: DataFrame | None = None, least: int | None = None) -> DataFrame:
    """keys, child, parent: a taxonomy from the answers of several runs over several papers (keys, ord, run, child, parent).

    In each paper (ord) the parents with most of the ``runs`` votes (or ``least``) are taken; papers follow in order. With
    ``words`` (synonym, name) both ends are put under their node's name first, unknown ones fall away.
    """
    if words is not None:
        named = answers.join(words.select(F.col("synonym").alias("child"), F.col("name").alias("_c")), "child").join(words.select(F.col("synonym").alias("parent"), F.col("name").alias("_p")), "parent")
        answers = named.where("_c <> _p").select(*keys, "ord", "run", F.col("_c").alias("child"), F.col("_p").alias("parent"))
    voted = majority(answers.select(*keys, "ord", "child", "parent"), [*keys, "ord"], least if least is not None else runs // 2 + 1)
    return insert_safely(voted, keys)


def tree_lines(links: DataFrame) -> DataFrame:
    """grp, child, parent as lines "child isA parent"."""
    return links.select("grp", F.concat("child", F.lit(" isA "), "parent").alias("line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, child, parent of the "child isA parent" lines of text files (cut at the first " isA "); pickles are never loaded."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("path")).where(F.contains("value", F.lit(" isA ")))
    return lines.select("path", F.trim(F.split("value", " isA ", 2)[0]).alias("child"), F.trim(F.split("value", " isA ", 2)[1]).alias("parent")).where((F.length("child") > 0) & (F.length("parent") > 0))


def write_links(links: DataFrame, path: str) -> None:
    """A taxonomy as a parquet table of links."""
    links.write.mode("overwrite").parquet(path)


def levels(found: DataFrame, links: DataFrame) -> DataFrame:
    """grp, depth, nodes, leaves by least depth of a node under any root; found: rows of hierarchy.depths."""
    least = found.where("depth >= 0").groupBy("grp", "node").agg(F.min("depth").alias("depth"))
    inner = links.select("grp", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(1))
    return least.join(inner, ["grp", "node"], "left").groupBy("grp", "depth").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("inner").isNull()).alias("leaves"))


def pruned(found: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """The links whose child lies at most ``most`` below a root."""
    near = found.where((F.col("depth") >= 0) & (F.col("depth") <= most)).select("grp", F.col("node").alias("child")).distinct()
    return links.join(near, ["grp", "child"], "left_semi").select("grp", "child", "parent")


def word_map(nodes: DataFrame) -> DataFrame:
    """value, id: the node that each value of a node (id, ord, values) names; of several the last by ord."""
    return nodes.select("id", "ord", F.explode("values").alias("value")).groupBy("value").agg(F.max_by("id", F.struct("ord", "id")).alias("id"))


# ------------------------------------------------------------ drawing

# ---- fixed values: sizes and steps of a drawing ----
ROOT_SIZE, CATEGORY_SIZE, SMALLEST, LARGEST, SPREAD = 32, 24, 12, 35, 23
LEAF_STEP, TOP, LEVEL_STEP, LEFT = 44, 40, 300, 30
# ---- end of fixed values ----


def node_sizes(degrees: DataFrame) -> DataFrame:
    """node, node_type, degree, size: by degree against the greatest; roots and categories have sizes of their own."""
    most = degrees.agg(F.max("degree").alias("_m"))
    scaled = SMALLEST + F.floor(F.col("degree") / F.greatest(F.lit(1), "_m") * SPREAD)
    size = F.when(F.col("node_type") == "root", ROOT_SIZE).when(F.col("node_type") == "category", CATEGORY_SIZE).otherwise(F.least(F.lit(LARGEST), F.greatest(F.lit(SMALLEST), scaled)))
    return degrees.crossJoin(F.broadcast(most)).select("node", "node_type", "degree", size.cast("int").alias("size"))  # one row


def edge_styles(edges: DataFrame) -> DataFrame:
    """edge_id, dashes, opacity, title: refined edges dashed, taxonomy ones faint."""
    taxonomy = F.col("relation") == "isA"
    title = F.concat_ws("\n", "relation", F.when(F.length("evidence_quote") > 0, F.col("evidence_quote")), F.when(F.col("confidence").isNotNull(), F.concat(F.lit("confidence "), F.round("confidence", 2).cast("string"))))
    return edges.select("edge_id", F.coalesce(F.col("source_type") == "refined", F.lit(False)).alias("dashes"), F.when(taxonomy, 0.45).otherwise(0.9).alias("opacity"), title.alias("title"))


def shown(edges: DataFrame, mode: str = "all", relations: list[str] | None = None, search: str = "") -> DataFrame:
    """Edges of a mode (all, relation, taxonomy), of some relations, whose text holds the search text (case aside)."""
    taxonomy = F.col("relation") == "isA"
    rows = edges.where(taxonomy) if mode == "taxonomy" else edges.where(~taxonomy) if mode == "relation" else edges
    if relations is not None:
        rows = rows.where(F.col("relation").isin(relations))
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "source", "relation", "target", "evidence_quote")), F.lit(search.lower()))) if search else rows


def merged_nodes(*parts: DataFrame) -> DataFrame:
    """id, label, type of several node tables: of one id the first part's, then the first in text order."""
    every = None
    for k, p in enumerate(parts):
        one = p.select("id", "label", "type", F.lit(k).alias("_part"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("id").agg(F.min_by(F.struct("label", "type"), F.struct("_part", "label", "type")).alias("x")).select("id", "x.label", "x.type")


def places(rows: list[tuple[str, str | None, int]]) -> list[tuple[str, float, float]]:
    """(id, x, y) of one tree's (id, parent, ord) rows: leaves one under the other in depth-first order, inner nodes in the middle of their children."""
    kids: dict[str | None, list[tuple[int, str]]] = defaultdict(list)
    for i, parent, order in rows:
        kids[parent].append((order, i))
    y: dict[str, float] = {}
    out: list[tuple[str, float, float]] = []
    leaves = 0
    todo = [(i, 0, False) for _, i in sorted(kids[None], reverse=True)]
    while todo:
        i, level, done = todo.pop()
        if done:
            y[i] = sum(y[k] for _, k in kids[i]) / len(kids[i])
        elif kids.get(i):
            todo.append((i, level, True))
            todo += [(k, level + 1, False) for _, k in sorted(kids[i], reverse=True)]
            continue
        else:
            y[i], leaves = float(LEAF_STEP * leaves + TOP), leaves + 1
        out.append((i, float(LEVEL_STEP * level + LEFT), y[i]))
    return out


def layout(nodes: DataFrame, tree: str = "root") -> DataFrame:
    """tree, id, x, y of trees (tree, id, parent, ord); a tree that is to be drawn fits one task."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, p if isinstance(p, str) else None, o) for i, p, o in df[["id", "parent", "ord"]].itertuples(index=False, name=None)]
        return pd.DataFrame([(key[0], *x) for x in places(rows)], columns=[tree, "id", "x", "y"])

    return nodes.groupBy(tree).applyInPandas(run, f"{tree} string, id string, x double, y double")


def for_script(json_text: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(json_text, F.lit("</"), F.lit("<\\/"))


def escaped(c: Column) -> Column:
    """Text for HTML: & < > and quotes as entities."""
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
