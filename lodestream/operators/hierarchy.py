"""Parent-child links to full hierarchies by peeling, with circles reported.

Leaves are peeled bottom-up: a node whose children are all peeled sends the number of its
descendants and their list to its parents. In reverse peel order every node then takes its path,
depth and roots from its parents. What peeling leaves over holds the circles: a node on a circle,
or one that reaches a circle going up, gets no root.

A hierarchy of bounded size (``local_edges``, counted before) is peeled inside one task. In a larger
one the runs of nodes with one parent are peeled first, all at once: each node's pointer up is doubled
until it stands at a root or at a node of several parents, so that a chain takes rounds by the
logarithm of its length; a pointer that never gets there is on a circle or below one. What is left,
nodes of several parents, is settled in a task or in rounds of joins. Both give the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.session import checkpoint

# ---- fixed values: spellings of "is a kind of", letters only ----
UP = ["isa", "isan", "isakindof", "isatypeof", "isasubclassof", "iskindof", "kindof", "akindof", "typeof", "atypeof", "subclassof", "subclass", "rdfssubclassof", "subtypeof", "subkindof", "issubclassof", "issubtypeof", "childof", "hasparent", "hassuperclass", "hypernym", "hashypernym", "broader", "hasbroader", "skosbroader", "narrowerthan", "specializationof", "specialisationof", "instanceof"]
DOWN = ["parentof", "isparentof", "superclassof", "issuperclassof", "hassubclass", "hassubtype", "haschild", "haskind", "hastype", "supertypeof", "issupertypeof", "hyponym", "hashyponym", "narrower", "hasnarrower", "skosnarrower", "broaderthan", "generalizationof", "generalisationof"]
# ---- end of fixed values ----


def node_name(c: Column) -> Column:
    """Lower case, stripped, every run of Unicode white space (no-break and separators too) as one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")))


def kind_links(edges: DataFrame) -> DataFrame:
    """Distinct (group, child, parent) of the taxonomy edges; relation spelling and direction undone.

    Edges with a null or blank end or a null paper_id are left out; other columns don't matter.
    """
    letters = F.regexp_replace(F.lower("relation"), "[^a-z]", "")
    named = edges.select("paper_id", letters.alias("rel"), node_name(F.col("source")).alias("s"), node_name(F.col("target")).alias("t"))
    kept = named.where(F.col("rel").isin(*UP, *DOWN) & F.col("paper_id").isNotNull() & (F.length("s") > 0) & (F.length("t") > 0))
    up = F.col("rel").isin(*UP)
    return kept.select(F.col("paper_id").alias("grp"), F.when(up, F.col("s")).otherwise(F.col("t")).alias("child"), F.when(up, F.col("t")).otherwise(F.col("s")).alias("parent")).distinct()


def peel(links: Iterable[tuple[str, str]]) -> tuple[list[str], set[str], dict[str, set[str]], dict[str, set[str]]]:
    """Bottom-up leaf peeling of (child, parent) links: (peel order, residual nodes, parents, children)."""
    parents: dict[str, set[str]] = defaultdict(set)
    children: dict[str, set[str]] = defaultdict(set)
    nodes: dict[str, None] = {}
    for c, p in links:
        parents[c].add(p)
        children[p].add(c)
        nodes[c] = nodes[p] = None
    waiting = {n: len(children[n]) for n in nodes}
    order = sorted(n for n in nodes if not waiting[n])
    for n in order:
        for p in sorted(parents[n]):
            waiting[p] -= 1
            if not waiting[p]:
                order.append(p)
    return order, set(nodes) - set(order), parents, children


def hierarchy_rows(links: Iterable[tuple[str, str]], descendants: bool = True) -> list[tuple]:
    """(node, root, depth, path, n_descendants, descendants) of one hierarchy, given as (child, parent) links.

    One row for each node and each root it reaches, with the fewest links and the path of fewest
    links (of equal ones the first in text order) from the root to the node. A node that lies on a
    circle or reaches one going up has one row, with root "" and depth -1. ``descendants`` lists
    all nodes below, in text order; for residual nodes it is found by walking down.
    """
    order, residual, parents, children = peel(links)
    below: dict[str, set[str]] = {}
    if descendants:
        for n in order:  # children come first
            below[n] = set().union(*({c} | below[c] for c in children[n])) if children[n] else set()
        for n in residual:
            seen, todo = set(), list(children[n])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [x2 for x2 in children[x] if x2 not in seen]
            below[n] = seen
    # Residual nodes above a circle are still to be told from those on it or below it.
    waiting = {n: len(parents[n]) for n in residual}
    top = sorted(n for n in residual if not waiting[n])
    for n in top:
        for c in sorted(children[n]):
            if c in residual:
                waiting[c] -= 1
                if not waiting[c]:
                    top.append(c)
    circular = residual - set(top)
    roots: dict[str, dict[str, tuple[int, tuple[str, ...]]]] = {}
    out: list[tuple] = []
    for n in [*top, *reversed(order)]:
        if any(p in circular for p in parents[n]):
            circular.add(n)
            continue
        best: dict[str, tuple[int, tuple[str, ...]]] = {} if parents[n] else {n: (0, (n,))}
        for p in parents[n]:
            for r, (d, path) in roots[p].items():
                new = (d + 1, (*path, n))
                if r not in best or new < best[r]:
                    best[r] = new
        roots[n] = best
    for n, found in roots.items():
        out += [(n, r, d, list(path), len(below.get(n, ())), sorted(below.get(n, ()))) for r, (d, path) in found.items()]
    out += [(n, "", -1, [n], len(below.get(n, ())), sorted(below.get(n, ()))) for n in circular]
    return out


_ROWS = "grp string, node string, root string, depth bigint, path array<string>, n_descendants bigint, descendants array<string>"
_DEPTHS = "grp string, node string, root string, depth bigint"


def _local(links: DataFrame, full: bool) -> DataFrame:
    """Whole hierarchies of bounded size, one task each."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        rows = hierarchy_rows(zip(df["child"], df["parent"], strict=True), descendants=full)
        if full:
            return pd.DataFrame([(key[0], *r) for r in rows], columns=["grp", "node", "root", "depth", "path", "n_descendants", "descendants"])
        return pd.DataFrame([(key[0], *r[:3]) for r in rows], columns=["grp", "node", "root", "depth"])

    return links.groupBy("grp").applyInPandas(run, _ROWS if full else _DEPTHS)


def _finish(rows: pd.DataFrame) -> list[tuple[str, str, int]]:
    """(node, root, depth) of the nodes still waiting: links (kind 0: child, parent, length) and settled parents (kind 1: node, root, depth)."""
    seeds: dict[str, dict[str, int]] = defaultdict(dict)
    parents: dict[str, dict[str, int]] = defaultdict(dict)
    children: dict[str, set[str]] = defaultdict(set)
    for kind, a, b, d in rows[["kind", "a", "b", "depth"]].itertuples(index=False, name=None):
        if kind:
            seeds[a][b] = int(d)
        else:
            parents[a][b] = min(int(d), parents[a].get(b, int(d)))
            children[b].add(a)
    waiting = {n: sum(p not in seeds for p in ps) for n, ps in parents.items()}
    ready = sorted(n for n, k in waiting.items() if not k)
    out = []
    for n in ready:
        best: dict[str, int] = {}
        for p, length in parents[n].items():
            for r, d in seeds[p].items():
                best[r] = min(best.get(r, d + length), d + length)
        seeds[n] = best
        out += [(n, r, d) for r, d in best.items()]
        for c in sorted(children[n]):
            waiting[c] -= 1
            if not waiting[c]:
                ready.append(c)
    return out + [(n, "", -1) for n, k in waiting.items() if k]


def chain_heads(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, node, head, d: how far above a node of one parent the next root or node of several parents stands; grp, node of those that reach none).

    Pointers are doubled; a round joins only those that have not arrived.
    """
    one = links.groupBy("grp", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("up")).where("n = 1")
    on_way = checkpoint(one.select("grp", "node", "up", F.lit(1).cast("bigint").alias("d")))
    arrived = on_way.limit(0).select("grp", "node", F.col("up").alias("head"), "d")
    for _ in range(max(1, on_way.count()).bit_length() + 1):
        # where the pointers ahead lead: on, if they are on the way, to their head, if they have arrived, else up is a head
        ahead = on_way.select("grp", F.col("node").alias("up"), F.col("up").alias("next"), F.col("d").alias("more"), F.lit(False).alias("there"))
        ahead = ahead.unionByName(arrived.select("grp", F.col("node").alias("up"), F.col("head").alias("next"), F.col("d").alias("more"), F.lit(True).alias("there")))
        step = on_way.join(ahead, ["grp", "up"], "left").withColumn("there", F.coalesce("there", F.lit(True)))
        step = checkpoint(step.select("grp", "node", F.coalesce("next", "up").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), "there"))
        arrived = checkpoint(arrived.unionByName(step.where("there").select("grp", "node", F.col("up").alias("head"), "d")))
        on_way = step.where("not there").drop("there")
        if on_way.isEmpty():
            break
    return arrived, on_way.select("grp", "node")


def large_depths(links: DataFrame, local_edges: int = 100_000, max_rounds: int = 1000) -> DataFrame:
    """(grp, node, root, depth) of hierarchies too large for one task.

    Chains are peeled by ``chain_heads``. Of the nodes of several parents a round settles those whose
    parents are all settled, by a join on (grp, node) over which a hot group spreads. When no group
    has more than ``local_edges`` links waiting, tasks finish them; with circles only, no round
    settles a node and the rest is circular. If ``max_rounds`` don't suffice an error is raised.
    """
    links = checkpoint(links)
    count = links.groupBy("grp", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    top = links.select("grp", F.col("parent").alias("node")).distinct().join(count, ["grp", "node"], "left_anti")
    heads, round_about = chain_heads(links)
    circle = F.lit(-1).cast("bigint").alias("depth")
    settled = checkpoint(top.select("grp", "node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth")))
    several = links.join(count.where("n > 1").select("grp", F.col("node").alias("child")), ["grp", "child"], "left_semi")
    # links of the nodes of several parents, from head to head; a parent on a circle settles never
    joined = several.join(heads.withColumnRenamed("node", "parent"), ["grp", "parent"], "left")
    joined = joined.select("grp", "child", F.coalesce("head", "parent").alias("parent"), (F.coalesce("d", F.lit(0)) + 1).cast("bigint").alias("length"))
    links = checkpoint(joined.groupBy("grp", "child", "parent").agg(F.min("length").alias("length")))
    front, pending = settled, links  # pending: links whose parent isn't settled
    for _ in range(max_rounds):
        most = pending.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
        if most <= local_edges or front.isEmpty():
            break
        names = front.select("grp", F.col("node").alias("parent")).distinct()
        still = checkpoint(pending.join(names, ["grp", "parent"], "left_anti"))
        freed = pending.select("grp", "child").distinct().join(still.select("grp", "child").distinct(), ["grp", "child"], "left_anti")
        moved = freed.join(links, ["grp", "child"]).join(settled.withColumnRenamed("node", "parent"), ["grp", "parent"])
        front = checkpoint(moved.groupBy("grp", F.col("child").alias("node"), "root").agg(F.min(F.col("depth") + F.col("length")).alias("depth")))
        settled = checkpoint(settled.unionByName(front))
        pending = still
    else:
        raise RuntimeError(f"hierarchies of over {local_edges} links did not settle in {max_rounds} rounds")
    waiting = pending.select("grp", "child").distinct()
    if most > local_edges:  # only circles and what hangs on them
        stops = settled.unionByName(waiting.select("grp", F.col("child").alias("node"), F.lit("").alias("root"), circle))
    else:
        rest = links.join(waiting, ["grp", "child"], "left_semi")
        ends = rest.select("grp", F.col("parent").alias("node")).distinct()
        seeds = settled.join(ends, ["grp", "node"], "left_semi").select("grp", F.lit(1).alias("kind"), F.col("node").alias("a"), F.col("root").alias("b"), "depth")
        rows = rest.select("grp", F.lit(0).alias("kind"), F.col("child").alias("a"), F.col("parent").alias("b"), F.col("length").alias("depth")).unionByName(seeds)

        def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(key[0], *r) for r in _finish(df)], columns=["grp", "node", "root", "depth"])

        stops = settled.unionByName(rows.groupBy("grp").applyInPandas(run, _DEPTHS))
    stops = checkpoint(stops)
    above = F.when(F.col("root") == "", -1).otherwise(F.col("depth") + F.col("d")).cast("bigint")
    chained = heads.join(stops.withColumnRenamed("node", "head"), ["grp", "head"]).select("grp", "node", "root", above.alias("depth"))
    return stops.unionByName(chained).unionByName(round_about.select("grp", "node", F.lit("").alias("root"), circle))


def _parted(links: DataFrame, local_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """(links of the groups that one task can hold, links of the others; None where there are none)."""
    links = checkpoint(links.select("grp", "child", "parent").distinct())
    big = links.groupBy("grp").count().where(F.col("count") > local_edges).select("grp")
    if big.isEmpty():
        return links, None
    big = checkpoint(big)
    return links.join(big, "grp", "left_anti"), links.join(big, "grp", "left_semi")


def depths(links: DataFrame, local_edges: int = 100_000) -> DataFrame:
    """(grp, node, root, depth) of all hierarchies in (grp, child, parent) links.

    Groups of up to ``local_edges`` links are peeled whole in a task, larger ones by ``large_depths``;
    an empty table gives an empty result, repeated links count once.
    """
    small, large = _parted(links, local_edges)
    found = _local(small, full=False)
    return found if large is None else found.unionByName(large_depths(large, local_edges))


def large_hierarchies(links: DataFrame, local_edges: int = 100_000) -> DataFrame:
    """The rows of ``hierarchies`` for groups too large for one task.

    Paths are made layer by layer from the depths, descendants by doubling the reach of each node;
    a task holds the list of a node, never that of a group. Both lists are as long as they are asked
    to be: a chain of n nodes has n²/2 descendants.
    """
    links = checkpoint(links)
    found = checkpoint(large_depths(links, local_edges))
    layer = found.where("depth <= 0").select("grp", "node", "root", "depth", F.array("node").alias("path"))
    rows, k = layer, 0
    while not layer.isEmpty():
        k += 1
        below = found.where(F.col("depth") == k).join(links.withColumnRenamed("child", "node"), ["grp", "node"])
        layer = below.join(layer.where("depth >= 0").select("grp", F.col("node").alias("parent"), "root", "path"), ["grp", "parent", "root"])
        layer = checkpoint(layer.groupBy("grp", "node", "root", "depth").agg(F.min("path").alias("path")).withColumn("path", F.concat("path", F.array("node"))))
        rows = rows.unionByName(layer)
    reach, before = checkpoint(links.select("grp", F.col("parent").alias("up"), F.col("child").alias("low"))), -1
    while (n := reach.count()) != before:
        before = n
        further = reach.withColumnRenamed("low", "mid").join(reach.withColumnRenamed("up", "mid"), ["grp", "mid"]).select("grp", "up", "low")
        reach = checkpoint(reach.union(further).distinct())
    lists = reach.groupBy("grp", F.col("up").alias("node")).agg(F.array_sort(F.collect_list("low")).alias("descendants"))
    full = rows.join(lists, ["grp", "node"], "left").withColumn("descendants", F.coalesce("descendants", F.array().cast("array<string>")))
    return full.select("grp", "node", "root", "depth", "path", F.size("descendants").cast("bigint").alias("n_descendants"), "descendants")


def hierarchies(links: DataFrame, local_edges: int = 100_000) -> DataFrame:
    """Paths, depths, roots and descendant lists of all hierarchies (grp, node, root, depth, path, n_descendants, descendants)."""
    small, large = _parted(links, local_edges)
    found = _local(small, full=True)
    return found if large is None else found.unionByName(large_hierarchies(large, local_edges))
