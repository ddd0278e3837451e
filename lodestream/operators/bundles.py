"""Retrieval from a graph: texts of edges and nodes, edges and node bundles for a question, context budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import scoring, text
from lodestream.operators import retrieval
from lodestream.session import checkpoint

# ---- fixed values: words that ask for a taxonomy, formats of texts, bounds ----
TAXONOMY_HINTS = ["category", "categories", "class", "classification", "classify", "concept", "conceptual", "definition", "defined", "hierarchy", "isa", "ontology", "taxonomic", "taxonomy", "type", "types"]
TAXONOMY_PHRASES = ["what kind of", "what type of", "which type", "which category"]
EDGE_TEXT = ("Relationship description. Source term: ", ". Relation: ", " (", "). Target term: ", ".", " Qualifiers: ", " Evidence: ", " Confidence: ")
NODE_TEXT = ("Term description. Term: ", ". Incident relation distribution: ", ". Representative incident relationships: ", " is target of ")
ARROW = (" --", "--> ")
NODE_OVERHEAD, EDGE_OVERHEAD = 160, 40
STOP_B = ["the", "a", "an", "and", "or", "of", "in", "to", "for", "with", "what", "which", "how", "is", "are", "was", "were", "their", "paper"]
# ---- end of fixed values ----


def is_taxonomy(relation: str = "relation", source_type: str = "source_type") -> Column:
    """An edge of a taxonomy, by its relation or its source; nulls are none."""
    return F.coalesce(F.col(relation) == "isA", F.lit(False)) | F.coalesce(F.col(source_type) == "taxonomy", F.lit(False))


def asks_taxonomy(question: Column) -> Column:
    """A question that asks for a kind or class: by one of its tokens or by a phrase. Null asks for nothing."""
    q = F.lower(F.coalesce(question, F.lit("")))
    phrase = F.lit(False)
    for p in TAXONOMY_PHRASES:
        phrase = phrase | F.contains(q, F.lit(p))
    return F.arrays_overlap(text.tokens_a(question), F.array(*(F.lit(h) for h in TAXONOMY_HINTS))) | phrase


def taxonomy_quota(top: Column, fraction: Column, asks: Column) -> Column:
    """How many taxonomy edges a selection of ``top`` may hold: all if the question asks for them, else a share (halves to even), one at least."""
    share = F.bround(top * F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction))).cast("int")
    return F.when(asks, F.greatest(F.lit(0), top)).otherwise(F.greatest(F.lit(1), share))


def statement(relation: str = "relation") -> Column:
    """source --relation--> target."""
    return F.concat("source", F.lit(ARROW[0]), relation, F.lit(ARROW[1]), "target")


def qualifiers() -> Column:
    """The qualifiers of an edge as a JSON text, null where its metadata has none."""
    q = F.get_json_object("metadata", "$.qualifiers")
    return F.when(q.startswith("{") & (q != "{}"), q)


def edge_text() -> Column:
    """The description of an edge by which it is searched."""
    t = [F.lit(x) for x in EDGE_TEXT]
    quote = F.when(F.length("evidence_quote") > 0, F.concat(t[6], "evidence_quote", F.lit(".")))
    sure = F.when(F.col("confidence").isNotNull(), F.concat(t[7], F.format_string("%.2f", F.round("confidence", 2)), F.lit(".")))
    return F.concat(t[0], "source", t[1], "relation", t[2], F.replace("relation", F.lit("_"), F.lit(" ")), t[3], "target", t[4], F.coalesce(F.concat(t[5], qualifiers(), F.lit(".")), F.lit("")), F.coalesce(quote, F.lit("")), F.coalesce(sure, F.lit("")))


def edge_line() -> Column:
    """The line of an edge in a context: statement, qualifiers, quote and where it is from."""
    file = F.element_at(F.split(F.coalesce("source_path", F.lit("")), "/"), -1)
    origin = F.concat_ws("; ", F.concat(F.lit("source_type="), F.coalesce("source_type", F.lit(""))), F.concat(F.lit("source="), file), F.when(F.length("paper_id") > 0, F.concat(F.lit("paper="), "paper_id")))
    quote = F.when(F.length("evidence_quote") > 0, F.concat(F.lit(' evidence="'), F.replace("evidence_quote", F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(statement(), F.coalesce(F.concat(F.lit(" qualifiers="), qualifiers()), F.lit("")), F.coalesce(quote, F.lit("")), F.lit(" ("), origin, F.lit(")"))


def edge_cost() -> Column:
    """Characters that an edge is reckoned to take in a context."""
    file = F.element_at(F.split(F.coalesce("source_path", F.lit("")), "/"), -1)
    return F.length(edge_line()) + F.length(F.coalesce("paper_id", F.lit(""))) + F.length(file) + EDGE_OVERHEAD


def _ends(edges: DataFrame) -> DataFrame:
    """node and edge of both ends of every edge, roots left out; a self-loop counts twice."""
    both = edges.select("*", F.posexplode(F.array("source", "target")).alias("end", "node"))
    return both.where(~F.lower("node").isin(scoring.ROOTS))


def node_texts(edges: DataFrame, relations: int = 8, examples: int = 8) -> DataFrame:
    """node, incident, text: the description of every node by which it is searched.

    Its relations by count (of equal ones by name), then its edges by hint, confidence, length,
    source and id. Ranks are cut inside the window, so a hot node is never gathered.
    """
    ends = _ends(edges)
    counts = ends.groupBy("node", "relation").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "relation"))).where(F.col("k") <= relations)
    spread = first.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat("relation", F.lit("="), "n").alias("s")))), lambda x: x["s"]), ", ").alias("relations"))
    order = [F.desc(scoring.relation_hint(F.col("relation"))), F.desc(F.coalesce("confidence", F.lit(0.0))), F.length(statement()), F.lower("source"), "edge_id", "end"]
    shown = ends.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("k") <= examples)
    line = F.when(F.col("source") == F.col("node"), statement()).otherwise(F.concat("node", F.lit(NODE_TEXT[3]), statement()))
    lines = shown.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("s")))), lambda x: x["s"]), " | ").alias("examples"))
    total = counts.groupBy("node").agg(F.sum("n").alias("incident"))
    told = F.concat(F.lit(NODE_TEXT[0]), "node", F.lit(NODE_TEXT[1]), "relations", F.lit(NODE_TEXT[2]), "examples", F.lit("."))
    return total.join(spread, "node").join(lines, "node").select("node", "incident", told.alias("text"))


def candidate_nodes(texts: DataFrame, query: list[str], most: int, vectors: DataFrame | None = None) -> DataFrame:
    """node, method, score, place: nodes for the tokens of a question.

    By BM25 over their texts, taken in turn with a second ranking ``vectors`` (node, score) if
    given; a name that differs in case only counts where it comes first. If nothing scores above 0,
    the nodes with most edges. Each list is cut before it is joined: of a list only the first rows
    of as many different names can matter.
    """
    texts = checkpoint(texts)

    def ranked(df: DataFrame, name: str, order: list, shift: int) -> DataFrame:
        named = df.where("score > 0").withColumn("key", F.lower("node"))
        kept = named.withColumn("j", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("j = 1")
        best = kept.orderBy(*order).limit(most)
        return best.select("node", "key", F.lit(name).alias("method"), "score", (2 * F.row_number().over(Window.orderBy(*order)) - shift).alias("pos"))

    scores = retrieval.bm25(texts, "node", F.col("text"), query).withColumn("score", F.round("score", 6))
    lists = ranked(scores.join(texts.select("node", "incident"), "node"), "bm25", [F.desc("score"), F.desc(F.length("node")), F.desc("incident"), F.lower("node"), "node"], 1)
    if vectors is not None:
        lists = lists.unionByName(ranked(vectors, "embedding", [F.desc("score"), "node"], 0))
    one = lists.withColumn("j", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).where("j = 1").orderBy("pos").limit(most)
    found = checkpoint(one.select("node", "method", "score", F.row_number().over(Window.orderBy("pos")).alias("place")))
    if found.isEmpty():
        top = texts.orderBy(F.desc("incident"), "node").limit(most)
        return top.select("node", F.lit("degree_fallback").alias("method"), F.col("incident").cast("double").alias("score"), F.row_number().over(Window.orderBy(F.desc("incident"), "node")).alias("place"))
    return found


def node_bundles(edges: DataFrame, nodes: DataFrame, query: list[str], most_edges: int = 12, depth: int = 3, most_taxonomy: int = 18) -> DataFrame:
    """node, place, kind, rank, edge_id, score: the bundle of each of some nodes (node, place).

    kind ``edge``: its edges that are no taxonomy, with the other edges of their sources, the best
    ``most_edges`` by shared tokens, relation, confidence and position; kind ``taxonomy``: links met going
    up from the node and the ends of its first 12 edges, ``depth`` steps, three a child, level by
    level. A node without edges shows its own taxonomy links first. Nodes with nothing have no row.
    """
    nodes = nodes.select("node", "place")
    tax = is_taxonomy()
    at_source = edges.join(F.broadcast(nodes.withColumn("source", F.col("node"))), "source")
    at_target = edges.join(F.broadcast(nodes.withColumn("target", F.col("node"))), "target").where(F.col("source") != F.col("node"))
    near = at_source.unionByName(at_target)
    events = near.where(~tax & ~F.lower("source").isin(scoring.ROOTS)).select("node", "place", "source").distinct()
    more = edges.where(~tax).join(events, "source")
    bundle = near.where(~tax).unionByName(more.select(near.columns)).dropDuplicates(["node", "edge_id"])
    words = F.array_distinct(text.tokens_a(edge_text()))
    overlap = F.size(F.array_intersect(words, F.array(*(F.lit(q) for q in query)))) if query else F.lit(0)
    score = 3.0 * overlap + scoring.relation_hint(F.col("relation")) + F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))) + F.when(F.col("source") == F.col("node"), 1.0).otherwise(0.8)
    scored = bundle.withColumn("score", F.round(score, 6))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "edge_id"))).where(F.col("rank") <= most_edges)
    best = best.select("node", "place", "rank", "edge_id", "score", "source", "target")
    links = edges.where(tax).withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("edge_id"))).where("k <= 3").select(F.col("source").alias("child"), F.col("target").alias("parent"), "k", F.col("edge_id").alias("link"))
    front = nodes.select("node", "place", F.col("node").alias("child")).unionByName(best.where("rank <= 12").select("node", "place", F.explode(F.array("source", "target")).alias("child"))).distinct()
    steps = None
    for level in range(1, depth + 1):
        step = front.join(links, "child").select("node", "place", "child", "parent", "k", "link", F.lit(level).alias("level"))
        steps = step if steps is None else steps.unionByName(step)
        front = step.select("node", "place", F.col("parent").alias("child")).distinct()
    met = steps.groupBy("node", "place", "child", "k", "link").agg(F.min("level").alias("level")) if steps is not None else None
    own = near.where(tax).join(best.select("node").distinct(), "node", "left_anti").select("node", "place", F.lit("").alias("child"), F.lit(0).alias("k"), F.col("edge_id").alias("link"), F.lit(0).alias("level"))
    if met is not None:
        cut = met.withColumn("j", F.row_number().over(Window.partitionBy("node").orderBy("level", "child", "k"))).where(F.col("j") <= most_taxonomy)
        own = own.unionByName(cut.select(own.columns))
    once = own.withColumn("j", F.row_number().over(Window.partitionBy("node", "link").orderBy("level", "child", "k"))).where("j = 1")
    above = once.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("level", "child", "k", "link")))
    return best.select("node", "place", F.lit("edge").alias("kind"), "rank", "edge_id", "score").unionByName(above.select("node", "place", F.lit("taxonomy").alias("kind"), "rank", F.col("link").alias("edge_id"), F.lit(None).cast("double").alias("score")))


def bundle_context(bundles: DataFrame, costs: DataFrame, budget: int, question: str = "question_id") -> DataFrame:
    """question, node, kind, edge_id, position: the rows of a question's bundles that fit a context, bundle by bundle.

    An edge already shown is skipped, and so is one that doesn't fit the rest of the budget unless
    nothing is shown yet. Bundles hold a bounded number of rows a question, so one task takes a question whole.
    """
    rows = bundles.join(costs.select("edge_id", F.col("cost").cast("bigint").alias("cost")), "edge_id")

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        shown: set[int] = set()
        used = 0
        for _, part in df.sort_values(["place", "kind", "rank"]).groupby("place", sort=True):
            spent, before = NODE_OVERHEAD + len(part["node"].iloc[0]), len(out)
            for node, kind, edge, cost in part[["node", "kind", "edge_id", "cost"]].itertuples(index=False, name=None):
                if edge in shown or (used + spent + cost > budget and out):
                    continue
                shown.add(edge)
                out.append((key[0], node, kind, edge, len(out) + 1))
                spent += cost
            if len(out) > before:
                used += spent
        return pd.DataFrame(out, columns=[question, "node", "kind", "edge_id", "position"])

    kind = dict(rows.dtypes)[question]
    return rows.groupBy(question).applyInPandas(run, f"{question} {kind}, node string, kind string, edge_id bigint, position int")


def widened(bundles: DataFrame, answer, start: int = 2, step: int = 2, most: int = 6, question: str = "question_id") -> DataFrame:
    """question, rounds, shown, answer: each question is answered with its first bundles, then with more while that isn't enough.

    ``answer`` maps (question, place, ...) rows to (question, answer); an answer that ``insufficient``
    tells is asked again with ``step`` bundles more, up to ``most``. A round touches only open questions.
    """
    open_questions, done, rounds, shown = bundles.select(question).distinct(), None, 0, start
    while True:
        rounds += 1
        got = answer(bundles.where(F.col("place") <= shown).join(open_questions, question, "left_semi"))
        got = got.select(question, F.lit(rounds).alias("rounds"), F.lit(shown).alias("shown"), "answer")
        last = shown >= most
        closed = got if last else got.where(~insufficient(F.col("answer")))
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        open_questions = got.where(insufficient(F.col("answer"))).select(question)
        shown = min(most, shown + step)


def insufficient(answer: Column) -> Column:
    """An answer that says that the context is not enough."""
    return F.coalesce(F.trim(answer) == "[INSUFFICIENT_CONTEXT]", F.lit(False))


def retrieve_edges(edges: DataFrame, query: list[str], top: int = 40, budget: int = 12_000, fraction: float = 0.18, asks: bool = False) -> DataFrame:
    """edge_id, score: the best edges for the tokens of a question that fit a context, taxonomy edges up to their quota."""
    scored = retrieval.bm25(edges.select("edge_id", edge_text().alias("body")), "edge_id", F.col("body"), query).where("score > 0")
    rows = edges.select("edge_id", edge_cost().alias("cost"), is_taxonomy().alias("tax")).join(scored.withColumn("score", F.round("score", 6)), "edge_id").withColumn("all", F.lit(0))
    quota = top if asks else max(1, round(top * min(1.0, max(0.0, fraction))))
    kept = retrieval.budgeted(rows, "all", F.col("cost"), [F.desc("score"), F.col("edge_id")], budget, top, F.col("tax"), quota)
    return kept.select("edge_id", "score")


# ------------------------------------------------------------ facts as plain texts


def tokens_b(c: Column) -> Column:
    """The different lower-case tokens of over two characters that are no stop words of facts."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(text.TOKEN_A), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(STOP_B)))


def facts(edges: DataFrame) -> DataFrame:
    """edge_id, fact, source_type, paper_id: one text a statement, with qualifiers and evidence; first wins of equal ones (case aside)."""
    evidence = text.clean(F.col("evidence_quote"))
    told = F.concat(statement(), F.coalesce(F.concat(F.lit(" qualifiers="), qualifiers()), F.lit("")), F.when(F.length(evidence) > 0, F.concat(F.lit(" evidence="), evidence)).otherwise(""))
    rows = edges.select("edge_id", told.alias("fact"), "source_type", "paper_id")
    first = rows.groupBy(F.lower("fact").alias("f"), "source_type", F.coalesce("paper_id", F.lit("")).alias("p")).agg(F.min("edge_id").alias("edge_id"))
    return rows.join(first.select("edge_id"), "edge_id", "left_semi")


def retrieve_facts(told: DataFrame, question: str, top: int = 40, budget: int = 12_000) -> DataFrame:
    """edge_id, overlap: the facts that share most tokens with a question, greedily within a budget of characters."""
    asked = tokens_b(F.lit(question))
    rows = told.select("edge_id", F.length("fact").alias("cost"), F.size(F.array_intersect(tokens_b(F.col("fact")), asked)).alias("overlap"), F.lit(0).alias("all")).where("overlap > 0")
    return retrieval.budgeted(rows, "all", F.col("cost"), [F.desc("overlap"), F.col("edge_id")], budget, top).select("edge_id", "overlap")

