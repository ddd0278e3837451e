"""Queries on retrieval from the graph and on its communities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import bundles, communities, edges, hierarchy
from lodestream.plans.reference import TOKENS, _edges
from lodestream.plans.reference_sql import EDGES, LINKS, ROOTS, _bm25, _clean, _hint, _quoted, _tokens_a
from lodestream.plans.registry import Registry
from lodestream.session import checkpoint, table

query = Registry()
QUESTION = "What type of annealing raises the coercivity of strontium hexaferrite?"

_ARROW = "source || ' --' || relation || '--> ' || target"
_QUAL = "CASE WHEN json_valid(metadata) AND json_extract(metadata, '$.qualifiers') IS NOT NULL AND CAST(json_extract(metadata, '$.qualifiers') AS VARCHAR) NOT IN ('{}', 'null') THEN CAST(json_extract(metadata, '$.qualifiers') AS VARCHAR) END"
_TEXT = f"""'Relationship description. Source term: ' || source || '. Relation: ' || relation || ' (' || replace(relation, '_', ' ') || '). Target term: ' || target || '.'
    || coalesce(' Qualifiers: ' || {_QUAL} || '.', '') || CASE WHEN length(coalesce(evidence_quote, '')) > 0 THEN ' Evidence: ' || evidence_quote || '.' ELSE '' END || CASE WHEN confidence IS NULL THEN '' ELSE ' Confidence: ' || printf('%.2f', round(confidence, 2)) || '.' END"""
_TAX = "(coalesce(relation = 'isA', false) OR coalesce(source_type = 'taxonomy', false))"
_NODES = f"""ends AS (SELECT *, source AS node, 0 AS e FROM edges UNION ALL SELECT *, target AS node, 1 AS e FROM edges), real_ends AS (SELECT * FROM ends WHERE lower(node) NOT IN ({ROOTS})),
    rel AS (SELECT node, relation, count(*) AS n FROM real_ends GROUP BY ALL), rel8 AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, relation) AS k FROM rel),
    spread AS (SELECT node, string_agg(relation || '=' || n, ', ' ORDER BY k) FILTER (k <= 8) AS relations, CAST(sum(n) AS BIGINT) AS incident FROM rel8 GROUP BY node),
    shown AS (SELECT node, CASE WHEN source = node THEN '' ELSE node || ' is target of ' END || {_ARROW} AS line, row_number() OVER (PARTITION BY node ORDER BY {_hint("relation")} DESC, coalesce(confidence, 0) DESC, length({_ARROW}), lower(source), edge_id, e) AS k FROM real_ends),
    lines AS (SELECT node, string_agg(line, ' | ' ORDER BY k) AS examples FROM shown WHERE k <= 8 GROUP BY node),
    node_texts AS (SELECT node, incident, 'Term description. Term: ' || node || '. Incident relation distribution: ' || relations || '. Representative incident relationships: ' || examples || '.' AS text FROM spread JOIN lines USING (node))"""


def _distinct(spark, d):
    return edges.distinct_edges(_edges(spark, d))


_FIRST = f"""{EDGES.replace("edges AS", "all_edges AS", 1)}, edges AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY lower(source), lower(relation), lower(target), lower({_clean("evidence_quote")}), coalesce(paper_id, '')
    ORDER BY dir_ord NULLS FIRST, loader_ord NULLS FIRST, file_ord NULLS FIRST, row_ord NULLS FIRST, edge_id) AS k FROM all_edges) WHERE k = 1)"""


@query(f"WITH {EDGES} SELECT edge_id, {_TEXT} AS text, {_TAX} AS taxonomy FROM edges")
def edge_texts(spark, d):
    return _edges(spark, d).select("edge_id", bundles.edge_text().alias("text"), bundles.is_taxonomy().alias("taxonomy"))


@query(f"WITH {EDGES}, {_NODES} SELECT node, incident, text FROM node_texts")
def node_descriptions(spark, d):
    return bundles.node_texts(_edges(spark, d))


@query(f"""SELECT qa_id, asks, CASE WHEN asks THEN 40 ELSE greatest(1, CAST(round_even(40 * f, 0) AS INTEGER)) END AS quota
    FROM (SELECT qa_id, (qa_id % 10) / 16.0 AS f, list_has_any({_tokens_a("question")}, [{_quoted(bundles.TAXONOMY_HINTS)}]) OR regexp_matches(lower(coalesce(question, '')), 'what kind of|what type of|which type|which category') AS asks FROM qa_example)""")
def taxonomy_quota(spark, d):
    asks = bundles.asks_taxonomy(F.col("question"))
    rows = table(spark, d, "qa_example").select("qa_id", asks.alias("asks"), (F.col("qa_id") % 10 / 16.0).alias("f"))
    return rows.select("qa_id", "asks", bundles.taxonomy_quota(F.lit(40), F.col("f"), F.col("asks")).alias("quota"))


@query(f"""WITH RECURSIVE {_FIRST}, {_NODES}, {_bm25(TOKENS, "text", "node", "node_texts")},
    ranked AS (SELECT id AS node, round(score, 6) AS s, incident, row_number() OVER (PARTITION BY lower(id) ORDER BY round(score, 6) DESC, length(id) DESC, incident DESC, lower(id), id) AS j FROM score JOIN node_texts n ON n.node = id WHERE score > 0),
    cand AS (SELECT node, row_number() OVER (ORDER BY s DESC, length(node) DESC, incident DESC, lower(node), node) AS place FROM ranked WHERE j = 1 QUALIFY place <= 6),
    near AS (SELECT c.node, c.place, e.* FROM cand c JOIN edges e ON e.source = c.node UNION ALL SELECT c.node, c.place, e.* FROM cand c JOIN edges e ON e.target = c.node AND e.source <> c.node),
    events_of AS (SELECT DISTINCT node, place, source FROM near WHERE NOT {_TAX} AND lower(source) NOT IN ({ROOTS})),
    bundle AS (SELECT node, place, edge_id FROM near WHERE NOT {_TAX} UNION SELECT v.node, v.place, e.edge_id FROM events_of v JOIN edges e ON e.source = v.source WHERE NOT {_TAX}),
    scored AS (SELECT b.node, b.place, e.edge_id, e.source, e.target, round(3.0 * len(list_intersect(list_distinct({_tokens_a(_TEXT)}), [{_quoted(TOKENS)}])) + {_hint("relation")} + least(1.0, coalesce(confidence, 0)) + CASE WHEN source = b.node THEN 1.0 ELSE 0.8 END, 6) AS score FROM bundle b JOIN edges e USING (edge_id)),
    best AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, edge_id) AS rank FROM scored QUALIFY rank <= 12),
    links AS (SELECT source AS child, target AS parent, edge_id AS link, row_number() OVER (PARTITION BY source ORDER BY edge_id) AS k FROM edges WHERE {_TAX} QUALIFY k <= 3),
    walk AS (SELECT node, place, node AS child, 1 AS level FROM cand UNION SELECT node, place, source, 1 FROM best UNION SELECT node, place, target, 1 FROM best UNION SELECT w.node, w.place, l.parent, w.level + 1 FROM walk w JOIN links l ON l.child = w.child WHERE w.level < 3),
    met AS (SELECT w.node, w.place, w.child, l.k, l.link, min(w.level) AS level FROM walk w JOIN links l ON l.child = w.child GROUP BY ALL),
    cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY level, child, k) AS j FROM met) WHERE j <= 18),
    own AS (SELECT node, place, '' AS child, 0 AS k, edge_id AS link, 0 AS level FROM near WHERE {_TAX} AND node NOT IN (SELECT node FROM best) UNION ALL SELECT node, place, child, k, link, level FROM cut),
    once AS (SELECT *, row_number() OVER (PARTITION BY node, link ORDER BY level, child, k) AS j FROM own QUALIFY j = 1)
    SELECT node, CAST(place AS INTEGER) AS place, 'edge' AS kind, CAST(rank AS INTEGER) AS rank, edge_id, score FROM best
    UNION ALL SELECT node, CAST(place AS INTEGER), 'taxonomy', CAST(row_number() OVER (PARTITION BY node ORDER BY level, child, k, link) AS INTEGER), link, NULL FROM once""")
def node_bundle_retrieval(spark, d):
    e = checkpoint(_distinct(spark, d))
    nodes = bundles.candidate_nodes(bundles.node_texts(e), TOKENS, 6)
    return bundles.node_bundles(e, nodes, TOKENS)


@query()
def bundle_context(spark, d):
    e = checkpoint(_distinct(spark, d))
    nodes = bundles.candidate_nodes(bundles.node_texts(e), TOKENS, 6)
    rows = bundles.node_bundles(e, nodes, TOKENS).withColumn("question_id", F.lit(1))
    return bundles.bundle_context(rows, e.select("edge_id", bundles.edge_cost().alias("cost")), 6000)


@query()
def edge_retrieval(spark, d):
    return bundles.retrieve_edges(_distinct(spark, d), TOKENS, asks=False)


_FACTS = f"""facts AS (SELECT edge_id, {_ARROW} || coalesce(' qualifiers=' || {_QUAL}, '') || CASE WHEN {_clean("evidence_quote")} <> '' THEN ' evidence=' || {_clean("evidence_quote")} ELSE '' END AS fact, source_type, paper_id FROM edges),
    first_facts AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY lower(fact), source_type, coalesce(paper_id, '') ORDER BY edge_id) AS k FROM facts) WHERE k = 1)"""


@query(f"WITH {EDGES}, {_FACTS} SELECT edge_id, fact, source_type, paper_id FROM first_facts")
def fact_distinct(spark, d):
    return bundles.facts(_edges(spark, d))


@query()
def budget_facts(spark, d):
    return bundles.retrieve_facts(bundles.facts(_edges(spark, d)), QUESTION)


_STOP_B = _quoted(bundles.STOP_B)
_WORDS = "list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_.+%-]+'), lambda t: lower(t)), lambda t: length(t) > 2 AND t NOT IN (" + _STOP_B + ")))"


@query(f"WITH {EDGES}, {_FACTS} SELECT edge_id, n AS overlap FROM (SELECT edge_id, CAST(len(list_intersect({_WORDS.format('fact')}, {_WORDS.format(_quoted([QUESTION]))})) AS INTEGER) AS n FROM first_facts) WHERE n > 0")
def fact_overlap(spark, d):
    told = bundles.facts(_edges(spark, d))
    return told.select("edge_id", F.size(F.array_intersect(bundles.tokens_b(F.col("fact")), bundles.tokens_b(F.lit(QUESTION)))).alias("overlap")).where("overlap > 0")


# ------------------------------------------------------------ communities


def _labelled(spark, d):
    """Taxonomy edges of the papers with clean ends, and the connected component of each end."""
    links = checkpoint(hierarchy.kind_links(table(spark, d, "graph_edge")))
    labels = edges.components(links.select("grp", F.col("child").alias("a"), F.col("parent").alias("b"))).select(F.col("grp").alias("paper_id"), "node", F.col("component").alias("community"))
    e = _edges(spark, d).withColumns({c: hierarchy.node_name(F.col(c)) for c in ("source", "target")})
    return e, checkpoint(labels)


_COMPONENTS = f"""{LINKS}, both_ways AS (SELECT paper_id, child AS a, parent AS b FROM links UNION SELECT paper_id, parent, child FROM links),
    reach AS (SELECT paper_id, a AS node, a AS other FROM both_ways UNION SELECT r.paper_id, r.node, w.b FROM reach r JOIN both_ways w ON w.paper_id = r.paper_id AND w.a = r.other),
    labels AS (SELECT paper_id, node, min(other) AS community FROM reach GROUP BY paper_id, node), {EDGES.replace("edges AS", "raw_edges AS", 1)},
    edges AS (SELECT * REPLACE (trim(lower(source)) AS source, trim(lower(target)) AS target) FROM raw_edges),
    inner_edges AS (SELECT e.*, s.community FROM edges e JOIN labels s ON s.paper_id = e.paper_id AND s.node = e.source JOIN labels t ON t.paper_id = e.paper_id AND t.node = e.target AND t.community = s.community)"""
_WEIGHT = "CASE WHEN relation = 'isA' THEN 0.75 WHEN relation = 'DEFINED_AS' THEN 1.0 ELSE 2.0 + least(1.0, coalesce(confidence, 0.0)) END"


@query(f"""WITH RECURSIVE {_COMPONENTS} SELECT paper_id, community, edge_id, CAST(k AS INTEGER) AS rank FROM (SELECT paper_id, community, edge_id, row_number() OVER (PARTITION BY paper_id, community
    ORDER BY relation = 'isA', {_hint("relation")} DESC, coalesce(confidence, 0) DESC, relation, source, edge_id) AS k FROM inner_edges) WHERE k <= 10""")
def community_edges(spark, d):
    e, labels = _labelled(spark, d)
    return communities.ordered_edges(communities.inner_edges(e, labels, ["paper_id"]), ["paper_id", "community"], 10).select("paper_id", "community", "edge_id", "rank")


_SHORT = "CASE WHEN length({0}) > {1} THEN rtrim(substr({0}, 1, {1} - 3)) || '...' ELSE {0} END"
_REPORTS = f"""rel AS (SELECT paper_id, community, relation, count(*) AS n, sum({_WEIGHT}) AS w FROM inner_edges GROUP BY ALL), relk AS (SELECT *, row_number() OVER (PARTITION BY paper_id, community ORDER BY n DESC, relation) AS k FROM rel),
    told AS (SELECT paper_id, community, CAST(sum(n) AS BIGINT) AS edges, round(sum(w), 6) AS importance, sum(CASE WHEN relation = 'isA' THEN n ELSE 0 END) >= 0.6 * sum(n) AS taxonomy_heavy, string_agg(relation, ', ' ORDER BY k) FILTER (k <= 3) AS top_relations, string_agg(relation || '=' || n, ', ' ORDER BY k) FILTER (k <= 6) AS relations FROM relk GROUP BY ALL),
    deg AS (SELECT paper_id, community, node, count(*) AS d FROM (SELECT paper_id, community, source AS node FROM inner_edges UNION ALL SELECT paper_id, community, target FROM inner_edges) GROUP BY ALL),
    degk AS (SELECT *, row_number() OVER (PARTITION BY paper_id, community ORDER BY d DESC, node) AS k FROM deg), deg30 AS (SELECT *, row_number() OVER (PARTITION BY paper_id, community ORDER BY NOT (lower(node) NOT IN ({ROOTS}) AND length(node) > 2), k) AS j FROM degk WHERE k <= 30),
    named AS (SELECT paper_id, community, string_agg(node, '; ' ORDER BY k) FILTER (j <= 4 AND lower(node) NOT IN ({ROOTS}) AND length(node) > 2) AS title_nodes, string_agg({_SHORT.format("node", 80)}, ', ' ORDER BY k) FILTER (k <= 8) AS top_nodes FROM deg30 GROUP BY ALL),
    shown AS (SELECT paper_id, community, {_SHORT.format("(" + _ARROW + ")", 180)} AS s, row_number() OVER (PARTITION BY paper_id, community ORDER BY {_hint("relation")} DESC, coalesce(confidence, 0) DESC, length({_ARROW}), lower(source), edge_id) AS k FROM inner_edges),
    lines AS (SELECT paper_id, community, string_agg(s, ' | ' ORDER BY k) AS examples FROM shown WHERE k <= 4 GROUP BY ALL),
    sizes AS (SELECT paper_id, community, count(*) AS nodes FROM labels GROUP BY ALL),
    reports AS (SELECT z.paper_id, z.community, nodes, coalesce(edges, 0) AS edges, CASE WHEN edges IS NULL THEN 0 ELSE 1 END AS papers, coalesce(importance, 0) AS importance, coalesce(taxonomy_heavy, false) AS taxonomy_heavy, coalesce(title_nodes, 'Graph community') || ' (' || coalesce(top_relations, '') || ')' AS title,
        'This community connects ' || nodes || ' nodes through ' || coalesce(edges, 0) || ' graph edges. Representative nodes: ' || coalesce(top_nodes, '') || '. Relations: ' || coalesce(relations, '') || '. Representative edges: ' || coalesce(examples, '') || '.' AS summary
        FROM sizes z LEFT JOIN told USING (paper_id, community) LEFT JOIN named USING (paper_id, community) LEFT JOIN lines USING (paper_id, community))"""


@query(f"WITH RECURSIVE {_COMPONENTS}, {_REPORTS} SELECT paper_id, community, nodes, edges, CAST(papers AS BIGINT) AS papers, importance, taxonomy_heavy, title, summary FROM reports")
def community_reports(spark, d):
    e, labels = _labelled(spark, d)
    return communities.reports(communities.inner_edges(e, labels, ["paper_id"]), labels, ["paper_id"])


@query(f"WITH RECURSIVE {_COMPONENTS}, {_REPORTS} SELECT paper_id, community, importance, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY importance DESC, nodes DESC, lower(community), community) AS k FROM reports) WHERE k <= 5")
def community_ranking(spark, d):
    e, labels = _labelled(spark, d)
    told = communities.reports(communities.inner_edges(e, labels, ["paper_id"]), labels, ["paper_id"])
    return communities.first_communities(told, ["paper_id"], 5).select("paper_id", "community", "importance", "rank")


@query()
def community_split(spark, d):
    e, labels = _labelled(spark, d)
    inside = communities.inner_edges(e, labels, ["paper_id"]).withColumn("weight", communities.weight())
    both = inside.select("paper_id", F.col("source").alias("a"), F.col("target").alias("b"), "weight").unionByName(inside.select("paper_id", F.col("target").alias("a"), F.col("source").alias("b"), "weight"))
    return communities.split_large(both.groupBy("paper_id", "a", "b").agg(F.sum("weight").alias("weight")), labels, ["paper_id"], 20)


def _scored_reports(spark, d):
    e, labels = _labelled(spark, d)
    told = communities.reports(communities.inner_edges(e, labels, ["paper_id"]), labels, ["paper_id"])
    return told.select(F.concat_ws("|", "paper_id", "community").alias("community"), "taxonomy_heavy", F.col("importance").alias("score"))


@query(f"""WITH RECURSIVE {_COMPONENTS}, {_REPORTS}, s AS (SELECT concat_ws('|', paper_id, community) AS community, taxonomy_heavy, importance AS score FROM reports),
    k AS (SELECT *, taxonomy_heavy AND sum(CASE WHEN taxonomy_heavy THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, community) > 1 AS no FROM s)
    SELECT community, taxonomy_heavy, score FROM k WHERE NOT no ORDER BY score DESC, community LIMIT 8""")
def community_selection(spark, d):
    return communities.selected_communities(_scored_reports(spark, d), 8, asks=False)
