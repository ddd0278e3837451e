"""Queries on terms, vocabularies and taxonomies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import edges, hierarchy, taxonomy, terms
from lodestream.plans.reference import _edges, _links
from lodestream.plans.reference_sql import EDGES, LINKS, _clean, _quoted
from lodestream.plans.registry import Registry
from lodestream.session import table

query = Registry()


def _label_sql(c: str) -> str:
    s = f"replace({_strip(c)}, '**', '')"
    s = f"regexp_replace({s}, '^[`*_\\s]+|[`*_\\s]+$', '', 'g')"
    s = f"regexp_replace({s}, '^\\(?[a-zA-Z0-9]+\\)?[:.)]\\s+', '')"
    return f"trim(regexp_replace({s}, '[\\x{{09}}-\\x{{0d}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def _strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^[\\x{{09}}-\\x{{0d}}\\x{{85}}\\p{{Z}}]+|[\\x{{09}}-\\x{{0d}}\\x{{85}}\\p{{Z}}]+$', '', 'g')"


def _holds(c: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"


_FIGURE = "(?:fig(?:ure)?|table|eq(?:uation)?)\\.?\\s*\\d+[a-z]?"
_W = "\\p{L}\\p{N}_"
_UNITS = "ms|s|sec|min|h|kg|g|mg|ug|m|cm|mm|um|nm|K|C|F|Hz|kHz|MHz|GHz|Pa|bar|V|A|W|J|mol|M|mM|uM"
_LITERAL = f"(?:^|[^{_W}])(?:{_UNITS}|percent)(?:$|[^{_W}])|[{_W}]%[{_W}]"
_GOOD = f"""(length(l) > 0 AND NOT ({_holds("lower(l)", ["domain terms", "evidence terms", "table-derived", "figure-derived", "experimental settings", "numeric values", "methods /", "quantities /"])} OR lower(l) = 'paired signals'
    OR {_holds("lower(l)", [" is ", " are ", " was ", " were ", " be ", " been ", " being ", " shows ", " show ", " indicates ", " induces ", " indicate ", " suggests ", " suggest ", " causes ", " cause ", " leads to ", " related to ", " due to "])}
    OR regexp_full_match(lower(l), '{_FIGURE}') OR regexp_matches(lower(l), '\\({_FIGURE}\\)') OR regexp_full_match(lower(l), '(?:left|right|upper|lower|middle|top|bottom)(?:\\s+panel)?') OR regexp_matches(lower(l), '^(?:end of |lack of |presence of |absence of )')
    OR {_holds("lower(l)", ["arrow", "caption", "see text", " around "])} OR l[-1] IN ('.', ':') OR length(l) > 96 OR len(regexp_extract_all(l, '[A-Za-z0-9.+/%\\[\\]-]+')) > 6
    OR (len(regexp_extract_all(l, '[A-Za-z0-9.+/%\\[\\]-]+')) = 1 AND lower(l) IN ({_quoted(terms.GENERIC_WORDS)})) OR regexp_full_match(lower(l), '[-+−]?\\d+(?:\\.\\d+)?\\s*(?:k?oe|k|nm|pa|ma|kv|g/cm3|%)')))"""


def _numeric_sql(c: str) -> str:
    return f"(length({_strip(c)}) > 0 AND (regexp_full_match({_strip(c)}, '[\\d.,+\\-]+(?:\\s*(?:%|percent|{_UNITS}))?') OR length(regexp_replace({_strip(c)}, '[^0-9]', '', 'g')) >= greatest(1, length(replace({_strip(c)}, ' ', '')) // 2)))"


def _noisy_sql(c: str, longest: int) -> str:
    return f"(length({_strip(c)}) = 0 OR {_numeric_sql(c)} OR lower({_strip(c)}) IN ('none', 'not explicitly present') OR length({_strip(c)}) > {longest})"


@query(f"WITH n AS (SELECT edge_id, target, {_label_sql('target')} AS l FROM graph_edge) SELECT edge_id, l AS label, {_GOOD} AS good, {_numeric_sql('target')} AS numeric_literal, {_noisy_sql('target', 60)} AS noisy FROM n")
def ontology_node_filter(spark, d):
    t = F.col("target")
    return table(spark, d, "graph_edge").select("edge_id", terms.label(t).alias("label"), terms.good_node(terms.label(t)).alias("good"), terms.numeric_literal(t).alias("numeric_literal"), terms.noisy(t, 60).alias("noisy"))


@query(f"SELECT edge_id, regexp_matches({_strip('target')}, '\\d') OR regexp_matches({_strip('target')}, '{_LITERAL}') AS literal FROM graph_edge WHERE length({_strip('target')}) > 0 AND contains(lower(evidence_quote), lower({_strip('target')}))")
def literal_objects(spark, d):
    t = terms.strip(F.col("target"))
    e = table(spark, d, "graph_edge").where((F.length(t) > 0) & F.contains(F.lower("evidence_quote"), F.lower(t)))
    return e.select("edge_id", terms.literal_object(F.col("target"), F.col("evidence_quote")).alias("literal"))


@query(f"SELECT node_type, node_id FROM (SELECT node_type, node_id, row_number() OVER (PARTITION BY node_type, lower({_label_sql('label')}) ORDER BY node_id) AS k FROM layout_node) WHERE k = 1")
def term_distinct(spark, d):
    return terms.distinct_terms(table(spark, d, "layout_node"), ["node_type"], "label", [F.col("node_id")]).select("node_type", "node_id")


@query(f"""WITH t AS (SELECT paper_id, {_strip('target')} AS term, edge_id FROM graph_edge WHERE paper_id IS NOT NULL AND NOT {_noisy_sql('target', 40)}),
    f AS (SELECT *, row_number() OVER (PARTITION BY paper_id, lower(term) ORDER BY edge_id) AS k FROM t QUALIFY k = 1) SELECT paper_id, term, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY edge_id) AS j FROM f) WHERE j <= 90""")
def taxonomy_terms(spark, d):
    rows = table(spark, d, "graph_edge").where("paper_id is not null").select("paper_id", F.col("target").alias("term"), "edge_id")
    return terms.selected_terms(rows, ["paper_id"], "term", [F.col("edge_id")], 90, 40)


def _uid_sql(c: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(lower(replace({c}, '-', ' ')), '\\s+'), lambda w: length(w) > 0), ' ')"


_VOCABULARY = f"""acr AS (SELECT DISTINCT paper_id, source AS acronym, target AS meaning FROM graph_edge WHERE relation = 'DEFINED_AS' AND paper_id IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL),
    marks AS (SELECT paper_id, list_sort(list(DISTINCT '(' || acronym || ')')) AS marks FROM acr GROUP BY paper_id),
    t AS (SELECT DISTINCT paper_id, replace(target, '*', '') AS term FROM graph_edge WHERE relation IN ('USES_METHOD', 'MEASURES_METRIC') AND paper_id IS NOT NULL AND target IS NOT NULL),
    plain AS (SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM acr a WHERE a.paper_id = t.paper_id AND a.acronym = t.term)),
    bare AS (SELECT p.paper_id, term, list_reduce(list_prepend(term, coalesce(marks, [])), lambda s, m: CASE WHEN contains(term, m) THEN trim(replace(s, m, '')) ELSE s END) AS bare FROM plain p LEFT JOIN marks USING (paper_id)),
    spelled AS (SELECT paper_id, {_uid_sql("bare")} AS uid, unnest([term, bare, replace(bare, '-', ' ')]) AS synonym FROM bare UNION SELECT paper_id, {_uid_sql("meaning")}, unnest([acronym, meaning]) FROM acr)"""


def _vocabulary(spark, d):
    e = table(spark, d, "graph_edge").where("paper_id is not null")
    acronyms = e.where("relation = 'DEFINED_AS' and source is not null and target is not null").select("paper_id", F.col("source").alias("acronym"), F.col("target").alias("meaning")).distinct()
    words = e.where(F.col("relation").isin("USES_METHOD", "MEASURES_METRIC")).select("paper_id", F.col("target").alias("term")).distinct()
    return terms.vocabulary(words, acronyms, ["paper_id"])


@query(f"WITH {_VOCABULARY} SELECT DISTINCT paper_id, uid, synonym FROM spelled")
def acronym_strip(spark, d):
    return _vocabulary(spark, d)


@query(f"WITH {_VOCABULARY}, p AS (SELECT DISTINCT uid, synonym FROM spelled), n AS (SELECT uid, min(synonym) AS name FROM p GROUP BY uid), l AS (SELECT synonym, max(uid) AS uid, count(*) > 1 AS repeated FROM p GROUP BY synonym) SELECT synonym, l.uid, name, repeated FROM l JOIN n USING (uid)")
def vocab_synonyms(spark, d):
    return terms.synonym_nodes(_vocabulary(spark, d))


_NAMES = "names AS (SELECT DISTINCT lower(unnest(list_prepend(canon_name, coalesce(synonyms, [])))) AS t FROM canon_entity)"


def _names(spark, d):
    c = table(spark, d, "canon_entity")
    return c.select(F.explode(F.concat(F.array("canon_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("term")).where("term is not null")


@query(r"""WITH names AS (SELECT DISTINCT lower(canon_name) AS t FROM canon_entity),
    l AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])[\t-\r ]+', concat('\1', chr(1)), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0), lambda x: lower(x)) AS l FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS n FROM l),
    o AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s),
    f AS (SELECT doc_id, t, n, o, CASE WHEN instr(s, ' ' || t) > 0 THEN instr(s, ' ' || t) WHEN instr(s, t || ' ') > 0 THEN instr(s, t || ' ') - 1 WHEN instr(s, '.' || t) > 0 THEN instr(s, '.' || t) WHEN instr(s, t || '.') > 0 THEN instr(s, t || '.') - 1
        WHEN instr(s, ',' || t) > 0 THEN instr(s, ',' || t) WHEN instr(s, t || ',') > 0 THEN instr(s, t || ',') - 1 WHEN instr(s, '(' || t) > 0 THEN instr(s, '(' || t) WHEN instr(s, t || ')') > 0 THEN instr(s, t || ')') - 1 END AS p FROM o JOIN names ON contains(s, t))
    SELECT doc_id, t AS term, CAST(o + p AS BIGINT) AS start, CAST(o + p + length(t) AS BIGINT) AS "end", CAST(n AS INTEGER) AS sentence FROM f WHERE p IS NOT NULL""")
def term_occurrence(spark, d):
    return terms.occurrences(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "canon_entity").select(F.col("canon_name").alias("term")))


@query(f"WITH {_NAMES}, {EDGES} SELECT edge_id FROM edges WHERE lower(source) IN (SELECT t FROM names WHERE t IS NOT NULL) AND (lower(target) IN (SELECT t FROM names WHERE t IS NOT NULL) OR (contains(lower(evidence_quote), lower(target)) AND (regexp_matches(target, '\\d') OR regexp_matches(target, '{_LITERAL}'))))")
def known_relationships(spark, d):
    rows = _edges(spark, d).withColumns({"subject": F.col("source"), "object": F.col("target")})
    return terms.known_relationships(rows, _names(spark, d), F.col("evidence_quote")).select("edge_id")


@query(f"WITH {_NAMES} SELECT edge_id FROM graph_edge WHERE relation = 'DEFINED_AS' AND lower(source) IN (SELECT t FROM names WHERE t IS NOT NULL)")
def known_definitions(spark, d):
    rows = table(spark, d, "graph_edge").where("relation = 'DEFINED_AS'").select("edge_id", F.col("source").alias("term"))
    return terms.known_definitions(rows, _names(spark, d)).select("edge_id")


@query("""WITH p AS (SELECT paper_id, section_id, substr(content, 1, 600) AS part FROM section_record WHERE paper_id IS NOT NULL AND content IS NOT NULL),
    e AS (SELECT *, 6000 - coalesce(sum(length(part)) OVER (PARTITION BY paper_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM p) SELECT paper_id, section_id, substr(part, 1, CAST(rest AS INTEGER)) AS part FROM e WHERE rest > 0""")
def context_packing(spark, d):
    rows = table(spark, d, "section_record").where("paper_id is not null and content is not null").dropDuplicates(["section_id"])
    return terms.packed_context(rows, ["paper_id"], "section_id", "content", 600, 6000)


# ------------------------------------------------------------ taxonomies

_VOTES = f"{LINKS.replace('SELECT DISTINCT paper_id, CASE', 'SELECT paper_id, CASE', 1)}"


@query(f"""WITH {_VOTES}, c AS (SELECT paper_id, child, parent, count(*) AS n FROM links WHERE child <> parent AND child <> 'none' AND parent <> 'none' GROUP BY ALL HAVING count(*) >= 2)
    SELECT paper_id, child, max(parent) AS parent, count(*) AS passed FROM c GROUP BY paper_id, child""")
def majority_vote(spark, d):
    raw = table(spark, d, "graph_edge").select("paper_id", F.regexp_replace(F.lower("relation"), "[^a-z]", "").alias("rel"), hierarchy.node_name(F.col("source")).alias("s"), hierarchy.node_name(F.col("target")).alias("t"))
    kept = raw.where(F.col("rel").isin(*hierarchy.UP, *hierarchy.DOWN) & F.col("paper_id").isNotNull() & (F.length("s") > 0) & (F.length("t") > 0))
    up = F.col("rel").isin(*hierarchy.UP)
    votes = kept.select("paper_id", F.when(up, F.col("s")).otherwise(F.col("t")).alias("child"), F.when(up, F.col("t")).otherwise(F.col("s")).alias("parent"))
    return taxonomy.majority(votes.where("child <> 'none' and parent <> 'none'"), ["paper_id"], 2)


_WALK = f"""{LINKS},
    nodes AS (SELECT paper_id, child AS node FROM links UNION SELECT paper_id, parent FROM links), up AS (SELECT paper_id, child AS node, parent AS above FROM links UNION SELECT up.paper_id, up.node, links.parent FROM up JOIN links ON links.paper_id = up.paper_id AND links.child = up.above),
    circular AS (SELECT DISTINCT paper_id, node FROM up WHERE node = above), bad AS (SELECT paper_id, node FROM circular UNION SELECT up.paper_id, up.node FROM up JOIN circular c ON c.paper_id = up.paper_id AND c.node = up.above),
    tops AS (SELECT paper_id, node FROM nodes ANTI JOIN links ON links.paper_id = nodes.paper_id AND links.child = nodes.node),
    walk AS (SELECT paper_id, node, node AS root, 0 AS depth, [node] AS path FROM tops UNION SELECT l.paper_id, l.child, w.root, w.depth + 1, list_append(w.path, l.child) FROM walk w JOIN links l ON l.paper_id = w.paper_id AND l.parent = w.node ANTI JOIN bad b ON b.paper_id = l.paper_id AND b.node = l.child)"""


@query(f"WITH RECURSIVE {_WALK} SELECT paper_id, node, root, array_to_string(arg_min(path, (depth, path)), ' > ') AS path FROM walk GROUP BY paper_id, node, root")
def taxonomy_paths(spark, d):
    found = hierarchy.hierarchies(_links(spark, d)).where("depth >= 0")
    return found.select(F.col("grp").alias("paper_id"), "node", "root", F.array_join("path", " > ").alias("path"))


@query(f"""WITH RECURSIVE {_WALK}, least AS (SELECT paper_id, node, min(depth) AS depth FROM walk GROUP BY ALL)
    SELECT paper_id, CAST(depth AS BIGINT) AS depth, count(*) AS nodes, count(*) FILTER (NOT EXISTS (SELECT 1 FROM links l WHERE l.paper_id = least.paper_id AND l.parent = least.node)) AS leaves FROM least GROUP BY paper_id, depth""")
def taxonomy_levels(spark, d):
    links = _links(spark, d)
    return taxonomy.levels(hierarchy.depths(links), links).withColumnRenamed("grp", "paper_id")


@query(f"WITH RECURSIVE {_WALK}, least AS (SELECT paper_id, node, min(depth) AS depth FROM walk GROUP BY ALL) SELECT l.paper_id, l.child, l.parent FROM links l JOIN least n ON n.paper_id = l.paper_id AND n.node = l.child WHERE n.depth <= 2")
def taxonomy_pruned(spark, d):
    links = _links(spark, d)
    return taxonomy.pruned(hierarchy.depths(links), links, 2).withColumnRenamed("grp", "paper_id")


@query(f"WITH RECURSIVE {LINKS}, tops AS (SELECT DISTINCT paper_id, parent AS node FROM links ANTI JOIN (SELECT paper_id AS p, child AS c FROM links) k ON k.p = links.paper_id AND k.c = links.parent), down AS (SELECT paper_id, node, node AS low FROM tops UNION SELECT x.paper_id, x.node, l.child FROM down x JOIN links l ON l.paper_id = x.paper_id AND l.parent = x.low) SELECT paper_id, node, low AS below FROM down WHERE node <> low")
def taxonomy_closure(spark, d):
    found = hierarchy.hierarchies(_links(spark, d)).where("depth = 0")
    return found.select(F.col("grp").alias("paper_id"), "node", F.explode("descendants").alias("below"))


@query()
def cycle_safe_insert(spark, d):
    answers = _links(spark, d).withColumn("ord", F.lit(0))
    return taxonomy.insert_safely(answers, ["grp"]).withColumnRenamed("grp", "paper_id")


@query(f"WITH {_NAMES.replace('DISTINCT lower(', 'canon_id, (')}, v AS (SELECT t, max(canon_id) AS id FROM names WHERE t IS NOT NULL GROUP BY t) SELECT t AS value, id FROM v")
def word_map(spark, d):
    c = table(spark, d, "canon_entity")
    return taxonomy.word_map(c.select(F.col("canon_id").alias("id"), F.lit(0).alias("ord"), F.concat(F.array("canon_name"), F.coalesce("synonyms", F.array().cast("array<string>"))).alias("values"))).where("value is not null")


# ------------------------------------------------------------ drawing

_DEGREE = f"{EDGES}, deg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY node)"


@query(f"WITH {_DEGREE}, k AS (SELECT node, CASE WHEN lower(node) IN ('root', 'thing', 'entity') THEN 'root' WHEN degree >= 50 THEN 'category' ELSE 'term' END AS node_type, degree FROM deg) SELECT node, node_type, degree, CAST(CASE node_type WHEN 'root' THEN 32 WHEN 'category' THEN 24 ELSE least(35, greatest(12, 12 + floor(degree / greatest(1, max(degree) OVER ()) * 23))) END AS INTEGER) AS size FROM k")
def viz_nodes(spark, d):
    deg = edges.degrees(_edges(spark, d))
    kind = F.when(F.lower("node").isin("root", "thing", "entity"), "root").when(F.col("degree") >= 50, "category").otherwise("term")
    return taxonomy.node_sizes(deg.withColumn("node_type", kind))


@query(f"WITH {EDGES} SELECT edge_id, coalesce(source_type = 'refined', false) AS dashes, CASE WHEN relation = 'isA' THEN 0.45::DOUBLE ELSE 0.9::DOUBLE END AS opacity, relation || CASE WHEN length(coalesce(evidence_quote, '')) > 0 THEN chr(10) || evidence_quote ELSE '' END || CASE WHEN confidence IS NULL THEN '' ELSE chr(10) || 'confidence ' || round(confidence, 2) END AS title FROM edges")
def viz_edges(spark, d):
    return taxonomy.edge_styles(_edges(spark, d))


@query(f"WITH {EDGES} SELECT edge_id FROM edges WHERE relation <> 'isA' AND relation IN ('USES_METHOD', 'HAS_VALUE') AND contains(lower(concat_ws(' ', source, relation, target, evidence_quote)), 'sol-gel')")
def viz_filter(spark, d):
    return taxonomy.shown(_edges(spark, d), "relation", ["USES_METHOD", "HAS_VALUE"], "sol-gel").select("edge_id")


@query(f"WITH {EDGES}, n AS (SELECT id, label, node_type AS type, 0 AS part FROM layout_node UNION ALL SELECT source, source, 'unknown', 1 FROM edges UNION ALL SELECT target, target, 'unknown', 1 FROM edges) SELECT id, label, type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, label NULLS FIRST, type NULLS FIRST) AS k FROM n) WHERE k = 1")
def viz_merge(spark, d):
    e = _edges(spark, d)
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).select("id", F.col("id").alias("label"), F.lit("unknown").alias("type"))
    return taxonomy.merged_nodes(table(spark, d, "layout_node").select("id", "label", F.col("node_type").alias("type")), ends)


@query()
def tree_layout(spark, d):
    found = hierarchy.hierarchies(_links(spark, d)).where("depth >= 0")
    name = lambda path: F.concat_ws("|", "grp", F.array_join(path, ">"))
    parent = F.when(F.col("depth") > 0, name(F.slice("path", F.lit(1), F.col("depth").cast("int"))))
    return taxonomy.layout(found.select(name(F.col("path")).alias("id"), parent.alias("parent"), F.lit(0).alias("ord"), F.concat_ws("|", "grp", "root").alias("root")))
