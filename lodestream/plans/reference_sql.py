"""SQL for DuckDB of the queries in plans.reference."""

from __future__ import annotations

from lodestream.functions import scoring, text

WS = r"[\x{09}-\x{0d}\x{85}\p{Z}]+"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '{WS}', ' ', 'g'))"


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _tokens_a(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '{text.TOKEN_A}'), lambda t: lower(t)), lambda t: length(t) > 2 AND t NOT IN ({_quoted(text.STOP_A)}))"


def _tokens_c(c: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({c}, ''), '{text.TOKEN_C}'), lambda t: replace(lower(t), 'ß', 'ss'))"


def _hint(c: str) -> str:
    out = "CASE"
    for name, x in scoring.HINTS.items():
        out += f" WHEN {c} = '{name}' THEN {x}"
    for words, x in scoring.HINT_FAMILIES:
        out += " WHEN " + " OR ".join(f"contains(upper({c}), '{w}')" for w in words) + f" THEN {x}"
    return out + " ELSE 1.0 END"


def _title(c: str) -> str:
    s = _clean(c)
    s = f"regexp_replace({s}, '^#+\\s*', '')"
    s = f"regexp_replace({s}, '\\\\(?:sub)*section\\*?\\{{(.+?)\\}}', '\\1', 'g')"
    s = f"regexp_replace({s}, '^\\d+(?:\\.\\d+)*\\.?\\s+', '')"
    s = f"regexp_replace({s}, '(?i)^[IVXLC]+\\.\\s+', '')"
    return f"lower(regexp_replace({s}, '[:.\\-]+$', ''))"


def _label(t: str) -> str:
    out = f"CASE WHEN length({t}) = 0 THEN 'other'"
    for label, names in text.SECTION_TITLES.items():
        out += f" WHEN {t} IN ({_quoted(names)}) THEN '{label}'"
    for label, names in text.SECTION_TITLES.items():
        out += " WHEN " + " OR ".join(f"starts_with({t}, '{n} ') OR starts_with({t}, '{n}:')" for n in names) + f" THEN '{label}'"
    out += " WHEN " + " OR ".join(f"starts_with({t}, '{n}')" for n in text.NOISE_TITLES) + " THEN 'other'"
    for label, words in (("methods", text.METHOD_WORDS), ("results", text.RESULT_WORDS)):
        out += " WHEN " + " OR ".join(f"contains({t}, '{w}')" for w in words) + f" THEN '{label}'"
    return out + " ELSE 'other' END"


EDGES = f"""edges AS (SELECT * FROM (SELECT edge_id, {_clean("source")} AS source, {_clean("relation")} AS relation, {_clean("target")} AS target, source_type, paper_id, evidence_quote, confidence, metadata,
    dir_ord, loader_ord, file_ord, row_ord FROM graph_edge) WHERE source <> '' AND relation <> '' AND target <> '')"""
ROOTS = _quoted(scoring.ROOTS)
LINKS = rf"""letters AS (SELECT paper_id, regexp_replace(lower(relation), '[^a-z]', '', 'g') AS rel,
        trim(lower(regexp_replace(source, '[\x{{09}}-\x{{0d}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'))) AS s, trim(lower(regexp_replace(target, '[\x{{09}}-\x{{0d}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'))) AS t FROM graph_edge),
    links AS (SELECT DISTINCT paper_id, CASE WHEN rel IN ('parentof', 'superclassof', 'hassubclass') THEN t ELSE s END AS child, CASE WHEN rel IN ('parentof', 'superclassof', 'hassubclass') THEN s ELSE t END AS parent
        FROM letters WHERE rel IN ('isa', 'subclassof', 'rdfssubclassof', 'kindof', 'parentof', 'superclassof', 'hassubclass') AND paper_id IS NOT NULL AND s <> '' AND t <> '')"""


def _bm25(query: list[str], body: str, ident: str, source: str) -> str:
    """CTEs toks, score(id, score)."""
    values = ", ".join(f"('{q}')" for q in query)
    return f"""toks AS (SELECT {ident} AS id, {_tokens_a(body)} AS toks FROM {source}),
        stats AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM toks),
        query AS (SELECT q, count(*) AS times FROM (VALUES {values}) v(q) GROUP BY q),
        tf AS (SELECT id, len(toks) AS len, q, times, len(list_filter(toks, lambda t: t = q)) AS tf FROM toks, query),
        df AS (SELECT q, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY q),
        score AS (SELECT id, sum(CASE WHEN tf > 0 THEN times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)) ELSE 0 END) AS score FROM tf JOIN df USING (q), stats GROUP BY id)"""


def _ranked(source: str, ident: str) -> str:
    return f"SELECT id AS {ident}, s AS score, CAST(row_number() OVER (ORDER BY s DESC, id) AS INTEGER) AS rank FROM (SELECT id, round(score, 6) AS s FROM {source}) ORDER BY s DESC, id LIMIT 20"


COSINE = """cosine AS (SELECT e.vec_id AS id, coalesce(list_dot_product(CAST(e.embedding AS DOUBLE[]), q.v) / nullif(sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(q.v, q.v)), 0), 0) AS score
        FROM embeddings e, (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) q)"""


def _scaled_a(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () <= 0 THEN 0 WHEN max({c}) OVER () - min({c}) OVER () < 1e-9 THEN CASE WHEN {c} > 0 THEN 1 ELSE 0 END ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


def _scaled_b(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-9 THEN CASE WHEN max({c}) OVER () > 0 THEN 1 ELSE 0 END ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


def oracle_sql() -> dict[str, str]:
    from lodestream.plans.reference import PHRASES, PRICES, SEEDS, TOKENS

    seeds = _quoted(SEEDS)
    title = _title("heading")
    closed = f"CASE WHEN regexp_matches({_clean('heading')}, '^(?:\\p{{L}} )+\\p{{L}}$') THEN replace({_clean('heading')}, ' ', '') ELSE {_clean('heading')} END"
    closed_title = _title("closed")
    priority = "CASE " + " ".join(f"WHEN relation = '{k}' THEN {v}" for k, v in scoring.CLAIM_PRIORITY.items()) + " ELSE 0 END"
    rate_in = "CASE " + " ".join(f"WHEN model = '{n}' THEN {a}" for n, a, _ in PRICES) + " " + " ".join(f"WHEN starts_with(model, '{n}') THEN {a}" for n, a, _ in PRICES) + " ELSE 0 END"
    rate_out = "CASE " + " ".join(f"WHEN model = '{n}' THEN {b}" for n, _, b in PRICES) + " " + " ".join(f"WHEN starts_with(model, '{n}') THEN {b}" for n, _, b in PRICES) + " ELSE 0 END"
    usage = "usage AS (SELECT event_id, ts, event_type AS model, CAST(coalesce(floor(value), 0) AS BIGINT) AS prompt, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS completion FROM events)"
    phrases = " + ".join(f"CASE WHEN contains(lower(coalesce(title, '')), '{p}') THEN 2.0 WHEN contains(lower(coalesce(abstract, '')), '{p}') THEN 1.0 ELSE 0.0 END" for p in PHRASES)
    query_list = "[" + _quoted(TOKENS) + "]"
    weight = "CASE WHEN relation = 'isA' THEN 0.75 WHEN relation = 'DEFINED_AS' THEN 1.0 ELSE 2.0 + least(1.0, coalesce(confidence, 0.0)) END"
    generic = "'experimental', 'experiment', 'experiments', 'method', 'methods', 'measurement', 'measurements', 'result', 'results', 'discussion', 'study', 'sample', 'samples', 'analysis', 'data'"
    event_words = "['analysis', 'calculation', 'calculations', 'characterization', 'comparison', 'experiment', 'experiments', 'measurement', 'measurements', 'preparation', 'simulation', 'study', 'test', 'tests']"
    is_generic = lambda n, t: f"(lower({n}) IN ({generic}) OR ({t} = 'Experiment' AND len(string_split(lower({n}), ' ')) <= 3 AND list_has_any(string_split(lower({n}), ' '), {event_words})))"
    return {
        "bm25_topk": f"WITH {_bm25(TOKENS, 'text', 'doc_id', 'documents')} {_ranked('score', 'doc_id')}",
        "bm25okapi_topk": f"""WITH base AS (SELECT cand_id AS id, {_tokens_c("concat_ws(' ', title, abstract)")} AS w FROM candidate_paper),
            toks AS (SELECT id, CASE WHEN len(w) = 0 THEN ['_empty_'] ELSE w END AS w FROM base),
            stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks),
            df AS (SELECT tok, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS tok FROM toks) GROUP BY tok),
            idf AS (SELECT tok, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, stats),
            low AS (SELECT 0.25 * avg(idf) AS low FROM idf),
            query AS (SELECT q, count(*) AS times FROM (VALUES {", ".join(f"('{q}')" for q in TOKENS)}) v(q) GROUP BY q),
            score AS (SELECT id, sum(coalesce(times * CASE WHEN idf < 0 THEN low ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)), 0)) AS score
                FROM (SELECT id, len(w) AS len, q, times, len(list_filter(w, lambda t: t = q)) AS tf FROM toks, query) x LEFT JOIN idf ON tok = q, low, stats GROUP BY id)
            {_ranked("score", "cand_id")}""",
        "cosine_topk": f"WITH {COSINE} {_ranked('cosine', 'vec_id')}",
        "hybrid_fusion": f"""WITH {_bm25(TOKENS, "text", "doc_id", "documents")}, {COSINE},
            both_scores AS (SELECT s.id, round(s.score, 6) AS b, round(c.score, 6) AS c FROM score s JOIN cosine c ON s.id = c.id),
            fused AS (SELECT id, 8.0 * (0.4 * {_scaled_a("b")} + 0.6 * {_scaled_a("c")}) AS score FROM both_scores) {_ranked("fused", "doc_id")}""",
        "rank_interleave": f"""WITH {_bm25(TOKENS, "text", "doc_id", "documents")}, {COSINE},
            lists AS (SELECT id, 'bm25' AS method, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank, 1 AS shift FROM score WHERE score > 0
                UNION ALL SELECT id, 'embedding', row_number() OVER (ORDER BY round(score, 6) DESC, id), 0 FROM cosine WHERE score > 0),
            placed AS (SELECT id, method, rank, 2 * rank - shift AS pos, row_number() OVER (PARTITION BY id ORDER BY 2 * rank - shift) AS k FROM lists WHERE rank <= 20)
            SELECT id AS doc_id, method, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS position FROM placed WHERE k = 1 ORDER BY pos LIMIT 20""",
        "edge_distinct": f"""WITH {EDGES} SELECT edge_id FROM (SELECT edge_id, row_number() OVER (PARTITION BY lower(source), lower(relation), lower(target), lower({_clean("evidence_quote")}), coalesce(paper_id, '')
            ORDER BY dir_ord NULLS FIRST, loader_ord NULLS FIRST, file_ord NULLS FIRST, row_ord NULLS FIRST, edge_id) AS k FROM edges) WHERE k = 1""",
        "graph_fingerprint": f"""WITH {EDGES} SELECT paper_id, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', lower(source), lower(relation), lower(target), lower({_clean("evidence_quote")}), coalesce(paper_id, ''))), 1, 12) AS BIGINT)) AS BIGINT) AS digest FROM edges GROUP BY paper_id""",
        "node_degree": f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY node",
        "node_catalog": f"""WITH {EDGES}, counted AS (SELECT node, relation, count(*) AS n FROM (SELECT source AS node, relation FROM edges UNION ALL SELECT target, relation FROM edges) WHERE lower(node) NOT IN ({ROOTS}) GROUP BY ALL)
            SELECT node, CAST(sum(n) AS BIGINT) AS incident, count(*) AS relations, arg_max(relation, (n, relation)) AS main_relation FROM counted GROUP BY node""",
        "edge_weights": f"""WITH {EDGES}, kept AS (SELECT source, target, {weight} AS w FROM edges WHERE lower(source) NOT IN ({ROOTS}) AND lower(target) NOT IN ({ROOTS}))
            SELECT a, b, round(sum(w), 6) AS weight FROM (SELECT source AS a, target AS b, w FROM kept UNION ALL SELECT target, source, w FROM kept) GROUP BY a, b""",
        "representative_edges": f"""WITH {EDGES} SELECT paper_id, edge_id, CAST(k AS INTEGER) AS rank FROM (SELECT paper_id, edge_id, row_number() OVER (PARTITION BY paper_id
            ORDER BY {_hint("relation")} DESC, coalesce(confidence, 0) DESC, length(concat_ws(' ', source, relation, target)), lower(source), edge_id) AS k FROM edges WHERE paper_id IS NOT NULL) WHERE k <= 3""",
        "node_incident": f"WITH {EDGES} SELECT source AS node, edge_id FROM edges WHERE source IN ({seeds}) UNION ALL SELECT target, edge_id FROM edges WHERE target IN ({seeds}) AND source <> target",
        "bundle_edges": f"""WITH {EDGES}, near AS (SELECT source AS node, * FROM edges WHERE source IN ({seeds}) UNION ALL SELECT target AS node, * FROM edges WHERE target IN ({seeds}) AND source <> target),
            events_of AS (SELECT DISTINCT node, source FROM near WHERE NOT (relation = 'isA' OR source_type = 'taxonomy') AND lower(source) NOT IN ({ROOTS})),
            bundle AS (SELECT DISTINCT node, edge_id FROM near UNION SELECT v.node, e.edge_id FROM events_of v JOIN edges e ON e.source = v.source WHERE NOT (e.relation = 'isA' OR e.source_type = 'taxonomy')),
            scored AS (SELECT b.node, e.edge_id, round(3.0 * len(list_intersect(list_distinct({_tokens_a("concat_ws(' ', source, relation, target, coalesce(evidence_quote, ''))")}), {query_list})) + {_hint("relation")} + least(1.0, coalesce(confidence, 0)) + CASE WHEN source = b.node THEN 1.0 WHEN target = b.node THEN 0.8 ELSE 0 END, 6) AS score FROM bundle b JOIN edges e USING (edge_id))
            SELECT node, edge_id, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, edge_id) AS k FROM scored) WHERE k <= 12""",
        "relation_histograms": f"WITH {EDGES} SELECT relation, source_type, count(*) AS n, CAST(grouping(relation, source_type) AS BIGINT) AS gid FROM edges GROUP BY GROUPING SETS ((relation), (source_type), ())",
        "paper_relation_counts": f"WITH {EDGES} SELECT paper_id, count(*) FILTER (relation = 'USES_MATERIAL') AS uses_material, count(*) FILTER (relation = 'HAS_VALUE') AS has_value, count(*) FILTER (relation = 'isA') AS isa, round(avg(CASE WHEN relation = 'isA' THEN 1.0 ELSE 0.0 END), 6) AS taxonomy_share FROM edges WHERE paper_id IS NOT NULL GROUP BY paper_id",
        "viz_topn": f"""WITH {EDGES}, best AS (SELECT node FROM (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY node) ORDER BY degree DESC, node LIMIT 50)
            SELECT edge_id, source, target FROM edges WHERE source IN (SELECT node FROM best) AND target IN (SELECT node FROM best)""",
        "connected_components": f"""WITH RECURSIVE {LINKS}, both_ways AS (SELECT paper_id, child AS a, parent AS b FROM links UNION SELECT paper_id, parent, child FROM links),
            reach AS (SELECT paper_id, a AS node, a AS other FROM both_ways UNION SELECT r.paper_id, r.node, w.b FROM reach r JOIN both_ways w ON w.paper_id = r.paper_id AND w.a = r.other)
            SELECT paper_id, node, min(other) AS component FROM reach GROUP BY paper_id, node""",
        "taxonomy_ancestors": f"""WITH RECURSIVE {LINKS}, first_parents AS (SELECT * FROM (SELECT paper_id, child, parent, row_number() OVER (PARTITION BY paper_id, child ORDER BY parent) AS k FROM links) WHERE k <= 3),
            leaves AS (SELECT DISTINCT paper_id, child AS node FROM links l WHERE NOT EXISTS (SELECT 1 FROM links m WHERE m.paper_id = l.paper_id AND m.parent = l.child)),
            walk AS (SELECT l.paper_id, l.node AS seed, f.child, f.parent, 1 AS level FROM leaves l JOIN first_parents f ON f.paper_id = l.paper_id AND f.child = l.node
                UNION SELECT w.paper_id, w.seed, f.child, f.parent, w.level + 1 FROM walk w JOIN first_parents f ON f.paper_id = w.paper_id AND f.child = w.parent WHERE w.level < 3)
            SELECT paper_id, seed, child, parent, CAST(min(level) AS INTEGER) AS level FROM walk GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY paper_id, seed, child, parent"),
        "transitive_reduction": f"""WITH RECURSIVE {LINKS}, up AS (SELECT paper_id, child AS node, parent AS above FROM links UNION SELECT u.paper_id, u.node, l.parent FROM up u JOIN links l ON l.paper_id = u.paper_id AND l.child = u.above)
            SELECT paper_id, child, parent FROM links l WHERE NOT EXISTS (SELECT 1 FROM links s JOIN up u ON u.paper_id = s.paper_id AND u.node = s.parent AND u.above = l.parent WHERE s.paper_id = l.paper_id AND s.child = l.child AND s.parent <> l.parent)""",
        "tree_frontier": """WITH RECURSIVE kids AS (SELECT id AS node, unnest(children) AS child FROM layout_node),
            walk AS (SELECT id AS root, id AS node, 0 AS hops FROM layout_node WHERE node_type = 'root' UNION SELECT w.root, k.child, w.hops + 1 FROM walk w JOIN kids k ON k.node = w.node WHERE w.hops < 3)
            SELECT root, node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY root, node""",
        "tree_levels": "SELECT level, node_type, count(*) AS nodes, count(*) FILTER (len(children) = 0) AS leaves, round(avg(y), 4) AS mean_y FROM layout_node GROUP BY level, node_type",
        "section_labels": f"""WITH t AS (SELECT section_id, {title} AS t, {closed} AS closed FROM section_record), u AS (SELECT section_id, t, {closed_title} AS c FROM t)
            SELECT section_id, {_label("t")} AS label, nullif({_label("c")}, 'other') AS heading_label FROM u""",
        "section_inherited": f"""WITH t AS (SELECT section_id, paper_id, start_line, {title} AS t, nullif(regexp_extract({_clean("heading")}, '^(\\d+)(?:\\.\\d+)*\\.?\\s+', 1), '') AS root FROM section_record),
            u AS (SELECT *, {_label("t")} AS label FROM t),
            v AS (SELECT *, last_value(CASE WHEN label <> 'other' AND root IS NOT NULL THEN {{'r': root, 'l': label}} END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY start_line NULLS FIRST, section_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM u)
            SELECT section_id, CASE WHEN label = 'other' AND root IS NOT NULL AND last.r = root THEN last.l ELSE label END AS label FROM v""",
        "heading_spans": """SELECT section_id, first_line, next_line FROM (SELECT section_id, start_line AS first_line, lead(start_line) OVER (PARTITION BY paper_id ORDER BY start_line NULLS FIRST, section_id) AS next_line,
            row_number() OVER (PARTITION BY paper_id, section ORDER BY start_line NULLS FIRST, section_id) AS k FROM section_record) WHERE k = 1""",
        "interval_prune": """SELECT section_id FROM (SELECT section_id, end_line, max(end_line) OVER (PARTITION BY paper_id ORDER BY start_line NULLS FIRST, end_line DESC NULLS LAST, section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM section_record) WHERE reach IS NULL OR end_line > reach""",
        "chunk_cap": """SELECT chunk_id FROM (SELECT 'c' || lpad(CAST(section_id AS VARCHAR), 9, '0') AS chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY CASE section WHEN 'results' THEN 0 WHEN 'discussion' THEN 1 WHEN 'ablation' THEN 1 WHEN 'evaluation' THEN 1 WHEN 'experimental' THEN 2 WHEN 'experiments' THEN 2 WHEN 'methods' THEN 2 WHEN 'conclusion' THEN 3 ELSE 9 END, length(content), section_id) AS k
            FROM section_record WHERE length(content) > 0) WHERE k <= 5""",
        "repeated_lines": "SELECT section_id, line, count(*) AS n FROM (SELECT section_id, trim(unnest(regexp_split_to_array(coalesce(content, ''), '\\r\\n|\\n|\\r'))) AS line FROM section_record) WHERE line <> '' GROUP BY section_id, line HAVING count(*) > 2",
        "sentence_stats": r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])[\t-\r ]+', concat('\1', chr(1)), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0) AS s FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, len(s) AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s""",
        "table_rows": "SELECT record_id, CAST(n - 1 AS BIGINT) AS row_no, array_to_string(list_transform(columns, lambda c: c || '=' || coalesce(cells[c], '')), '; ') AS line FROM (SELECT record_id, columns, unnest(rows) AS cells, generate_subscripts(rows, 1) AS n FROM table_record)",
        "term_in_sections": "SELECT lower(canon_name) AS term, count(*) AS sections FROM canon_entity JOIN section_record ON contains(lower(content), lower(canon_name)) GROUP BY 1",
        "token_vocabulary": f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_tokens_a('text')})) AS token FROM documents) GROUP BY token",
        "inverted_index": f"SELECT cand_id, array_to_string({_tokens_c('abstract')}, ' ') AS abstract FROM candidate_paper WHERE abstract IS NOT NULL AND len({_tokens_c('abstract')}) > 0",
        "candidate_filter": """SELECT cand_id FROM candidate_paper WHERE (year IS NULL OR year BETWEEN 2005 AND 2020) AND NOT regexp_matches(lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))), 'editorial|erratum|correction to')""",
        "candidate_merge": rf"""WITH rows_ AS (SELECT *, coalesce(lower(nullif(trim(regexp_replace(trim(doi), '(?i)^https?://(dx\.)?doi\.org/', '')), '')), nullif(trim(landing_url), ''), concat_ws('|', lower({_clean("title")}), coalesce(CAST(year AS VARCHAR), ''), source_key)) AS key FROM candidate_paper),
            urls AS (SELECT key, url, min((cand_id, pos)) AS place FROM (SELECT key, cand_id, unnest(pdf_urls) AS url, generate_subscripts(pdf_urls, 1) - 1 AS pos FROM rows_) GROUP BY key, url),
            listed AS (SELECT key, string_agg(url, ' ' ORDER BY place) AS urls FROM urls GROUP BY key)
            SELECT r.key, count(*) AS n, min(cand_id) AS cand_id, max(citation_count) AS citations, bool_or(coalesce(is_oa, false)) AS open, arg_min(abstract, cand_id) FILTER (trim(coalesce(abstract, '')) <> '') AS abstract, coalesce(any_value(urls), '') AS urls FROM rows_ r LEFT JOIN listed l ON l.key = r.key GROUP BY r.key""",
        "candidate_rank": f"""WITH s AS (SELECT cand_id, source_key, round({phrases} + len(list_intersect(list_distinct({_tokens_c("concat_ws(' ', title, abstract)")}), {query_list})) / {len(TOKENS)}.0, 9) AS p, ln(1 + coalesce(citation_count, 0)) AS c FROM candidate_paper),
            f AS (SELECT cand_id, source_key, round(0.75 * {_scaled_b("p")} + 0.25 * {_scaled_b("c")}, 6) AS score FROM s)
            SELECT cand_id, source_key, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY score DESC, cand_id) AS k FROM f) WHERE k <= 10""",
        "source_counters": "SELECT source_key, count(*) AS candidates, count(*) FILTER (is_oa) AS open, count(doi) AS with_doi, least(count(*) FILTER (is_oa), 10) AS selected, CAST(sum(coalesce(len(pdf_urls), 0)) AS BIGINT) AS urls FROM candidate_paper GROUP BY source_key",
        "identifiers": r"""SELECT cand_id, nullif(trim(regexp_replace(trim(doi), '(?i)^https?://(dx\.)?doi\.org/', '')), '') AS doi, regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, TRY_CAST(nullif(regexp_extract(coalesce(doi, ''), '((?:19|20)\d{2})', 1), '') AS INTEGER) AS doi_year,
            CASE WHEN length(title) > 40 THEN rtrim(substr(title, 1, 37)) || '...' ELSE title END AS short FROM candidate_paper""",
        "claim_errors": f"""WITH {EDGES}, c AS (SELECT edge_id, source AS subject, target AS object, relation, confidence,
                CASE WHEN relation = 'HAS_VALUE' THEN 'MagneticProperty' WHEN starts_with(source, 'Exp ') THEN 'Experiment' WHEN starts_with(source, 'observation') THEN 'Observation' ELSE 'Material' END AS st,
                CASE WHEN relation = 'USES_METHOD' THEN 'Method' WHEN relation IN ('MEASURES_METRIC', 'HAS_PROPERTY') THEN 'MagneticProperty' WHEN relation = 'HAS_CONDITION' THEN 'Condition' WHEN relation IN ('HAS_VALUE', 'REPORTS_RESULT', 'INDICATES') THEN 'Result' ELSE 'Material' END AS ot FROM edges)
            , types AS (SELECT DISTINCT unnest(list_concat(domain_types, range_types)) AS t FROM relation_schema)
            SELECT edge_id, concat_ws('; ', CASE WHEN st NOT IN (SELECT t FROM types) AND '*' NOT IN (SELECT t FROM types) THEN 'unknown subject type' END, CASE WHEN ot NOT IN (SELECT t FROM types) AND '*' NOT IN (SELECT t FROM types) THEN 'unknown object type' END, CASE WHEN r.relation IS NULL THEN 'unknown relation' END,
                CASE WHEN r.relation IS NOT NULL AND NOT (list_contains(domain_types, '*') OR list_contains(domain_types, st)) THEN 'domain mismatch' END,
                CASE WHEN r.relation IS NOT NULL AND NOT (list_contains(range_types, '*') OR list_contains(range_types, ot)) THEN 'range mismatch' END,
                CASE WHEN coalesce(confidence, 0) < 0.65 THEN 'low confidence' END, CASE WHEN {is_generic("subject", "st")} OR {is_generic("object", "ot")} THEN 'generic entity' END) AS errors
            FROM c LEFT JOIN relation_schema r ON r.relation = c.relation""",
        "claim_cap": f"WITH {EDGES} SELECT edge_id, row_number() OVER (PARTITION BY paper_id ORDER BY {priority} DESC, coalesce(confidence, 0) DESC, edge_id) <= 12 AS accepted FROM edges WHERE paper_id IS NOT NULL",
        "claim_merge": f"WITH {EDGES} SELECT edge_id, n AS merged FROM (SELECT edge_id, row_number() OVER (PARTITION BY lower(source), lower(relation), lower(target) ORDER BY coalesce(confidence, 0) DESC, edge_id) AS k, count(*) OVER (PARTITION BY lower(source), lower(relation), lower(target)) AS n FROM edges) WHERE k = 1",
        "quote_check": f"WITH {EDGES} SELECT edge_id, contains(lower({_clean('evidence_quote')}), lower(target)) AS holds FROM edges WHERE evidence_quote IS NOT NULL",
        "answer_scores": SCORES + " SELECT qa_id, eval_func, score FROM scores",
        "evaluation_summary": SCORES + " SELECT eval_func, count(*) AS evaluated, count(score) AS scored, round(avg(score), 6) AS mean_score, CAST(grouping(eval_func) AS TINYINT) AS total FROM scores GROUP BY ROLLUP (eval_func)",
        "qa_unreferenced": "SELECT qa_id FROM qa_example WHERE uuid NOT IN (SELECT u FROM (SELECT unnest(from_uuids) AS u FROM qa_example) WHERE u IS NOT NULL)",
        "qa_resume": "WITH saved AS (SELECT uuid, sha256(coalesce(question, '')) AS k FROM qa_example WHERE saved_at <= created_at + INTERVAL 1 DAY) SELECT qa_id FROM qa_example q WHERE NOT EXISTS (SELECT 1 FROM saved s WHERE s.uuid = q.uuid AND s.k = sha256(coalesce(q.question, '')))",
        "qa_types": "SELECT CASE WHEN coalesce(list_contains(tags, 'subjective'), false) THEN 'subjective' ELSE 'objective' END AS kind, evaluator.eval_func AS eval_func, count(*) AS n FROM qa_example GROUP BY ALL",
        "qa_apportion": """WITH c AS (SELECT evaluator.eval_func AS eval_func, count(*) AS n FROM qa_example WHERE evaluator.eval_func IS NOT NULL GROUP BY 1),
            e AS (SELECT eval_func, n, n * 80.0::DOUBLE / sum(n) OVER () AS exact FROM c), b AS (SELECT *, floor(exact) AS base, round(exact - floor(exact), 9) AS rest FROM e)
            SELECT eval_func, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, eval_func) <= 80 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM b""",
        "qa_papers": "SELECT paper_id, count(*) AS questions FROM (SELECT unnest(list_distinct(list_concat(coalesce(anchor_pdf, []), coalesce(reference_pdf, [])))) AS paper_id FROM qa_example) GROUP BY paper_id",
        "similar_questions": r"""WITH t AS (SELECT qa_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(question, '')), '[A-Za-z0-9_.+%µμ°×^-]+'), lambda x: length(x) >= 3))) AS toks FROM qa_example),
            c AS (SELECT min(qa_id) AS class_id, toks FROM t WHERE len(toks) > 0 GROUP BY toks),
            n AS (SELECT a.class_id, count(*) AS links FROM c a JOIN c b ON a.class_id <> b.class_id AND len(list_intersect(a.toks, b.toks)) >= 0.64 * (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) - 1e-9 GROUP BY a.class_id)
            SELECT qa_id, class_id, coalesce(links, 0) AS links FROM t JOIN c USING (toks) LEFT JOIN n USING (class_id)""",
        "usage_cost": f"WITH {usage} SELECT model, count(*) AS records, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, round(sum((prompt * {rate_in} + completion * {rate_out}) / 1e6), 6) AS cost FROM usage GROUP BY ROLLUP (model)",
        "usage_tumbling": f"WITH {usage} SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS start, model, count(*) AS records, CAST(sum(prompt) AS BIGINT) AS prompt FROM usage GROUP BY ALL",
        "usage_sliding": f"WITH {usage}, w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTE * k AS start, model, prompt FROM usage, (VALUES (0), (1)) v(k)) SELECT start, model, count(*) AS records, CAST(sum(prompt) AS BIGINT) AS prompt FROM w GROUP BY ALL",
        "usage_sessions": f"""WITH {usage}, f AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY model ORDER BY ts, event_id)) <= 600 THEN 0 ELSE 1 END AS fresh FROM usage),
            s AS (SELECT *, sum(fresh) OVER (PARTITION BY model ORDER BY ts, event_id) AS s FROM f) SELECT model, min(ts) AS start, count(*) AS n FROM s GROUP BY model, s""",
        "early_stop": """WITH c AS (SELECT event_id, user_id, count(*) OVER w AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
            s AS (SELECT event_id, coalesce(sum(CASE WHEN n >= 60 OR (n >= 20 AND v >= 4) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM c) SELECT event_id FROM s WHERE stops = 0""",
        "paper_files": r"""WITH p AS (SELECT paper_id, regexp_extract(json_path, '([^/]+)\.json$', 1) AS stem FROM paper_input)
            SELECT paper_id, CASE WHEN stem = paper_id THEN 0 WHEN regexp_matches(stem, '[._]parsed$') THEN 1 ELSE 2 END AS kind, coalesce(nullif(regexp_extract(paper_id, '^(.+)_(\d+)$', 1), ''), paper_id) AS collection, TRY_CAST(nullif(regexp_extract(paper_id, '^(.+)_(\d+)$', 2), '') AS INTEGER) AS paper_index FROM p""",
        "figure_files": r"""WITH f AS (SELECT paper_id, list_sort(list_filter(coalesce(figure_paths, []), lambda p: regexp_matches(p, '(?i)\.(png|jpe?g|gif|bmp|tiff?|webp)$'))) AS f FROM paper_input) SELECT paper_id, array_to_string(f, ' ') AS figures, CAST(len(f) AS INTEGER) AS n FROM f""",
        "graph_nodes": f"WITH {EDGES} SELECT id, arg_min(type, (edge_id, k)) AS type FROM (SELECT edge_id, 0 AS k, source AS id, source_type AS type FROM edges UNION ALL SELECT edge_id, 1, target, relation FROM edges) GROUP BY id",
        "metadata_sections": "SELECT json_extract_string(m, '$.provenance.section') AS section, coalesce(json_extract_string(m, '$.qualifiers.unit'), json_extract_string(m, '$.qualifiers.units')) AS unit, count(*) AS n FROM (SELECT CASE WHEN json_valid(metadata) THEN metadata END AS m FROM graph_edge) GROUP BY 1, 2",
        "late_edges": "SELECT CAST(greatest(0, floor((floor(epoch(ingested_at)) - floor(epoch(extracted_at))) / 86400)) AS BIGINT) AS days_late, count(*) AS n, min(edge_id) AS first FROM graph_edge WHERE extracted_at IS NOT NULL GROUP BY 1",
        "latest_examples": "SELECT qa_id FROM (SELECT qa_id, row_number() OVER (PARTITION BY question ORDER BY saved_at DESC NULLS LAST, qa_id DESC) AS k FROM qa_example WHERE question IS NOT NULL) WHERE k = 1",
    }


SCORES = r"""WITH g AS (SELECT qa_id, evaluator.eval_func AS eval_func, answer AS p, CASE WHEN json_valid(evaluator.eval_kwargs) THEN evaluator.eval_kwargs END AS kw FROM qa_example),
    h AS (SELECT *, json_extract_string(kw, '$.gold') AS gold, coalesce(json_extract_string(kw, '$.lowercase'), '') = 'true' AS low, TRY_CAST(json_extract_string(kw, '$.ndigits') AS INTEGER) AS nd FROM g),
    i AS (SELECT *, CASE WHEN lower(trim(p)) IN ('true', '1', 'yes', 'y', 't') THEN true WHEN lower(trim(p)) IN ('false', '0', 'no', 'n', 'f') THEN false END AS pb, CASE WHEN lower(trim(gold)) IN ('true', '1', 'yes', 'y', 't') THEN true WHEN lower(trim(gold)) IN ('false', '0', 'no', 'n', 'f') THEN false END AS gb,
        CASE WHEN regexp_full_match(p, '\s*[+-]?\d+(_\d+)*\s*') THEN TRY_CAST(regexp_replace(p, '[_\s]', '', 'g') AS BIGINT) END AS pi, CASE WHEN regexp_full_match(gold, '\s*[+-]?\d+(_\d+)*\s*') THEN TRY_CAST(regexp_replace(gold, '[_\s]', '', 'g') AS BIGINT) END AS gi, TRY_CAST(p AS DOUBLE) AS pf, TRY_CAST(gold AS DOUBLE) AS gf FROM h),
    scores AS (SELECT qa_id, eval_func, CASE WHEN p IS NULL THEN NULL
        WHEN eval_func = 'eval_string_exact_match' THEN CASE WHEN CASE WHEN low THEN lower(trim(p)) = lower(trim(coalesce(gold, ''))) ELSE trim(p) = trim(coalesce(gold, '')) END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
        WHEN eval_func = 'eval_bool_exact_match' THEN CASE WHEN pb = gb THEN 1.0 ELSE 0.0 END
        WHEN eval_func = 'eval_int_exact_match' THEN CASE WHEN pi = gi THEN 1.0 ELSE 0.0 END
        WHEN eval_func = 'eval_float_exact_match' THEN CASE WHEN CASE WHEN nd IS NULL THEN pf = gf OR abs(pf - gf) <= 1e-6 * greatest(abs(pf), abs(gf)) ELSE round_even(pf, nd) = round_even(gf, nd) END THEN 1.0 ELSE 0.0 END END AS score FROM i)"""
