"""Queries on examples for questioning, on parsed papers and on candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import candidates, evaluation, quality
from lodestream.plans.reference_sql import SCORES, _clean, _label, _title, _tokens_c
from lodestream.plans.registry import Registry
from lodestream.session import table
from lodestream.sources import papers

query = Registry()


@query()
def quality_gate(spark, d):
    return quality.quality_gate(table(spark, d, "qa_example").dropDuplicates(["qa_id"]))


@query()
def leakage_ratio(spark, d):
    return quality.leakage(table(spark, d, "qa_example"))


@query()
def concise_context(spark, d):
    return quality.concise(table(spark, d, "qa_example"))


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_BARE = f"regexp_replace(lower({_clean('heading')}), '^\\s*(?:section\\s*)?\\d+(?:\\.\\d+)*\\.?\\s*', '')"


@query(f"""WITH s AS (SELECT section_id, paper_id, {_BARE} AS t, lower(trim(coalesce(heading, ''))) AS low, lower(coalesce(content, '')) AS body, {_clean("content")} AS c FROM section_record),
    k AS (SELECT *, {_any("t", quality.INCLUDED)} AS inside FROM s WHERE NOT {_any("t", quality.EXCLUDED)} AND NOT starts_with(low, 'references') AND NOT starts_with(low, 'acknowledg') AND NOT (contains(body, 'doi:') AND contains(body, 'keywords:'))
        AND length(c) >= 260 AND len(regexp_extract_all(c, '[A-Za-z0-9][A-Za-z0-9_.+%μµ°×^-]*')) >= 45 AND NOT {_any("low", quality.AUTHORS)} AND {_any("lower(c)", quality.CUES)} AND paper_id IS NOT NULL)
    SELECT section_id FROM (SELECT *, max(inside) OVER (PARTITION BY paper_id) AS has FROM k) WHERE inside OR NOT has""")
def eligible_sections(spark, d):
    rows = table(spark, d, "section_record").where("paper_id is not null")
    return quality.eligible_sections(rows, "paper_id", "heading", "content").select("section_id")


@query()
def focus_sections(spark, d):
    rows = table(spark, d, "section_record").where("paper_id is not null")
    return quality.focus_sections(rows, "paper_id", "heading", "section_id", "reported_result", 42).select("paper_id", "section_id")


@query()
def seeded_sample(spark, d):
    return quality.sample(table(spark, d, "qa_example").withColumn("f", F.col("evaluator.eval_func")), ["f"], 20, 42, "uuid").select("qa_id")


_TAGS = "list_append(list_filter(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, []))), lambda t: t <> 'single'), 'multiple')"
_LOW = "lower({0}[1:1]) || {0}[2:]"


@query(f"""WITH q AS (SELECT *, CAST(row_number() OVER (ORDER BY qa_id, uuid) AS BIGINT) - 1 AS n FROM qa_example WHERE question IS NOT NULL AND answer_format IS NOT NULL)
    SELECT a.n // 2 AS pair_id, 'In the paper "' || coalesce(a.anchor_pdf[1], '') || '", ' || {_LOW.format("a.question")} || ' In the paper "' || coalesce(b.anchor_pdf[1], '') || '", ' || {_LOW.format("b.question")} || ' ' AS question,
        array_to_string(list_sort(CASE WHEN list_contains({_TAGS}, 'objective') AND list_contains({_TAGS}, 'subjective') THEN list_filter({_TAGS}, lambda t: t <> 'objective') ELSE {_TAGS} END), ',') AS tags, a.uuid || ' ' || b.uuid AS sources
    FROM q a JOIN q b ON b.n = a.n + 1 AND a.n % 2 = 0""")
def multi_pairing(spark, d):
    from pyspark.sql import Window

    q = table(spark, d, "qa_example").where("question is not null and answer_format is not null")
    placed = q.select("uuid", (F.row_number().over(Window.orderBy("qa_id", "uuid")) - 1).cast("bigint").alias("n"))  # the table that pairs are drawn from: ids only
    pairs = placed.groupBy(F.floor(F.col("n") / 2).alias("pair_id")).agg(F.min_by("uuid", "n").alias("first"), F.max_by("uuid", "n").alias("second"), F.count(F.lit(1)).alias("k")).where("k = 2").drop("k")
    return quality.paired(q, pairs).select("pair_id", "question", F.array_join("tags", ",").alias("tags"), F.array_join("from_uuids", " ").alias("sources"))


@query("""WITH c AS (SELECT evaluator.eval_func AS eval_func, count(*) AS n FROM qa_example WHERE evaluator.eval_func IS NOT NULL GROUP BY 1), l AS (SELECT eval_func, greatest(0, 100 - n) AS deficit FROM c)
    SELECT eval_func, deficit FROM l ORDER BY deficit / 100.0 DESC, deficit DESC, eval_func LIMIT 1""")
def eval_type_quota(spark, d):
    now = table(spark, d, "qa_example").where("evaluator.eval_func is not null").groupBy(F.col("evaluator.eval_func").alias("eval_func")).agg(F.count(F.lit(1)).alias("n"))
    return quality.neediest(now, now.withColumn("n", F.lit(100).cast("bigint")), "eval_func")


@query("SELECT edge_id, confidence AS score FROM graph_edge WHERE confidence < 0.8 ORDER BY edge_id LIMIT 40")
def wrong_cases(spark, d):
    return quality.wrong_cases(table(spark, d, "graph_edge").select("edge_id", F.col("confidence").alias("score")), "edge_id", 0.8)


@query(SCORES + """, r AS (SELECT uuid, score FROM scores JOIN qa_example USING (qa_id)), f AS (SELECT * FROM (SELECT uuid, question, row_number() OVER (PARTITION BY uuid ORDER BY qa_id) AS k FROM qa_example) WHERE k = 1)
    SELECT uuid, score, question FROM r LEFT JOIN f USING (uuid)""")
def record_examples(spark, d):
    q = table(spark, d, "qa_example")
    records = evaluation.scored(q).join(q.select("qa_id", "uuid"), "qa_id").select("uuid", "score")
    return quality.with_examples(records, q).select("uuid", "score", "question")


@query(SCORES + """, halves AS (SELECT eval_func, qa_id % 2 AS part, score FROM scores), a AS (SELECT eval_func, avg(score) AS before, count(score) AS before_n FROM halves WHERE part = 0 GROUP BY 1), b AS (SELECT eval_func, avg(score) AS after, count(score) AS after_n FROM halves WHERE part = 1 GROUP BY 1)
    SELECT eval_func, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS change, coalesce(before_n, 0) AS before_n, coalesce(after_n, 0) AS after_n FROM a FULL JOIN b USING (eval_func)""")
def holdout_compare(spark, d):
    scores = evaluation.scored(table(spark, d, "qa_example"))
    return quality.compared(scores.where("qa_id % 2 = 0"), scores.where("qa_id % 2 = 1"))


@query("""SELECT qa_id, coalesce(contains(evaluator.eval_func, 'llm'), false) OR (json_valid(evaluator.eval_kwargs) AND (coalesce(contains(CAST(json_extract(evaluator.eval_kwargs, '$.eval_func_list') AS VARCHAR), 'llm'), false) OR coalesce(contains(json_extract_string(evaluator.eval_kwargs, '$.eval_func'), 'llm'), false))) AS asks,
    coalesce(trim(answer) = '[INSUFFICIENT_CONTEXT]', false) AS insufficient FROM qa_example""")
def model_evaluators(spark, d):
    from lodestream.operators.bundles import insufficient

    return table(spark, d, "qa_example").select("qa_id", quality.asks_model(F.col("evaluator")).alias("asks"), insufficient(F.col("answer")).alias("insufficient"))


# ------------------------------------------------------------ parsed papers


_MD_ROW = "array_to_string(list_transform(cols, lambda c: c || '=' || " + _clean("r[c]") + "), '; ')"


@query(f"""WITH t AS (SELECT record_id, rows, list_filter(list_transform(CASE WHEN len(coalesce(columns, [])) > 0 THEN columns ELSE coalesce(map_keys(rows[1]), []) END, lambda c: {_clean("c")}), lambda c: c <> '') AS cols FROM table_record)
    SELECT record_id, CASE WHEN len(cols) > 0 THEN array_to_string(list_concat(['Columns: ' || array_to_string(cols, ' | '), 'Rows:'], list_transform(list_filter(coalesce(rows, []), lambda r: len(list_filter(cols, lambda c: {_clean("r[c]")} <> '')) > 0), lambda r: '- ' || {_MD_ROW})), chr(10)) ELSE '' END AS markdown FROM t""")
def table_markdown(spark, d):
    t = table(spark, d, "table_record")
    return t.select("record_id", papers.table_markdown(F.coalesce("columns", F.array().cast("array<string>")), F.col("rows")).alias("markdown"))


_SECTION = _label("t")


@query(f"""WITH s AS (SELECT paper_id, start_line AS page, {_title("heading")} AS t FROM section_record WHERE paper_id IS NOT NULL AND start_line IS NOT NULL), n AS (SELECT DISTINCT paper_id, page, {_SECTION} AS section FROM s), named AS (SELECT * FROM n WHERE section <> 'other'),
    exact AS (SELECT paper_id, page, min(section) AS a, max(section) AS b FROM named GROUP BY ALL), pages AS (SELECT paper_id, page, max(section) AS s FROM named GROUP BY paper_id, page), starts AS (SELECT *, lead(page) OVER (PARTITION BY paper_id ORDER BY page) AS following FROM pages)
    SELECT record_id, coalesce(CASE WHEN a = b THEN a END, s.s, 'unknown') AS section FROM table_record r LEFT JOIN exact e ON e.paper_id = r.paper_id AND e.page = r.page
        LEFT JOIN starts s ON s.paper_id = r.paper_id AND ((following IS NULL AND r.page = s.page) OR (r.page >= s.page AND r.page < following))""")
def section_for_page(spark, d):
    from lodestream.functions import text

    s = table(spark, d, "section_record").where("paper_id is not null and start_line is not null")
    found = s.select("paper_id", F.col("start_line").alias("page_number"), F.array("start_line").alias("page_numbers"), text.section_label(F.col("heading")).alias("section")).distinct()
    rows = table(spark, d, "table_record").select("record_id", "paper_id", F.col("page").alias("page_number"))
    return papers.section_of_page(rows, found).select("record_id", F.col("page_section").alias("section"))


@query()
def evidence_chunks(spark, d):
    found, tabled = papers.from_records(table(spark, d, "section_record"), table(spark, d, "table_record"))
    return papers.evidence_chunks(found, tabled, 1500, excluded=["abstract", "introduction"]).select("chunk_id", "section", "title", "text")


@query()
def enriched_context(spark, d):
    found, tabled = papers.from_records(table(spark, d, "section_record"), table(spark, d, "table_record"))
    return papers.enriched_context(found.where("paper_id is not null"), ["methods", "results", "discussion"], tabled.where("paper_id is not null"), 20_000)


# ------------------------------------------------------------ candidates


@query(f"SELECT cand_id, concat_ws(chr(10), CASE WHEN {_clean('title')} <> '' THEN 'Title: ' || {_clean('title')} END, CASE WHEN {_clean('abstract')} <> '' THEN 'Abstract: ' || {_clean('abstract')} END) AS text, len({_tokens_c('title')}) AS title_tokens FROM candidate_paper")
def semantic_texts(spark, d):
    from lodestream.functions import text

    return table(spark, d, "candidate_paper").select("cand_id", candidates.semantic_text().alias("text"), F.size(text.tokens_c(F.col("title"))).cast("bigint").alias("title_tokens"))


@query("""WITH o AS (SELECT * FROM candidate_paper WHERE is_oa AND len(coalesce(pdf_urls, [])) > 0), f AS (SELECT cand_id, source_key, list_filter(list_concat(coalesce(pdf_urls, []), coalesce(crossref_pdf_urls, [])), lambda u: regexp_matches(lower(u), '\\.pdf$|/pdf|download=true')) AS urls, citation_count FROM o)
    SELECT cand_id, source_key, urls[1] AS url, CAST(row_number() OVER (PARTITION BY source_key ORDER BY coalesce(citation_count, 0) DESC, cand_id) AS INTEGER) AS position FROM f WHERE len(urls) > 0 QUALIFY position <= 10""")
def download_queue(spark, d):
    return candidates.download_queue(table(spark, d, "candidate_paper").where(F.size("pdf_urls") > 0), 10).select("cand_id", "source_key", "url", "position")




@query("SELECT lower(regexp_replace(trim(source_display_name), '\\s+', ' ', 'g')) AS alias, min(source_key) AS source_key, count(*) AS papers FROM candidate_paper WHERE source_display_name IS NOT NULL GROUP BY 1")
def source_alias_join(spark, d):
    p = table(spark, d, "candidate_paper").where("source_display_name is not null")
    catalog = p.groupBy(candidates.alias(F.col("source_display_name")).alias("alias")).agg(F.min("source_key").alias("source_key"))
    named = candidates.resolved(p.select("cand_id", F.col("source_display_name").alias("name")), "name", catalog)
    return named.groupBy("alias", "source_key").agg(F.count(F.lit(1)).alias("papers"))


