"""Queries of the engine's relational, text and graph operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import parse, scoring, text
from lodestream.operators import candidates, claims, documents, edges, evaluation, hierarchy, retrieval, terms, usage
from lodestream.plans import reference_sql
from lodestream.session import table
from lodestream.sources import readers, sinks

QUESTION = "coercivity strontium hexaferrite annealing temperature magnetization domain"
TOKENS = QUESTION.split()
PHRASES = ["strontium hexaferrite", "grain size"]
SEEDS = ["coercivity", "remanence", "magnetite", "Exp 15"]
PRICES = [("view", 0.2, 1.25), ("sign", 0.75, 4.5), ("purchase", 2.5, 15.0), ("err", 0.02, 0.0)]
_T = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, _T] = {}


def _query(f: _T) -> _T:
    QUERIES[f.__name__] = f
    return f


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.cleaned(table(spark, d, "graph_edge"))


# ------------------------------------------------------------ retrieval


@_query
def bm25_topk(spark, d):
    return retrieval.top(retrieval.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), TOKENS), "doc_id", 20)


@_query
def bm25okapi_topk(spark, d):
    papers = table(spark, d, "candidate_paper")
    return retrieval.top(retrieval.bm25_okapi(papers, "cand_id", F.concat_ws(" ", "title", "abstract"), TOKENS), "cand_id", 20)


def _cosine(spark, d):
    vectors = table(spark, d, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()
    query = F.array(*(F.lit(float(x)) for x in (first[0] if first else [0.0])))
    return vectors.select("vec_id", scoring.cosine(F.col("embedding"), query).alias("score"))


@_query
def cosine_topk(spark, d):
    return retrieval.top(_cosine(spark, d), "vec_id", 20)


@_query
def hybrid_fusion(spark, d):
    words = retrieval.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), TOKENS).select("doc_id", F.round("score", 6).alias("b"))
    both = words.join(_cosine(spark, d).select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("c")), "doc_id")
    lim = both.agg(F.min("b"), F.max("b"), F.min("c"), F.max("c")).first()
    fused = 8.0 * (0.4 * scoring.scaled_a(F.col("b"), F.lit(lim[0]), F.lit(lim[1])) + 0.6 * scoring.scaled_a(F.col("c"), F.lit(lim[2]), F.lit(lim[3])))
    return retrieval.top(both.select("doc_id", fused.alias("score")), "doc_id", 20)


@_query
def rank_interleave(spark, d):
    words = retrieval.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), TOKENS)
    return retrieval.interleave(words, _cosine(spark, d).withColumnRenamed("vec_id", "doc_id"), "doc_id", 20).select("doc_id", "method", "rank", "position")


@_query
def budget_edges(spark, d):
    rows = edges.distinct_edges(_edges(spark, d)).where(F.col("paper_id").isNotNull())
    cost = F.length(F.concat_ws(" ", "source", "relation", "target")) + F.length("paper_id") + 40
    order = [F.desc(scoring.relation_hint(F.col("relation"))), F.desc(F.coalesce("confidence", F.lit(0.0))), F.col("edge_id")]
    return retrieval.budgeted(rows, "paper_id", cost, order, 2000, 40).select("edge_id")


# ------------------------------------------------------------ edges


@_query
def edge_distinct(spark, d):
    return edges.distinct_edges(_edges(spark, d)).select("edge_id")


@_query
def graph_fingerprint(spark, d):
    return edges.fingerprint(_edges(spark, d))


@_query
def node_degree(spark, d):
    return edges.degrees(_edges(spark, d))


@_query
def node_catalog(spark, d):
    ends = _edges(spark, d).select(F.explode(F.array("source", "target")).alias("node"), "relation").where(~F.lower("node").isin(scoring.ROOTS))
    counted = ends.groupBy("node", "relation").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("node").agg(F.sum("n").alias("incident"), F.count(F.lit(1)).alias("relations"), F.max_by("relation", F.struct("n", "relation")).alias("main_relation"))


@_query
def edge_weights(spark, d):
    return edges.weights(_edges(spark, d)).withColumn("weight", F.round("weight", 6))


@_query
def representative_edges(spark, d):
    return edges.representative(_edges(spark, d).where("paper_id is not null"), "paper_id", 3).select("paper_id", "edge_id", "rank")


@_query
def node_incident(spark, d):
    return edges.incident(_edges(spark, d), SEEDS).select("node", "edge_id")


@_query
def bundle_edges(spark, d):
    return edges.bundle_top(_edges(spark, d), SEEDS, TOKENS).select("node", "edge_id", "score", "rank")


@_query
def relation_histograms(spark, d):
    e = _edges(spark, d)
    return e.groupingSets([["relation"], ["source_type"], []], "relation", "source_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))


@_query
def paper_relation_counts(spark, d):
    e = _edges(spark, d).where("paper_id is not null")
    return e.groupBy("paper_id").agg(*(F.count_if(F.col("relation") == r).alias(r.lower()) for r in ("USES_MATERIAL", "HAS_VALUE", "isA")), F.round(F.avg((F.col("relation") == "isA").cast("double")), 6).alias("taxonomy_share"))


@_query
def viz_topn(spark, d):
    e = _edges(spark, d)
    top = edges.degrees(e).orderBy(F.desc("degree"), "node").limit(50).select("node")
    inside = e.join(F.broadcast(top.withColumnRenamed("node", "source")), "source", "left_semi").join(F.broadcast(top.withColumnRenamed("node", "target")), "target", "left_semi")
    return inside.select("edge_id", "source", "target")


@_query
def community_labels(spark, d):
    e = _edges(spark, d).where("paper_id is not null")
    w = F.when(F.col("relation") == "isA", 0.75).when(F.col("relation") == "DEFINED_AS", 1.0).otherwise(2.0 + F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    both = e.select(F.col("paper_id").alias("grp"), "source", "target", w.alias("w")).select("grp", F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b"), "w"), F.struct(F.col("target").alias("a"), F.col("source").alias("b"), "w"))).alias("x")).select("grp", "x.*")
    return edges.communities(both.groupBy("grp", "a", "b").agg(F.sum("w").alias("weight"))).withColumnRenamed("grp", "paper_id")


# ------------------------------------------------------------ taxonomies


def _links(spark, d):
    return hierarchy.kind_links(table(spark, d, "graph_edge"))


@_query
def connected_components(spark, d):
    links = _links(spark, d).select("grp", F.col("child").alias("a"), F.col("parent").alias("b"))
    return edges.components(links).withColumnRenamed("grp", "paper_id")


@_query
def taxonomy_ancestors(spark, d):
    links = _links(spark, d)
    leaves = links.select("grp", F.col("child").alias("node")).distinct().join(links.select("grp", F.col("parent").alias("node")), ["grp", "node"], "left_anti")
    return edges.ancestors(links, leaves).select(F.col("grp").alias("paper_id"), "seed", "child", "parent", "level")


@_query
def transitive_reduction(spark, d):
    return edges.reduced(_links(spark, d)).withColumnRenamed("grp", "paper_id")


@_query
def tree_frontier(spark, d):
    nodes = table(spark, d, "layout_node").select("id", "node_type", F.explode_outer("children").alias("child"))
    front = nodes.where("node_type = 'root'").select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct()
    out = front
    links = nodes.where("child is not null").select(F.col("id").alias("node"), "child")
    for hop in (1, 2, 3):
        front = front.join(links, "node").select("root", F.col("child").alias("node"), F.lit(hop).alias("hops")).distinct()
        out = out.unionByName(front)
    return out.groupBy("root", "node").agg(F.min("hops").alias("hops"))


@_query
def tree_levels(spark, d):
    n = table(spark, d, "layout_node")
    return n.groupBy("level", "node_type").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.size("children") == 0).alias("leaves"), F.round(F.avg("y"), 4).alias("mean_y"))


# ------------------------------------------------------------ documents


@_query
def section_labels(spark, d):
    return table(spark, d, "section_record").select("section_id", text.section_label(F.col("heading")).alias("label"), text.heading_label(F.col("heading")).alias("heading_label"))


@_query
def section_inherited(spark, d):
    return documents.inherited_labels(table(spark, d, "section_record"))


@_query
def heading_spans(spark, d):
    return documents.spans(table(spark, d, "section_record"))


@_query
def interval_prune(spark, d):
    return documents.pruned_spans(table(spark, d, "section_record"))


@_query
def chunk_packing(spark, d):
    c = documents.chunks(table(spark, d, "section_record"), 1500)
    return c.groupBy("section_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("text")).cast("bigint").alias("longest"))


@_query
def chunk_cap(spark, d):
    rows = table(spark, d, "section_record").where("length(content) > 0").select("paper_id", "section", F.col("content").alias("text"), F.concat(F.lit("c"), F.lpad(F.col("section_id").cast("string"), 9, "0")).alias("chunk_id"))
    return documents.capped(rows, 5).select("chunk_id")


@_query
def repeated_lines(spark, d):
    return documents.repeated_lines(table(spark, d, "section_record"), "section_id", "content", 2)


@_query
def sentence_stats(spark, d):
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(s).cast("bigint").alias("sentences"), F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).cast("bigint").alias("longest"))


@_query
def table_rows(spark, d):
    t = table(spark, d, "table_record").select("record_id", "columns", F.posexplode("rows").alias("row_no", "cells"))
    return t.select("record_id", F.col("row_no").cast("bigint").alias("row_no"), documents.table_text(F.col("columns"), F.col("cells")).alias("line"))


@_query
def term_in_sections(spark, d):
    names = table(spark, d, "canon_entity").select(F.col("canon_name").alias("term"))
    return terms.containing(table(spark, d, "section_record"), "section_id", "content", names).groupBy("term").agg(F.count(F.lit(1)).alias("sections"))


@_query
def token_vocabulary(spark, d):
    toks = table(spark, d, "documents").select(F.explode(F.array_distinct(text.tokens_a(F.col("text")))).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@_query
def inverted_index(spark, d):
    words = text.tokens_c(F.col("abstract"))
    rows = table(spark, d, "candidate_paper").where("abstract is not null").select("cand_id", words.alias("w")).where(F.size("w") > 0)
    index = rows.select("cand_id", F.posexplode("w").alias("pos", "word")).groupBy("cand_id", "word").agg(F.collect_list("pos").alias("at"))
    maps = index.groupBy("cand_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return maps.select("cand_id", parse.from_inverted(F.col("index")).alias("abstract"))


# ------------------------------------------------------------ candidates


@_query
def candidate_filter(spark, d):
    kept = candidates.in_years(candidates.without_terms(table(spark, d, "candidate_paper"), ["editorial", "erratum", "correction to"]), 2005, 2020)
    return kept.select("cand_id")


@_query
def candidate_merge(spark, d):
    return candidates.merged(table(spark, d, "candidate_paper"))


@_query
def candidate_rank(spark, d):
    return candidates.ranked(table(spark, d, "candidate_paper"), PHRASES, TOKENS)


@_query
def source_counters(spark, d):
    p = table(spark, d, "candidate_paper")
    return p.groupBy("source_key").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("is_oa").alias("open"), F.count("doi").alias("with_doi"), F.least(F.count_if("is_oa"), F.lit(10)).cast("bigint").alias("selected"), F.sum(F.size(F.coalesce("pdf_urls", F.array().cast("array<string>")))).cast("bigint").alias("urls"))


@_query
def identifiers(spark, d):
    p = table(spark, d, "candidate_paper")
    return p.select("cand_id", text.doi(F.col("doi")).alias("doi"), text.slug(F.col("title")).alias("slug"), text.year(F.col("doi")).alias("doi_year"), text.truncate(F.col("title"), 40).alias("short"))


# ------------------------------------------------------------ claims and evaluation


def _claims(spark, d):
    kind = lambda c: F.when(F.col(c).startswith("Exp "), "Experiment").when(F.col(c).startswith("observation"), "Observation").otherwise("Material")
    rel = F.col("relation")
    ends = F.when(rel == "USES_METHOD", "Method").when(rel.isin("MEASURES_METRIC", "HAS_PROPERTY"), "MagneticProperty").when(rel.isin("HAS_CONDITION",), "Condition").when(rel.isin("HAS_VALUE", "REPORTS_RESULT", "INDICATES"), "Result").otherwise("Material")
    return _edges(spark, d).select("edge_id", "paper_id", F.col("source").alias("subject"), F.when(rel == "HAS_VALUE", "MagneticProperty").otherwise(kind("source")).alias("subject_type"), "relation", F.col("target").alias("object"), ends.alias("object_type"), "confidence", "evidence_quote")


@_query
def claim_errors(spark, d):
    v = claims.validated(_claims(spark, d), table(spark, d, "relation_schema"))
    return v.select("edge_id", F.array_join("errors", "; ").alias("errors"))


@_query
def claim_cap(spark, d):
    return claims.capped(_edges(spark, d).where("paper_id is not null"), "paper_id", 12).select("edge_id", "accepted")


@_query
def claim_merge(spark, d):
    return claims.merged(_edges(spark, d))


@_query
def quote_check(spark, d):
    e = _edges(spark, d).where("evidence_quote is not null")
    return e.select("edge_id", claims.quote_in(F.col("target"), F.col("evidence_quote")).alias("holds"))


@_query
def answer_scores(spark, d):
    return evaluation.scored(table(spark, d, "qa_example"))


@_query
def answer_scores_all(spark, d):
    return evaluation.scored_all(table(spark, d, "qa_example"))


@_query
def evaluation_summary_all(spark, d):
    return evaluation.summary(evaluation.scored_all(table(spark, d, "qa_example")))


@_query
def evaluation_summary(spark, d):
    return evaluation.summary(evaluation.scored(table(spark, d, "qa_example")))


@_query
def qa_unreferenced(spark, d):
    q = table(spark, d, "qa_example")
    used = q.select(F.explode("from_uuids").alias("uuid")).distinct()
    return q.join(used, "uuid", "left_anti").select("qa_id")


@_query
def qa_resume(spark, d):
    q = table(spark, d, "qa_example")
    saved = q.where(F.col("saved_at") <= F.col("created_at") + F.expr("INTERVAL 1 DAY")).select("uuid", F.sha2(F.coalesce("question", F.lit("")), 256).alias("k"))
    now = q.select("qa_id", "uuid", F.sha2(F.coalesce("question", F.lit("")), 256).alias("k"))
    return now.join(saved, ["uuid", "k"], "left_anti").select("qa_id")


@_query
def qa_types(spark, d):
    q = table(spark, d, "qa_example")
    kind = F.when(F.coalesce(F.array_contains("tags", "subjective"), F.lit(False)), "subjective").otherwise("objective")
    return q.groupBy(kind.alias("kind"), F.col("evaluator.eval_func").alias("eval_func")).agg(F.count(F.lit(1)).alias("n"))


@_query
def qa_apportion(spark, d):
    counts = table(spark, d, "qa_example").where("evaluator.eval_func is not null").groupBy(F.col("evaluator.eval_func").alias("eval_func")).agg(F.count(F.lit(1)).alias("n"))
    return evaluation.apportioned(counts, "eval_func", "n", 80)


@_query
def qa_papers(spark, d):
    q = table(spark, d, "qa_example")
    none = F.array().cast("array<string>")
    ids = F.array_distinct(F.concat(F.coalesce("anchor_pdf", none), F.coalesce("reference_pdf", none)))
    return q.select(F.explode(ids).alias("paper_id")).groupBy("paper_id").agg(F.count(F.lit(1)).alias("questions"))


@_query
def similar_questions(spark, d):
    return evaluation.similar_questions(table(spark, d, "qa_example"))


# ------------------------------------------------------------ usage, files, streams


@_query
def usage_cost(spark, d):
    return usage.cost(usage.usage(table(spark, d, "events")), PRICES)


@_query
def usage_tumbling(spark, d):
    return usage.per_window(usage.usage(table(spark, d, "events")), "1 hour")


@_query
def usage_sliding(spark, d):
    return usage.per_window(usage.usage(table(spark, d, "events")), "1 hour", "30 minutes")


@_query
def usage_sessions(spark, d):
    return usage.sessions(usage.usage(table(spark, d, "events")), "model", 600)


@_query
def early_stop(spark, d):
    e = table(spark, d, "events")
    return usage.until_stop(e, "user_id", F.col("event_type") == "purchase", 60, 20, 4).select("event_id")


@_query
def paper_files(spark, d):
    return readers.picked_json(table(spark, d, "paper_input"))


@_query
def figure_files(spark, d):
    return readers.figures(table(spark, d, "paper_input"))


@_query
def graph_nodes(spark, d):
    e = _edges(spark, d)
    return sinks.graph_nodes(e.withColumn("source_kind", F.col("source_type")).withColumn("target_kind", F.col("relation")))


@_query
def metadata_sections(spark, d):
    meta = parse.json_object(F.col("metadata"))
    rows = table(spark, d, "graph_edge").select(F.try_variant_get(meta, "$.provenance.section", "string").alias("section"), F.coalesce(F.try_variant_get(meta, "$.qualifiers.unit", "string"), F.try_variant_get(meta, "$.qualifiers.units", "string")).alias("unit"))
    return rows.groupBy("section", "unit").agg(F.count(F.lit(1)).alias("n"))


@_query
def late_edges(spark, d):
    e = table(spark, d, "graph_edge").where("extracted_at is not null")
    late = F.greatest(F.lit(0), F.floor((F.unix_timestamp("ingested_at") - F.unix_timestamp("extracted_at")) / 86400))
    return e.groupBy(late.cast("bigint").alias("days_late")).agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("first"))


@_query
def latest_examples(spark, d):
    q = table(spark, d, "qa_example").where("question is not null")
    return sinks.latest(q.select("qa_id", "question", F.struct("saved_at", "qa_id").alias("v")), "question", "v").select("qa_id")


def queries() -> dict[str, _T]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return reference_sql.oracle_sql()
