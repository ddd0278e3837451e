"""Candidate papers: filters, merging by key, ranking per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import scoring, text



def without_terms(papers: DataFrame, terms: list[str]) -> DataFrame:
    """Papers with none of the terms in title and abstract, case ignored."""
    body = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    bad = F.lit(False)
    for t in terms:
        bad = bad | F.contains(body, F.lit(t.lower()))
    return papers.where(~bad)


def in_years(papers: DataFrame, first: int, last: int) -> DataFrame:
    """Papers of the years; an unknown year passes."""
    return papers.where(F.col("year").isNull() | F.col("year").between(first, last))


def dedupe_key() -> Column:
    """DOI, else landing url, else title, year and source."""
    doi = F.lower(text.doi(F.col("doi")))
    landing = F.when(F.length(F.trim("landing_url")) > 0, F.trim("landing_url"))
    return F.coalesce(doi, landing, F.concat_ws("|", F.lower(text.clean(F.col("title"))), F.coalesce(F.col("year").cast("string"), F.lit("")), F.col("source_key")))


def merged(papers: DataFrame) -> DataFrame:
    """One row for each key: first non-empty texts by cand_id, any open access, most citations, all urls in order."""
    rows = papers.withColumn("key", dedupe_key())
    filled = lambda c: F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0, F.col(c))
    urls = rows.select("key", "cand_id", F.posexplode(F.coalesce("pdf_urls", F.array().cast("array<string>"))).alias("pos", "url"))
    first = urls.groupBy("key", "url").agg(F.min(F.struct("cand_id", "pos")).alias("at")).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda s: s["url"]), " ").alias("urls"))
    one = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("cand_id").alias("cand_id"), F.max("citation_count").alias("citations"), F.bool_or(F.coalesce("is_oa", F.lit(False))).alias("open"),
        F.min_by(filled("abstract"), F.when(filled("abstract").isNotNull(), F.col("cand_id"))).alias("abstract"),
    )
    return one.join(first, "key", "left").withColumn("urls", F.coalesce("urls", F.lit("")))


def phrase_score(phrases: list[str], query: list[str]) -> Column:
    """2 for each phrase in the title, else 1 in the abstract, plus the share of query tokens found."""
    title, abstract = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("abstract", F.lit("")))
    score = F.lit(0.0)
    for p in phrases:
        score = score + F.when(F.contains(title, F.lit(p.lower())), 2.0).when(F.contains(abstract, F.lit(p.lower())), 1.0).otherwise(0.0)
    words = F.array_distinct(text.tokens_c(F.concat_ws(" ", "title", "abstract")))
    return score + (F.size(F.array_intersect(words, F.array(*(F.lit(q) for q in query)))) / len(query) if query else F.lit(0.0))


def ranked(papers: DataFrame, phrases: list[str], query: list[str], weights: tuple[float, float] = (0.75, 0.25), most: int = 10) -> DataFrame:
    """The best papers of each source by weighted min-max of phrase and citation scores; two sums, then one window."""
    scored = papers.select("cand_id", "source_key", F.round(phrase_score(phrases, query), 9).alias("p"), F.log1p(F.coalesce("citation_count", F.lit(0)).cast("double")).alias("c"))
    low = scored.agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.min("c").alias("c0"), F.max("c").alias("c1")).first()
    part = lambda c, k: scoring.scaled_b(F.col(c), F.lit(low[f"{k}0"]), F.lit(low[f"{k}1"]))
    full = scored.select("cand_id", "source_key", F.round(weights[0] * part("p", "p") + weights[1] * part("c", "c"), 6).alias("score"))
    order = Window.partitionBy("source_key").orderBy(F.desc("score"), "cand_id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def semantic_text() -> Column:
    """The text of a paper by which its meaning is compared: title and abstract, each named, on lines of their own."""
    filled = lambda name, c: F.when(F.length(text.clean(F.col(c))) > 0, F.concat(F.lit(f"{name}: "), text.clean(F.col(c))))
    return F.concat_ws("\n", filled("Title", "title"), filled("Abstract", "abstract"))


def alias(c: Column) -> Column:
    """A name of a source for look-up: trimmed, white space as one space, lower case (ß as ss)."""
    return F.replace(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), F.lit("ß"), F.lit("ss"))


def resolved(rows: DataFrame, name: str, catalog: DataFrame, strict: bool = True) -> DataFrame:
    """rows with ``alias`` and the source_key of a catalog (alias, source_key); an unknown name is an error if ``strict``, else falls away."""
    named = rows.withColumn("alias", alias(F.col(name)))
    both = named.join(catalog.select("alias", "source_key"), "alias", "left" if strict else "inner")
    return both.withColumn("source_key", F.when(F.col("source_key").isNull(), F.raise_error(F.concat(F.lit("unknown source: "), name)).cast("string")).otherwise(F.col("source_key"))) if strict else both


def pdf_urls() -> Column:
    """The urls of a paper that look like a PDF, in order, each once."""
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce("pdf_urls", none), F.coalesce("crossref_pdf_urls", none)))
    return F.filter(every, lambda u: F.lower(u).rlike(r"\.pdf$|/pdf|download=true"))


def download_queue(papers: DataFrame, most: int) -> DataFrame:
    """The first open papers of each source that have a PDF, by citations, with the url to try first and their position."""
    open_papers = papers.where("is_oa").withColumn("urls", pdf_urls()).where(F.size("urls") > 0)
    order = Window.partitionBy("source_key").orderBy(F.desc(F.coalesce("citation_count", F.lit(0).cast("bigint"))), "cand_id")
    return open_papers.withColumn("url", F.col("urls")[0]).withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def distinct_phrases(phrases: list[str]) -> list[str]:
    """Phrases of a search, each once (case folded), in order; blank ones left out."""
    return list({p.strip().casefold(): p.strip() for p in reversed(phrases) if p.strip()}.values())[::-1]


def ranking_context(query: str, keywords: list[str]) -> tuple[list[str], list[str]]:
    """(tokens, phrases) by which papers are ranked for a query and its keywords."""
    import re

    phrases = distinct_phrases([query, *keywords])
    return [t.casefold() for t in re.findall(text.TOKEN_C, " ".join(phrases))], phrases
