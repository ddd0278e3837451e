"""Crawling over recorded pages: paged searches, look-ups by DOI, site walks, probes and downloads."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.session import checkpoint
from lodestream.sources import html


def enriched(papers: DataFrame, works: DataFrame) -> DataFrame:
    """papers with crossref_pdf_urls and license_urls of a table of works (doi, links array<struct<url,content_type>>, licenses array<string>), by DOI, case aside."""
    pdf = F.filter("links", lambda x: F.contains(F.lower(F.coalesce(x["content_type"], F.lit(""))), F.lit("pdf")) | F.lower(x["url"]).endswith(".pdf"))
    found = works.select(F.lower("doi").alias("_doi"), F.array_distinct(F.transform(pdf, lambda x: x["url"])).alias("_pdf"), F.array_distinct("licenses").alias("_lic")).dropDuplicates(["_doi"])
    both = papers.join(found, F.lower("doi") == F.col("_doi"), "left")
    return both.withColumns({"crossref_pdf_urls": F.coalesce("_pdf", "crossref_pdf_urls"), "license_urls": F.coalesce("_lic", "license_urls")}).drop("_doi", "_pdf", "_lic")


def site_walk(pages: DataFrame, starts: list[str], domain: str, depth: int = 2, most_pages: int = 25, most_found: int | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """url, text, found_on, level: the PDF links met on a walk over recorded pages (url, html), breadth first.

    Pages of a level are taken by url; ``most_pages`` bounds the pages, ``most_found`` the links. A
    url is visited once; links out of the domain are not followed, a link whose text names a year out of ``years`` is left out.
    Site maps (XML) give their locations.
    """
    spark = pages.sparkSession
    front = spark.createDataFrame([(u,) for u in dict.fromkeys(starts)], "url string").where(html.in_domain(F.col("url"), domain))
    seen, taken, out = front, 0, None
    for level in range(depth + 1):
        visited = checkpoint(pages.join(front, "url", "left_semi").orderBy("url").limit(max(0, most_pages - taken)))
        taken += visited.count()
        maps = visited.where(F.ltrim("html").startswith("<?xml") | F.contains("html", F.lit("<urlset"))).select("url", F.explode(html.locations(F.col("html"))).alias("href"), F.lit("").alias("text"))
        linked = _links(visited.where(~(F.ltrim("html").startswith("<?xml") | F.contains("html", F.lit("<urlset"))))).unionByName(maps)
        absolute = linked.select(_absolute(F.col("url"), F.col("href")).alias("to"), "text", F.col("url").alias("found_on")).where(html.in_domain(F.col("to"), domain))
        found = absolute.where(html.is_pdf(F.col("to"))).select(F.col("to").alias("url"), "text", "found_on", F.lit(level).alias("level"))
        out = found if out is None else out.unionByName(found)
        nxt = absolute.where(~html.is_pdf(F.col("to"))).select(F.col("to").alias("url")).distinct().join(seen, "url", "left_anti")
        front = checkpoint(nxt)
        seen = seen.unionByName(front)
        if taken >= most_pages or front.isEmpty():
            break
    year = F.regexp_extract("text", r"((?:19|20)\d{2})", 1).try_cast("int")
    kept = out if years is None else out.where(year.isNull() | year.between(*years))
    first = kept.groupBy("url").agg(F.min_by(F.struct("text", "found_on", "level"), F.struct("level", "found_on", "text")).alias("x")).select("url", "x.*")
    return first if most_found is None else first.orderBy("level", "found_on", "url").limit(most_found)


def _links(pages: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [(u, *x) for u, h in zip(df["url"], df["html"], strict=True) for x in html.Page(h).links]
            yield pd.DataFrame(got, columns=["url", "href", "text"])

    return pages.select("url", "html").mapInPandas(run, "url string, href string, text string")


def _absolute(base: Column, href: Column) -> Column:
    """A link made absolute against its page; fragments cut off."""
    bare = F.regexp_replace(href, "#.*$", "")
    root, folder = F.regexp_extract(base, r"^(https?://[^/]+)", 1), F.regexp_replace(base, r"(^https?://[^/]+$)|/[^/]*$", "$1")
    return F.when(bare.rlike("^https?://"), bare).when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).when(bare.startswith("/"), F.concat(root, bare)).otherwise(F.concat(folder, F.lit("/"), bare))


# ------------------------------------------------------------ probes and downloads

Fetch = Callable[[str], tuple[int, str, bytes]]


def _probe(fetch: Fetch, url: str) -> tuple[bool, str]:
    try:
        status, kind, body = fetch(url)
    except Exception as e:
        return False, type(e).__name__
    if status >= 400:
        return False, f"http {status}"
    return (True, "") if "application/pdf" in kind.lower() or body[:4] == b"%PDF" else (False, "no pdf")


def verified(urls: DataFrame, make: Callable[[], Fetch]) -> DataFrame:
    """url, ok, reason: whether each different url gives a PDF, by type or first bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make()
        for df in frames:
            got = [(u, *_probe(fetch, u)) for u in df["url"]]
            yield pd.DataFrame(got, columns=["url", "ok", "reason"])

    return urls.select("url").where("url is not null").distinct().mapInPandas(run, "url string, ok boolean, reason string")


def first_verified(papers: DataFrame, checked: DataFrame) -> DataFrame:
    """cand_id, url, ok, reason of papers (cand_id, urls): the first url that is a PDF, else the last one tried."""
    each = papers.select("cand_id", F.posexplode("urls").alias("k", "url")).join(checked, "url")
    place = F.struct(F.when(F.col("ok"), 0).otherwise(1), F.when(F.col("ok"), F.col("k")).otherwise(-F.col("k")))
    return each.groupBy("cand_id").agg(F.min_by(F.struct("url", "ok", "reason"), place).alias("x")).select("cand_id", "x.*")


def downloaded(papers: DataFrame, make: Callable[[], Fetch], store: Callable[[str, bytes], str], only_open: bool = True) -> DataFrame:
    """cand_id, status, url, path, attempts: each paper's urls (cand_id, is_oa, urls) tried in order until one gives a PDF.

    ``store`` puts the bytes where all executors can reach and returns the path; it is called again if
    a task is repeated, so it should replace.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make()
        for df in frames:
            got = []
            for i, is_open, urls in zip(df["cand_id"], df["is_oa"], df["urls"], strict=True):
                urls = list(urls) if urls is not None else []
                if only_open and not is_open:
                    got.append((i, "skipped_non_oa", None, None, "[]"))
                    continue
                tried, hit = [], None
                for u in urls:
                    try:
                        status, kind, body = fetch(u)
                        good = status < 400 and ("application/pdf" in kind.lower() or body[:4] == b"%PDF")
                    except Exception as e:
                        tried.append({"url": u, "reason": type(e).__name__})
                        continue
                    if good:
                        hit = (u, store(f"{i}.pdf", body))
                        break
                    tried.append({"url": u, "reason": "no pdf" if status < 400 else f"http {status}"})
                got.append((i, "downloaded" if hit else "download_failed" if urls else "metadata_only", *(hit or (None, None)), json.dumps(tried)))
            yield pd.DataFrame(got, columns=["cand_id", "status", "url", "path", "attempts"])

    return papers.select("cand_id", F.coalesce("is_oa", F.lit(False)).alias("is_oa"), "urls").mapInPandas(run, "cand_id bigint, status string, url string, path string, attempts string")


def file_store(folder: str) -> Callable[[str, bytes], str]:
    """A store in a shared folder."""

    def put(name: str, body: bytes) -> str:
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, name)
        with open(path + ".part", "wb") as f:
            f.write(body)
        os.replace(path + ".part", path)
        return path

    return put
