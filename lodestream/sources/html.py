"""Links and tables of HTML pages, locations of XML site maps."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from typing import ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Page(HTMLParser):
    """A page as its links and table rows, from one walk over the tags.

    Open elements of interest stand on a stack; text goes to all of them, so a link in a cell, or a
    table in a cell, is read with the text around it. An element that ends closes what is open in it.
    """

    HELD = frozenset(("a", "table", "tr", "td", "th"))
    #: What a new element ends where its end tag was left out.
    ENDS: ClassVar[dict[str, tuple[str, ...]]] = {"a": ("a",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}

    def __init__(self, html: str | None):
        super().__init__()
        self.links: list[tuple[str, str]] = []
        self.rows: list[list[str]] = []
        self._open: list[tuple[str, str, list]] = []  # (tag, href, texts or cells)
        self.feed(html or "")
        self.close()

    def _level(self, *tags: str) -> int | None:
        """Where the innermost of the tags is open, within the innermost table."""
        for k in reversed(range(len(self._open))):
            if self._open[k][0] in tags:
                return k
            if self._open[k][0] == "table":
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HELD:
            if (k := self._level(*self.ENDS.get(tag, ()))) is not None:
                self._finish(k)
            self._open.append((tag, dict(attrs).get("href") or "", []))

    def handle_data(self, data: str) -> None:
        for tag, _, texts in self._open:
            if tag in ("a", "td", "th"):
                texts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HELD and (k := self._level(tag)) is not None:
            self._finish(k)

    def _finish(self, k: int) -> None:
        while len(self._open) > k:
            tag, href, held = self._open.pop()
            if tag == "a" and href.strip():
                self.links.append((href.strip(), " ".join("".join(held).split())))
            elif tag in ("td", "th") and (row := self._level("tr")) is not None:
                self._open[row][2].append(" ".join("".join(held).split()))
            elif tag == "tr" and any(held):
                self.rows.append(held)


def links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, href, text of every link with a target; null pages give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = []
            for i, html in zip(df["id"], df["html"], strict=True):
                got += [(i, *x) for x in Page(html).links]
            yield pd.DataFrame(got, columns=["id", "href", "text"])

    return pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).alias("html")).mapInPandas(run, "id bigint, href string, text string").withColumnRenamed("id", id_col)


def tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, row_no, cells of every table row that isn't wholly empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = []
            for i, html in zip(df["id"], df["html"], strict=True):
                got += [(i, n, r) for n, r in enumerate(Page(html).rows)]
            yield pd.DataFrame(got, columns=["id", "row_no", "cells"])

    return pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).alias("html")).mapInPandas(run, "id bigint, row_no int, cells array<string>").withColumnRenamed("id", id_col)


def locations(xml: Column) -> Column:
    """Texts of all loc elements of a site map."""
    return F.xpath(xml, F.lit("//*[local-name()='loc']/text()"))


def in_domain(url: Column, domain: str, strict: bool = False) -> Column:
    """The host of a url ends in a domain; ``strict`` asks for a dot before it."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    ends = host.endswith(domain.lower())
    return F.coalesce(ends & ((host == domain.lower()) | host.endswith("." + domain.lower())) if strict else ends, F.lit(False))


def is_pdf(url: Column) -> Column:
    u = F.lower(url)
    return F.coalesce(u.endswith(".pdf") | F.contains(u, F.lit("/pdf")) | F.contains(u, F.lit("download=true")), F.lit(False))
