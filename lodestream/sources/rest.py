"""A paged search service as a Python data source, one partition for each source and term.

Where there is no network, recorded pages stand in: ``<source>__<term>__<page>.json`` files in a folder
that all executors share, each an object with ``results`` and, if there is a next page, ``next``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Slice(InputPartition):
    def __init__(self, source: str, term: str):
        self.source, self.term = source, term


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.limit = options["folder"], int(options.get("limit", 0))
        self.sources, self.terms = options["sources"].split(","), options["terms"].split(",")
        self.optional = options.get("missing", "error") == "skip"

    def partitions(self) -> list[InputPartition]:
        return [_Slice(s, t) for s in self.sources for t in self.terms]

    def _page(self, source: str, term: str, page: str) -> dict:
        path = os.path.join(self.folder, f"{source}__{term}__{page}.json")
        if not os.path.exists(path):
            if self.optional:
                return {}
            raise FileNotFoundError(f"no recorded page {path}")
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        return got if isinstance(got, dict) else {}

    def read(self, partition: _Slice) -> Iterator[tuple]:
        """The results of all pages in order, each work once, up to the limit of a term."""
        seen: set[str] = set()
        page: str | None = "1"
        walked: set[str] = set()
        while page and page not in walked:
            walked.add(page)
            got = self._page(partition.source, partition.term, page)
            for r in got.get("results") or []:
                if not isinstance(r, dict):
                    continue
                key = str(r.get("doi") or r.get("landing_url") or (r.get("title"), r.get("year"))).lower()
                if key in seen:
                    continue
                seen.add(key)
                year = r.get("year")
                yield partition.source, partition.term, r.get("title"), r.get("doi"), year if isinstance(year, int) else None, json.dumps(r.get("abstract_inverted_index")) if r.get("abstract_inverted_index") else None
                if self.limit and len(seen) >= self.limit:
                    return
            page = str(got["next"]) if got.get("next") else None


class SearchSource(DataSource):
    """spark.read.format("search").options(folder=..., sources="a,b", terms="x,y").load()

    A missing page is an error, so that no result is silently short; ``missing="skip"`` takes it as empty.
    """

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return "source string, term string, title string, doi string, year int, abstract_index string"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(dict(self.options))
