"""Reading model output and dynamic JSON without failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_object(c: Column) -> Column:
    """A variant from text that holds a JSON object: fenced, with words around it or with trailing commas; else null."""
    bare = F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(inner, r",\s*([}\]])", "$1")
    return F.coalesce(*(F.try_parse_json(F.when(F.length(x) > 0, x)) for x in (bare, inner, mended)))


def list_items(c: Column) -> Column:
    """Terms of "- term" lines."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?m)^\s*[-*]\s+(.+?)\s*$"), F.lit(1)), lambda x: F.trim(x))


def triples(c: Column) -> Column:
    """(subject, relation, object) of "- a > r > b" lines of exactly three parts."""
    parts = F.transform(list_items(c), lambda x: F.transform(F.split(x, ">"), lambda y: F.trim(y)))
    whole = F.filter(parts, lambda p: F.size(p) == 3)
    return F.transform(whole, lambda p: F.struct(p[0].alias("subject"), p[1].alias("relation"), p[2].alias("object")))


def pairs(c: Column, listed: bool) -> Column:
    """(key, value) of "- key: value" lines (``listed``) or "key: value" lines, of exactly two parts; blank ones left out."""
    lines = list_items(c) if listed else F.split(F.coalesce(c, F.lit("")), r"\r\n|[\r\n]")
    parts = F.transform(lines, lambda x: F.transform(F.split(x, ":"), lambda y: F.trim(y)))
    whole = F.filter(parts, lambda p: (F.size(p) == 2) & (F.length(p[0]) > 0) & (F.length(p[1]) > 0))
    return F.transform(whole, lambda p: F.struct(p[0].alias("key"), p[1].alias("value")))


def kinds(c: Column) -> Column:
    """(child, parent) of "x: y", "x isA y" or "x is y" lines, in this order of preference."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\r\n]"), lambda x: F.regexp_replace(F.trim(x), r"^[-*]\s+", ""))
    cut = lambda x, sep: F.transform(F.split(x, sep, 2), lambda y: F.trim(y))
    both = F.transform(lines, lambda x: F.when(F.contains(x, F.lit(":")), cut(x, ":")).when(F.contains(x, F.lit(" isA ")), cut(x, " isA ")).when(F.contains(x, F.lit(" is ")), cut(x, " is ")))
    whole = F.filter(both, lambda p: (F.size(p) == 2) & (F.length(p[0]) > 0) & (F.length(p[1]) > 0))
    return F.transform(whole, lambda p: F.struct(p[0].alias("child"), p[1].alias("parent")))


def winner(c: Column) -> Column:
    """answer1 or answer2 where exactly one is named the winner, else null."""
    one, two = F.contains(F.lower(c), F.lit("winner=answer1")), F.contains(F.lower(c), F.lit("winner=answer2"))
    return F.when(one & ~two, "answer1").when(two & ~one, "answer2")


def from_inverted(index: Column) -> Column:
    """The text of an inverted index (word -> positions), words in order of position."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(places), lambda s: s["word"]), " ")
