"""Terms and vocabularies: labels, predicates, occurrences in texts, synonyms, acronyms, categories, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import text

# ---- fixed values: what makes a poor label, units of literals ----
HEADINGS = ["domain terms", "evidence terms", "table-derived", "figure-derived", "experimental settings", "numeric values", "methods /", "quantities /"]
CLAUSES = [" is ", " are ", " was ", " were ", " be ", " been ", " being ", " shows ", " show ", " indicates ", " induces ", " indicate ", " suggests ", " suggest ", " causes ", " cause ", " leads to ", " related to ", " due to "]
GENERIC_WORDS = ["behavior", "composite", "data", "dependency", "dependencies", "effect", "evidence", "experiment", "figure", "measurement", "method", "model", "process", "region", "regions", "result", "results", "sample", "signals", "system", "value", "values"]
GENERIC_PHRASES = ["paired signals"]
STARTS = ["end of ", "lack of ", "presence of ", "absence of "]
HOLDS = ["arrow", "caption", "see text", " around "]
FIGURE = r"(?:fig(?:ure)?|table|eq(?:uation)?)\.?\s*\d+[a-z]?"
PANEL = r"(?:left|right|upper|lower|middle|top|bottom)(?:\s+panel)?"
BARE = r"[-+−]?\d+(?:\.\d+)?\s*(?:k?oe|k|nm|pa|ma|kv|g/cm3|%)"
WORD = r"[A-Za-z0-9.+/%\[\]-]+"
LONGEST, MOST_WORDS = 96, 6
LITERAL_UNITS = "ms|s|sec|min|h|kg|g|mg|ug|m|cm|mm|um|nm|K|C|F|Hz|kHz|MHz|GHz|Pa|bar|V|A|W|J|mol|M|mM|uM"
NONE_TERMS = ["none", "not explicitly present"]
# ---- end of fixed values ----

_W = r"\p{L}\p{N}_"


def strip(c: Column) -> Column:
    """A text without white space (Unicode) at its ends; null is ""."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def label(c: Column) -> Column:
    """A term without marks and enumerators, white space as one space; null is ""."""
    s = F.replace(strip(c), F.lit("**"), F.lit(""))
    s = F.regexp_replace(s, r"^[`*_\s]+|[`*_\s]+$", "")
    s = F.regexp_replace(s, r"^\(?[a-zA-Z0-9]+\)?[:.)]\s+", "")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def _any(c: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(c, F.lit(p))
    return found


def good_node(c: Column) -> Column:
    """A label that may name a node: no heading, clause, figure, panel, generic word or bare quantity, and not too long."""
    low = F.lower(c)
    words = F.size(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)))
    starts = F.lit(False)
    for s in STARTS:
        starts = starts | low.startswith(s)
    bad = (
        _any(low, HEADINGS) | low.isin(GENERIC_PHRASES) | _any(low, CLAUSES) | low.rlike(rf"^{FIGURE}$") | low.rlike(rf"\({FIGURE}\)") | low.rlike(rf"^{PANEL}$") | starts | _any(low, HOLDS)
        | c.endswith(".") | c.endswith(":") | (F.length(c) > LONGEST) | (words > MOST_WORDS) | ((words == 1) & low.isin(GENERIC_WORDS)) | low.rlike(rf"^{BARE}$")
    )
    return F.coalesce((F.length(c) > 0) & ~bad, F.lit(False))


def literal_object(value: Column, content: Column) -> Column:
    """A value that stands in a text (case aside) and holds a figure or a unit."""
    v = strip(value)
    looks = v.rlike(r"\d") | v.rlike(rf"(?:^|[^{_W}])(?:{LITERAL_UNITS}|percent)(?:$|[^{_W}])|[{_W}]%[{_W}]")
    return F.coalesce((F.length(v) > 0) & F.contains(F.lower(content), F.lower(v)) & looks, F.lit(False))


def numeric_literal(c: Column) -> Column:
    """A number with or without a unit, or a text that is mostly figures."""
    s = strip(c)
    figures = F.length(F.regexp_replace(s, "[^0-9]", ""))
    half = F.greatest(F.lit(1), F.floor(F.length(F.replace(s, F.lit(" "), F.lit(""))) / 2))
    return (F.length(s) > 0) & (s.rlike(rf"^[\d.,+\-]+(?:\s*(?:%|percent|{LITERAL_UNITS}))?$") | (figures >= half))


def noisy(c: Column, longest: int | None = None) -> Column:
    """A term of no use to a taxonomy: blank, too long, a literal, a word for none."""
    s = strip(c)
    out = (F.length(s) == 0) | numeric_literal(c) | F.lower(s).isin(NONE_TERMS)
    return out if longest is None else out | (F.length(s) > longest)


def universal_id(c: Column) -> Column:
    """One id for the spellings of a word: hyphens as spaces, lower case, white space as one space."""
    return F.array_join(F.filter(F.split(F.lower(F.replace(c, F.lit("-"), F.lit(" "))), r"\s+"), lambda w: F.length(w) > 0), " ")


def distinct_terms(rows: DataFrame, keys: list[str], term: str, order: list[Column]) -> DataFrame:
    """The first row of each label (case aside) in each group."""
    one = Window.partitionBy(*keys, F.lower(label(F.col(term)))).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")


def selected_terms(rows: DataFrame, keys: list[str], term: str, order: list[Column], most: int = 90, longest: int = 120) -> DataFrame:
    """The first ``most`` different terms of each group that are no noise, stripped."""
    kept = rows.withColumn(term, strip(F.col(term))).where(~noisy(F.col(term), longest))
    first = kept.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, F.lower(term)).orderBy(*order))).where("_k = 1")
    return first.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


# ------------------------------------------------------------ vocabularies


def vocabulary(terms: DataFrame, acronyms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, uid, synonym: spellings of each term of a group; terms: keys, term; acronyms: keys, acronym, meaning.

    A term that is an acronym falls away, "(ACR)" is cut from terms of its group; a spelling
    without hyphens is one too. Each acronym and its meaning belong to the meaning's id.
    """
    clean = terms.select(*keys, F.replace("term", F.lit("*"), F.lit("")).alias("term")).where(F.col("term").isNotNull())
    plain = clean.join(acronyms.select(*keys, F.col("acronym").alias("term")), [*keys, "term"], "left_anti")
    listed = acronyms.where("acronym is not null and meaning is not null").groupBy(*keys).agg(F.array_sort(F.collect_set(F.concat(F.lit("("), "acronym", F.lit(")")))).alias("marks"))
    stripped = F.aggregate(F.coalesce("marks", F.array().cast("array<string>")), F.col("term"), lambda s, m: F.when(F.contains(F.col("term"), m), F.trim(F.replace(s, m, F.lit("")))).otherwise(s))
    bare = plain.join(listed, keys, "left").select(*keys, "term", stripped.alias("bare"))
    spelled = bare.select(*keys, universal_id(F.col("bare")).alias("uid"), F.explode(F.array("term", "bare", F.replace("bare", F.lit("-"), F.lit(" ")))).alias("synonym"))
    meant = acronyms.where("acronym is not null and meaning is not null").select(*keys, universal_id(F.col("meaning")).alias("uid"), F.explode(F.array("acronym", "meaning")).alias("synonym"))
    return spelled.unionByName(meant).distinct()


def synonym_nodes(spellings: DataFrame) -> DataFrame:
    """synonym, uid, name, repeated: the node that a spelling names over all groups.

    A node is an id with the union of its spellings and is named by the first of them in text
    order; a spelling of several ids goes to the last id, and is marked as repeated.
    """
    pairs = spellings.select("uid", "synonym").distinct()
    names = pairs.groupBy("uid").agg(F.min("synonym").alias("name"))
    last = pairs.groupBy("synonym").agg(F.max("uid").alias("uid"), (F.count(F.lit(1)) > 1).alias("repeated"))
    return last.join(names, "uid").select("synonym", "uid", "name", "repeated")


def known_relationships(rows: DataFrame, terms: DataFrame, content: Column | None = None) -> DataFrame:
    """rows (subject, relation, object) whose subject is a term and whose object is one too, or a literal of ``content`` (case aside)."""
    low = terms.select(F.lower("term").alias("_t")).distinct()
    subject = rows.join(low.withColumnRenamed("_t", "_s"), F.lower("subject") == F.col("_s"), "left_semi")
    marked = subject.join(low.withColumn("_known", F.lit(True)), F.lower("object") == F.col("_t"), "left").drop("_t")
    keep = F.col("_known").isNotNull() if content is None else F.col("_known").isNotNull() | literal_object(F.col("object"), content)
    return marked.where(keep).drop("_known")


def known_definitions(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows (term, definition) whose term is known (case aside)."""
    return rows.join(terms.select(F.lower("term").alias("_t")).distinct(), F.lower(rows["term"]) == F.col("_t"), "left_semi")


def stated_acronyms(rows: DataFrame, content: Column) -> DataFrame:
    """rows (acronym, meaning) of which both stand in a text (case aside)."""
    body = F.lower(content)
    return rows.where(F.contains(body, F.lower("acronym")) & F.contains(body, F.lower("meaning")))


# ------------------------------------------------------------ occurrences


def _listed(terms: DataFrame, most: int) -> list[str]:
    """The distinct terms in lower case for an automaton that every task holds; more than ``most`` are refused."""
    rows = terms.select(F.lower("term").alias("t")).where(F.length("t") > 0).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"at most {most} terms are sent to the tasks")
    return sorted(r["t"] for r in rows)


def _automaton(words: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    if words:
        a.make_automaton()
    return a


def containing(rows: DataFrame, id_col: str, content: str, terms: DataFrame, most: int = 1_000_000) -> DataFrame:
    """id, term: the terms (lower case) that stand anywhere in a text, each once a row; one pass over the text for all terms."""
    words = _listed(terms, most)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = _automaton(words)
        for df in frames:
            got = [(i, w) for i, t in zip(df["id"], df["t"], strict=True) if words for w in {w for _, w in a.iter(t)}]
            yield pd.DataFrame(got, columns=["id", "term"])

    kind = dict(rows.dtypes)[id_col]
    found = rows.select(F.col(id_col).alias("id"), F.lower(content).alias("t")).where(F.length("t") > 0).mapInPandas(run, f"id {kind}, term string")
    return found.withColumnRenamed("id", id_col)


#: The character before or after a term that makes an occurrence, in order of preference.
SIDES = [(-1, " "), (1, " "), (-1, "."), (1, "."), (-1, ","), (1, ","), (-1, "("), (1, ")")]


def occurrences(docs: DataFrame, id_col: str, content: str, terms: DataFrame, bounded: bool = True, most: int = 1_000_000) -> DataFrame:
    """id, term, start, end, sentence: where each term (lower case) stands in the sentences of a text, once a sentence.

    An occurrence has one of ``SIDES`` at its side, of several the one earliest in that list, then in the
    sentence; without ``bounded`` any other place counts last. start and end count over the
    sentences joined by one character. Null and empty texts have none.
    """
    words = _listed(terms, most)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = _automaton(words)
        for df in frames:
            got = []
            for i, sentences in zip(df["id"], df["s"], strict=True):
                offset = 0
                for n, s in enumerate(sentences if words else ()):
                    best: dict[str, tuple[int, int]] = {}
                    for end, w in a.iter(s):
                        start = end + 1 - len(w)
                        around = {-1: s[start - 1 : start] if start else "", 1: s[end + 1 : end + 2]}
                        rank = next((k for k, (side, c) in enumerate(SIDES) if around[side] == c), len(SIDES))
                        if (rank < len(SIDES) or not bounded) and (rank, start) < best.get(w, (99, 0)):
                            best[w] = (rank, start)
                    got += [(i, w, offset + start, offset + start + len(w), n) for w, (_, start) in best.items()]
                    offset += len(s) + 1
            yield pd.DataFrame(got, columns=["id", "term", "start", "end", "sentence"])

    kind = dict(docs.dtypes)[id_col]
    cut = docs.select(F.col(id_col).alias("id"), F.transform(text.sentences(F.col(content)), F.lower).alias("s")).where(F.size("s") > 0)
    return cut.mapInPandas(run, f"id {kind}, term string, start bigint, end bigint, sentence int").withColumnRenamed("id", id_col)


def spaceless(term: str, content: str) -> list[tuple[int, int]]:
    """(start, end) in a text of the places of a term, white space in both aside (case too)."""
    places = [k for k, c in enumerate(content) if not c.isspace()]
    squashed, wanted = "".join(content[k] for k in places).lower(), "".join(term.split()).lower()
    return [(places[m.start()], places[m.end() - 1] + 1) for m in re.finditer(re.escape(wanted), squashed)] if wanted else []


# ------------------------------------------------------------ chunks and categories

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _packed(parts: list[str], limit: int, glue: str) -> list[str]:
    """Parts joined while the chunk stays within the limit; a longer part is a chunk of its own."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(p) <= limit:
            out[-1] += glue + p
        else:
            out.append(p)
    return out


def _table_parts(block: str, limit: int) -> list[str]:
    """A table in parts of whole rows, its head repeated in each."""
    lines = block.splitlines()
    at = next((k for k, x in enumerate(lines) if x.strip() == "Rows:"), len(lines))
    rows = [x for x in lines[at + 1 :] if x.startswith("- ")]
    if len(block) <= limit:
        return [block]
    if not rows:
        return _packed([s.strip() for s in _SENTENCE.split(block) if s.strip()], limit, " ")
    head = "\n".join([*lines[: at + 1], *(x for x in lines[at + 1 :] if not x.startswith("- "))]).strip()
    out = [head]
    for r in rows:
        if len(out[-1]) + 1 + len(r) > limit and out[-1] != head:
            out.append(head)
        out[-1] += "\n" + r
    return out


def table_chunks(content: str | None, limit: int) -> list[str]:
    """Chunks of a text in which "[TABLE " blocks (to the next blank line) stand alone; long tables are cut between rows."""
    blocks: list[tuple[bool, list[str]]] = []
    table = False
    for line in (content or "").splitlines():
        if line.strip().startswith("[TABLE "):
            blocks.append((True, []))
            table = True
        elif not blocks:
            blocks.append((False, []))
        blocks[-1][1].append(line)
        if table and not line.strip():
            blocks.append((False, []))
            table = False
    out: list[str] = []
    loose = ""
    for is_table, lines in blocks:
        block = "\n".join(lines).strip()
        if not block:
            continue
        for part in _table_parts(block, limit) if is_table else _packed([s.strip() for s in _SENTENCE.split(block) if s.strip()], limit, " "):
            if loose and (is_table or len(loose) + len(part) + 2 > limit):
                out.append(loose)
                loose = ""
            if is_table:
                out.append(part.strip())
            else:
                loose = f"{loose}\n\n{part}" if loose else part
    return [*out, loose] if loose else out


def categories(c: Column) -> Column:
    """(category, subcategory) of "Main Category ..: name" and "Subcategory ..: name" lines, in order; a category without any has a null one."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\r\n]"), lambda x: F.replace(F.trim(x), F.lit("*"), F.lit(""))), lambda x: F.length(x) > 0)
    after = lambda x: F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))
    pair = "array<struct<category:string,subcategory:string>>"
    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast(pair).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        name = after(x)
        main = x.startswith("Main Category") & F.contains(x, F.lit(":")) & (F.length(name) > 0)
        sub = x.startswith("Subcategory") & F.contains(x, F.lit(":")) & (F.length(name) > 0) & acc["now"].isNotNull()
        added = F.struct(F.when(main, name).otherwise(acc["now"]).alias("category"), F.when(sub, name).alias("subcategory"))
        return F.struct(F.when(main, name).otherwise(acc["now"]).alias("now"), F.when(main | sub, F.concat(acc["out"], F.array(added))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lines, start, step, lambda a: a["out"])


def category_text(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: numbered blocks of categories with their subcategories; pairs: keys, ord, category, subcategory."""
    subs = pairs.groupBy(*keys, "category").agg(F.min("ord").alias("ord"), F.transform(F.array_sort(F.collect_list(F.when(F.col("subcategory").isNotNull(), F.struct("ord", "subcategory")))), lambda x: x["subcategory"]).alias("subs"))
    lines = F.array_join(F.transform("subs", lambda s, i: F.concat(F.lit("    Subcategory "), (i + 1).cast("string"), F.lit(": "), s)), "\n")
    listed = subs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "category", lines.alias("lines")))).alias("l"))
    block = lambda x, i: F.concat(F.lit("Main Category "), (i + 1).cast("string"), F.lit(": "), x["category"], F.lit("\n\n"), x["lines"])
    return listed.select(*keys, F.array_join(F.transform("l", block), "\n\n").alias("text"))


def target_count(n: Column, ratio: float | None = None, given: int | None = None, least: int = 1) -> Column:
    """How many of n categories stay: the given number, else a share (halves to even), else all; at least ``least``, at most n."""
    wanted = F.lit(given) if given is not None else F.bround(n * F.lit(ratio)).cast("int") if ratio is not None else n
    return F.when(n <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(n, F.greatest(F.lit(max(1, least)), wanted)))).cast("int")


def protected(rows: DataFrame, keys: list[str], names: list[str], most: int) -> DataFrame:
    """rows (keys, ord, category, curated) that stay: curated ones and protected candidates; over ``most``, protected first, then by order."""
    kept = rows.withColumn("_p", F.lower("category").isin([n.lower() for n in names])).where(F.col("curated") | F.col("_p"))
    group = Window.partitionBy(*keys)
    limit = F.greatest(F.lit(most), F.sum(F.col("_p").cast("int")).over(group))
    place = F.row_number().over(group.orderBy(F.desc("_p"), "ord"))
    return kept.withColumn("_m", limit).withColumn("_k", place).where(F.col("_k") <= F.col("_m")).drop("_p", "_m", "_k")


def packed_context(rows: DataFrame, keys: list[str], order: str, content: str, each: int = 6000, total: int = 60_000) -> DataFrame:
    """keys, order, part: texts cut to ``each`` characters, in order, while their sum stays within ``total``; the last one is cut to what is left."""
    cut = rows.withColumn("part", F.substring(F.col(content), 1, each))
    earlier = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = cut.withColumn("_left", F.lit(total) - earlier).where("_left > 0")
    return left.select(*keys, order, F.expr("substring(part, 1, cast(_left as int))").alias("part"))
