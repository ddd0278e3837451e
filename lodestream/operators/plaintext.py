"""Plain texts of papers: cleaning of lines, headings, sections between headings and between start and end marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import text

# ---- fixed values: marks of abstracts and introductions, lengths ----
ABSTRACT_ENDS = ["introduction", "keyword", "©", "elsevier", "k e y w o r d s", "i n t r o d u c t i o n", "doi"]
INTRODUCTION_STARTS = ["introduction", "1."]
INTRODUCTION_ENDS = ["results", "method", "experimental", "2."]
HEADING_LENGTH, LONG_LINE, ABSTRACT_LENGTH = 120, 400, (100, 3000)
# ---- end of fixed values ----

_LINE = r"\r\n|[\r\n]"


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), _LINE)


def cleaned(c: Column, repeats: int = 10, longest: int | None = None, hyphens: bool = False) -> Column:
    """A text without one-character lines, footnotes and lines that stand over ``repeats`` times (over ``longest`` characters too, if asked), empty lines closed up.

    Lines go as lines: what they hold stays where it stands inside others. With ``hyphens`` words cut at a line end
    are joined and all lines make one.
    """
    kept = F.filter(lines(c), lambda x: (F.length(x) != 1) & ~F.lower(x).startswith("footnote"))
    if longest is not None:
        kept = F.filter(kept, lambda x: F.length(x) < longest)
    held = F.transform(kept, lambda x: F.struct(x.alias("line"), F.size(F.filter(kept, lambda y: y == x)).alias("n")))
    few = F.transform(F.filter(held, lambda s: (s["n"] <= repeats) | (F.length(F.trim(s["line"])) == 0)), lambda s: s["line"])
    if hyphens:
        return F.trim(F.array_join(F.transform(F.filter(few, lambda x: F.length(x) > 0), lambda x: F.when(x.endswith("-"), F.regexp_replace(x, "-$", "")).otherwise(F.concat(x, F.lit(" ")))), ""))
    return F.regexp_replace(F.array_join(few, "\n"), "\n{2,}", "\n")


def repeated(docs: DataFrame, id_col: str, content: str, repeats: int = 10) -> DataFrame:
    """id, text: as the repetition rule of ``cleaned``, for texts of very many lines: counted by a join of each line with its number, not inside a row."""
    each = docs.select(id_col, F.posexplode(lines(F.col(content))).alias("k", "line"))
    often = each.where(F.length(F.trim("line")) > 0).groupBy(id_col, "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > repeats).select(id_col, "line")
    kept = each.join(often, [id_col, "line"], "left_anti")
    return kept.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s["line"]), "\n").alias("text"))


def marked_heading(line: Column) -> Column:
    """The heading of a markdown or LaTeX line, else null."""
    s = F.trim(line)
    latex = F.regexp_extract(s, r"^\\(?:sub)*section\*?\{(.+?)\}\s*$", 1)
    return F.when(s.rlike(r"^#{1,6}\s+\S"), F.trim(F.regexp_replace(s, "^#+", ""))).when(F.length(latex) > 0, F.trim(latex))


def plain_heading(line: Column) -> Column:
    """The heading that a plain line is: a section's name, numbered words, or capitals with a section's name; else null."""
    s = F.trim(line)
    names = [n for ns in text.SECTION_TITLES.values() for n in ns]
    title = text.title_text(F.when(s.rlike(r"^(?:\p{L} )+\p{L}$"), F.replace(s, F.lit(" "), F.lit(""))).otherwise(s))
    numbered = s.rlike(r"^(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.)\s+[A-Z][A-Za-z /&-]{2,}$")
    capitals = (s == F.upper(s)) & (s != F.lower(s)) & title.rlike("|".join(n for n in names))
    return F.when((F.length(s) > 0) & (F.length(s) <= HEADING_LENGTH) & (title.isin(names) | numbered | capitals), s)


def headings(docs: DataFrame, id_col: str, content: str, marked: bool) -> DataFrame:
    """id, line, heading, section of the lines of each text that head a section of a known name."""
    each = docs.select(id_col, F.posexplode(lines(F.col(content))).alias("line", "s"))
    head = each.withColumn("heading", marked_heading(F.col("s")) if marked else plain_heading(F.col("s"))).where("heading is not null")
    return head.withColumn("section", text.heading_label(F.col("heading"))).where("section is not null").select(id_col, "line", "heading", "section")


def extracted(docs: DataFrame, id_col: str, content: str, marked: bool, wanted: list[str] | None = None, fallback: bool = True) -> DataFrame:
    """id, section, heading, first, last, content: the sections of each text, from a heading to the next.

    Of a section the first with content counts. Where a text has no abstract or introduction heading
    the marks of these decide (``between_marks``), if ``fallback``.
    """
    found = headings(docs, id_col, content, marked)
    ends = found.withColumn("next", F.lead("line").over(Window.partitionBy(id_col).orderBy("line")))
    body = ends.join(docs.select(id_col, lines(F.col(content)).alias("_l")), id_col)
    stop = F.coalesce("next", F.size("_l"))
    cut = body.select(id_col, "section", "heading", (F.col("line") + 1).alias("first"), (stop - 1).alias("last"), F.trim(F.array_join(F.slice("_l", F.col("line") + 2, F.greatest(F.lit(0), stop - F.col("line") - 1)), "\n")).alias("content")).where(F.length("content") > 0)
    out = cut.withColumn("_k", F.row_number().over(Window.partitionBy(id_col, "section").orderBy("first"))).where("_k = 1").drop("_k")
    if fallback:
        marks = between_marks(docs, id_col, content).join(out.select(id_col, "section"), [id_col, "section"], "left_anti")
        out = out.unionByName(marks.select(out.columns))
    return out.where(F.col("section").isin(wanted)) if wanted else out


def _starts(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.startswith(w)
    return out


def between_marks(docs: DataFrame, id_col: str, content: str) -> DataFrame:
    """id, section, heading, first, last, content of abstracts and introductions by the lines that begin and end them.

    An abstract begins after the line that names it (letter-spaced too) and ends before a line that
    holds one of ``ABSTRACT_ENDS`` or at the end; an introduction has to be closed by a line that begins the next section.
    """
    l = lines(F.col(content))  # noqa: E741
    low = F.transform(l, F.lower)
    names = F.transform(low, lambda x: F.contains(F.replace(x, F.lit(" "), F.lit("")), F.lit("abstract")))
    ends = F.transform(low, lambda x: x.rlike("|".join(ABSTRACT_ENDS)))
    begins = F.transform(low, lambda x: _starts(x, INTRODUCTION_STARTS))
    closes = F.transform(low, lambda x: _starts(x, INTRODUCTION_ENDS))
    rows = docs.select(id_col, l.alias("_l"), names.alias("_a"), ends.alias("_e"), begins.alias("_b"), closes.alias("_c"))
    at = F.array_position("_a", True)
    after = lambda flags, pos: F.array_position(F.slice(flags, F.greatest(pos + 1, F.lit(1)).cast("int"), F.size(flags)), True)
    abstract = rows.withColumn("p", at).where("p > 0").withColumn("q", after("_e", F.col("p"))).withColumn("n", F.when(F.col("q") > 0, F.col("q") - 1).otherwise(F.size("_l") - F.col("p")))
    intro = rows.withColumn("p", F.array_position("_b", True)).where("p > 0").withColumn("q", after("_c", F.col("p"))).where("q > 0").withColumn("n", F.col("q") - 1)
    take = lambda df, name: df.select(id_col, F.lit(name).alias("section"), F.lit(name).alias("heading"), F.col("p").cast("int").alias("first"), (F.col("p") + F.col("n") - 1).cast("int").alias("last"), F.trim(F.array_join(F.slice("_l", F.col("p").cast("int") + 1, F.greatest(F.lit(0), F.col("n").cast("int"))), "\n")).alias("content"))
    return take(abstract, "abstract").unionByName(take(intro, "introduction")).where(F.length("content") > 0)


def doi_in(c: Column) -> Column:
    """The first DOI in a text; null for none."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]*[A-Z0-9])", 1)
    return F.when(F.length(found) > 0, found)


def token_estimate(c: Column) -> Column:
    """Tokens of a text where no tokenizer is at hand: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("bigint")
