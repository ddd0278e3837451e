"""Column functions on text: cleaning, tokenizers, sentences, slugs, identifiers, section titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns, stop words, section titles ----
TOKEN_A = r"[A-Za-z0-9_.+%-]+"
TOKEN_C = r"[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)*"
STOP_A = ["the", "a", "an", "and", "or", "of", "in", "to", "for", "with", "what", "which", "how", "is", "are", "was", "were", "their", "paper", "according", "provided", "section"]
SECTION_TITLES = {
    "abstract": ["abstract", "summary"],
    "introduction": ["introduction", "background"],
    "methods": ["method", "methods", "methodology", "materials and methods", "method and materials", "approach", "proposed method"],
    "experimental": ["experimental", "experimental setup", "experiment setup", "experimental details", "implementation details"],
    "experiments": ["experiment", "experiments", "experimental evaluation"],
    "evaluation": ["evaluation", "evaluation setup", "benchmark evaluation"],
    "results": ["result", "results", "results and discussion", "experimental results", "main results"],
    "discussion": ["discussion", "analysis", "discussion and conclusions"],
    "ablation": ["ablation", "ablation study", "ablation studies", "ablations"],
    "conclusion": ["conclusion", "conclusions", "concluding remarks"],
}
NOISE_TITLES = ["references", "reference", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements", "author information", "associated content", "supporting information", "supplemental information", "supplementary information", "supplementary references", "supplementary figures", "keywords", "for table of contents only"]
METHOD_WORDS = ["apparatus", "calculation", "calculations", "characterization", "computation", "computational", "device characterization", "experimental section", "fabrication", "materials", "measurement", "measurements", "method", "microscopy", "modeling", "paramagnetic resonance", "preparation", "resonance", "sample preparation", "simulation", "spectroscopy", "synthesis", "x-ray diffraction"]
RESULT_WORDS = ["comparison", "effect of", "influence of", "mechanism", "properties", "results", "response", "transport"]
# ---- end of fixed values ----


def clean(c: Column) -> Column:
    """Every run of Unicode white space as one space, ends stripped; null is ""."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def tokens_a(c: Column) -> Column:
    """Lower-case tokens of over two characters that are no stop words, with repeats."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN_A), F.lit(0)), F.lower)
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(STOP_A))


def tokens_c(c: Column) -> Column:
    """Alphanumeric tokens with inner hyphens, underscores and slashes, case-folded (ß as ss), with repeats."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN_C), F.lit(0)), lambda t: F.replace(F.lower(t), F.lit("ß"), F.lit("ss")))


def sentences(c: Column) -> Column:
    """Sentences: cut after . ! ? before white space and at line ends; blank ones dropped."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.length(F.trim(s)) > 0)


def truncate(c: Column, limit: int, mark: str = "...") -> Column:
    """At most ``limit`` characters, the end replaced by ``mark`` where something is cut."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - len(mark))), F.lit(mark))).otherwise(c)


def slug(c: Column) -> Column:
    """Lower case, every run of other than letters and figures as a hyphen, no hyphen at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def doi(c: Column) -> Column:
    """A DOI without a resolver prefix; blank is null."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"(?i)^https?://(dx\.)?doi\.org/", ""))
    return F.when(F.length(bare) > 0, bare)


def year(c: Column) -> Column:
    """The first year between 1900 and 2099 in a text."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"((?:19|20)\d{2})", 1).try_cast("int")


def title_text(c: Column) -> Column:
    """A section title without markup, number and closing marks, in lower case."""
    t = clean(c)
    t = F.regexp_replace(t, r"^#+\s*", "")
    t = F.regexp_replace(t, r"\\(?:sub)*section\*?\{(.+?)\}", "$1")
    t = F.regexp_replace(t, r"^\d+(?:\.\d+)*\.?\s+", "")
    t = F.regexp_replace(t, r"(?i)^[IVXLC]+\.\s+", "")
    return F.lower(F.regexp_replace(t, r"[:.\-]+$", ""))


def _either(names: list[str]) -> str:
    return "(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")"


def section_label(c: Column) -> Column:
    """Canonical section of a title: exact alias, alias at its beginning, noise, then method and result words.

    One pattern a label, so that the expression stays small enough to be compiled.
    """
    t = title_text(c)
    out = F.when(F.length(t) == 0, F.lit("other"))
    for label, names in SECTION_TITLES.items():
        out = out.when(t.isin(names), F.lit(label))
    for label, names in SECTION_TITLES.items():
        out = out.when(t.rlike(f"^{_either(names)}[ :]"), F.lit(label))
    out = out.when(t.rlike(f"^{_either(NOISE_TITLES)}"), F.lit("other"))
    return out.when(t.rlike(_either(METHOD_WORDS)), F.lit("methods")).when(t.rlike(_either(RESULT_WORDS)), F.lit("results")).otherwise(F.lit("other"))


def heading_label(c: Column) -> Column:
    """As section_label, with letter-spaced headings closed up; a heading that names none is null."""
    t = clean(c)
    closed = F.when(t.rlike(r"^(?:\p{L} )+\p{L}$"), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t)
    label = section_label(closed)
    return F.when(label != "other", label)


def number_root(c: Column) -> Column:
    """The first number of a numbered title ("2.1 Setup" -> "2"), else null."""
    found = F.regexp_extract(clean(c), r"^(\d+)(?:\.\d+)*\.?\s+", 1)
    return F.when(F.length(found) > 0, found)
