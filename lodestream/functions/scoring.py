"""Column functions on scores: BM25, cosine, normalisation, relation hints, evaluators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: scores by relation, root nodes ----
HINTS = {"REPORTS_RESULT": 2.8, "MEASURES_METRIC": 2.4, "HAS_CONDITION": 2.2, "USES_METHOD": 1.8, "USES_MATERIAL": 1.5, "DEFINED_AS": 1.0, "isA": 0.5}
HINT_FAMILIES = [(("RESULT", "FINDING"), 2.5), (("METRIC", "MEASURE", "VALUE"), 2.2), (("CONDITION", "SETTING"), 2.0), (("METHOD", "TECHNIQUE"), 1.6), (("MATERIAL", "SAMPLE"), 1.4)]
ROOTS = ["root", "thing", "entity"]
CLAIM_PRIORITY = {"REPORTS_RESULT": 5, "HAS_VALUE": 5, "INDICATES": 5, "HAS_CONDITION": 4, "MEASURES_METRIC": 3, "HAS_PROPERTY": 3, "SHOWS": 3, "REPRESENTS": 2, "USES_METHOD": 2, "USES_MATERIAL": 1, "EVIDENCED_BY": 1}
# ---- end of fixed values ----


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length of two vectors, 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, z: s + z)
    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(total(F.transform(x, lambda p: p.cast("double") * p.cast("double")))) * F.sqrt(total(F.transform(y, lambda p: p.cast("double") * p.cast("double"))))
    return F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))


def bm25_term(tf: Column, length: Column, n: float, df: float, mean: float, k1: float = 1.5, b: float = 0.75) -> Column:
    """The BM25 summand of one query token, with idf = ln(1 + (N - df + .5) / (df + .5))."""
    import math

    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.when(tf > 0, F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean or 1.0)))).otherwise(F.lit(0.0))


def scaled_a(score: Column, low: Column, high: Column) -> Column:
    """Min-max, all 0 where the maximum isn't positive; of equal scores the positive ones are 1."""
    return F.when(high <= 0, 0.0).when(high - low < 1e-9, F.when(score > 0, 1.0).otherwise(0.0)).otherwise((score - low) / (high - low))


def scaled_b(score: Column, low: Column, high: Column) -> Column:
    """Min-max; equal scores are all 1 where positive, else all 0."""
    return F.when(high - low < 1e-9, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((score - low) / (high - low))


def relation_hint(relation: Column) -> Column:
    """Score of a relation: by name, else by the family its name holds, else 1."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, x in HINTS.items():
        out = out.when(relation == name, F.lit(x))
    for words, x in HINT_FAMILIES:
        holds = F.lit(False)
        for w in words:
            holds = holds | F.contains(F.upper(relation), F.lit(w))
        out = out.when(holds, F.lit(x))
    return out.otherwise(F.lit(1.0))


def claim_priority(relation: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, x in CLAIM_PRIORITY.items():
        out = out.when(relation == name, F.lit(x))
    return out.otherwise(F.lit(0))


def string_match(pred: Column, gold: Column, lowercase: Column | None = None) -> Column:
    """1 where the stripped texts are equal (in lower case if asked), else 0."""
    a, b = F.trim(F.coalesce(pred, F.lit(""))), F.trim(F.coalesce(gold, F.lit("")))
    low = F.coalesce(lowercase, F.lit(False)) if lowercase is not None else F.lit(False)
    return F.when(F.when(low, F.lower(a) == F.lower(b)).otherwise(a == b), 1.0).otherwise(0.0)


def bool_match(pred: Column, gold: Column) -> Column:
    """1 where both are the same truth value in one of its spellings."""
    truth = lambda c: F.when(F.lower(F.trim(c)).isin("true", "1", "yes", "y", "t"), True).when(F.lower(F.trim(c)).isin("false", "0", "no", "n", "f"), False)
    return F.when(truth(pred) == truth(gold), 1.0).otherwise(0.0)


def int_match(pred: Column, gold: Column) -> Column:
    """1 where both are the same whole number ("12.0" is none, "1_000" is one)."""
    whole = lambda c: F.when(c.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.regexp_replace(c, r"[_\s]", "").try_cast("bigint"))
    return F.when(whole(pred) == whole(gold), 1.0).otherwise(0.0)


def float_match(pred: Column, gold: Column, ndigits: Column | None = None, tolerance: float = 1e-6) -> Column:
    """1 where two numbers are relatively close, both rounded (half to even) first if asked."""
    a, b = pred.try_cast("double"), gold.try_cast("double")
    if ndigits is not None:
        scale = F.pow(F.lit(10.0), ndigits)
        a, b = F.when(ndigits.isNull(), a).otherwise(F.rint(a * scale) / scale), F.when(ndigits.isNull(), b).otherwise(F.rint(b * scale) / scale)
    return F.when((a == b) | (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))), 1.0).otherwise(0.0)
