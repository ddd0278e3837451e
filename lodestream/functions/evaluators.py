"""Evaluators of answers that need Python: fuzzy texts, lists, structured objects, logic, relevance. No model is called."""

from __future__ import annotations

import ast
import json
import math
import re
from difflib import SequenceMatcher
from typing import Any

TRUE, FALSE = {"true", "1", "yes", "y", "t"}, {"false", "0", "no", "n", "f"}


def ratio(a: str, b: str) -> int:
    """Likeness of two texts in per cent; an empty one is like none but itself."""
    return 100 if a == b else round(100 * SequenceMatcher(None, a, b).ratio()) if a and b else 0


def partial_ratio(a: str, b: str) -> int:
    """The best likeness of the shorter text to as long a part of the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100 if a == b else 0
    blocks = SequenceMatcher(None, short, long).get_matching_blocks()
    best = max(SequenceMatcher(None, short, long[(k := max(0, j - i)) : k + len(short)]).ratio() for i, j, _ in blocks)
    return 100 if best > 0.995 else round(100 * best)


def _words(s: str) -> list[str]:
    return re.sub(r"\W", " ", s).lower().split()


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(" ".join(sorted(_words(a))), " ".join(sorted(_words(b))))


def token_set_ratio(a: str, b: str) -> int:
    x, y = set(_words(a)), set(_words(b))
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    one, two = (f"{both} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
    return max(ratio(both, one), ratio(both, two), ratio(one, two))


FUZZY = {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio}


def _text(pred: Any, gold: Any, blank: str | None, lowercase: bool) -> tuple[str, str]:
    out = [str(x).strip() for x in (pred, gold)]
    out = [re.sub(r"\s+", blank, x) for x in out] if blank is not None else out
    return tuple(x.lower() for x in out) if lowercase else tuple(out)


def string_exact(pred: Any, gold: Any, lowercase: bool = False, ignore_blank: bool = False, **_: Any) -> bool:
    a, b = _text(pred, gold, "" if ignore_blank else None, lowercase)
    return a == b


def string_fuzzy(pred: Any, gold: Any, fuzz_method: str = "ratio", threshold: int = 95, ignore_blank: bool = False, lowercase: bool = False, **_: Any) -> bool:
    a, b = _text(pred, gold, None if not ignore_blank else " " if fuzz_method.startswith("token") else "", lowercase)
    return FUZZY[fuzz_method](a, b) >= threshold


def bool_exact(pred: Any, gold: Any, **_: Any) -> bool:
    a, b = str(pred).strip().lower(), str(gold).strip().lower()
    return a in TRUE and b in TRUE or a in FALSE and b in FALSE


def int_exact(pred: Any, gold: Any, **_: Any) -> bool:
    try:
        return int(pred) == int(gold)
    except (TypeError, ValueError, OverflowError):
        return False


def float_exact(pred: Any, gold: Any, ndigits: int | None = None, tolerance: float = 1e-6, **_: Any) -> bool:
    try:
        a, b = float(pred), float(gold)
        return math.isclose(round(a, ndigits), round(b, ndigits), rel_tol=tolerance) if ndigits is not None else math.isclose(a, b, rel_tol=tolerance)
    except (TypeError, ValueError, OverflowError):
        return False


def _literal(s: Any) -> Any:
    try:
        return ast.literal_eval(s)
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return None


def as_list(s: Any) -> list:
    """A list of a list, tuple or set or of a text that spells one; else a list of the one value."""
    got = s if isinstance(s, (list, tuple, set)) else _literal(s)
    return list(got) if isinstance(got, (list, tuple, set)) else [s]


def as_dict(s: Any) -> Any:
    if isinstance(s, dict):
        return s
    try:
        return json.loads(s)
    except (TypeError, ValueError):
        got = _literal(s)
        return got if isinstance(got, dict) else {}


def structured(pred: Any, gold: Any, **kw: Any) -> bool:
    """Lists and dictionaries equal in all elements; what is in them by its own kind (a truth value as a whole number)."""
    if isinstance(gold, list):
        mine = as_list(pred)
        if kw.get("ignore_order"):
            mine, gold = sorted(mine, key=str), sorted(gold, key=str)
        return len(mine) == len(gold) and all(structured(p, g, **kw) for p, g in zip(mine, gold, strict=True))
    if isinstance(gold, dict):
        mine = as_dict(pred)
        if not isinstance(mine, dict) or len(mine) != len(gold):
            return False
        if kw.get("lowercase"):
            mine, gold = {k.lower(): v for k, v in mine.items()}, {k.lower(): v for k, v in gold.items()}
        return all(k in mine and structured(mine[k], v, **kw) for k, v in gold.items())
    if isinstance(gold, int):
        return int_exact(pred, gold)
    if isinstance(gold, float):
        return float_exact(pred, gold, **kw)
    return string_fuzzy(pred, gold, **kw) if kw.get("threshold", -1) > 0 else string_exact(pred, gold, **kw)


def included(pred: Any, gold: list, element_type: str = "str", **kw: Any) -> bool:
    """One of the gold elements; numbers are rounded to two places unless asked otherwise."""
    kw = {"ndigits": 2, "threshold": -1} | kw
    one = {"str": string_fuzzy if kw["threshold"] > 0 else string_exact, "int": int_exact, "float": float_exact}.get(element_type, structured)
    return any(one(pred, g, **kw) for g in gold)


def list_included(pred: Any, gold: list, **kw: Any) -> bool:
    return all(included(p, gold, **kw) for p in as_list(pred))


def list_overlap(pred: Any, gold: list, count: int = 1, **kw: Any) -> bool:
    """``count`` different elements of the answer are gold ones; of none but a list without gold elements is 0."""
    hits = {str(p) for p in as_list(pred) if included(p, gold, **kw)}
    return bool(hits) and len(hits) >= count


def relevant(pred: str, question: str, reference_answer: str | list[str], threshold: int = 95) -> bool:
    return any(ratio(pred.lower(), x.lower()) >= threshold for x in ([reference_answer] if isinstance(reference_answer, str) else reference_answer))


class NeedsModel(Exception):
    """An evaluator inside a combination asks a model."""


def _inner(pred: Any, name: str, kwargs: dict) -> bool:
    if name.endswith("_with_llm"):
        raise NeedsModel(name)
    return bool(EVALUATORS[name](pred, **kwargs))


def conjunction(pred: Any, eval_func_list: list[str], eval_kwargs_list: list[dict]) -> bool:
    mine = as_list(pred)
    return len(mine) == len(eval_func_list) and all([_inner(*x) for x in zip(mine, eval_func_list, eval_kwargs_list)])


def disjunction(pred: Any, eval_func_list: list[str], eval_kwargs_list: list[dict]) -> bool:
    mine = as_list(pred)
    return len(mine) == len(eval_func_list) and any([_inner(*x) for x in zip(mine, eval_func_list, eval_kwargs_list)])


def negation(pred: Any, eval_func: str, eval_kwargs: dict) -> bool:
    return not _inner(pred, eval_func, eval_kwargs)


#: Those that columns can't say.
PYTHON = {
    "eval_string_fuzzy_match": string_fuzzy, "eval_structured_object_exact_match": structured, "eval_element_included": included, "eval_element_list_included": list_included, "eval_element_list_overlap": list_overlap,
    "eval_conjunction": conjunction, "eval_disjunction": disjunction, "eval_negation": negation, "eval_paper_relevance_with_reference_answer": relevant,
}
EVALUATORS = PYTHON | {"eval_string_exact_match": string_exact, "eval_bool_exact_match": bool_exact, "eval_int_exact_match": int_exact, "eval_float_exact_match": float_exact}


def evaluate(name: str, kwargs: str | None, pred: str | None) -> float | None:
    """1 or 0 by one of ``PYTHON``; null for no answer, another evaluator or one that needs a model. Errors are 0."""
    if pred is None or name not in PYTHON:
        return None
    if pred.startswith("[ERROR]:"):
        return 0.0
    try:
        return float(PYTHON[name](pred, **json.loads(kwargs or "{}")))
    except NeedsModel:
        return None
    except Exception:
        return 0.0
