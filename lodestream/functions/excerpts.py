"""Texts of questions and answers in plain Python: scalars, tokens, numbers, leaks, excerpts."""

from __future__ import annotations

import ast
import html
import json
import re
from typing import Any

# ---- fixed values: stop words, number pattern, marks of answers without content, limits ----
CONTEXT_WORDS = frozenset("about according answer between does from give have into paper provide question report reported should show shows table tell that their there this what when where which with within your".split())
QUALITY_WORDS = CONTEXT_WORDS | frozenset("single sentence string number value format exactly return including using used section content provided paper answer format with without must only".split())
TOKEN = re.compile(r"[A-Za-z0-9_.+%µμ°×^-]+")
NUMBER = re.compile(r"[-+]?\d+(?:\.\d+)?(?:\s*[–-]\s*[-+]?\d+(?:\.\d+)?)?(?:\s*(?:%|K|mT|T|Pa|kPa|mW|W|h|hours?|days?|nm|µm|μm|μB|µB|meV|eV|Hz|kHz|MHz|°C|C|g|mg|mm|Å|kOe|Oe))?", re.IGNORECASE)
NO_ANSWERS = frozenset({"false", "no", "none", "not reported", "no."})
NO_QUESTIONS = ("does the provided markdown section", "are there any numerical", "any quantitative", "specify any experimental setup")
LIMITS = {"question": 560, "answer_format": 720, "answer": 720, "context": 900, "reasoning": 500, "steps": 3}
TOKEN_LEAK, NUMBER_LEAK = 0.72, 0.80
# ---- end of fixed values ----


def cleaned(value: Any) -> str:
    """Text without markup, entities undone, white space as one space; None, False and 0 are ""."""
    return " ".join(re.sub(r"<[^>]+>", " ", html.unescape(str(value or ""))).split())


def _spelled(s: str) -> Any:
    for read in (json.loads, ast.literal_eval):
        try:
            return read(s)
        except Exception:
            continue
    return None


def scalars(value: Any) -> list[str]:
    """The single values in an answer; a text that spells a list, an object or a value is opened."""
    todo, out = [value], []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += reversed(x.values())
        elif isinstance(x, list | tuple | set):
            todo += reversed(list(x))
        elif s := cleaned(x):
            inner = _spelled(s) if isinstance(x, str) else None
            if inner is None:
                out.append(s)
            else:
                todo.append(inner)
    return out


def tokens(value: Any) -> set[str]:
    return {t for s in scalars(value) for t in TOKEN.findall(s.lower()) if len(t) >= 3 and t not in QUALITY_WORDS}


def numbers(value: Any) -> set[str]:
    """Quantities of an answer, as written and without spaces; none inside formulas, no bare whole number below 10, no range of such."""
    out: set[str] = set()
    for s in scalars(value):
        for m in NUMBER.finditer(s):
            n = " ".join(m[0].split()).lower()
            left, right = s[max(0, m.start() - 2) : m.start()], s[m.end() : m.end() + 2]
            if left[-1:].isalpha() or right[:1].isalpha() or (right[:1] in ("+", "-") and right[1:].isalpha()) or (left[-1:] in ("+", "-") and left[:-1].isalpha()):
                continue
            if re.fullmatch(r"[-+]?\d+(?:\.\d+)?", n) and (right[:1] in ("+", "-") or ("." not in n and abs(int(n)) < 10)):
                continue
            if re.fullmatch(r"[-+]?\d+\s*[–-]\s*[-+]?\d+", n) and all(abs(int(x)) < 10 for x in re.findall(r"[-+]?\d+", n)):
                continue
            out |= {n, re.sub(r"\s+", "", n)}
    return out


def leaks(answer: Any, visible: str) -> tuple[float, float]:
    """(share of the answer's tokens, share of its quantities) that stand in a visible text."""
    mine, low = tokens(answer), cleaned(visible).lower()
    squashed, counted = re.sub(r"\s+", "", low), numbers(answer)
    shown = sum(n in low or re.sub(r"\s+", "", n) in squashed for n in counted)
    return len(mine & tokens(visible)) / max(1, len(mine)), shown / max(1, len(counted))


def says_nothing(question: str | None, answer: Any) -> bool:
    """The answer, or the question with it, says that there is no content."""
    q, a = cleaned(question).lower(), cleaned(answer).lower()
    if "no usable content" in a or "no usable content" in q or a in NO_ANSWERS or a.startswith("none") or "no reported" in a or "contains no" in a:
        return True
    return any(x in q for x in NO_QUESTIONS) and any(x in a for x in ("false", "no", "none"))


def flaw(question: str | None, form: str | None, answer: Any, repeated: bool = False) -> str | None:
    """The first reason against an example, or None."""
    q, f, a = cleaned(question), cleaned(form), cleaned(answer)
    if not a or a.upper() == "REJECT" or "no usable content" in f"{question}\n{form}\n{a}".lower():
        return "rejected"
    for name, s in (("question", q), ("answer_format", f), ("answer", a)):
        if len(s) > LIMITS[name]:
            return f"{name} too long"
    if says_nothing(question, answer):
        return "negative evidence"
    by_token, by_number = leaks(answer, f"{question}\n{form}")
    if len(tokens(answer)) >= 3 and by_token >= TOKEN_LEAK:
        return "token leakage"
    counted = numbers(answer)
    if counted and by_number >= NUMBER_LEAK and (re.fullmatch(r"[-+]?\d+(?:\.\d+)?", a) or len(counted) >= 2 or len(a) <= 60):
        return "number leakage"
    return "near-duplicate" if repeated else None


def shortened(text: Any, limit: int) -> str:
    s = cleaned(text)
    return s if limit <= 0 or len(s) <= limit else s[: limit - 3].rstrip() + "..."


def _key_tokens(*values: Any) -> set[str]:
    return {t for v in values for t in re.findall(r"[A-Za-z0-9_.+%-]+", str(v or "").lower()) if len(t) >= 3 and t not in CONTEXT_WORDS}


def excerpt(context: str | None, question: str | None, answer: Any, limit: int = LIMITS["context"]) -> str:
    """The sentences of a context that bear on a question and its answer, in their order, within ``limit`` characters.

    A sentence scores a point for each shared token and four more for each of the answer's; the best are
    taken while they fit (the first always), repeated ones once.
    """
    s = cleaned(context)
    if len(s) <= limit:
        return s
    size = max(200, limit // 2)
    units = [u[k : k + size].strip() for u in re.split(r"(?<=[.!?])\s+", s) for k in range(0, len(u), size)]
    about, given = _key_tokens(question, answer), _key_tokens(answer)
    ranked = sorted((-(len(about & t) + 4 * len(given & t)), k) for k, u in enumerate(units) if u and (about & (t := _key_tokens(u)) or given & t))
    if not ranked:
        return shortened(s, limit)
    taken, seen, used = [], set(), 0
    for _, k in ranked:
        cost = len(units[k]) + (5 if taken else 0)
        if units[k].lower() in seen or (taken and used + cost > limit):
            continue
        taken.append(k)
        seen.add(units[k].lower())
        used += cost
        if used >= limit:
            break
    return shortened("\n...\n".join(units[k] for k in sorted(taken)), limit)


def reasoning(steps: list[str] | None, answer: Any, limit: int = LIMITS["reasoning"], most: int = LIMITS["steps"]) -> str:
    """The first steps, cleaned and numbered anew; without any a sentence that names the answer."""
    kept = [x for x in (re.sub(r"^\s*[-*\d.)]+\s*", "", cleaned(s)) for s in steps or []) if x][:most]
    told = " ".join(f"{k}. {x}" for k, x in enumerate(kept, 1)) if kept else f"The answer is supported by the cited context and should be reported as: {answer}"
    return shortened(told, limit)


def fields(text: str | None) -> dict[str, str]:
    """The "[name]: value" segments of a model's reply, by lower-case name."""
    marks = list(re.finditer(r"\[([A-Za-z_ ]+)\]\s*:", text or ""))
    ends = [m.start() for m in marks[1:]] + [len(text or "")] * bool(marks)
    return {m[1].strip().lower(): (text or "")[m.end() : end].strip() for m, end in zip(marks, ends, strict=True)}


def evaluator_of(text: str | None) -> dict[str, Any] | None:
    """An evaluator spelled in a reply: JSON, a Python literal, either with trailing commas, or the bare name of a function."""
    s = re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", (text or "").strip())
    for candidate in (s, re.sub(r",\s*([}\]])", r"\1", s)):
        got = _spelled(candidate)
        if isinstance(got, dict) and isinstance(got.get("eval_func"), str):
            return {"eval_func": got["eval_func"], "eval_kwargs": got.get("eval_kwargs") or {}}
    return {"eval_func": m[0], "eval_kwargs": {}} if (m := re.match(r"eval_\w+", s)) else None
