"""Broken prompt and response pairs, by ordered rules.

A pair is a question with its answer format and the gold value of its evaluator. The rules are
emptiness, refusal phrases of many languages, copied questions or formats, unclosed delimiters and
abrupt endings, and a language other than the question's. Whether an ending is abrupt is partly a
statistic of all responses: how often its last words end a response without a full stop, against
how often they go on; and whether its last word is only the beginning of a common one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import checkpoint

DEFECTS = ("empty", "refusal", "copy", "truncated", "language")

# ---- fixed values: placeholders, refusal phrases, function words ----
PLACEHOLDERS = {"", "na", "none", "null", "nil", "nan", "tbd", "tba", "todo", "undefined", "unknown", "missing", "blank", "empty", "placeholder", "answer", "your answer", "your answer here", "insert answer here", "keine angabe", "sin respuesta", "sans réponse", "lorem ipsum", "xxx", "없음"}
REFUSALS = [
    r"\b(?:i|we)(?:'m| am| are|'re)? (?:so |very |really )?(?:sorry|afraid)\b", r"^(?:sorry|apologies|my apologies)\b", r"\bi apologi[sz]e\b",
    r"\bi(?:'m| am)? (?:can ?not|can't|could not|couldn't|won't|will not|would rather not|do not|don't|am not able to|am unable to|not able to|unable to|must decline|have to decline|decline|refuse)\b.{0,40}\b(?:help|assist|answer|provide|comment|speculat\w+|determine|judge|discuss|respond|comply|access|say|tell|know|give|disclose|share)\b",
    r"\bi (?:must|have to|need to|respectfully) (?:decline|refuse)\b", r"\bi won't\b", r"\bi can't help\b", r"^unable to (?:determine|answer|provide|find|comply)\b", r"\bas an? (?:ai|language|large language|virtual|artificial)\b.{0,40}\b(?:model|assistant|intelligence|ai)\b",
    r"\b(?:this|that|the question|it) (?:can ?not|can't|could not) be answered\b", r"\bnot be appropriate for me\b", r"\bdo(?:es)? not (?:contain|provide|include|give) (?:enough|sufficient|the necessary|any) information\b", r"\b(?:not enough|insufficient) (?:information|context) (?:to|for)\b", r"\bi do not have (?:access|enough|the)\b", r"\bi am (?:unable|not able|not allowed|not permitted)\b",
    r"^no usable content\W*$", r"^reject(?:ed)?\W*$",
    r"\bich (?:kann|darf|möchte|werde) .{0,60}\b(?:nicht|keine?)\b", r"\b(?:tut mir leid|bedaure|leider kann|kann leider nicht|kann nicht beantwortet werden|nicht beantworten)\b",
    r"\bje (?:ne peux|ne suis pas|regrette|refuse|ne saurais)\b", r"\b(?:désolée?|je m'excuse|impossible de répondre|ne peut (?:pas )?être répondu)\b",
    r"\b(?:lo siento|lamento|no puedo|no me es posible|me niego a|no es posible responder|no se puede responder)\b", r"\b(?:mi dispiace|non posso|não posso|desculpe|sinto muito)\b",
    r"죄송|답변(?:을|할|드릴)? ?수 ?(?:가 )?없|답할 수 없|대답할 수 없|알 수 없습니다|도와드릴 수 없", r"抱歉|对不起|無法|无法(?:回答|提供|确定)|不能回答|申し訳|お答えできません|回答できません", r"\b(?:извините|не могу|к сожалению)\b",
]
LANGUAGE_WORDS = {
    "en": "the of is was were are which what how why does did with from this that these by and to for it its be been has have had into than then because their they could not",
    "de": "der das und ist nicht mit wird werden wurde wurden eine einer eines dem den von zur zum wie warum weil bei nimmt nach für aus ein auf sind durch über kann welche benutzt",
    "fr": "le les des du une est et que qui dans pour pourquoi parce quelle quel avec sur été plus au aux ont cette ce se sont par puis pendant",
    "es": "el los las del una y que por qué para con se porque más cuál método fue como está son durante menos quedan",
    "it": "il gli della delle di che per perché con è sono una nel più quale questo come stato",
    "pt": "o os as do da dos das um uma não com para porque é são mais qual foi como pelo",
}
OPEN_WORDS = set(
    "a an the of in on at by to for from with without into onto than then that which who whose and or but nor so if as because since while whereas although though when where is was were are be been being has have had not no very more most less its their our his her this these those such between among under over above below about due only also namely e.g i.e eg ie via per see "
    "der die das den dem des ein eine einer einem einen und oder aber weil dass mit von zu zur zum bei für auf aus im am ist sind wird wurde nicht "
    "le la les un une des du de et ou mais que qui dans pour par avec sur est sont au aux en se "
    "el los las una del y o pero que en por para con se es son al más de".split()
) - {"no", "so", "see", "die", "on", "al", "es", "am"} | {"so", "see"}
LEADS = {"question", "the", "is", "you", "ask", "asked", "asks", "we", "need", "to", "find", "out", "as", "of", "this", "i", "am", "answer", "response", "q", "a", "so", "prompt", "my", "your", "wants", "know", "user"}
# ---- end of fixed values ----

_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS), re.I)
_LANGUAGE = {k: frozenset(v.split()) for k, v in LANGUAGE_WORDS.items()}
_SHARED = {w for k in _LANGUAGE for w in _LANGUAGE[k] if sum(w in v for v in _LANGUAGE.values()) > 1}
_SCRIPTS = (("ko", "가", "힣"), ("ja", "぀", "ヿ"), ("zh", "一", "鿿"), ("ru", "Ѐ", "ӿ"), ("ar", "؀", "ۿ"), ("hi", "ऀ", "ॿ"))
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_END = re.compile(r"[.!?。！？][\"”’'»)\]]*$")
_INVISIBLE = re.compile(r"[\s\u200b-\u200f\u2060\ufeff\u00ad]+")


def language(text: str) -> str | None:
    """The language of a text by script, else by function words; None where neither says enough."""
    letters = [c for c in text if c.isalpha()]
    for name, a, b in _SCRIPTS:
        if letters and sum(a <= c <= b for c in letters) >= 0.25 * len(letters):
            return name
    words = [w.lower() for w in _WORDS.findall(text)]
    score = {k: sum((1.0 if w not in _SHARED else 0.4) for w in words if w in v) for k, v in _LANGUAGE.items()}
    for c in text:
        if c in "ßäöü":
            score["de"] += 0.5
        elif c in "¿¡ñ":
            score["es"] += 1
        elif c in "çêèœ":
            score["fr"] += 0.5
    (first, a), (_, b) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return first if a >= 2 and a >= 1.5 * b else None


def response_of(kwargs: str | None) -> object:
    """The gold value or reference answer in evaluator arguments; None where there is none or they are no JSON object."""
    try:
        got = json.loads(kwargs) if kwargs else None
    except ValueError:
        return None
    if not isinstance(got, dict):
        return None
    return got["gold"] if got.get("gold") is not None else got.get("reference_answer")


def is_empty(response: object) -> bool:
    """No content: nothing, blank or invisible characters, signs only, a placeholder, an empty list."""
    if response is None:
        return True
    if isinstance(response, bool | int | float):
        return False
    if isinstance(response, list | tuple):
        return all(is_empty(x) for x in response)
    if isinstance(response, dict):
        return all(is_empty(x) for x in response.values())
    text = str(response)
    bare = " ".join(_WORDS.findall(_INVISIBLE.sub(" ", text).lower()))
    return bare.replace("n a", "na") in PLACEHOLDERS and not re.search(r"[^\W_]\s*[=<>]", text)


def _norm(text: str | None) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text or "")]


def is_copy(question: str | None, form: str | None, response: str) -> bool:
    """The response repeats the question or the format, or the clause that asks, and adds nothing."""
    said = _norm(response)
    if len(said) < 3:
        return False
    for source in (question, form):
        asked = _norm(source)
        if len(asked) < 3:
            continue
        clause = _norm(re.split(r"[\"”»],?\s", source or "")[-1])
        for whole in (asked, clause):
            k = len(whole)
            if k < 3:
                continue
            for lead in range(0, min(len(said), 9)):
                if said[lead : lead + k] == whole and all(w in LEADS for w in said[:lead]) and len(said) == lead + k:
                    return True
    return False


_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}


def is_unclosed(text: str) -> bool:
    """A bracket or quotation mark is opened and not closed (list numbers like "1)" don't count)."""
    s = re.sub(r"(?:(?<=\s)|^)(?:\d{1,2}|[a-z])\)", "", text)
    stack = []
    for c in s:
        if c in _PAIRS and not (c == "“" and stack and stack[-1] == "“"):
            stack.append(_PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
    return bool(stack) or s.count('"') % 2 == 1


def is_abrupt(text: str) -> bool:
    """The text itself shows that it breaks off: dots, an open mark or a word that calls for more at its end."""
    s = text.strip()
    if not s:
        return False
    if re.search(r"(?:\.\.\.|…)[\])}\"”]*$", s):
        return True
    if _END.search(s):
        return False
    if s[-1] in ",;:-–—(/=+&“«" or re.search(r"(?:^|\s)(?:\d{1,2}|[a-z])\)\s*\w*$", s) or re.search(r"[\"“«(]\s?\w*$", s):
        return True
    words = _norm(s)
    return len(words) >= 2 and words[-1] in OPEN_WORDS


def defects_of(question: str | None, form: str | None, response: object, stat: bool = False) -> list[str]:
    """Every defect of a pair, in the order of DEFECTS; ``stat``: the corpus statistic calls its ending abrupt."""
    if is_empty(response):
        return ["empty"]
    if not isinstance(response, str):
        return []
    out = []
    if _REFUSAL.search(response.replace("’", "'")):
        out.append("refusal")
    if is_copy(question, form, response):
        out.append("copy")
    if is_unclosed(response) or is_abrupt(response) or stat:
        out.append("truncated")
    asked, given = language(re.split(r"[\"”»],?\s", question or "")[-1] or ""), language(response)
    if asked and given and asked != given:
        out.append("language")
    return out


def abrupt_endings(responses: DataFrame, least: int = 10, share: float = 0.03, short: int = 3, longest: int = 64) -> DataFrame:
    """The distinct texts of ``response`` whose bare ending is abrupt by the statistics of all of them.

    Of a text of more than ``short`` words, the last three, two or one words, as the longest run that
    occurs ``least`` times, decide: abrupt if the run ends a text without a full stop in less than
    ``share`` of its occurrences. A shorter text (a name, mostly) is abrupt if, inside other texts, one
    and the same word follows it nine times in ten. A last word that never goes on is abrupt if it
    begins a word (of at most ``longest`` letters) three times as frequent. Repeated texts count as often as they stand there.
    """
    words = F.split(F.trim(F.lower("response")), r"(?U)\s+")
    bare = ~F.col("response").rlike(r"[.!?。！？…][\"”’'»)\]]*\s*$")
    texts = responses.where(F.col("response").isNotNull()).groupBy("response").agg(F.count(F.lit(1)).alias("times")).withColumn("raw", words).withColumn("bare", bare)
    clean = texts.withColumn("w", F.transform("raw", lambda x: F.regexp_replace(x, r"^[\"“(\[]+|[.,;:!?)\]\"”]+$", "")))
    clean = checkpoint(clean.select("response", "times", "bare", "w", F.size("w").alias("n")).where("n > 0"))

    def grams(size: int) -> DataFrame:
        at = F.posexplode(F.sequence(F.lit(1), F.col("n") - size + 1))
        runs = clean.where(F.col("n") >= size).select("w", "n", "times", "bare", at.alias("k", "start"))
        key = F.array_join(F.slice("w", F.col("start"), size), " ")
        last = F.col("bare") & (F.col("start") + size - 1 == F.col("n"))
        return runs.select(key.alias("gram"), "times", last.alias("last")).groupBy("gram").agg(F.sum("times").alias("total"), F.sum(F.when(F.col("last"), F.col("times")).otherwise(0)).alias("ends"))

    ends = clean.where("bare")
    verdict = None
    for size in (3, 2, 1):
        key = F.array_join(F.slice("w", F.greatest(F.col("n") - size + 1, F.lit(1)), size), " ")
        judged = ends.where(F.col("n") > short).select("response", key.alias("gram")).join(grams(size), "gram").where(F.col("total") >= least)
        judged = judged.select("response", F.lit(size).alias("size"), (F.col("ends") < share * F.col("total")).alias("abrupt"))
        verdict = judged if verdict is None else verdict.unionByName(judged)
    by_run = verdict.groupBy("response").agg(F.max_by("abrupt", "size").alias("abrupt")).where("abrupt").select("response")
    names = checkpoint(ends.where(F.col("n") <= short).select("response", "n", F.array_join("w", " ").alias("gram")))
    by_name = None
    for size in range(1, short + 1):
        at = F.explode(F.sequence(F.lit(1), F.col("n") - size))
        runs = clean.where(F.col("n") > size).select("w", "times", at.alias("start")).select("times", F.array_join(F.slice("w", F.col("start"), size), " ").alias("gram"), F.element_at("w", F.col("start") + size).alias("next"))
        runs = runs.join(names.where(F.col("n") == size).select("gram").distinct(), "gram", "left_semi")
        after = runs.groupBy("gram", "next").agg(F.sum("times").alias("count")).groupBy("gram").agg(F.sum("count").alias("total"), F.max("count").alias("top"))
        got = names.join(after.where(F.col("total") >= least).where("top >= 0.9 * total"), "gram").select("response")
        by_name = got if by_name is None else by_name.union(got)
    single = checkpoint(grams(1))
    stubs = single.where("total = ends and length(gram) >= 1").select("gram", "total")
    longer = single.where((F.col("total") >= 10) & (F.length("gram") <= longest)).select(F.col("total").alias("full"), F.explode(F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda k: F.substring(F.col("gram"), F.lit(1), k))).alias("gram"))
    longer = longer.groupBy("gram").agg(F.max("full").alias("full"))
    cut = stubs.join(longer, "gram").where("full >= 3 * total").select("gram")
    by_stub = ends.select("response", F.element_at("w", -1).alias("gram")).join(cut, "gram", "left_semi").select("response")
    return by_run.union(by_name).union(by_stub).distinct()


def pair_defects(examples: DataFrame) -> DataFrame:
    """qa_id, defects array<string>: every triggered defect of each defective pair, in the order of DEFECTS.

    A null evaluator, arguments that are no JSON object and a missing gold value are empty
    responses; a null question can't be copied and has no language; repeated examples count each.
    Values that are no text (numbers, booleans, filled lists) have no defect of text; a row without an
    id has no result.
    """
    kwargs = F.col("evaluator.eval_kwargs")
    text = F.coalesce(F.get_json_object(kwargs, "$.gold"), F.get_json_object(kwargs, "$.reference_answer"))
    rows = examples.select("qa_id", "question", "answer_format", kwargs.alias("kwargs"), text.alias("response"))
    stats = abrupt_endings(rows.select("response"))
    rows = rows.join(stats.withColumn("stat", F.lit(True)), "response", "left").withColumn("stat", F.coalesce("stat", F.lit(False))).where(F.col("qa_id").isNotNull())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [
                (i, d)
                for i, q, f, k, s in zip(df["qa_id"], df["question"], df["answer_format"], df["kwargs"], df["stat"], strict=True)
                if (d := defects_of(q, f, response_of(k), bool(s)))
            ]
            yield pd.DataFrame(got, columns=["qa_id", "defects"])

    return rows.select("qa_id", "question", "answer_format", "kwargs", "stat").mapInPandas(run, "qa_id bigint, defects array<string>")


def first_defect(defects: DataFrame) -> DataFrame:
    """qa_id, defect: of several triggered defects the first in the order of DEFECTS."""
    return defects.select("qa_id", F.element_at("defects", 1).alias("defect"))
