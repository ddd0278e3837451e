"""Examples for questioning: gates, eligible sections, focus, pairing, samples, quotas, joins of records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import excerpts, text
from lodestream.operators import evaluation

# ---- fixed values: section keywords, cues, focus words ----
EXCLUDED = ["abstract", "introduction", "background", "related work"]
INCLUDED = ["method", "materials", "experimental", "experiment", "measurement", "fabrication", "synthesis", "preparation", "characterization", "evaluation", "result", "discussion", "performance", "analysis"]
CUES = ["measure", "experiment", "sample", "result", "figure", "field", "temperature", "magnet", "synth", "fabricat", "method", "observ", "increase", "decrease", "compare", "mechanism", "property", "material", "nm", "μ", "k ", " t", "%"]
AUTHORS = ["author", "affiliation", "correspondence"]
FOCUS = {
    "experimental_setup": ["experimental", "experiment", "method", "materials", "measurement", "sample", "fabrication", "synthesis", "preparation"],
    "reported_result": ["result", "discussion", "performance", "characterization", "magnetic", "electrochemical"],
    "isa_concept": ["method", "materials", "experimental", "measurement", "characterization", "result", "discussion"],
    "mechanism_or_comparison": ["result", "discussion", "mechanism", "analysis", "comparison", "performance"],
}
LEAST_CHARS, LEAST_WORDS = 260, 45
# ---- end of fixed values ----


def _holds(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def quality_gate(examples: DataFrame) -> DataFrame:
    """qa_id, reason: the first reason against each example (null: none), by length, content, leaks and likeness to others.

    The near-duplicates come from ``similar_questions``: another question of a like token set, or an
    earlier row of the same.
    """
    near = evaluation.similar_questions(examples).select("qa_id", ((F.col("links") > 0) | (F.col("qa_id") != F.col("class_id"))).alias("repeated")).dropDuplicates(["qa_id"])
    rows = examples.select("qa_id", "question", "answer_format", "answer").join(near, "qa_id", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [excerpts.flaw(q, f, a, r) for q, f, a, r in zip(df["question"], df["answer_format"], df["answer"], df["repeated"], strict=True)]
            yield pd.DataFrame({"qa_id": df["qa_id"], "reason": pd.Series(got, dtype="object")})

    return rows.mapInPandas(run, "qa_id bigint, reason string")


def leakage(examples: DataFrame) -> DataFrame:
    """qa_id, tokens, numbers: shares of an answer's tokens and quantities that its question and format show."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [excerpts.leaks(a, f"{q}\n{f}") for q, f, a in zip(df["question"], df["answer_format"], df["answer"], strict=True)]
            yield pd.DataFrame({"qa_id": df["qa_id"], "tokens": [t for t, _ in got], "numbers": [n for _, n in got]})

    return examples.where("answer is not null").select("qa_id", "question", "answer_format", "answer").mapInPandas(run, "qa_id bigint, tokens double, numbers double")


def concise(examples: DataFrame) -> DataFrame:
    """qa_id, context, reasoning of examples, cut to what bears on the question; the reasoning's steps are its lines."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            contexts = [excerpts.excerpt(*x) for x in zip(df["context"], df["question"], df["answer"], strict=True)]
            steps = [excerpts.reasoning((r or "").splitlines(), a) for r, a in zip(df["reasoning"], df["answer"], strict=True)]
            yield pd.DataFrame({"qa_id": df["qa_id"], "context": contexts, "reasoning": steps})

    return examples.select("qa_id", "question", "answer", "context", "reasoning").mapInPandas(run, "qa_id bigint, context string, reasoning string")


def bare_title(c: Column) -> Column:
    """A section title in lower case without its number."""
    return F.regexp_replace(F.lower(text.clean(c)), r"^\s*(?:section\s*)?\d+(?:\.\d+)*\.?\s*", "")


def substantive(title: Column, content: Column) -> Column:
    """A text of some length with a scientific word, and no list of authors."""
    body = text.clean(content)
    words = F.size(F.regexp_extract_all(body, F.lit(r"[A-Za-z0-9][A-Za-z0-9_.+%μµ°×^-]*"), F.lit(0)))
    return (F.length(body) >= LEAST_CHARS) & (words >= LEAST_WORDS) & ~_holds(F.lower(F.coalesce(title, F.lit(""))), AUTHORS) & _holds(F.lower(body), CUES)


def eligible_sections(sections: DataFrame, group: str, title: str, content: str) -> DataFrame:
    """The sections of each group that questions may be asked on.

    Excluded titles, references, thanks and headers fall away, and so does what isn't substantive; of
    the rest those whose title holds a wanted word, or all if a group has none such.
    """
    t, low, body = bare_title(F.col(title)), F.lower(F.trim(F.coalesce(F.col(title), F.lit("")))), F.lower(F.coalesce(F.col(content), F.lit("")))
    header = F.contains(body, F.lit("doi:")) & F.contains(body, F.lit("keywords:"))
    kept = sections.where(~_holds(t, EXCLUDED) & ~low.startswith("references") & ~low.startswith("acknowledg") & ~header & substantive(F.col(title), F.col(content)))
    marked = kept.withColumn("_in", _holds(t, INCLUDED))
    some = marked.where("_in").select(group).distinct().withColumn("_some", F.lit(True))
    return marked.join(some, group, "left").where(F.col("_in") | F.col("_some").isNull()).drop("_in", "_some")


def seeded(seed: int, *ids: str) -> Column:
    """A number by which rows are drawn: the same for the same ids and seed, at every partitioning."""
    return F.xxhash64(F.lit(seed), *ids)


def sample(rows: DataFrame, keys: list[str], size: int, seed: int, id_col: str) -> DataFrame:
    """``size`` rows of each group, drawn by the hash of their id."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(seeded(seed, id_col), id_col))).where(F.col("_k") <= size).drop("_k")


def focus_sections(sections: DataFrame, group: str, title: str, id_col: str, focus: str, seed: int) -> DataFrame:
    """One section of each group, drawn by hash: of those whose title holds a word of the focus, else of all."""
    held = _holds(F.lower(F.coalesce(F.col(title), F.lit(""))), FOCUS.get(focus.lower(), []))
    order = Window.partitionBy(group).orderBy(F.desc(held), seeded(seed, id_col), id_col)
    return sections.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def is_figure_caption(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)^\s*(figure|fig\.?)\s*[\w.:-]*")


def figure_keys(caption: Column) -> Column:
    """Keys of the figures a caption names: figure_1, figure1, fig_1, fig1."""
    names = F.transform(F.regexp_extract_all(F.coalesce(caption, F.lit("")), F.lit(r"(?i)(?:figure|fig\.?)\s*([sS]?\d+[A-Za-z]?)"), F.lit(1)), F.lower)
    return F.flatten(F.transform(names, lambda n: F.array(*(F.concat(F.lit(p), n) for p in ("figure_", "figure", "fig_", "fig")))))


def figure_files(figures: DataFrame, files: DataFrame) -> DataFrame:
    """figures (paper_id, figure_id, caption, image) with ``path``: the file of the given image name, else the first whose stem holds a key of the caption.

    files: paper_id, path; a figure meets the files of its own paper only.
    """
    name = F.element_at(F.split("path", "/"), -1)
    both = figures.withColumn("_keys", figure_keys(F.col("caption"))).join(files.select("paper_id", "path", name.alias("_name"), F.lower(F.regexp_replace(name, r"\.[^.]*$", "")).alias("_stem")), "paper_id")
    place = F.when(F.col("_name") == F.col("image"), 0).otherwise(F.array_min(F.transform("_keys", lambda k, i: F.when(F.contains(F.col("_stem"), k), i + 1))))
    best = both.withColumn("_p", place).where("_p is not null").groupBy("paper_id", "figure_id").agg(F.min_by("path", F.struct("_p", "path")).alias("path"))
    return figures.join(best, ["paper_id", "figure_id"], "left")


def paired(examples: DataFrame, pairs: DataFrame) -> DataFrame:
    """One example of two (pairs: pair_id, first, second uuid): both questions, evaluators, tags and papers.

    Tags are those of both, "single" as "multiple", "objective" only where neither is subjective.
    """
    side = lambda k: examples.select(F.col("uuid").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("question", "answer_format", "tags", "evaluator", "anchor_pdf", "answer")))
    both = pairs.join(side("first"), "first").join(side("second"), "second")
    low = lambda c: F.concat(F.lower(F.substring(c, 1, 1)), F.expr(f"substring({c}, 2)"))
    paper = lambda k: F.coalesce(F.try_element_at(f"{k}_anchor_pdf", F.lit(1)), F.lit(""))
    none = F.array().cast("array<string>")
    tags = F.array_distinct(F.concat(F.coalesce("first_tags", none), F.coalesce("second_tags", none)))
    tags = F.concat(F.array_remove(tags, "single"), F.array(F.lit("multiple")))
    tags = F.when(F.array_contains(tags, "objective") & F.array_contains(tags, "subjective"), F.array_remove(tags, "objective")).otherwise(tags)
    question = F.concat(F.lit('In the paper "'), paper("first"), F.lit('", '), low("first_question"), F.lit(' In the paper "'), paper("second"), F.lit('", '), low("second_question"), F.lit(" "))
    form = F.concat(F.lit("You answer should be a Python list of 2 elements, each element is the answer of the corresponding question. For question 1, "), low("first_answer_format"), F.lit(" For question 2, "), low("second_answer_format"), F.lit(" "))
    kwargs = F.to_json(F.struct(F.array("first_evaluator.eval_func", "second_evaluator.eval_func").alias("eval_func_list"), F.array("first_evaluator.eval_kwargs", "second_evaluator.eval_kwargs").alias("eval_kwargs_list")))
    evaluator = F.struct(F.lit("eval_conjunction").alias("eval_func"), kwargs.alias("eval_kwargs"))
    return both.select("pair_id", question.alias("question"), form.alias("answer_format"), F.array_sort(tags).alias("tags"), evaluator.alias("evaluator"), F.array(paper("first"), paper("second")).alias("anchor_pdf"), F.array("first", "second").alias("from_uuids"), F.array("first_answer", "second_answer").alias("answers"))


def neediest(current: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key, deficit of the kind that lacks the largest share of its target, then most, then the first by name; both: key, n."""
    both = target.select(key, F.col("n").alias("want")).join(current.select(key, F.col("n").alias("have")), key, "left")
    lack = F.greatest(F.lit(0).cast("bigint"), F.col("want") - F.coalesce("have", F.lit(0)))
    share = lack / F.greatest(F.lit(1), "want")
    return both.select(key, lack.alias("deficit"), share.alias("_s")).orderBy(F.desc("_s"), F.desc("deficit"), key).limit(1).drop("_s")


def wrong_cases(scores: DataFrame, order: str, threshold: float = 0.5, most: int = 40) -> DataFrame:
    """The first ``most`` rows whose score (a text or number) is below the threshold or no number; a null score is no case."""
    number = F.col("score").cast("string").try_cast("double")
    return scores.where(F.col("score").isNotNull() & (number.isNull() | (number < threshold))).orderBy(order).limit(most)


def with_examples(records: DataFrame, examples: DataFrame, key: str = "uuid") -> DataFrame:
    """Every record with its example; a record without one keeps nulls, an example that stands twice counts once (its first row by qa_id)."""
    first = examples.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("qa_id"))).where("_k = 1").drop("_k")
    return records.join(first, key, "left")


def in_order(examples: DataFrame, records: DataFrame, key: str = "uuid", order: str = "ord") -> DataFrame:
    """The records of the examples that have one, in the order of the examples."""
    return examples.select(key, order).join(records, key).orderBy(order)


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """eval_func, mean scores before and after, change: two summaries side by side."""
    one, two = (x.groupBy("eval_func").agg(F.avg("score").alias(n), F.count("score").alias(f"{n}_n")) for x, n in ((before, "before"), (after, "after")))
    both = one.join(two, "eval_func", "full")
    return both.select("eval_func", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(F.col("after") - F.col("before"), 6).alias("change"), F.coalesce("before_n", F.lit(0)).alias("before_n"), F.coalesce("after_n", F.lit(0)).alias("after_n"))


def asks_model(evaluator: Column) -> Column:
    """An evaluator (eval_func, eval_kwargs) that asks a model, itself or inside a combination."""
    inner = F.from_json(evaluator["eval_kwargs"], "eval_func_list array<string>, eval_func string")
    return F.coalesce(F.contains(evaluator["eval_func"], F.lit("llm")), F.lit(False)) | F.coalesce(F.exists(inner["eval_func_list"], lambda f: F.contains(f, F.lit("llm"))), F.lit(False)) | F.coalesce(F.contains(inner["eval_func"], F.lit("llm")), F.lit(False))
