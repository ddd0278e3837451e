"""The boundary to models: any object with ``complete`` or ``embed`` may stand behind it, recorded answers too.

A client is made inside the task by a function that can be sent there, so no connection is shipped.
Tests and runs without a network use ``Recorded``.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import excerpts, parse, text
from lodestream.operators import claims

ERROR = "[ERROR]: "


class TextClient(Protocol):
    def complete(self, prompt: str) -> str: ...


class VectorClient(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Recorded:
    """Answers by prompt, or by a function of it; a prompt without one is an error. Vectors come from the hashes of tokens."""

    def __init__(self, answers: dict[str, str] | Callable[[str], str], size: int = 16):
        self.answers, self.size = answers, size

    def complete(self, prompt: str) -> str:
        return self.answers(prompt) if callable(self.answers) else self.answers[prompt]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split():
                h = hashlib.sha256(w.encode()).digest()
                v[h[0] % self.size] += 1.0 if h[1] % 2 else -1.0
            out.append(v)
        return out


def ask(client: TextClient, prompt: str, attempts: int = 4, wait: float = 3.0) -> str:
    """The answer to a prompt; after ``attempts`` failures, with a longer pause after each, the error as text."""
    last: Exception | None = None
    for k in range(1, attempts + 1):
        try:
            return client.complete(prompt)
        except Exception as e:
            last = e
            if k < attempts and wait:
                time.sleep(wait * k)
    return f"{ERROR}{last}"


def completed(rows: DataFrame, prompt: str, make: Callable[[], TextClient], out: str = "reply", tasks: int | None = None, attempts: int = 4, wait: float = 3.0) -> DataFrame:
    """rows with the reply to each prompt (null for a null prompt); ``tasks`` bounds how many ask at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for df in frames:
            yield df.assign(**{out: [None if p is None else ask(client, p, attempts, wait) for p in df[prompt]]})

    spread = rows.repartition(tasks) if tasks else rows
    return spread.mapInPandas(run, rows.withColumn(out, F.lit(None).cast("string")).schema)


def embedded(rows: DataFrame, content: str, make: Callable[[], VectorClient], out: str = "vector", batch: int = 64) -> DataFrame:
    """rows with the vector of each text, asked for in batches; blank texts are sent as "[empty]"."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for df in frames:
            texts = [t if t and t.strip() else "[empty]" for t in df[content]]
            got: list[list[float]] = []
            for k in range(0, len(texts), batch):
                part = client.embed(texts[k : k + batch])
                if len(part) != len(texts[k : k + batch]):
                    raise ValueError("as many vectors as texts are expected")
                got += part
            yield df.assign(**{out: got})

    return rows.mapInPandas(run, rows.withColumn(out, F.lit(None).cast("array<double>")).schema)


# ------------------------------------------------------------ prompts and replies


def answer_prompt(question: Column, form: Column, context: Column, strict: bool = True) -> Column:
    """The prompt for an answer from a context; ``strict`` asks for [INSUFFICIENT_CONTEXT] where it says nothing."""
    rule = "Answer from the context only; if it is not enough, reply [INSUFFICIENT_CONTEXT]." if strict else "Use the context where it helps."
    return F.concat(F.lit(rule + "\n\nQuestion: "), question, F.lit("\nAnswer format: "), F.coalesce(form, F.lit("free text")), F.lit("\n\nContext:\n"), F.coalesce(context, F.lit("(none)")), F.lit("\n\nAnswer:"))


def judge_prompt(question: Column, one: Column, two: Column) -> Column:
    """The prompt that asks which of two answers is better."""
    return F.concat(F.lit("Which answer is better? Reply winner=answer1 or winner=answer2.\n\nQuestion: "), question, F.lit("\nanswer1: "), one, F.lit("\nanswer2: "), two)


def verdict(reply: Column) -> Column:
    """True or False as a reply says, in a fence or bare, the last one first; null where it says neither."""
    said = F.regexp_extract_all(F.lower(F.coalesce(reply, F.lit(""))), F.lit(r"\b(true|false)\b"), F.lit(1))
    return F.try_element_at(said, F.lit(-1)) == "true"


def judged(examples: DataFrame, make: Callable[[], TextClient], **kw) -> DataFrame:
    """qa_id, score: answers held against the reference answer of their evaluator by a model; null where it gives no verdict."""
    gold = F.coalesce(F.get_json_object("evaluator.eval_kwargs", "$.reference_answer"), F.get_json_object("evaluator.eval_kwargs", "$.gold"))
    prompt = F.concat(F.lit("Is the answer right? Reply True or False.\n\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\nReference: "), F.coalesce(gold, F.lit("")), F.lit("\nAnswer: "), "answer")
    asked = completed(examples.where("answer is not null").select("qa_id", prompt.alias("prompt")), "prompt", make, **kw)
    return asked.select("qa_id", verdict(F.col("reply")).cast("double").alias("score"))


def image_message(prompt: Column, content: Column, kind: Column) -> Column:
    """A prompt with an image as a data url (prompt, url)."""
    return F.struct(prompt.alias("text"), F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(content)).alias("url"))


CLAIM = "array<struct<subject:string,subject_type:string,relation:string,object:string,object_type:string,evidence_quote:string,confidence:string,qualifiers:map<string,string>>>"


def extracted_claims(chunks: DataFrame, schema: DataFrame, make: Callable[[], TextClient], instruction: str = "List the claims of this text as JSON.", least: float = 0.65, most: int = 12, **kw) -> DataFrame:
    """Claims of evidence chunks (chunk_id, paper_id, text) as a model gives them, each with its errors; accepted: none.

    Fields are cleaned, relations in capitals, a confidence that is no number is 0. Beyond the schema,
    a quote has to stand in its chunk, and of a chunk the first ``most`` by priority and confidence are taken.
    """
    asked = completed(chunks.select("chunk_id", "paper_id", "text", F.concat(F.lit(instruction + "\n\n"), "text").alias("prompt")), "prompt", make, **kw)
    held = asked.select("chunk_id", "paper_id", "text", F.posexplode(F.from_json(F.try_variant_get(parse.json_object(F.col("reply")), "$.claims", "string"), CLAIM)).alias("k", "c"))
    fields = {n: text.clean(F.col(f"c.{n}")) for n in ("subject", "subject_type", "object", "object_type", "evidence_quote")}
    flat = held.select("chunk_id", "paper_id", "text", "k", *(v.alias(n) for n, v in fields.items()), F.upper(text.clean(F.col("c.relation"))).alias("relation"), F.coalesce(F.col("c.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), F.col("c.qualifiers").alias("qualifiers"))
    checked = claims.validated(flat, schema, least)
    quoted = F.when(~claims.quote_in(F.col("evidence_quote"), F.col("text")), F.array_append("errors", F.lit("quote not in chunk"))).otherwise(F.col("errors"))
    rows = checked.withColumn("errors", quoted).withColumn("edge_id", F.col("k").cast("bigint"))
    good = claims.capped(rows.where(F.size("errors") == 0), "chunk_id", most)
    over = good.withColumn("errors", F.when(F.col("accepted"), F.col("errors")).otherwise(F.array(F.lit("over the cap of its chunk"))))
    return over.unionByName(rows.where(F.size("errors") > 0).withColumn("accepted", F.lit(False))).drop("edge_id", "text")


def refined(wrong: DataFrame, contexts: DataFrame, schema: DataFrame, make: Callable[[], TextClient], key: str = "uuid", least: float = 0.55, **kw) -> DataFrame:
    """New claims from the contexts (key, context) of wrong answers: asked for, checked and merged, the most confident of each triple."""
    chunks = wrong.join(contexts, key).select(F.col(key).alias("chunk_id"), F.lit("").alias("paper_id"), F.substring("context", 1, 1500).alias("text"))
    got = extracted_claims(chunks, schema, make, "Which claims are missing? List them as JSON.", least, **kw).where("accepted")
    rows = got.withColumnRenamed("subject", "source").withColumnRenamed("object", "target").withColumn("edge_id", F.xxhash64("chunk_id", "k"))
    return rows.join(claims.merged(rows).select("edge_id"), "edge_id", "left_semi")


def extracted_terms(chunks: DataFrame, make: Callable[[], TextClient], steps: dict[str, str], **kw) -> dict[str, DataFrame]:
    """The tables of the steps asked for (terms, acronyms, definitions, relationships: instruction) over chunks (chunk_id, text), each distinct."""
    read = {
        "terms": lambda c: F.transform(parse.list_items(c), lambda x: F.struct(x.alias("term"))),
        "acronyms": lambda c: parse.pairs(c, False), "definitions": lambda c: parse.pairs(c, True), "relationships": parse.triples,
    }
    out = {}
    for name, instruction in steps.items():
        asked = completed(chunks.select("chunk_id", F.concat(F.lit(instruction + "\n\n"), "text").alias("prompt")), "prompt", make, **kw)
        out[name] = asked.select(F.explode(read[name](F.col("reply"))).alias("x")).select("x.*").distinct()
    return out


def refined_text(rows: DataFrame, content: str, stages: list[str], make: Callable[[], TextClient], **kw) -> DataFrame:
    """rows whose text went through stages of a model, each with its instruction and the reply before."""
    for s in stages:
        rows = completed(rows.withColumn("_p", F.concat(F.lit(s + "\n\n"), F.col(content))), "_p", make, "_r", **kw).withColumn(content, F.col("_r")).drop("_p", "_r")
    return rows


def generated(candidates: DataFrame, quota: DataFrame, kind: str, prompt: str, make: Callable[[], TextClient], attempts: int = 4, **kw) -> DataFrame:
    """Examples (id, kind, prompt, reply, fields) up to the quota (kind, n) of each kind, from more candidates than needed.

    At most ``attempts`` times the quota are asked for, in the order of their id; replies with a question and an
    answer count, the first of them stay.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(kind).orderBy("id")
    tried = candidates.join(quota.select(kind, F.col("n").alias("_n")), kind).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= attempts * F.col("_n"))
    asked = completed(tried, prompt, make, **kw)
    as_map = F.udf(excerpts.fields, "map<string,string>")
    good = asked.withColumn("fields", as_map("reply")).where(F.col("fields.question").isNotNull() & F.col("fields.answer").isNotNull())
    return good.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("_n")).drop("_k", "_n")
