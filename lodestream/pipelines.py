"""Pipelines as functions over one session: settings, run folders, caches, resumed answering, stages in order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream import models
from lodestream.operators import bundles, candidates, evaluation, quality
from lodestream.session import checkpoint
from lodestream.sources import sinks


@dataclass(frozen=True)
class CrawlSettings:
    """What is searched, and how much of it is kept."""

    query: str
    keywords: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    years: tuple[int, int] | None = None
    target: int = 30
    most: int = 120
    per_source: int = 10
    pool: int = field(default=0)

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValueError("a query is needed")
        if self.years and self.years[0] > self.years[1]:
            raise ValueError("the first year comes after the last")
        if min(self.target, self.most, self.per_source) <= 0:
            raise ValueError("numbers have to be positive")
        object.__setattr__(self, "pool", self.pool or max(2 * self.target, 80))
        if self.pool > self.most:
            raise ValueError(f"at most {self.most} candidates can't make a pool of {self.pool}")

    @property
    def phrases(self) -> list[str]:
        return candidates.distinct_phrases([self.query, *self.keywords])


def run_id(prefix: str = "run", now: datetime | None = None) -> str:
    return f"{prefix}_{(now or datetime.now(timezone.utc)):%Y%m%d_%H%M%S}"


def chosen_run(explicit: str | None = None, active: str | None = None, fresh: bool = False, now: datetime | None = None) -> str:
    """The run that is meant: the one named, else a fresh one if asked for, else the active one, else a fresh one."""
    return explicit or (run_id(now=now) if fresh or not active else active)


def key_of(**parts: object) -> str:
    """A short hash of settings, the same for the same parts in any order."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def exists(spark: SparkSession, path: str) -> bool:
    """A finished table or file at a path, on any file system that the session knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and (not fs.isDirectory(p) or bool(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))))


def cached(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table built once for a key (a version, settings, a fingerprint of the input); later runs read it."""
    path = f"{root}/key={key}"
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def record_key(columns: Sequence[Column | str]) -> Column:
    """A hash of all that an answer depends on; nulls and blanks differ."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\u0000")) for c in columns))), 256)


def resumed(spark: SparkSession, questions: DataFrame, path: str, keys: Sequence[str], answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers (uuid, record_key, answer) of all questions: those stored for the same key are kept, the rest are asked and appended.

    The store is append-only, so a run that is cut off loses only what it hadn't written; of several answers the last counts.
    """
    asked = questions.withColumn("record_key", record_key(list(keys)))
    if exists(spark, path):
        stored = spark.read.parquet(path)
        asked = asked.join(stored.select("uuid", "record_key"), ["uuid", "record_key"], "left_anti")
    fresh = answer(checkpoint(asked)).select("uuid", "record_key", "answer", F.current_timestamp().alias("at"))
    fresh.write.mode("append").parquet(path)
    wanted = questions.select("uuid", record_key(list(keys)).alias("record_key")).distinct()
    last = sinks.latest(spark.read.parquet(path).withColumn("_key", F.concat_ws("|", "uuid", "record_key")), "_key", "at").drop("_key")
    return last.join(wanted, ["uuid", "record_key"], "left_semi").select("uuid", "record_key", "answer")


def in_sequence(stages: Sequence[tuple[str, Callable[[dict], DataFrame | None]]], state: dict | None = None, reuse: Callable[[str], DataFrame | None] | None = None) -> dict:
    """Stages one after the other, each given what the ones before made; ``reuse`` may supply a stage's result. The first failure ends it."""
    state = dict(state or {})
    for name, stage in stages:
        kept = reuse(name) if reuse else None
        try:
            state[name] = kept if kept is not None else stage(state)
        except Exception as e:
            raise RuntimeError(f"stage {name} failed") from e
    return state


def candidate_papers(papers: DataFrame, settings: CrawlSettings) -> DataFrame:
    """From found papers to a queue: filtered, merged by key, ranked in each source by phrases and citations, the open ones with a PDF queued."""
    kept = candidates.without_terms(papers, list(settings.excluded)) if settings.excluded else papers
    if settings.years:
        kept = candidates.in_years(kept, *settings.years)
    one = kept.join(candidates.merged(kept).select("cand_id"), "cand_id", "left_semi")
    tokens, phrases = candidates.ranking_context(settings.query, list(settings.keywords))
    ranked = candidates.ranked(one, phrases, tokens, most=settings.most)
    queue = candidates.download_queue(one.join(ranked.select("cand_id"), "cand_id", "left_semi"), settings.per_source)
    return ranked.join(queue.select("cand_id", "url", "position"), "cand_id", "left")


def answered(examples: DataFrame, edges: DataFrame, tokens: Callable[[str], list[str]], make: Callable[[], models.TextClient], most: int = 6, limit: int = 12_000, asked: int = 1000, **kw) -> DataFrame:
    """uuid, answer, rounds: questions answered from their node bundles, widened while the answer says that the context is not enough.

    ``asked`` bounds the questions of a run, as each walks the graph once; more are an error.
    """
    rows = examples.select("uuid", "question", "answer_format").limit(asked + 1).collect()
    if len(rows) > asked:
        raise ValueError(f"at most {asked} questions are answered in a run")
    texts = checkpoint(bundles.node_texts(edges))
    lines = edges.select("edge_id", bundles.edge_line().alias("line"), bundles.edge_cost().alias("cost"))
    found = None
    for r in rows:
        query = tokens(r["question"] or "")
        got = bundles.node_bundles(edges, bundles.candidate_nodes(texts, query, most), query).withColumn("question_id", F.lit(r["uuid"]))
        found = got if found is None else found.unionByName(got)
    if found is None:
        return examples.select("uuid", F.lit("").alias("answer"), F.lit(0).alias("rounds")).limit(0)
    found = checkpoint(found)

    def answer(part: DataFrame) -> DataFrame:
        shown = bundles.bundle_context(part, lines, limit).join(lines.select("edge_id", "line"), "edge_id")
        context = shown.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]), "\n").alias("context"))
        asked_for = examples.select(F.col("uuid").alias("question_id"), "question", "answer_format")
        prompts = asked_for.join(context, "question_id").select("question_id", models.answer_prompt(F.col("question"), F.col("answer_format"), F.col("context")).alias("prompt"))
        return checkpoint(models.completed(prompts, "prompt", make, "answer", **kw).select("question_id", "answer"))

    return bundles.widened(found, answer, most=most).select(F.col("question_id").alias("uuid"), "answer", "rounds")


def evaluated(examples: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, summary) of answers (uuid, answer) by the evaluators that need no model."""
    rows = examples.drop("answer").join(answers.select("uuid", "answer"), "uuid", "left")
    scores = evaluation.scored_all(rows)
    return scores, evaluation.summary(scores)


def dataset(examples: DataFrame) -> DataFrame:
    """The examples of a data set: without a flaw, and not taken up by another one."""
    sound = quality.quality_gate(examples).where("reason is null").select("qa_id")
    used = examples.select(F.explode("from_uuids").alias("uuid")).distinct()
    return examples.join(sound, "qa_id", "left_semi").join(used, "uuid", "left_anti")
