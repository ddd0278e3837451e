"""Reading level of each English document, by a familiar-word formula.

A word is familiar at a level if documents of that level or an easier one hold it at least
``ALPHA`` times as often as any; the high-frequency lists so made are nested (school, general
reader, student), and the grade of a word is the number of lists it stands outside. The difficulty
of a sentence is the mean grade of its words (the sum of its shares of words outside each list),
that of a document is the mean over the middle half of its prose, plus a weight times the log of
its average sentence length. Headings, lists of references, tables and stray sentences fall away.

Document frequencies are counted over all documents: first by the levels readers gave to a sample,
then again by the levels these give to the whole corpus. The weight is that of a least-squares fit
of the labels on both terms; the thresholds are those that err least on the labels.

Texts are read once: the prose of each is kept as 32-bit numbers of its words (CRC-32; a word of no
list takes the grade of a listed one by chance in seven of a million cases) and the lengths of its
sentences, and all later passes run over these with arrays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import checkpoint

ALPHA = 0.25
LEVELS = (1, 2, 3, 4)
# ---- fixed values: function words by which English is told from other languages ----
ENGLISH = frozenset("the of is and to it that this are was were with by for from which has have be been not its as at or an can you your if when then than they their we our will what how does do into because these there one only who she he out up some all but".split())
OTHERS = {
    "de": frozenset("der die das und ist nicht mit wird werden wurde wurden eine einer dem den von zu zur wie bei für auf sind durch nach aus sich wenn nimmt".split()),
    "fr": frozenset("le les des du une est et que qui dans pour avec sur été plus au aux ont cette ce ces se sont par puis nous quand il".split()),
    "es": frozenset("el los las del una y que con se por más como está son entre sobre cuando después muy este esta estos luego".split()),
    "it": frozenset("il gli della delle che per con è sono una nel più questo".split()),
    "pt": frozenset("os as da dos das um uma não com para é são mais foi como pelo".split()),
}
# ---- end of fixed values ----

_TAG = re.compile(r"<\s*/?\s*(?:p|br|div|li|h[1-6]|tr|ul|ol|table|td|th)\b[^<>]*>", re.I)
_ANY_TAG = re.compile(r"<[^<>]{1,200}>")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_EOL = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”’)\]]*\s+|;\s+|\s[-–—]\s")
_REFERENCE = re.compile(r"^\s*(?:\[\d{1,3}\]|\(?\d{1,3}[.)]\s+(?=.*\(\d{4}\)|.*\bet al)|[A-Z][\w'’-]+,? (?:[A-Z]\.,? ?)+.*\(\d{4}\))")
_REFERENCES = re.compile(r"^\W*(?:\d+\.?\s*)?(?:references|bibliography|literature|works cited|further reading)\W*$", re.I)


def prose(text: str | None) -> list[list[str]]:
    """Sentences of the prose of a text as words in lower case; no headings, references, tables or markup."""
    if not text:
        return []
    text = _INVISIBLE.sub("", _ANY_TAG.sub(" ", _TAG.sub("\n", text))).replace("&amp;", "&").replace("&nbsp;", " ")
    lines, out, refs = [x.strip() for x in _EOL.split(text)], [], False
    joined: list[str] = []
    for x in lines:  # hard-wrapped lines belong together
        if joined and joined[-1] and x and joined[-1][-1] not in ".!?:;" and x[0].islower():
            joined[-1] += " " + x
        else:
            joined.append(x)
    for x in joined:
        if not x:
            continue
        if _REFERENCES.match(x):
            refs = True
            continue
        if _REFERENCE.match(x) or (refs and re.search(r"\(\d{4}\)", x)):
            continue
        words = _WORD.findall(x)
        if len(words) < 2 or 2 * sum(map(len, words)) < sum(map(len, x.split())):
            continue
        if x[-1] not in ".!?…\"”)'’" and len(words) <= 10:
            continue
        refs = False
        out += [w for s in _SENTENCE.split(x) if s and (w := [y.lower() for y in _WORD.findall(s)])]
    return out


def _number(word: str) -> int:
    """The number of a word (never 0) and, above 32 bits, which languages have it as a function word (bit 0: English)."""
    tongues = (word in ENGLISH) + sum((word in v) * (2 << k) for k, v in enumerate(OTHERS.values()))
    return (tongues << 32) + (zlib.crc32(word.encode()) or 1)


_KEEP = "doc_id bigint, english int, other int, words binary, lengths binary"


def read_prose(docs: DataFrame, least: int = 30) -> DataFrame:
    """doc_id, english, other, words, lengths of every document with at least ``least`` words of prose.

    english, other: how many words are function words of English, and of the other language that has
    most of them; words, lengths: numbers of the words and lengths of the sentences, as bytes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: dict[str, int] = {}
        for df in frames:
            got = []
            for i, text in zip(df["doc_id"], df["text"], strict=True):
                sentences = prose(text)
                n = sum(map(len, sentences))
                if n < least:
                    continue
                codes = np.fromiter((number.get(w) or number.setdefault(w, _number(w)) for s in sentences for w in s), dtype=np.int64, count=n)
                tongues = codes >> 32
                other = max(np.count_nonzero(tongues & (2 << k)) for k in range(len(OTHERS)))
                got.append((i, np.count_nonzero(tongues & 1), other, codes.astype(np.uint32).tobytes(), np.array([len(s) for s in sentences], dtype=np.uint32).tobytes()))
                if len(number) > 500_000:
                    number.clear()
            yield pd.DataFrame(got, columns=["doc_id", "english", "other", "words", "lengths"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where((F.length("text") > 0) & F.col("doc_id").isNotNull())
    return texts.mapInPandas(run, _KEEP)


class Model:
    """Graded word numbers, the weight of the sentence length and the three thresholds."""

    def __init__(self, words: np.ndarray, grade: np.ndarray, weight: float = 0.0, cuts: tuple[float, ...] = (0.5, 1.2, 1.8)):
        self.words, self.grade, self.weight, self.cuts = words, grade, weight, cuts

    def features(self, df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(English?, mean grade over the middle half of the prose by difficulty, log of the average sentence length) of each row.

        English: the words between the content words are English ones, and more of them than of any
        other language. Telegraphic prose has few such words: it counts if it has no foreign ones
        either and most of its words are listed.
        """
        if df.empty:
            return np.zeros(0, dtype=bool), np.zeros(0), np.zeros(0)
        words = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in df["words"]])
        lengths = [np.frombuffer(x, dtype=np.uint32).astype(np.int64) for x in df["lengths"]]
        per_doc = np.array([len(x) for x in lengths])
        length = np.concatenate(lengths)
        first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])  # first sentence of each document
        n = np.add.reduceat(length, first)
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        listed = self.words[at] == words if len(self.words) else np.zeros(len(words), dtype=bool)
        grade = np.where(listed, self.grade[at] if len(self.words) else 0, len(LEVELS) - 1)
        mean = np.add.reduceat(grade, np.concatenate([[0], np.cumsum(length)[:-1]])) / length
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        order = np.lexsort((length, mean, doc))
        mean, size = mean[order], length[order]
        begin = np.cumsum(size) - size
        begin -= begin[first][doc]
        part = np.maximum(0.0, np.minimum(begin + size, 0.75 * n[doc]) - np.maximum(begin, 0.25 * n[doc]))
        g = np.add.reduceat(mean * part, first) / np.maximum(np.add.reduceat(part, first), 1e-9)
        known = np.add.reduceat(listed.astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
        en, other = df["english"].to_numpy(), df["other"].to_numpy()
        english = ~((other > 0) & (en <= 1.5 * other)) & ((en >= 0.1 * n) | ((other <= 0.02 * n) & (known >= 0.7 * n)))
        return english, g, np.log(n / per_doc)

    def levels(self, g: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1 + (g[:, None] + self.weight * length[:, None] > np.array(self.cuts)).sum(axis=1)


def grades(rows: list[tuple[int, list[float]]], docs: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, grades) of words from their document frequencies by level; ``docs``: documents of each level."""
    rate = np.array([by for _, by in rows], dtype=float).reshape(len(rows), len(LEVELS)) / np.maximum(docs, 1.0)
    reach = np.maximum.accumulate(rate, axis=1) >= ALPHA * rate.max(axis=1, keepdims=True)
    words = np.array([w for w, _ in rows], dtype=np.uint32)
    order = np.argsort(words)
    return words[order], reach.argmax(axis=1)[order]


def fit(model: Model, rows: list[tuple[float, float, float]]) -> Model:
    """Weight and thresholds from (grade, log length, level) rows of labelled documents."""
    if not rows:
        return model
    x = np.array(rows, dtype=float)
    slope = np.linalg.lstsq(np.c_[x[:, :2], np.ones(len(x))], x[:, 2], rcond=None)[0]
    weight = float(slope[1] / slope[0]) if slope[0] > 0 and slope[1] > 0 else 0.0
    score, cuts = x[:, 0] + weight * x[:, 1], []
    order = np.argsort(score, kind="stable")
    v = score[order]
    for k in LEVELS[:-1]:
        above = (x[order, 2] > k).astype(float)
        # errors if the cut stands after the i-th: levels above among those below it, and the reverse
        cost = np.concatenate([[0], np.cumsum(above)]) + np.concatenate([np.cumsum((1 - above)[::-1])[::-1], [0]])
        least = np.flatnonzero(cost == cost.min())
        i = int(least[len(least) // 2])
        cuts.append(float((v[max(i - 1, 0)] + v[min(i, len(v) - 1)]) / 2))
    return Model(model.words, model.grade, weight, tuple(np.maximum.accumulate(cuts).tolist()))


def _frequencies(rows: DataFrame, model: Model | None, list_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Graded list of the ``list_size`` most frequent words, from document frequencies by level.

    rows: as ``read_prose`` gives them and, where ``model`` is None, level. Counted per batch, then summed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if model is None:
                level = df["level"].to_numpy()
            else:
                english, g, length = model.features(df)
                df, level = df[english], model.levels(g, length)[english]
            if df.empty:
                continue
            held = [np.unique(np.frombuffer(x, dtype=np.uint32)).astype(np.int64) for x in df["words"]]
            held = [np.concatenate([[0], x]) for x in held]  # 0 counts the documents
            key = np.concatenate(held) * 8 + np.repeat(level, [len(x) for x in held])
            key, count = np.unique(key, return_counts=True)
            yield pd.DataFrame({"word": key // 8, "level": (key % 8).astype(np.int32), "n": count})

    counts = rows.mapInPandas(run, "word bigint, level int, n bigint")
    by = counts.groupBy("word").agg(*(F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(f"l{k}") for k in LEVELS), F.sum("n").alias("all"))
    top = [(r["word"], [float(r[f"l{k}"]) for k in LEVELS]) for r in by.orderBy(F.desc("all"), "word").limit(list_size + 1).collect()]
    docs = dict(top).get(0, [0.0] * len(LEVELS))
    return grades([x for x in top if x[0]], docs)


def train(read: DataFrame, labels: DataFrame, max_labels: int = 20_000, list_size: int = 30_000) -> Model | None:
    """Word lists, weight and thresholds from all documents as ``read_prose`` gives them, and the labels; None where nothing is labelled.

    ``max_labels`` bounds the labelled documents used (those first in hash order, of repeated ids one
    row), ``list_size`` the words of the lists: a word beyond is familiar at no level. A document's
    label is the mean of its readers'; null labels don't count.
    """
    one = labels.where(F.col("level").between(1, 4)).groupBy("doc_id").agg(F.avg("level").alias("mean"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    labelled = checkpoint(read.join(F.broadcast(one), "doc_id").dropDuplicates(["doc_id"]).withColumn("level", F.round("mean").cast("int")))
    if labelled.isEmpty():
        return None

    def rows(model: Model) -> list[tuple[float, float, float]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                english, g, length = model.features(df)
                yield pd.DataFrame({"g": g, "length": length, "level": df["mean"]})[english]

        return [tuple(r) for r in labelled.mapInPandas(run, "g double, length double, level double").collect()]

    first = Model(*_frequencies(labelled, None, list_size))
    first = fit(first, rows(first))
    model = Model(*_frequencies(read, first, list_size))
    return fit(model, rows(model))


def reading_levels(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, list_size: int = 30_000) -> DataFrame:
    """doc_id, level (1 to 4) of every document with at least 30 words of English prose.

    Null, empty and white texts, rows without an id, other languages, number dumps and stubs have no row; repeated
    documents have one each; without any label the result is empty.
    """
    read = checkpoint(read_prose(docs))
    model = train(read, labels, max_labels, list_size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if model:
                english, g, length = model.features(df)
                yield pd.DataFrame({"doc_id": df["doc_id"], "level": model.levels(g, length)})[english]

    return read.mapInPandas(run, "doc_id bigint, level bigint")
