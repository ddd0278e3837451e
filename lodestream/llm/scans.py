"""Noise in text from scanned pages, found and repaired.

Three sources of evidence are gathered over all sections: how many sections hold a word, how many
hold a short line (fuzzily: digits and characters that scanners confuse are folded), and how often
such a line interrupts a sentence. Running heads stand at the edge of a page, that is between two
blocks of prose or beside a page number: there they are lines that repeat and whose words live only
in them, or lines in the shape of a running head. Page numbers are number lines that count up from
one to the next through the section, and lone ones beside prose.
Words cut at a line end are joined if the corpus knows the joined word better than the
compound; misread words are those that turn into a common word when one confusion is undone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import checkpoint, parallelism, sized

# ---- fixed values: characters that scanners confuse, (printed, read) ----
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("i", "!"), ("i", "l"), ("i", "1"), ("l", "1"), ("l", "i"), ("l", "!"), ("l", "|"), ("i", "|"), ("t", "f"), ("f", "t"),
    ("o", "0"), ("a", "@"), ("s", "5"), ("s", "$"), ("g", "q"), ("g", "9"), ("q", "g"), ("b", "6"), ("b", "h"), ("h", "b"), ("b", "8"), ("z", "2"),
    ("n", "ri"), ("u", "ii"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("h", "li"), ("li", "h"), ("n", "u"), ("u", "n"), ("y", "v"), ("v", "y"),
]
#: Folding to one character of each confusable class, longer first.
FOLDS = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n"), ("0", "o"), ("1", "i"), ("l", "i"), ("!", "i"), ("|", "i"), ("@", "a"), ("5", "s"), ("c", "e"), ("q", "g"), ("9", "g"), ("6", "b"), ("h", "b"), ("8", "b")]
# ---- end of fixed values ----

_EOL = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_HYPHEN = "-\u2010\u2011\u00ad–¬"
_HYPHENS = frozenset(_HYPHEN)
_WORD_SPLIT = re.compile(r"[\s\-–—\u2010\u2011\u00ad¬/]+")
_STRIP = ".,;:()[]{}\"“”‘’'?…=*†"
_CUT_END = re.compile(rf"(?P<left>[^\W_][\w!@$|\u00ad]*)[{_HYPHEN}][ \t]*$")


class _Cut:
    """A word cut at the end of a line. Only the end of a line is looked at, so long lines cost nothing."""

    @staticmethod
    def search(line: str) -> re.Match | None:
        return _CUT_END.search(line, max(0, len(line) - 80)) if line.rstrip(" \t")[-1:] in _HYPHENS else None

    @staticmethod
    def sub(by: str, line: str) -> str:
        m = _Cut.search(line)
        return line[: m.start()] + by if m else line


_CUT = _Cut
_FIRST = re.compile(r"[ \t]*(?P<right>[^\W\d_][\w!@$|]*)")
_DIGITS = r"(?:[0-9][0-9OolISBZ!]{0,4}|[OolISBZ!]{1,2}[0-9]{1,3}[OolISBZ!]?)"
_ROMAN = r"(?:[ivxlc1!]*[ivx][ivxlc1!]*)"
#: Page-number lines: bare, roman, bracketed, between dashes, with "page".
_PAGE = re.compile(
    rf"^\s*(?:(?P<bare>{_DIGITS}|{_ROMAN})|\[\s?{_DIGITS}\s?\]|[-–—~·]+\s?(?:{_DIGITS}|{_ROMAN})\s?[-–—~·]+|p(?:p|g)?\.\s?{_DIGITS}|(?i:p[a@]ge)\s{_DIGITS}(?:\s(?:of|/)\s{_DIGITS})?|{_DIGITS}\s?/\s?{_DIGITS}|{_DIGITS}\s?\|\s?p\s?[a@]\s?[gq]\s?[ec])\s*$",
    re.I,
)
_LEAD = re.compile(rf"^\s*(?P<n>{_DIGITS})\s+(?=[^\W\d_])")
_TRAIL = re.compile(rf"(?:\s{{2,}}|\t)(?P<n>{_DIGITS})\s*$")
_LIST = re.compile(r"^\s*(?:\(?\d{1,3}[.)]|[-–•*·])\s")
_SHAPES = (
    re.compile(r"^[A-Z][^.!?]{2,60}?,? (?:Vol\.?|No\.?|Volume) ?\d+(?:\s?\(\d{4}\))?$"),
    re.compile(r"^[A-Z][^.!?]{2,60} \d+ ?\(\d{4}\)$"),
    re.compile(r"^[A-Z][\w'’!@-]+(?: (?:and|&) [A-Z][\w'’-]+)? [ec]t [a@][l1i!]\.?$"),
    re.compile(r"^[A-Z][\w'’!@-]+(?: [A-Z]\.)*: [A-Z\d][^.!?]{5,90}$"),
)


def fold(text: str) -> str:
    """A line in lower case with figures as # and confusable characters as one."""
    s = re.sub(r"\d+", "#", " ".join(text.lower().split()))
    for a, b in FOLDS:
        s = s.replace(a, b)
    return s


_SMALL = re.compile(r"(?:[a-z][^a-z]*){10}")


def _capitals(s: str) -> bool:
    if len(s) <= 100 and _SMALL.search(s):  # more than a tenth of its letters
        return False
    letters = [c for c in s if c.isalpha()]
    small = sum(c.islower() for c in letters)
    return len(letters) >= 6 and small <= 0.1 * len(letters) and not re.search(r"[=→]", s) and (" " in s.strip() or len(letters) >= 9)


def tokens(line: str) -> list[str]:
    """Words of a line in lower case, compounds in parts, outer punctuation off."""
    return [w for x in _WORD_SPLIT.split(line.lower()) if (w := x.strip(_STRIP).rstrip("!"))]


_ROMANS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_MISREAD = str.maketrans("OolIiSsBbZz!", "001115588221")


def number_of(text: str) -> int | None:
    """The number in a page-number line, misread figures and roman ones too."""
    if m := re.search(r"[0-9OolISBZ!]*[0-9][0-9OolISBZ!]*", text):
        return int(m[0].translate(_MISREAD))
    m = re.search(_ROMAN, text.lower())
    digits = [_ROMANS[c] for c in m[0].replace("1", "i").replace("!", "i")] if m else []
    return sum(-a if any(b > a for b in digits[k + 1 : k + 2]) else a for k, a in enumerate(digits)) or None


class Line:
    """What one line of a section may be."""

    __slots__ = ("no", "text", "blank", "page", "number", "count", "core", "shape", "candidate", "interrupts", "edge")

    def __init__(self, no: int, text: str, longest: int = 90):
        s = text.strip()
        self.no, self.text, self.blank = no, text, not s
        self.page = len(s) <= 24 and bool(_PAGE.match(text))
        self.number, self.core, self.shape, self.candidate, self.interrupts, self.edge = False, "", False, False, False, False
        self.count = number_of(s) if self.page else None
        if self.blank or self.page or len(s) > longest + 2:
            return
        if s[0].islower() and _SMALL.search(s):  # neither in capitals nor begun with one
            return
        s = re.sub(r"\s+\.$", "", s)
        if len(s) > longest or "=" in s or (_LIST.match(s) and not _LEAD.match(s)):
            return
        core = s
        if m := _LEAD.match(core):
            core, self.number, self.count = core[m.end() :].strip(), True, number_of(m["n"])
        if m := _TRAIL.search(core):
            core, self.number, self.count = core[: m.start()].strip(), True, number_of(m["n"])
        self.core = core
        self.shape = any(p.match(core) for p in _SHAPES) or _capitals(core)
        self.candidate = self.shape or (core[:1].isupper() and core[-1:] not in ".!?;,:" and len(core.split()) <= 9 and not _CUT.search(core))


def _prose(line: Line) -> bool:
    return not line.blank and not line.page and len(line.text.split()) >= 4 and not _LIST.match(line.text)


def lines_of(text: str, missed: int = 3) -> list[Line]:
    """The lines of a section with what stands around them worked out.

    A number line is in a sequence if the next or the last number line of the section is 1 to
    ``missed`` + 1 further on (some numbers may have been lost).
    """
    lines = [Line(k, x) for k, x in enumerate(_EOL.split(text))]
    n = len(lines)
    furniture = [x for x in lines if x.page or x.candidate]
    if not furniture:
        return lines
    counted = [x for x in furniture if x.count is not None and (x.page or x.shape)]
    in_sequence = {x.no for a, b in zip(counted, counted[1:], strict=False) if 1 <= b.count - a.count <= missed + 1 for x in (a, b)}

    def beside(k: int, step: int) -> Line | None:
        k += step
        while 0 <= k < n and (lines[k].page or lines[k].shape) and not lines[k].blank:
            k += step
        return lines[k] if 0 <= k < n else None

    for x in furniture:
        a, b = beside(x.no, -1), beside(x.no, 1)
        open_before = a is not None and not a.blank and a.text.rstrip()[-1:] not in ".!?:"
        x.interrupts = bool(open_before and b is not None and b.text.lstrip()[:1].islower())
        near = [lines[k] for k in range(max(0, x.no - 2), min(n, x.no + 3)) if k != x.no and not lines[k].blank]
        x.edge = x.interrupts or x.number or any(y.page or _prose(y) for y in near)
        if x.page and not x.interrupts and x.no not in in_sequence and (n < 3 or _PAGE.match(x.text)["bare"]):
            # a lone bare number needs prose or furniture beside it
            x.page = any(len(y.text.split()) >= 4 and not _LIST.match(y.text) or y.shape for y in near)
    return lines


def splits_of(lines: list[Line]) -> list[tuple[int, str, str, int]]:
    """(line, left part, right part, line of the right part) of words cut at a line end; furniture may stand between."""
    out: list[tuple[int, str, str, int]] = []
    open_cuts: list[tuple[Line, re.Match]] = []
    for y in lines:
        if y.blank or y.page or y.shape:
            if not y.blank and not y.page and (m := _CUT.search(y.text)):
                open_cuts.append((y, m))
            continue
        r = _FIRST.match(y.text) if open_cuts else None
        if r:
            upper = r["right"][:1].isupper()
            taken = [(x, m) for x, m in open_cuts if not upper or x.text.isupper()]
            out += [(x.no, m["left"].lower().replace("\u00ad", ""), r["right"].lower().rstrip("!"), y.no) for x, m in taken]
            if not y.candidate:  # a line of text: what it doesn't take up stays open no longer
                taken = open_cuts
            open_cuts = [c for c in open_cuts if c not in taken]
        if m := _CUT.search(y.text):
            open_cuts.append((y, m))
    return sorted(out)


def undone(word: str) -> set[str]:
    """The words that one undone confusion (at one place, or at all of a kind) can give."""
    out = set()
    for printed, read in CONFUSIONS:
        at = word.find(read)
        while at >= 0:
            out.add(word[:at] + printed + word[at + len(read) :])
            at = word.find(read, at + 1)
        out.add(word.replace(read, printed))
    for a in list(out):  # two different confusions in one word, where the word holds figures or signs
        if re.search(r"[0-9!@$|]", a):
            for printed, read in CONFUSIONS:
                if re.search(r"[0-9!@$|]", read) and read in a:
                    out.add(a.replace(read, printed))
    out.discard(word)
    return {w for w in out if w.isalpha()}


def _sections(sections: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return sections.select(F.col(id_col).cast("bigint").alias("section_id"), F.col(text_col).cast("string").alias("content")).where((F.length("content") > 0) & F.col("section_id").isNotNull())


def read_lines(sections: DataFrame, id_col: str = "section_id", text_col: str = "content", longest: int = 64) -> DataFrame:
    """section_id, signs, words of every section with content, from one reading of its text.

    signs: struct(kind, line, a, b, at) of page numbers, lines that may be running heads, and words
    cut at a line end; words: a line for compounds and words of under three letters, then one for each line of the text
    with the words that stand there first. Runs of over ``longest`` letters are no words.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sign = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                signs: list[tuple] = []
                words: list[str] = []
                ends = [0]
                for text in part.column(1).to_pylist():
                    lines = lines_of(text)
                    splits = splits_of(lines)
                    after = {no for *_, no in splits}
                    first: dict[str, int] = {}
                    for x in lines:
                        if x.page:
                            signs.append(("page_no", x.no, x.text, "", -1))
                        elif x.candidate:
                            signs.append(("shape" if x.shape and x.edge else "line", x.no, fold(x.core), "1" if x.interrupts else "0", int(x.number)))
                        if not x.page and not x.blank:
                            line = _CUT.sub("", x.text)
                            if x.no in after:
                                line = _FIRST.sub("", line, count=1)
                            for w in tokens(line):
                                if len(w) < longest:
                                    first.setdefault(w, x.no if len(w) >= 3 else -1)
                            if "-" in line:
                                for w in line.lower().split():
                                    if "-" in w and len(c := w.strip(_STRIP)) < longest and "-" in c:
                                        first.setdefault(c, -1)
                    signs += [("split", *x) for x in ((n, a, b, no) for n, a, b, no in splits)]
                    by_line: list[list[str]] = [[] for _ in range(len(lines) + 1)]
                    for w, no in first.items():
                        by_line[no + 1].append(w)
                    words.append("\n".join(map(" ".join, by_line)))
                    ends.append(len(signs))
                columns = zip(*signs, strict=True) if signs else [[]] * 5
                struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, sign, strict=True)], names=["kind", "line", "a", "b", "at"])
                listed = [part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct), pa.array(words, pa.string())]
                yield pa.RecordBatch.from_arrays(listed, names=["section_id", "signs", "words"])

    shape = "section_id bigint, signs array<struct<kind:string,line:bigint,a:string,b:string,at:bigint>>, words string"
    return _sections(sections, id_col, text_col).mapInArrow(run, shape)


def find_noise(sections: DataFrame, id_col: str = "section_id", text_col: str = "content", ratio: int = 20, least: int = 5) -> DataFrame:
    """All noise of all sections: section_id, kind (hyphen, ocr_char, header, page_no), line, a, b, at.

    a is what stands in the text, b what it should be, at the line of a word's second part. Null
    and empty contents and rows without an id have none; repeated sections are treated each; other
    columns are ignored. ``ratio`` and ``least``: a word is misread if the word it may stand for is in
    at least ``least`` and ``ratio`` times as many sections.
    """
    read = checkpoint(read_lines(sections, id_col, text_col))
    vocab = checkpoint(read.select(F.explode(F.split("words", "[ \n]+")).alias("word")).where(F.length("word") > 0).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    known = vocab.select(F.col("word").alias("fixed"), F.col("df").alias("fixed_df")).where(F.col("fixed_df") >= least)
    signs = read.select("section_id", F.explode("signs").alias("s")).select("section_id", "s.*")

    def undo(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [(w, n, u) for w, n in zip(df["word"], df["n"], strict=True) for u in undone(w)]
            yield pd.DataFrame(got, columns=["word", "n", "fixed"])

    def meant(words: DataFrame) -> DataFrame:
        """word, n, fixed, fixed_df of the words (word, n) that are misread."""
        tried = words.repartition(parallelism(read.sparkSession)).mapInPandas(undo, "word string, n bigint, fixed string").join(known, "fixed")
        return tried.where(F.col("fixed_df") >= ratio * F.col("n"))

    # Words cut at a line end: which of joined word and compound does the corpus know better?
    pairs = signs.where("kind = 'split'").select("a", "b").distinct().select("a", "b", F.concat("a", "b").alias("joined"), F.concat_ws("-", "a", "b").alias("compound"))
    count = lambda name: vocab.select(F.col("word").alias(name), F.col("df").alias(f"n_{name}"))
    pairs = pairs.join(count("joined"), "joined", "left").join(count("compound"), "compound", "left").join(count("a"), "a", "left").join(count("b"), "b", "left")
    pairs = checkpoint(pairs.fillna(0, ["n_joined", "n_compound", "n_a", "n_b"]))
    # Misread words, rare ones of the lines and unknown joined ones alike.
    odd = vocab.where(F.length("word") >= 3).select("word", F.col("df").alias("n")).unionByName(pairs.where("n_joined < n_compound + 2").select(F.col("joined").alias("word"), F.col("n_joined").alias("n")).distinct())
    misread = checkpoint(meant(odd).groupBy("word").agg(F.max_by("fixed", F.struct("fixed_df", "fixed")).alias("fixed")))
    at = read.select("section_id", F.posexplode(F.split("words", "\n")).alias("line", "held")).where("line > 0 and length(held) > 0")
    each = at.select("section_id", (F.col("line") - 1).cast("bigint").alias("line"), F.explode(F.split("held", " ")).alias("word"))
    words = each.join(sized(misread), "word").select("section_id", F.lit("ocr_char").alias("kind"), "line", F.col("word").alias("a"), F.col("fixed").alias("b"), F.lit(-1).cast("bigint").alias("at"))
    judged = pairs.join(misread.withColumnRenamed("word", "joined"), "joined", "left")
    cut = (F.col("n_joined") > F.col("n_compound")) | ((F.col("n_compound") == 0) & (F.col("fixed").isNotNull() | ~((F.col("n_a") >= least) & (F.col("n_b") >= least))))
    judged = judged.where(cut & ~F.col("b").isin("and", "or", "to", "und", "et", "y")).select("a", "b", F.coalesce("fixed", "joined").alias("whole"), F.col("fixed").isNotNull().alias("misread"))
    parts = signs.where("kind = 'split'").join(judged, ["a", "b"])
    hyphens = parts.select("section_id", F.lit("hyphen").alias("kind"), "line", F.concat_ws("-", "a", "b").alias("a"), F.col("whole").alias("b"), "at")
    cut_misread = parts.where("misread").select("section_id", F.lit("ocr_char").alias("kind"), "line", F.concat_ws("-", "a", "b").alias("a"), F.col("whole").alias("b"), "at")
    # Running heads by fuzzy repetition: lines that interrupt sentences and have words of their own. A line in the shape
    # of one that stands at an edge needs no repetition.
    seen = signs.where("kind in ('line', 'shape')")
    keys = seen.groupBy("a").agg(F.countDistinct("section_id").alias("n"), F.count(F.lit(1)).alias("times"), F.sum(F.col("b").cast("int")).alias("interrupts"))
    keys = keys.where("times >= 2 and interrupts > 0 and interrupts >= 0.25 * times")
    folded = _folded(vocab)
    own = keys.select("a", "n", F.explode(F.split("a", r"[\s#\-–—/.,;:()]+")).alias("w")).where(F.length("w") >= 4).join(folded.withColumnRenamed("word", "w"), "w")
    heads = own.groupBy("a").agg(F.min(F.col("df") / F.col("n")).alias("least")).where("least <= 1.5").select("a")
    found = seen.join(heads.withColumn("repeats", F.lit(True)), "a", "left").where(F.col("repeats") | (F.col("kind") == "shape"))
    headers = found.select("section_id", F.lit("header").alias("kind"), "line", "a", F.lit("").alias("b"), F.lit(-1).cast("bigint").alias("at"))
    numbers = found.where("at = 1").select("section_id", F.lit("page_no").alias("kind"), "line", "a", F.lit("").alias("b"), F.lit(-1).cast("bigint").alias("at"))
    plain = signs.where("kind = 'page_no'")
    lines = plain.unionByName(headers).unionByName(numbers)
    return lines.unionByName(hyphens).unionByName(words).unionByName(cut_misread).select("section_id", "kind", "line", "a", "b", "at")


def _folded(vocab: DataFrame) -> DataFrame:
    """The vocabulary by folded word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"word": [fold(w) for w in df["word"]], "df": df["df"]})

    return vocab.mapInPandas(run, "word string, df bigint").groupBy("word").agg(F.sum("df").alias("df"))


def noise_kinds(noise: DataFrame) -> DataFrame:
    """section_id, defect: one row for each section and each kind of noise in it."""
    return noise.select("section_id", F.col("kind").alias("defect")).distinct()


def repair_text(text: str, noise: list[tuple[str, int, str, str, int]]) -> str:
    """A section as continuous paragraphs: furniture out, cut words joined, misread words mended, lines joined."""
    lines = _EOL.split(text)
    drop = {n for kind, n, *_ in noise if kind in ("header", "page_no")}
    for kind, n, a, b, at in noise:
        if kind == "hyphen" and 0 <= at < len(lines):
            m, r = _CUT.search(lines[n]), _FIRST.match(lines[at])
            if m and r:
                left = m["left"] + r["right"]
                whole = b if left.lower() != b and left[:1].islower() else (b.capitalize() if left.lower() != b else left)
                lines[n] = lines[n][: m.start()] + whole
                lines[at] = lines[at][r.end() :]
                tail = re.match(r"\S+", lines[at])
                if tail:
                    lines[n], lines[at] = lines[n] + tail[0], lines[at][tail.end() :]
    for kind, n, a, b, at in noise:
        if kind == "ocr_char" and at < 0:
            pattern = re.compile(rf"(?<![^\W_]){re.escape(a)}(?![^\W_])", re.I)
            for k in range(len(lines)):
                lines[k] = pattern.sub(lambda m: b.capitalize() if m[0][:1].isupper() else b, lines[k])
    paragraphs: list[list[str]] = [[]]
    for k, x in enumerate(lines):
        if k in drop:
            continue
        if not x.strip():
            if paragraphs[-1]:
                paragraphs.append([])
        elif _LIST.match(x) and paragraphs[-1]:
            paragraphs.append([x.strip()])
        else:
            paragraphs[-1].append(x.strip())
    joined = [re.sub(rf"(?<=\w[{_HYPHEN}]) (?=[^\W\d_])", "", " ".join(" ".join(p).split())) for p in paragraphs if p]
    return "\n\n".join(joined)


def repair(sections: DataFrame, noise: DataFrame, id_col: str = "section_id", text_col: str = "content") -> DataFrame:
    """section_id, repaired: every section with content as readable paragraphs (null and empty contents are left out)."""
    listed = noise.groupBy("section_id").agg(F.array_sort(F.collect_set(F.struct("kind", "line", "a", "b", "at"))).alias("noise"))
    both = _sections(sections, id_col, text_col).join(listed, "section_id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for text, noise in zip(df["content"], df["noise"], strict=True):
                items = [(x["kind"], x["line"], x["a"], x["b"], x["at"]) for x in noise] if noise is not None else []
                out.append(repair_text(text, items))
            yield pd.DataFrame({"section_id": df["section_id"], "repaired": out})

    return both.mapInPandas(run, "section_id bigint, repaired string")
