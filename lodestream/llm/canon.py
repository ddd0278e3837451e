"""Mapping freely typed values to a reference list by token-level repair.

Every distinct token of the values is joined to the words of the reference names by edit distance
(through shared deletion keys, so no pair is tried that can't match). With the repaired tokens the
complete names are ranked by soft TF-IDF; the best name above a threshold gives the entry, any
other value is reported as not listed (0). Words that go with many different entries ("powder",
"as received") are found in the data itself and weigh nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import checkpoint, parallelism, sized

# ---- fixed values: words about form, look-alike letters ----
#: Words about form, origin or circumstance.
FORMS = frozenset(
    "a an the of in at as by for from with and on to our pure film films thin thick powder powders pellet pellets bulk nanoparticle nanoparticles particle particles nanopowder precursor received commercial grade purity wt vol mol percent rt measured measurement measurements exp experimental avg average mean value values technique method methods route process house si see fig table ref nominal approx ca mg g kg ml doped undoped annealed layer coating crystal single "
    "polycrystalline nanocrystalline nano nanostructured ingot target substrate high fresh prepared synthesised synthesized calculated theoretical typical standard dried ground".split()
)
HOMOGLYPHS = str.maketrans("аеорсхуіѕԁһкмнтвАЕОРСХУІЅКМНТВ", "aeopcxyisdhkmhtbAEOPCXYISKMHTB")
#: Chemical elements in order of their number: symbol and name.
ELEMENTS = dict(
    x.split(":") for x in (
        "h:hydrogen he:helium li:lithium be:beryllium b:boron c:carbon n:nitrogen o:oxygen f:fluorine ne:neon na:sodium mg:magnesium al:aluminium si:silicon p:phosphorus s:sulphur cl:chlorine ar:argon k:potassium ca:calcium "
        "sc:scandium ti:titanium v:vanadium cr:chromium mn:manganese fe:iron co:cobalt ni:nickel cu:copper zn:zinc ga:gallium ge:germanium as:arsenic se:selenium br:bromine kr:krypton rb:rubidium sr:strontium y:yttrium zr:zirconium "
        "nb:niobium mo:molybdenum tc:technetium ru:ruthenium rh:rhodium pd:palladium ag:silver cd:cadmium in:indium sn:tin sb:antimony te:tellurium i:iodine xe:xenon cs:caesium ba:barium la:lanthanum ce:cerium pr:praseodymium "
        "nd:neodymium pm:promethium sm:samarium eu:europium gd:gadolinium tb:terbium dy:dysprosium ho:holmium er:erbium tm:thulium yb:ytterbium lu:lutetium hf:hafnium ta:tantalum w:tungsten re:rhenium os:osmium ir:iridium "
        "pt:platinum au:gold hg:mercury tl:thallium pb:lead bi:bismuth th:thorium u:uranium"
    ).split()
)
#: Names of valences.
VALENCES = {("iron", "ii"): "ferrous", ("iron", "iii"): "ferric", ("copper", "i"): "cuprous", ("copper", "ii"): "cupric", ("tin", "ii"): "stannous", ("tin", "iv"): "stannic", ("cobalt", "ii"): "cobaltous", ("cobalt", "iii"): "cobaltic", ("chromium", "iii"): "chromic", ("mercury", "ii"): "mercuric"}
# ---- end of fixed values ----

_OXIDES = {re.sub(r"(?:um|on)$", "a", n): n for n in [*ELEMENTS.values(), "aluminum"] if re.search(r"(?:um|on)$", n)}
_SYMBOLS = re.compile(r"(?<![^\W_])[a-z]{1,2}(?:-[a-z]{1,2})+(?![^\W_])")
_VALENCE = re.compile(r"\b([a-z]+) ?\((i{1,3}|iv)\)")


def spelled_out(s: str) -> str:
    """A clean name with hyphened element symbols, valences and oxide names ("fe-pt", "iron(iii)", "titania") in words."""
    s = _SYMBOLS.sub(lambda m: " ".join(ELEMENTS[x] for x in m[0].split("-")) if all(x in ELEMENTS for x in m[0].split("-")) else m[0], s)
    s = _VALENCE.sub(lambda m: VALENCES.get((m[1], m[2]), m[0]), s)
    return " ".join(f"{_OXIDES[w]} oxide".replace("aluminum", "aluminium") if w in _OXIDES else w for w in s.split(" "))


_TAG = re.compile(r"</?(?:sub|sup|i|b|em|strong|span)\b[^<>]*>", re.I)
_LATEX = re.compile(r"\\(?:mathrm|text|ce|mathit|rm)\b|[${}\\]|_(?=\{?\d)|\^(?=\{?\d)")
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_TOKEN = re.compile(r"[^\W_]+")
_WHERE = re.compile(r"\bat (?:room temperature|rt|\d+ ?k)\b|\b(?:of )?(?:sample|specimen|batch|step|stage|lot|run) (?:[a-z]|\d{1,3})\b")


def clean(value: str) -> str:
    """A value in plain characters and lower case: markup, quotes, look-alike letters and odd spaces undone."""
    s = _LATEX.sub("", _TAG.sub("", value))
    s = unicodedata.normalize("NFKC", s)
    if re.search("[a-zA-Z]", s.translate(HOMOGLYPHS)):
        s = s.translate(HOMOGLYPHS)
    s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    return " ".join(s.lower().replace("µ", "μ").split()).strip("\"'“”‘’`*.,;:†? ")


def squash(text: str) -> str:
    return "".join(_TOKEN.findall(text))


def unmix(token: str) -> str:
    """Figures that stand for letters in a word ("c0ercivity", "fie1d") turned back; formulas stay."""
    if re.search(r"[01]", token) and not re.search(r"[2-9]", token) and sum(c.isalpha() for c in token) >= 3:
        return token.replace("0", "o").replace("1", "l")
    return token


def variants(value: str) -> list[list[str]]:
    """Token lists under which a value may be named: whole, without brackets, before the comma, squashed."""
    s = clean(value)
    out: list[list[str]] = []
    parts = [s, _BRACKETS.sub(" ", s), s.split(",")[0]]
    if _WHERE.search(s):
        parts += [_WHERE.sub(" ", x) for x in parts]
    if re.search(r"[01]", s) and not re.search(r"[2-9]", s):
        parts.append(s.replace("0", "o").replace("1", "l"))
    if (t := spelled_out(s)) != s:
        parts.append(t)
    if m := re.fullmatch(r"(.+?),\s*([^,\d%]+)", _BRACKETS.sub(" ", s).strip()):
        parts.append(f"{m[2]} {m[1]}")
    for p in parts:
        t = [unmix(x) for x in _TOKEN.findall(p)]
        for u in (t, ["".join(t)], [x for x in t if x not in FORMS and not re.fullmatch(r"\d+|[a-z]|\d+(?:mg|g|kg|ml|wt|at|nm|mol)", x)]):
            if u and u not in out:
                out.append(u)
            j = ["".join(u)]
            if u and j not in out:
                out.append(j)
    return out


def osa(a: str, b: str, most: int = 3) -> int:
    """Edit distance with swaps of neighbours, cut off above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    k = next((k for k in range(n) if a[k] != b[k]), n)
    a, b, n = a[k:], b[k:], n - k
    k = next((k for k in range(n) if a[-1 - k] != b[-1 - k]), n)
    a, b = a[: len(a) - k], b[: len(b) - k]
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return one[-1]


LONG = 16


def allowed(word: str) -> int:
    """Edits that a reference word forgives; formulas and abbreviations none. From ``LONG`` letters a swap counts as two."""
    if re.search(r"\d", word) or len(word) < 4:
        return 0
    return 1 if len(word) == 4 else 2 if len(word) < LONG else 3


def deletions(word: str, k: int) -> set[str]:
    """The word with up to k letters left out."""
    out = {word}
    for _ in range(k):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def quarters(word: str) -> list[str]:
    """Keys of a long reference word: its four quarters. Three edits leave one of them whole."""
    n = len(word)
    return [f"{n}.{p}.{word[p * n // 4 : (p + 1) * n // 4]}" for p in range(4)]


def quarter_places(token: str) -> set[str]:
    """Keys under which a token may meet a long word within three edits: each quarter up to three letters off its place."""
    out = set()
    for n in range(max(LONG, len(token) - 3), len(token) + 4):
        for p in range(4):
            a, b = p * n // 4, (p + 1) * n // 4
            out |= {f"{n}.{p}.{token[k : k + b - a]}" for k in range(max(0, a - 3), a + 4) if k + b - a <= len(token)}
    return out


def names(entities: DataFrame) -> DataFrame:
    """canon_id, name_id, name tokens of every name (given, synonym, general alias) and its squashed form."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = []
            for i, name, synonyms in zip(df["canon_id"], df["canon_name"], df["synonyms"], strict=True):
                every = [name, *(synonyms if synonyms is not None else [])]
                seen = set()
                for x in every:
                    if not x:
                        continue
                    t = _TOKEN.findall(clean(x))
                    for u in (t, ["".join(t)], _TOKEN.findall(spelled_out(clean(x)))):
                        if u and tuple(u) not in seen:
                            seen.add(tuple(u))
                            got.append((i, " ".join(u), u))
            yield pd.DataFrame(got, columns=["canon_id", "name", "words"])

    rows = entities.select("canon_id", "canon_name", "synonyms").where(F.col("canon_id").isNotNull()).mapInPandas(run, "canon_id bigint, name string, words array<string>")
    return rows.dropDuplicates(["canon_id", "name"])


def _keys(df: DataFrame, column: str, keys) -> DataFrame:
    """column, key: the distinct words in a column and what they meet others by."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            yield pd.DataFrame([(w, k) for w in part[column] for k in keys(w)], columns=[column, "key"])

    return df.select(column).distinct().mapInPandas(run, f"{column} string, key string")


def repair_tokens(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, word, sim: each distinct token with the nearest reference words (all of those at the least distance).

    Tokens meet words of up to 15 letters on deletion keys, longer ones on their quarters; no pair
    within the distance that ``allowed`` grants can miss. A token that is a word keeps to it.
    Formulas and abbreviations (figures, under 4 letters) are never repaired.
    """
    whole = tokens.select("token").distinct().join(words.select(F.col("word").alias("token")).distinct(), "token")
    exact = whole.select("token", F.col("token").alias("word"), F.lit(1.0).alias("sim"))
    open_tokens = tokens.select("token").distinct().join(whole, "token", "left_anti").where((F.length("token") > 3) & ~F.col("token").rlike(r"\d") & ~F.col("token").isin(*sorted(FORMS)))
    short_keys = lambda w: deletions(w, min(2, allowed(w))) if len(w) < LONG + 2 else ()
    short = words.where(F.length("word") < LONG)
    near = _keys(open_tokens, "token", short_keys).join(_keys(short, "word", lambda w: deletions(w, allowed(w))), "key").select("token", "word").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [(t, w, d, 1.0 - d / max(len(t), len(w))) for t, w in zip(df["token"], df["word"], strict=True) if (d := osa(t, w)) <= allowed(w)]
            yield pd.DataFrame(got, columns=["token", "word", "d", "sim"])

    near = near.repartition(parallelism(tokens.sparkSession)).mapInPandas(run, "token string, word string, d int, sim double")
    long = words.where((F.length("word") >= LONG) & ~F.col("word").rlike(r"\d"))
    met = _keys(open_tokens.where(F.length("token") >= LONG - 3), "token", quarter_places).join(_keys(long, "word", quarters), "key").select("token", "word").distinct()
    d = F.levenshtein("token", "word", 3)
    far = met.withColumn("d", d).where("d >= 0").withColumn("sim", 1.0 - F.col("d") / F.greatest(F.length("token"), F.length("word")))
    near = checkpoint(near.unionByName(far.select("token", "word", "d", "sim")))
    best = near.groupBy("token").agg(F.min("d").alias("d"))
    return exact.unionByName(near.join(best, ["token", "d"]).select("token", "word", "sim"))


def map_values(values: DataFrame, entities: DataFrame, least: float = 0.8, many: int = 12) -> DataFrame:
    """value, canon_id, score of every distinct non-blank value of the column ``value``; canon_id 0: not listed.

    Of equal scores the smaller canon_id wins. A word outside the reference vocabulary counts as
    form or circumstance if it stands with at least ``many`` different entries. Null and blank
    values are left out, an empty reference lists nothing.
    """
    filled = values.select("value").where(F.length(F.regexp_replace("value", r"(?U)[\s\p{Cf}]+", "")) > 0).distinct()
    # values go by a number from here on, so that no shuffle carries their texts
    distinct = checkpoint(filled).withColumn("vid", F.monotonically_increasing_id())

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [(i, k, t) for i, v in zip(df["vid"], df["value"], strict=True) for k, t in enumerate(variants(v))]
            yield pd.DataFrame(got, columns=["vid", "variant", "tokens"])

    cuts = checkpoint(distinct.select("vid", "value").mapInPandas(cut, "vid bigint, variant int, tokens array<string>"))
    known = checkpoint(names(entities))
    total = max(1, known.count())
    words = known.select("canon_id", "name", F.explode(F.array_distinct("words")).alias("word"))
    idf = words.groupBy("word").agg((F.lit(1.0) + F.log(F.lit(float(total)) / F.countDistinct("canon_id"))).alias("w"))
    words = checkpoint(words.join(idf, "word"))
    norms = sized(checkpoint(words.groupBy("canon_id", "name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))))
    words, idf = sized(words), words.select("word", "w").distinct()
    tokens = cuts.select("vid", "variant", F.explode(F.array_distinct("tokens")).alias("token"))
    repaired = checkpoint(repair_tokens(tokens.select("token"), idf).join(idf, "word"))
    weight = sized(checkpoint(repaired.groupBy("token").agg(F.max("w").alias("w"))))
    repaired = sized(repaired)
    # Words that stand with many entries are circumstance: count the entries of the other tokens.
    one = tokens.join(repaired.where("sim = 1.0").select("token", "word"), "token").join(words.select("word", "canon_id"), "word")
    beside = tokens.join(weight, "token", "left_anti").select("vid", "token").distinct()
    loose = beside.join(one.select("vid", "canon_id").distinct(), "vid").groupBy("token").agg(F.countDistinct("canon_id").alias("n"), F.countDistinct("vid").alias("m"))
    loose = sized(checkpoint(loose.where((F.col("n") >= many) & (F.col("m") >= many)).select("token", F.lit(True).alias("loose"))))
    top = 1.0 + F.log(F.lit(float(total)))
    weighed = tokens.join(weight, "token", "left").join(loose, "token", "left")
    form = F.col("w").isNull() & (F.col("loose").isNotNull() | F.col("token").isin(*sorted(FORMS)) | F.col("token").rlike(r"^(\d+|[a-z]|\d+(mg|g|kg|ml|wt|at|nm|mol))$"))
    weighed = weighed.withColumn("w", F.when(form, 0.0).otherwise(F.coalesce("w", top)))
    sizes = weighed.groupBy("vid", "variant").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    shared = tokens.join(repaired.select("token", "word", "sim"), "token").join(words, "word")
    # a word of a name counts once, for its nearest token
    dots = shared.groupBy("vid", "variant", "canon_id", "name", "word").agg(F.max(F.col("sim") * F.col("w") * F.col("w")).alias("dot"))
    dots = dots.groupBy("vid", "variant", "canon_id", "name").agg(F.sum("dot").alias("dot"))
    scored = dots.join(norms, ["canon_id", "name"]).join(sizes, ["vid", "variant"]).where("size > 0").withColumn("score", F.col("dot") / (F.col("norm") * F.col("size")))
    ranked = scored.groupBy("vid").agg(F.max_by(F.struct("canon_id", "score"), F.struct(F.round("score", 9), -F.col("canon_id"))).alias("best"))
    found = distinct.join(ranked.select("vid", "best.canon_id", "best.score"), "vid", "left")
    listed = F.coalesce(F.col("score"), F.lit(0.0)) >= least
    return found.select("value", F.when(listed, F.col("canon_id")).otherwise(F.lit(0).cast("bigint")).alias("canon_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def typed_values(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """place, row_id, value of the free-typed names of edges and layout nodes; null and blank names are left out."""
    filled = lambda c: F.length(F.regexp_replace(c, r"(?U)[\s\p{Cf}]+", "")) > 0
    at_source = edges.where(F.col("relation").isin("HAS_PROPERTY", "HAS_VALUE") & filled("source")).select(F.lit("edge_source").alias("place"), F.col("edge_id").alias("row_id"), F.col("source").alias("value"))
    at_target = edges.where(F.col("relation").isin("USES_MATERIAL", "USES_METHOD", "MEASURES_METRIC", "HAS_PROPERTY") & filled("target")).select(F.lit("edge_target").alias("place"), F.col("edge_id").alias("row_id"), F.col("target").alias("value"))
    labels = layout.where((F.col("node_type") == "term") & filled("label")).select(F.lit("layout_label").alias("place"), F.col("node_id").alias("row_id"), F.col("label").alias("value"))
    return at_source.unionByName(at_target).unionByName(labels)


def map_rows(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """place, row_id, canon_id: the entry of the value of each row (the values are mapped once each)."""
    return rows.join(mapped.select("value", "canon_id"), "value").select("place", "row_id", "canon_id")
