"""Quantities written in different units, decoded to one common unit.

A *device* is a series of readings of one column of a table, or of one quantity of a paper. The
unit of every reading is the hidden state of a Markov model over all units named anywhere in the
device: text evidence (the unit beside the number, in the column name, in a units row, in metadata,
in the caption or in the sentence) is the emission, graded by how near it stands; a switch of units
costs a fixed amount plus the jump of the log level it implies. ``viterbi_units`` finds the best
state path of every device. Between several units named for a reading the level decides; a unit
beside the number can't be outvoted, that of a caption can, if the level of its column is clear.
The numbers of a paper are no such series (they come from many samples), so that a unit that its
sentence names falls only to another one named there or in the metadata. ``found_quantities`` reports only readings whose unit is named somewhere.

Costs are whole numbers, so that a long device may be cut into runs: each run is a (min, +) matrix
over the states, the matrices are combined, and every run is decoded with the state its neighbours
ask for. The path is that of the whole device, whatever the length of a run.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import checkpoint

# ---- fixed values: physical conversion factors to the common units of quantity_unit ----
MU0 = 4e-7 * math.pi
A_PER_M_PER_OE = 1000 / (4 * math.pi)
PREFIX = {"": 1.0, "k": 1e3, "M": 1e6, "G": 1e9, "m": 1e-3, "c": 1e-2, "µ": 1e-6, "μ": 1e-6, "u": 1e-6, "n": 1e-9, "p": 1e-12, "h": 1e2}
PRESSURE_KPA = {"Pa": 1e-3, "bar": 100.0, "atm": 101.325, "psi": 6.894757293168361, "Torr": 101.325 / 760, "mmHg": 101.325 / 760}
SECONDS = {"s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0, "wk": 604800.0}
NUMBER_WORDS = {
    "half an": 0.5, "half a": 0.5, "a quarter of an": 0.25, "an": 1, "a": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15, "eighteen": 18, "twenty": 20, "twenty-four": 24,
    "thirty": 30, "thirty-six": 36, "forty": 40, "forty-five": 45, "forty-eight": 48, "fifty": 50, "sixty": 60, "seventy-two": 72, "ninety": 90,
}
VULGAR = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3}
SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
# ---- end of fixed values ----


class Unit(NamedTuple):
    """value * factor + offset is the value in the common unit of ``quantity``."""

    quantity: str
    name: str
    factor: float
    offset: float = 0.0


class Reading(NamedTuple):
    value: float
    unit: Unit | None
    start: int
    end: int
    power: float = 1.0


_DASH = "[-−–]"
_GAP = r"[ \u00a0\u2009\u202f]"


def _per(length: str, n: str) -> str:
    """Regex of "per length^n" in its spellings: /m3, m−3, ·m^-3, m⁻³."""
    power = {"1": "(?:\\^?[1¹])?", "2": "\\^?[2²]", "3": "\\^?[3³]"}[n]
    minus = {"1": "[1¹]", "2": "[2²]", "3": "[3³]"}[n]
    return rf"(?:{_GAP}?/{_GAP}?{length}{power}|[ \u00a0\u2009\u202f·⋅*.]{{0,2}}{length}\^?\{{?(?:{_DASH}|⁻){minus}\}}?)"


#: name of the regex group -> spelling; longer and composed units stand before their parts.
_SPELLINGS = [
    ("joule", rf"(?P<joule_p>[kM]?)J{_per('m', '3')}"),
    ("mgoe", rf"(?P<mgoe_p>[kM]?)G{_GAP}?[·⋅*.]?{_GAP}?Oe"),
    ("amp2", rf"(?P<amp2_p>[kmµμu]?)A(?:(?P<amp2_c>{_per('cm', '2')})|(?P<amp2_mm>{_per('mm', '2')})|{_per('m', '2')})"),
    ("amp1", rf"(?P<amp1_p>[kMm]?)A{_per('m', '1')}"),
    ("oersted", r"(?P<oersted_p>[km]?)(?:Oe|(?i:oersteds?))"),
    ("tesla", r"(?P<tesla_p>[mµμu]?)(?:T|(?i:teslas?))"),
    ("gauss", r"(?P<gauss_p>k?)(?:G|(?i:gauss))"),
    ("celsius", r"[°º˚]\s?C|℃|(?i:deg\.?\s?C|degrees?\s(?:C|celsius|centigrade)|celsius)"),
    ("fahrenheit", r"[°º˚]\s?F|℉|(?i:deg\.?\s?F|degrees?\s(?:F|fahrenheit)|fahrenheit)"),
    ("kelvin", r"K|(?i:kelvins?)"),
    ("pressure", rf"mm{_GAP}?Hg|(?P<pressure_p>[hkMGm]?)(?P<pressure_u>Pa|bar|[Tt]orr)|atm|psi"),
    ("time_s", r"(?P<time_p>[mµμn]?)s|(?i:secs?|seconds?)"),
    ("time_min", r"(?i:mins?|minutes?)"),
    ("time_h", r"(?i:hrs?|hours?|h)"),
    ("time_d", r"(?i:days?)|d"),
    ("time_wk", r"(?i:wks?|weeks?)"),
    ("length", r"(?P<length_p>[nµμumckp]?)m|(?i:(?P<length_w>nano|micro|milli|centi)?met(?:er|re)s?|microns?|(?P<angstrom>[åÅ]ngstr[oö]ms?|angstr[oö]ms?))|[ÅÅ]"),
]
#: After a unit: no further letter or figure, no "per" anything.
_CLOSED = rf"(?![A-Za-zµμ0-9_^⁻¹²³])(?!{_GAP}?/{_GAP}?[A-Za-zµμ°])(?!{_GAP}?[·⋅*]?{_GAP}?[A-Za-zµμ]+\^?\{{?(?:{_DASH}|⁻)[\d¹²³])"
UNIT = "(?:" + "|".join(f"(?P<{name}>{text})" for name, text in _SPELLINGS) + ")" + _CLOSED
_UNIT = re.compile(UNIT)

_DIGITS = rf"(?:\d{{1,3}}(?:{_GAP}\d{{3}})+(?![\d])(?:[.,]\d+)?|\d+(?:[.,]\d+)*|\.\d+)"
_TEN = rf"(?:\s?[×x*·]\s?10\s?(?:\^\s?\{{?[-−–+]?\d+\}}?|[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+|{_DASH}\d+)|[eE][-−+]?\d+)"
_ONE = rf"[-−–+]?{_DIGITS}(?:{_TEN})?(?:\s?[½¼¾⅓⅔])?|[½¼¾⅓⅔]"
_PM = rf"\s?(?:±|\+/[-−]|\+[-−])\s?{_DIGITS}(?:{_TEN})?"
#: A value: plain, with an uncertainty, bracketed, or a range; then perhaps a unit.
_VALUE = re.compile(
    rf"(?<![\w.,^⁻/:-])(?<![A-Za-z0-9]{_DASH})(?:(?P<open>\()\s?(?P<in>{_ONE})(?:{_PM})?\s?\)(?P<outer>{_TEN})?|(?P<one>{_ONE})(?:{_PM})?)"
)
_BETWEEN = re.compile(rf"\s?(?:{_DASH}|…|\.\.\.?|\bto\b|\band\b)\s?")
_SUBTRACT = re.compile(rf"\s?{_DASH}\s?")
_WORDS = re.compile(
    r"(?<![\w-])(?P<n>" + "|".join(sorted((w.replace(" ", r"\s") for w in NUMBER_WORDS), key=len, reverse=True)) + r")\s(?P<half>and a half\s)?(?=(?i:sec|min|h(?:ou)?r|day|d\b|week))", re.I
)
_ALONE_TEN = re.compile(rf"^\s*(?:[×x*]\s?)?10\s?(?:\^\s?\{{?(?P<a>[-−–+]?\d+)\}}?|(?P<b>[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+))\s*")


def to_unit(m: re.Match) -> Unit | None:
    """The unit that a match of ``UNIT`` names."""
    g = m.groupdict()
    if g["joule"]:
        return Unit("energy_product", "J/m3", PREFIX[g["joule_p"]] / 1e3)
    if g["mgoe"]:
        return Unit("energy_product", "GOe", PREFIX[g["mgoe_p"]] * 1e-4 * A_PER_M_PER_OE / 1e3)
    if g["amp2"]:
        return Unit("current_density", "A/m2", PREFIX[g["amp2_p"]] * (1e4 if g["amp2_c"] else 1e6 if g["amp2_mm"] else 1.0))
    if g["amp1"]:
        return Unit("magnetic_field", "A/m", PREFIX[g["amp1_p"]] / 1e3)
    if g["oersted"]:
        return Unit("magnetic_field", "Oe", PREFIX[g["oersted_p"]] * A_PER_M_PER_OE / 1e3)
    if g["tesla"]:
        return Unit("magnetic_field", "T", PREFIX[g["tesla_p"]] / MU0 / 1e3)
    if g["gauss"]:
        return Unit("magnetic_field", "G", PREFIX[g["gauss_p"]] * 1e-4 / MU0 / 1e3)
    if g["celsius"]:
        return Unit("temperature", "degC", 1.0, 273.15)
    if g["fahrenheit"]:
        return Unit("temperature", "degF", 5 / 9, 273.15 - 160 / 9)
    if g["kelvin"]:
        return Unit("temperature", "K", 1.0)
    if g["pressure"]:
        text = g["pressure"]
        if g["pressure_u"]:
            name = "Torr" if g["pressure_u"] == "torr" else g["pressure_u"]
            return Unit("pressure", name, PREFIX[g["pressure_p"]] * PRESSURE_KPA[name])
        name = "mmHg" if text.startswith("mm") else text
        return Unit("pressure", name, PRESSURE_KPA[name])
    for name in ("s", "min", "h", "d", "wk"):
        if g[f"time_{name}"]:
            return Unit("duration", name, SECONDS[name] * (PREFIX[g["time_p"]] if name == "s" and g["time_p"] else 1.0))
    if g["length"]:
        text = g["length"]
        if g["angstrom"] or text in "ÅÅ":
            return Unit("length", "Å", 0.1)
        if text.lower().startswith("micron"):
            return Unit("length", "m", 1e3)
        word = {"nano": "n", "micro": "µ", "milli": "m", "centi": "c"}.get((g["length_w"] or "").lower(), g["length_p"] or "")
        return Unit("length", "m", PREFIX[word] * 1e9)
    return None


def to_number(text: str) -> float | None:
    """A written number; a comma before exactly three digits groups thousands, any other is a decimal mark."""
    text = text.strip().replace("−", "-").replace("–", "-")
    plus = 0.0
    if text and text[-1] in VULGAR:
        plus, text = VULGAR[text[-1]], text[:-1].strip()
        if not text:
            return plus
    power = 0
    if m := re.search(r"\s?[×x*·]\s?10\s?\^?\s?\{?(?P<n>[-+]?\d+|[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)\}?$", text) or re.search(r"[eE](?P<n>[-+]?\d+)$", text):
        power, text = int(m["n"].translate(SUPERSCRIPTS)), text[: m.start()]
    text = re.sub(r"(?<=\d)[ \u00a0\u2009\u202f](?=\d{3}(?!\d))", "", text)
    if re.fullmatch(r"[-+]?\d+(?:\.\d{3})+,\d+", text):
        text = text.replace(".", "").replace(",", ".")
    text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text).replace(",", ".")
    try:
        x = float(text)
    except ValueError:
        return None
    return (x + math.copysign(plus, x)) * 10**power if power >= 0 else (x + math.copysign(plus, x)) / 10**-power


def find_unit(text: str, pos: int = 0) -> tuple[Unit, int] | None:
    """The unit that begins at ``pos`` (after at most one space) and where it ends."""
    while pos < len(text) and text[pos] in " \u00a0\u2009\u202f":
        pos += 1
    if (m := _UNIT.match(text, pos)) and (unit := to_unit(m)):
        return unit, m.end()
    return None


_PARTS = re.compile(r"(?<=\d)(\s?(?:d|h|hrs?|min))(?=\d+\s?(?:h|min|s|sec)\b)")


def spaced(text: str) -> str:
    """A text with the parts of a time set apart: "5h20min" becomes "5h 20min"."""
    return _PARTS.sub(r"\1 ", text)


def readings(text: str) -> list[Reading]:
    """All numbers of a text (as ``spaced`` gives it) with the unit that stands beside each, if one does."""
    text = spaced(text)
    out: list[Reading] = []
    pos, items = 0, []
    w = _WORDS.search(text)
    while True:
        m = _VALUE.search(text, pos)
        if w and w.start() < pos:
            w = _WORDS.search(text, pos)
        if w and (not m or w.start() < m.start()):
            x = NUMBER_WORDS[" ".join(w["n"].lower().split())] + (0.5 if w["half"] else 0)
            items.append((x, w.start(), w.end()))
            pos = w.end()
        elif m:
            x = to_number(m["in"] or m["one"])
            if x is not None:
                scale = to_number("1" + m["outer"].strip()) if m["outer"] else 1.0
                items.append((x * (scale or 1.0), m.start(), m.end()))
            pos = m.end()
            # the second end of a range is no signed number
            if (d := _SUBTRACT.match(text, pos)) and (n := re.compile(_ONE).match(text, d.end())) and (y := to_number(n[0])) is not None:
                u = re.compile(_PM).match(text, n.end())
                pos = u.end() if u else n.end()
                items.append((y, n.start(), pos))
        else:
            break
    k = 0
    while k < len(items):
        x, start, end = items[k]
        own = find_unit(text, end)
        if k + 1 < len(items):
            y, start2, end2 = items[k + 1]
            own2 = find_unit(text, end2)
            between = text[own[1] if own else end : start2]
            if _BETWEEN.fullmatch(between) and own2 and (own is None or own[0] == own2[0]) and ("and" not in between or re.search(r"between\s*$", text[:start])):
                out.append(Reading((x + y) / 2, own2[0], start, own2[1]))
                k += 2
                continue
            if own is None and _BETWEEN.fullmatch(between) and "and" not in between and y > x:
                out.append(Reading((x + y) / 2, None, start, end2))
                k += 2
                continue
        out.append(Reading(x, own[0] if own else None, start, own[1] if own else end))
        k += 1
    merged: list[Reading] = []
    for r in out:  # a time given in parts
        last = merged[-1] if merged else None
        if (
            last and last.unit and r.unit and last.unit.quantity == r.unit.quantity == "duration" and r.unit.factor < last.unit.factor
            and re.fullmatch(r"\s*(?:and\s+|,\s*)?", text[last.end : r.start])
        ):
            merged[-1] = Reading(last.value * last.unit.factor / r.unit.factor + r.value, r.unit, last.start, r.end)
        else:
            merged.append(r)
    return merged


class Evidence(NamedTuple):
    """A unit named in the text and how near to the number it stands (0 beside, then outward)."""

    unit: Unit
    power: float
    distance: int


def alone(text: str | None) -> tuple[Unit, float] | None:
    """A text that is a unit and nothing else, perhaps in brackets and with a power of ten."""
    if text is None:
        return None
    s = text.strip()
    while len(s) > 1 and (s[0], s[-1]) in {("(", ")"), ("[", "]"), ("{", "}")}:
        s = s[1:-1].strip()
    power = 1.0
    if m := _ALONE_TEN.match(s):
        power, s = 10.0 ** int((m["a"] or m["b"]).replace("−", "-").replace("–", "-").translate(SUPERSCRIPTS)), s[m.end() :]
    if (m := _UNIT.match(s)) and m.end() == len(s) and (unit := to_unit(m)):
        return unit, power
    return None


_TAIL = re.compile(r"^(?P<base>.*?\S)\s*(?:\((?P<a>[^()]*)\)|\[(?P<b>[^\[\]]*)\]|\s/\s(?P<c>.+)|\bin\s(?P<d>.+)|,\s?(?P<e>.+))\s*$")


def column_unit(name: str) -> tuple[Unit, float] | None:
    """The unit in a column name: "d [nm]", "T_cal / °C", "J in A/m²", "P, MPa", "Field (10³ Oe)"."""
    for m in (_TAIL.match(name), re.match(r"^(?P<base>.*?\S)\s*(?P<a>\([^()]*\)|\[[^\[\]]*\])\s*$", name), re.match(r"^(?P<base>[^/]*\S)\s/\s(?P<a>.+)$", name)):
        if m:
            for k, v in m.groupdict().items():
                if k != "base" and v and (u := alone(v)):
                    return u
    return None


_CAPTION = re.compile(r"^\s*(?:is |are )?(?:values? )?(?:is |are )?(?:all )?(?:given |measured |expressed |reported |listed |stated )?(?:in|as|:)\s+(?P<u>.+)$")


def caption_unit(caption: str | None, column: str) -> tuple[Unit, float] | None:
    """The unit a caption gives for a column: "(X given in U)", ", X values are in U", "; X in U"."""
    if not caption:
        return None
    pos = 0
    while (k := caption.find(column, pos)) >= 0:
        pos = k + len(column)
        if k and (caption[k - 1].isalnum() or caption[k - 1] == "_"):
            continue
        if m := _CAPTION.match(caption[pos:]):
            text = m["u"]
            t = _ALONE_TEN.match(text)
            if u := _UNIT.match(text, t.end() if t else 0):
                unit = to_unit(u)
                if unit:
                    return unit, (10.0 ** int((t["a"] or t["b"]).replace("−", "-").translate(SUPERSCRIPTS)) if t else 1.0)
    return None


_MENTION = re.compile(r"(?:\b(?:in|reports?|units?(?: of)?|reads?|as)\b|[(\[:])\s*(?:the\s)?(?P<u>\S.*)")


def sentence_units(sentence: str | None, value: float) -> list[tuple[Unit, int]]:
    """The units a sentence gives for ``value``: beside the same number (1), then as "in U" or "reports U" (2)."""
    if not sentence:
        return []
    out = [(r.unit, 1) for r in readings(sentence) if r.value == value and r.unit]
    pos = 0
    while m := _MENTION.search(sentence, pos):
        if (u := _UNIT.match(sentence, m.start("u"))) and (unit := to_unit(u)):
            out.append((unit, 2))
        pos = m.start() + 1
    return list({u: (u, d) for u, d in reversed(out)}.values())[::-1]


# ---------------------------------------------------------------- the hidden Markov model


#: Cost of a state by the distance of the text that names it (beside, name of the column or metadata, units row or
#: same number in a sentence, mention in a sentence, caption), in thousandths. Two jumps gain 16,000 at most: less than
#: what lies between the unit beside a number and any other, less than what lies between a unit named in a sentence and
#: one not named for the reading at all, more than what lies between the latter and a caption.
NAMED = (0, 17_000, 18_000, 20_000, 26_000)
UNNAMED = 38_000
SWITCH, JUMP = 2_000, 8_000
State = tuple[Unit, float]


def states_of(evidence: Iterable[Sequence[Evidence]]) -> list[State]:
    """All units named in a device, in a fixed order."""
    return sorted({(e.unit, e.power) for es in evidence for e in es})


def _costs(values: Sequence[float], evidence: Sequence[Sequence[Evidence]], states: Sequence[State], before: float | None = None, spread: float = 0.375) -> tuple[np.ndarray, np.ndarray]:
    """(emissions [t, state], transitions [t, from, to]) of a run; ``before`` is the last value of the run before it."""
    at = {s: k for k, s in enumerate(states)}
    emission = np.zeros((len(values), len(states)), dtype=np.int64)
    for t, es in enumerate(evidence):
        if es:
            emission[t] = UNNAMED
            for e in es:
                k = at[e.unit, e.power]
                emission[t, k] = min(emission[t, k], NAMED[min(e.distance, len(NAMED) - 1)])
    x = np.array([values[0] if before is None else before, *values], dtype=float)
    common = np.abs(x[:, None] * [p * u.factor for u, p in states] + [u.offset for u, _ in states])
    level = np.log10(np.where(common > 0, common, 1e-6))
    jump = np.rint(np.minimum(np.abs(level[1:, None, :] - level[:-1, :, None]) / spread * 1000, JUMP)).astype(np.int64)
    jump += SWITCH * (1 - np.eye(len(states), dtype=np.int64))
    if before is None:
        jump[0] = 0
    return emission, jump


def _path(emission: np.ndarray, jump: np.ndarray, start: np.ndarray, end: int | None = None) -> list[int]:
    """The cheapest states of a run after costs ``start``, to ``end`` if given; of equal ones the first."""
    best, back, every = start, [], np.arange(emission.shape[1])
    for e, j in zip(emission, jump, strict=True):
        cost = best[:, None] + j
        come = cost.argmin(axis=0)
        back.append(come)
        best = cost[come, every] + e
    k = int(best.argmin()) if end is None else end
    path = [k]
    for come in reversed(back[1:]):
        path.append(k := int(come[k]))
    return path[::-1]


def run_matrix(emission: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """[from, to]: least cost from a state before a run to a state at its end."""
    out = jump[0] + emission[0]
    for e, j in zip(emission[1:], jump[1:], strict=True):
        out = (out[:, :, None] + j).min(axis=1) + e
    return out


def viterbi_units(values: Sequence[float], evidence: Sequence[Sequence[Evidence]], states: Sequence[State] = ()) -> list[int]:
    """Best unit of each reading of one device, as indices into ``states`` (by default all that are named).

    Ties go to the first state. An empty series gives an empty list, one without any unit -1.
    """
    states = list(states) or states_of(evidence)
    if not values or not states:
        return [-1] * len(values)
    if len(states) == 1:
        return [0] * len(values)
    return _path(*_costs(values, evidence, states), np.zeros(len(states), dtype=np.int64))


def _decode(values: list[float], evidence: list[list[Evidence]]) -> list[State | None]:
    """The unit of every reading of a device."""
    states = states_of(evidence)
    return [states[k] if k >= 0 else None for k in viterbi_units(values, evidence, states)]


def _common(value: float, unit: Unit, power: float) -> float:
    return value * power * unit.factor + unit.offset


# ---------------------------------------------------------------- table cells

_MISSING = {"", "-", "–", "—", "n/a", "na", "n.d.", "nd", "none", "null", "nan", "?", ".."}


def table_readings(record_id: int, caption: str | None, columns: Sequence[str] | None, rows: Sequence[dict | None] | None) -> list[tuple]:
    """(row_no, col, quantity, unit, value, common, named) of all cells of a table that state a quantity.

    The device is the column; its readings are decoded in row order.
    """
    rows = [dict(r) if r else {} for r in rows or []]
    units_rows: dict[int, dict[str, tuple[Unit, float]]] = {}
    for n, row in enumerate(rows):
        cells = {c: u for c, v in row.items() if (u := alone(v))}
        if cells and not any(re.search(r"\d", v or "") and not alone(v) for v in row.values()):
            units_rows[n] = cells
    out: list[tuple] = []
    for col in dict.fromkeys(k for row in rows for k in row):
        outer: list[Evidence] = []
        if u := column_unit(col):
            outer.append(Evidence(*u, 1))
        if (u := caption_unit(caption, col)) and (not outer or u[0].quantity == outer[0].unit.quantity):
            outer.append(Evidence(*u, 4))
        below: tuple[Unit, float] | None = next((c[col] for c in units_rows.values() if col in c), None)
        values, evidence, at = [], [], []
        for n, row in enumerate(rows):
            if n in units_rows:
                below = units_rows[n].get(col, below)
                continue
            text = row.get(col)
            if text is None or text.strip().lower() in _MISSING:
                continue
            text = spaced(text)
            found = readings(text)
            if not found:
                continue
            stated = [r for r in found if r.unit]
            for r in stated or found[:1]:
                own = [Evidence(r.unit, 1.0, 0)] if r.unit else []
                if own:
                    own += [e for e in outer if e.unit.quantity == r.unit.quantity]
                else:
                    rest = text[: r.start] + " " + text[r.end :]
                    if len(found) > 1 or re.search(r"[^\W\d_]|[%°/]", re.sub(r"(?i)\b(?:ca|about|approx|circa|c)\b\.?", "", rest)):
                        continue
                    own = ([Evidence(*below, 2)] if below else []) + outer
                values.append(r.value)
                evidence.append(own)
                at.append(n)
        if not any(evidence):
            continue
        for n, x, es, state in zip(at, values, evidence, _decode(values, evidence), strict=True):
            if state:
                out.append((n, col, state[0].quantity, state[0].name, x, _common(x, *state), bool(es)))
    return out


# ---------------------------------------------------------------- statements (graph edges)


def statement_evidence(text: str | None, sentence: str | None, metadata: str | None) -> list[tuple[float, list[Evidence]]]:
    """The numbers a statement gives and the units of one quantity named for each, nearest first."""
    if not text or not text.strip():
        return []
    text = spaced(text)
    found = readings(text)
    stated = [r for r in found if r.unit]
    if stated:
        return [(r.value, [Evidence(r.unit, 1.0, 0)]) for r in stated]
    if len(found) != 1:
        return []
    r = found[0]
    rest = re.sub(r"(?i)\b(?:ca|about|approx(?:imately)?|circa|c)\b\.?", "", text[: r.start] + " " + text[r.end :])
    if re.search(r"[^\W\d_]|[%°/:]", re.sub(r"^[^=:]*[=:]|^.*\bof\b", "", rest)):
        return []
    evidence: list[Evidence] = []
    if metadata:
        try:
            qualifiers = (json.loads(metadata) or {}).get("qualifiers") or {}
            for k, v in qualifiers.items():
                if "unit" in k.lower() and isinstance(v, str) and (u := alone(v)):
                    evidence.append(Evidence(*u, 1))
        except (ValueError, AttributeError):
            pass
    evidence += [Evidence(u, 1.0, 1 + d) for u, d in sentence_units(sentence, r.value)]
    evidence = [e for e in evidence if e.unit.quantity == evidence[0].unit.quantity]  # a device is one quantity
    return [(r.value, evidence)] if evidence else []


_FOUND = "row_id bigint, row_no bigint, col string, quantity string, unit string, value double, common double, named boolean"


def decode_tables(tables: DataFrame, block_rows: int = 256) -> DataFrame:
    """Readings of all table cells: record_id, row_no, col, quantity, unit, value, common, named.

    A record holds its devices (columns) whole, so decoding needs no shuffle. Null columns, rows,
    cells and captions count as absent; repeated records come out once each; a table without rows
    gives none. ``block_rows`` bounds the records that one Arrow batch turns into Python objects.
    """

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("row_id", pa.int64()), ("row_no", pa.int64()), ("col", pa.string()), ("quantity", pa.string()), ("unit", pa.string()), ("value", pa.float64()), ("common", pa.float64()), ("named", pa.bool_())])
        for batch in batches:
            for k in range(0, batch.num_rows, block_rows):
                part = batch.slice(k, block_rows).to_pydict()
                got = [
                    (i, *x)
                    for i, caption, columns, rows in zip(part["record_id"], part["caption"], part["columns"], part["rows"], strict=True)
                    for x in table_readings(i, caption, columns, rows)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else [[]] * 8, kinds.types, strict=True)], schema=kinds)

    return tables.select("record_id", "caption", "columns", "rows").mapInArrow(run, _FOUND)


def _boundaries(matrices: DataFrame, fan: int) -> DataFrame:
    """device, run, before, last: costs of the states before each run and the state at its end.

    matrices: device, run, m (a flattened (min, +) matrix). Of more than ``fan`` runs each ``fan``
    are multiplied first, so no task holds more of a device than that.
    """

    def load(m) -> np.ndarray:
        k = math.isqrt(len(m))
        return np.asarray(m, dtype=np.int64).reshape(k, k)

    def product(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        got = None
        for m in df.sort_values("run")["m"]:
            got = load(m) if got is None else (got[:, :, None] + load(m)).min(axis=1)
        return pd.DataFrame([(key[0], key[1], got.ravel().tolist())], columns=["device", "run", "m"])

    def walk(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("run")
        ms = [load(m) for m in df["m"]]
        cost = [np.asarray(df["before"].iloc[0], dtype=np.int64) if df["before"].iloc[0] is not None else np.zeros(len(ms[0]), dtype=np.int64)]
        for m in ms:
            cost.append((cost[-1][:, None] + m).min(axis=0))
        given = df["last"].iloc[0]
        last = [int(cost[-1].argmin()) if pd.isna(given) else int(given)]
        for c, m in zip(cost[-2:0:-1], ms[:0:-1], strict=True):
            last.append(int((c + m[:, last[-1]]).argmin()))
        return pd.DataFrame({"device": key[0], "run": df["run"].to_numpy(), "before": [c.tolist() for c in cost[:-1]], "last": last[::-1]})

    shape = "device string, run bigint, before array<bigint>, last int"
    most = matrices.agg(F.max("run")).first()[0] or 0
    if most < fan:
        return matrices.withColumn("before", F.lit(None).cast("array<bigint>")).withColumn("last", F.lit(None).cast("int")).groupBy("device").applyInPandas(walk, shape)
    above = F.floor(F.col("run") / fan)
    parents = checkpoint(matrices.groupBy("device", above.alias("run")).applyInPandas(product, "device string, run bigint, m array<bigint>"))
    held = _boundaries(parents, fan).withColumnRenamed("run", "parent")
    return matrices.withColumn("parent", above).join(held, ["device", "parent"]).groupBy("device", "parent").applyInPandas(walk, shape)


def decode_statements(edges: DataFrame, relations: Sequence[str] = ("HAS_VALUE", "HAS_CONDITION", "REPORTS_RESULT"), block: int = 4096, fan: int = 1024) -> DataFrame:
    """Readings of the targets of edges: the device is a quantity of a paper, in the order of edge_id.

    A device of more than ``block`` readings is cut into runs of so many consecutive ones, so that
    no task gets an unbounded group (one paper may hold a third of all edges); the runs are joined
    by their (min, +) matrices, which changes no row. Null or blank targets and rows without an id
    give no reading.
    """
    picked = edges.where(F.col("relation").isin(*relations) & F.col("edge_id").isNotNull()).select("edge_id", "paper_id", "target", "evidence_quote", "metadata")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = []
            for i, paper, target, quote, meta in df.itertuples(index=False, name=None):
                got += [
                    (i, n, f"{paper}|{es[0].unit.quantity}", x, json.dumps([[*e.unit, e.power, e.distance] for e in es]))
                    for n, (x, es) in enumerate(statement_evidence(target, quote, meta))
                ]
            yield pd.DataFrame(got, columns=["row_id", "n", "device", "value", "evidence"])

    def named(texts: Iterable[str]) -> list[list[Evidence]]:
        return [[Evidence(Unit(*e[:4]), e[4], e[5]) for e in json.loads(t)] for t in texts]

    def rows_of(ids: Sequence[int], values: Sequence[float], path: Sequence[State]) -> list[tuple]:
        return [(i, -1, "target", u.quantity, u.name, x, _common(x, u, p), True) for i, x, (u, p) in zip(ids, values, path, strict=True)]

    fields = [c.split()[0] for c in _FOUND.split(", ")]
    seen = checkpoint(picked.mapInPandas(parse, "row_id bigint, n bigint, device string, value double, evidence string").withColumn("range", F.floor(F.col("row_id") / block)))
    every = Window.partitionBy("device")
    size = seen.groupBy("device", "range").agg(F.count(F.lit(1)).alias("held")).select("device", "range", F.sum("held").over(every).alias("all"), (F.sum("held").over(every.orderBy("range")) - F.col("held")).alias("earlier"))
    readings = seen.join(size, ["device", "range"])
    short = readings.where(F.col("all") <= block).select("row_id", "n", "device", "value", "evidence").repartition("device").sortWithinPartitions("device", "row_id", "n")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(run: list[tuple]) -> list[tuple]:
            values = [r[3] for r in run]
            return rows_of([r[0] for r in run], values, _decode(values, named(r[4] for r in run)))

        run: list[tuple] = []
        for df in frames:
            got: list[tuple] = []
            for row in df.itertuples(index=False, name=None):
                if run and run[-1][2] != row[2]:
                    got += flush(run)
                    run = []
                run.append(row)
            yield pd.DataFrame(got, columns=fields)
        if run:
            yield pd.DataFrame(flush(run), columns=fields)

    found = short.mapInPandas(decode, _FOUND)
    if size.where(F.col("all") > block).isEmpty():
        return found
    place = F.row_number().over(Window.partitionBy("device", "range").orderBy("row_id", "n"))
    long = readings.where(F.col("all") > block).withColumn("run", F.floor((F.col("earlier") + place - 1) / block)).select("row_id", "n", "device", "run", "value", "evidence")
    ends = long.groupBy("device", "run").agg(F.max_by("value", F.struct("row_id", "n")).alias("value")).select("device", (F.col("run") + 1).alias("run"), F.col("value").alias("previous"))
    units = long.groupBy("device").agg(F.collect_set("evidence").alias("units"))  # as many as there are spellings, not readings
    long = checkpoint(long.join(units, "device").join(ends, ["device", "run"], "left"))

    def costs(df: pd.DataFrame) -> tuple[pd.DataFrame, list[State], np.ndarray, np.ndarray]:
        df = df.sort_values(["row_id", "n"])
        states, previous = states_of(named(df["units"].iloc[0])), df["previous"].iloc[0]
        return df, states, *_costs(df["value"].tolist(), named(df["evidence"]), states, None if pd.isna(previous) else previous)

    def matrix(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, run_matrix(*costs(df)[2:]).ravel().tolist())], columns=["device", "run", "m"])

    def between(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df, states, emission, jump = costs(df)
        path = _path(emission, jump, np.asarray(df["before"].iloc[0], dtype=np.int64), int(df["last"].iloc[0]))
        return pd.DataFrame(rows_of(df["row_id"].tolist(), df["value"].tolist(), [states[k] for k in path]), columns=fields)

    matrices = checkpoint(long.groupBy("device", "run").applyInPandas(matrix, "device string, run bigint, m array<bigint>"))
    joined = long.join(_boundaries(matrices, fan), ["device", "run"])
    return found.unionByName(joined.groupBy("device", "run").applyInPandas(between, _FOUND))


def found_quantities(edges: DataFrame, tables: DataFrame, quantities: DataFrame) -> DataFrame:
    """place, row_id, row_no, col, quantity, common_value of every stated quantity of ``quantities``.

    Only readings whose unit is named count. common_value is rounded to the nearest integer; a
    value that isn't finite or beyond the range of bigint gives no row.
    """
    both = decode_statements(edges).withColumn("place", F.lit("edge")).unionByName(decode_tables(tables).withColumn("place", F.lit("table")))
    wanted = quantities.select("quantity").where(F.col("quantity").isNotNull()).distinct()
    kept = both.where(F.col("named") & (F.abs("common") < 9.2e18))
    return kept.join(wanted, "quantity", "left_semi").select("place", "row_id", "row_no", "col", "quantity", F.rint("common").cast("bigint").alias("common_value"))
