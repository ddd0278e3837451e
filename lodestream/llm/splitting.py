"""Splitting oversized texts at natural boundaries, by dynamic programming over the boundary positions.

The cost of a split is first the sum of its cut penalties (a paragraph end is free, any number of
sentence ends costs less than one word end, and that less than a place inside a word), then, among
splits of equal penalty, the sum of the squared deviations of the pieces from an even size. Every
piece stays within the limit, the overlap counted in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("paragraph", "sentence", "word", "char")
PENALTY = (0, 1, 10**6, 10**12)
_EOL = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
_PARAGRAPH = re.compile(rf"{_EOL}[^\S\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*{_EOL}\s*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"\s+")
_PATTERNS = (_PARAGRAPH, _SENTENCE, _WORD)


def _gaps(text: str, level: int) -> list[tuple[int, int]]:
    """White space at which a level cuts (a level cuts where the coarser ones do, too)."""
    spans = [m.span() for p in _PATTERNS[: level + 1] for m in p.finditer(text)]
    return sorted(spans)


def cut_level(text: str, limit: int = 2000) -> str:
    """The coarsest level at which no unit (without the white space at its ends) is over the limit."""
    for level, name in enumerate(LEVELS[:3]):
        pos, longest = 0, 0
        for a, b in [*_gaps(text, level), (len(text), len(text))]:
            longest, pos = max(longest, a - pos), max(pos, b)
        if longest <= limit:
            return name
    return "char"


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the text may be cut, and their levels.

    Finer levels are opened only where the coarser ones leave a stretch longer than half of
    ``reach``: elsewhere a finer cut is never needed, and it costs more than all coarser ones. In a
    run without white space every 32nd place counts as one.
    """
    n = len(text)
    level_of: dict[int, int] = {}
    ends = [(0, n)]
    for level, pattern in enumerate(_PATTERNS):
        nxt = []
        for a, b in ends:
            at = sorted({m.end() for m in pattern.finditer(text, a, b) if a < m.end() < b})
            for p in at:
                level_of.setdefault(p, level)
            nxt += [(x, y) for x, y in zip([a, *at], [*at, b], strict=True) if y - x > reach // 2]
        ends = nxt
    step = max(1, min(32, reach // 4))
    for a, b in ends:
        for p in range(a + step, b, step):
            level_of.setdefault(p, 3)
    pos = np.array(sorted(level_of), dtype=np.int64)
    return pos, np.array([level_of[p] for p in pos.tolist()], dtype=np.int64)


def split_text(text: str, limit: int = 2000, overlap: int = 100) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; a piece after the first starts ``overlap`` before the end of the last.

    A text within the limit is one piece, an empty one too. Lengths are in code points.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    reach = limit - overlap
    pos, level = boundaries(text, reach)
    keep = pos >= min(overlap, reach)  # the first piece has to hold the overlap
    pos, level = np.append(pos[keep], n), np.append(level[keep], 0)
    pen = np.array(PENALTY, dtype=np.int64)[level]
    even = n / np.ceil(max(n - overlap, 1) / reach)
    m = len(pos)
    never = np.iinfo(np.int64).max // 2
    paid, uneven, come = np.full(m, never), np.full(m, np.inf), np.full(m, -1, dtype=np.int64)
    first = pos <= limit
    paid[first], uneven[first] = pen[first], ((pos[first] - even) / limit) ** 2
    low = np.searchsorted(pos, pos - reach)
    for j in range(m):
        i = low[j]
        if i < j:
            before = paid[i:j]
            least = before.min()
            c = np.where(before == least, uneven[i:j] + ((pos[j] - pos[i:j] - even) / limit) ** 2, np.inf)
            k = int(np.argmin(c))
            if (least + pen[j], c[k]) < (paid[j], uneven[j]):
                paid[j], uneven[j], come[j] = least + pen[j], c[k], i + k
    cuts, j = [], m - 1
    while j >= 0:
        cuts.append(int(pos[j]))
        j = int(come[j])
    cuts.reverse()
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip([0, *cuts], cuts, strict=False)]


_PIECES = "section_id bigint, piece_no bigint, start bigint, end bigint, piece string, cut string"


def split_sections(sections: DataFrame, limit: int = 2000, overlap: int = 100, id_col: str = "section_id", text_col: str = "content") -> DataFrame:
    """Pieces of all texts: section_id, piece_no, start, end, piece, cut (null for a text within the limit).

    A null text gives no piece, an empty one an empty piece. Repeated sections are split each;
    other columns are ignored. Work is per row, without a shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("section_id", pa.int64()), ("piece_no", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("piece", pa.string()), ("cut", pa.string())])
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    cut = cut_level(text, limit) if len(text) > limit else None
                    got += [(i, n, a, b, text[a:b], cut) for n, (a, b) in enumerate(split_text(text, limit, overlap))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else [[]] * 6, schema.types, strict=True)], schema=schema)

    rows = sections.select(F.col(id_col).cast("bigint").alias("section_id"), F.col(text_col).cast("string").alias("content")).where(F.col("content").isNotNull())
    return rows.mapInArrow(run, _PIECES)


def oversized(pieces: DataFrame) -> DataFrame:
    """section_id and cut of the sections that were split."""
    return pieces.where(F.col("piece_no") == 1).select("section_id", "cut")
