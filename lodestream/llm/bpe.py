"""Exact byte-level BPE in linear time: longest matches of an Aho-Corasick automaton, with backtracking.

The vocabulary is public (a ``tokenizers`` JSON file with its merges). Bytes are written as Latin-1
characters, so that the automaton works on str. A text is cut by the public split pattern; of each
piece the automaton gives the longest token at every byte. From left to right the longest token is
tried first; it may follow the token before it only if the merges would not have joined the two in
another way (``BytePairs.adjacent``, memoised). Where no token fits, the last one is taken back and
the place is barred, so every byte is visited a bounded number of times.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of the public byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.json as installed; a parameter everywhere, never copied."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _printable_bytes() -> dict[str, int]:
    """Character -> byte of the printable alphabet in which byte-level vocabularies are written."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """One vocabulary: automaton, merges and the adjacency test."""

    def __init__(self, path: str, cache: int = 1 << 18):
        model = json.load(open(path, encoding="utf-8"))["model"]
        byte = _printable_bytes()
        latin = lambda token: "".join(chr(byte[c]) for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.size: dict[int, int] = {}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        text_of: dict[int, str] = {ids[c]: chr(b) for c, b in byte.items()}
        for k, (a, b) in enumerate(merges):
            t = ids[a + b]
            self.split[t], self.rank[t], self.joined[(ids[a], ids[b])] = (ids[a], ids[b]), k, t
            text_of[t] = latin(a + b)
        self.whole = {s: t for t, s in text_of.items()}
        for t, s in text_of.items():
            self.size[t] = len(s)
            self.automaton.add_word(s, t)
        self.automaton.make_automaton()
        for t, s in text_of.items():
            self.shorter[t] = next((self.whole[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.whole), None)
        self.adjacent = lru_cache(1 << 20)(self._adjacent)
        self.piece = lru_cache(cache)(self._piece)
        self.find = regex.compile(PATTERN).findall

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether the merges keep ``left`` and ``right`` apart when their bytes stand side by side.

        The last merges of both are undone in turn, latest first; a pair along the seam that a
        merge earlier than the undone one would have joined shows that the two can't be neighbours.
        """
        bound = len(self.rank)
        while True:
            made = self.joined.get((left, right))
            if made is not None and self.rank[made] < bound:
                return False
            l, r = self.rank.get(left, -1), self.rank.get(right, -1)
            if l < 0 and r < 0:
                return True
            # a merge on the left comes before an equal one on the right
            if l > r:
                bound, left = l, self.split[left][1]
            else:
                bound, right = r + 1, self.split[right][0]

    def _piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode().decode("latin-1")
        if (t := self.whole.get(text)) is not None:
            return (t,)
        n = len(text)
        longest: list[int] = [0] * n
        for end, t in self.automaton.iter(text):  # a later end is a longer match from the same start
            longest[end + 1 - self.size[t]] = t
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else None
            while token is not None and not (open_at[pos + self.size[token]] and (last is None or self.adjacent(last, token))):
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                pos += self.size[token]
                token = longest[pos] if pos < n else None
            else:
                open_at[pos] = 0
                token = out.pop()
                pos -= self.size[token]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text, without special tokens (their strings are ordinary text); [] for None and ""."""
        if not text:
            return []
        piece, out = self.piece, []
        for p in self.find(text):
            out += piece(p) if len(p) < 200 else self._piece(p)
        return out


@lru_cache(2)
def vocabulary(path: str) -> BytePairs:
    """The vocabulary of a file, built once in each Python worker."""
    return BytePairs(path)


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, counts: bool = False, keep: tuple[str, ...] = (), step: int = 512) -> DataFrame:
    """(id, ids array<int>) of every row, or (id, n_tokens bigint) with ``counts``.

    Null and empty texts have the empty list (0 tokens); white space is encoded as it stands.
    Repeated rows come out as often as they stand in the input; an empty table gives none; of the
    other columns only those in ``keep`` come along, as strings. The work is per row, without a shuffle.
    """
    path = path or default_vocabulary()
    name = "n_tokens" if counts else "ids"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = vocabulary(path)
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                lists = [bpe.encode(t) for t in part.column(1).to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                if counts:
                    values = pa.array(sizes)
                else:
                    offsets = np.zeros(len(lists) + 1, np.int32)
                    np.cumsum(sizes, out=offsets[1:])
                    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), values, *part.columns[2:]], names=["id", name, *kept])

    kept = [f"k{n}" for n in range(len(keep))]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).cast("string").alias(k) for c, k in zip(keep, kept, strict=True)))
    done = rows.mapInArrow(run, ", ".join(["id bigint", f"{name} {'bigint' if counts else 'array<int>'}", *(f"{k} string" for k in kept)]))
    return done.toDF(id_col, name, *keep)
