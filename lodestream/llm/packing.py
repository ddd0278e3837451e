"""Filling containers of fixed capacity: mixture-controlled packing by deficit round-robin.

Every source has a queue of items. A container is one window: each source earns credit for its
target share of the capacity, the source with the most credit sends the largest of its items that
fits, and what a source sends beyond its credit it owes to the windows after. Credit is carried
from window to window and, as the surplus or debt a source has before a shard, from partition to
partition. Items are spread over shards by hash, so a source of any size is spread with them.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import checkpoint


class Queue:
    """Items of one source by size; of equal sizes the smallest id goes first."""

    def __init__(self, items: list[tuple[int, int]]):
        self.items = sorted((size, -k) for size, k in items)

    def largest(self, room: int) -> int:
        """Size of the largest item that fits, 0 if none does."""
        n = bisect_right(self.items, (room, math.inf))
        return self.items[n - 1][0] if n else 0

    def take(self, size: int) -> int:
        n = bisect_right(self.items, (size, math.inf)) - 1
        return -self.items.pop(n)[1]


def round_robin(queues: dict[str, list[tuple[int, int]]], capacity: int, share: dict[str, float], credit: dict[str, float] | None = None) -> list[list[int]]:
    """Containers (lists of item keys) for the (size, key) items of each source.

    In a window sources are served by falling credit: first whoever can pay for its largest fitting
    item, then, so that no room is wasted, whoever has any item that fits. Every item is placed;
    ties go to the source that is first in text order.
    """
    todo = {s: Queue(items) for s, items in sorted(queues.items()) if items}
    owed = {s: (credit or {}).get(s, 0.0) for s in todo}
    out: list[list[int]] = []
    while todo:
        room, box = capacity, []
        whole = sum(share.get(s, 0.0) for s in todo) or 1.0
        for s in todo:  # sources that have run dry leave their share to the rest
            owed[s] += capacity * share.get(s, 0.0) / whole
        while room:
            best = None
            for s, q in todo.items():
                size = q.largest(room)
                if size:
                    rank = (owed[s] >= size, owed[s], size)
                    if best is None or rank > best[0]:
                        best = (rank, s, size)
            if best is None:
                break
            _, s, size = best
            box.append(todo[s].take(size))
            room -= size
            owed[s] -= size
            if not todo[s].items:
                del todo[s]
        out.append(box)
    return out


_PLACED = "doc_id bigint, piece_no bigint, source string, token_start bigint, n_tokens bigint, container string"


def pack(sizes: DataFrame, capacity: int = 2048, weights: dict[str, float] | None = None, shard_containers: int = 2048) -> DataFrame:
    """Place (doc_id, source, n_tokens) rows; returns doc_id, piece_no, source, token_start, n_tokens, container.

    Only an item larger than ``capacity`` is split: into full pieces, each a container of its own,
    and the rest, which is packed like any item. Target shares are the sources' shares of all
    tokens, or ``weights`` (other sources get 0 and fill what is left). Items of 0 tokens take no
    room and have a null container; a null source is a source of its own (""); repeated rows are
    items of their own; an empty table gives an empty result. A shard holds about
    ``shard_containers`` containers, whatever the input, and wastes at most its last one.
    """
    rows = sizes.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"))
    rows = checkpoint(rows).withColumn("row", F.monotonically_increasing_id())
    pieces = rows.select("doc_id", "row", "source", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0).cast("bigint")))).alias("piece_no"))
    pieces = pieces.select("doc_id", "row", "piece_no", "source", (F.col("piece_no") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece_no") * capacity).alias("n_tokens"))
    lone = F.when(F.col("n_tokens") > 0, F.concat_ws("-", F.lit("d"), "doc_id", "piece_no", "row"))
    done = pieces.where((F.col("n_tokens") == 0) | (F.col("n_tokens") == capacity)).withColumn("container", lone)
    items = pieces.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))
    total = rows.where("n > 0").agg(F.sum(F.col("n") % capacity)).first()[0] or 0
    shards = max(1, round(total / (capacity * shard_containers)))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no", "row"), F.lit(shards)))
    # What each source should have sent before a shard, less what it has sent: a sum over at most one row a shard.
    sent = items.groupBy("source", "shard").agg(F.sum("n_tokens").alias("sent"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_source = sent.groupBy("source").agg(F.sum("sent").alias("all_sent"))
    if weights:
        whole = sum(weights.values())
        share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for s, w in weights.items() for x in (s, w / whole))), F.col("source")), F.lit(0.0))
    else:
        share = F.col("all_sent") / F.lit(max(total, 1))
    state = sent.withColumn("earlier", F.coalesce(F.sum("sent").over(before), F.lit(0))).join(by_source, "source")
    state = state.select("shard", "source", share.alias("share"), (share * F.lit(total / shards) * F.col("shard") - F.col("earlier")).alias("credit"))

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        queues: dict[str, list[tuple[int, int]]] = {}
        df = df.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
        for k, (s, n) in enumerate(zip(df["source"], df["n_tokens"], strict=True)):
            queues.setdefault(s, []).append((int(n), k))
        shares, credits = dict(zip(df["source"], df["share"], strict=True)), dict(zip(df["source"], df["credit"], strict=True))
        place: list[str | None] = [None] * len(df)
        for c, box in enumerate(round_robin(queues, capacity, shares, credits)):
            for k in box:
                place[k] = f"s-{key[0]}-{c}"
        return df.assign(container=place)[["doc_id", "piece_no", "source", "token_start", "n_tokens", "container"]]

    packed = items.join(checkpoint(state), ["shard", "source"]).groupBy("shard").applyInPandas(run, _PLACED)
    return done.select("doc_id", "piece_no", "source", "token_start", "n_tokens", "container").unionByName(packed)


def split_items(placed: DataFrame) -> DataFrame:
    """doc_id of the items that had to be split (they have a second piece)."""
    return placed.where(F.col("piece_no") == 1).select("doc_id").distinct()
