"""Items of varying length into containers of fixed capacity, none split unless it exceeds the capacity alone.

Documents are routed by their own length to tiers of context size: the windows of tier 0 are as long as the container, those of each
further tier half as long, and a document belongs to the tier with the shortest window that holds it. Tiers are packed one
after the other, from the longest windows down, each into windows of its own size: the longest document of the tier that
waits opens a window, and what it leaves of the window is filled from the shorter tiers, by two documents that fill it
exactly, if there are such, else by the longest that fits. Windows of one tier lie in containers of their own; room that a window
leaves goes to the next one in its container, and a container that a tier leaves unfinished is continued by the next tier, as shorter
windows nest in longer ones. Containers are dealt out over step groups within the tier that opened them, those of like cost of
attention in turn and back, so that the containers of a step are of one context size and the groups of like cost.

All documents of one length are alike to the packing, so it works on counts by length. Packing runs on many independent shards
of about ``SHARD_ITEMS`` items drawn by hash; each loses at most part of one container. A task sees only numbers
and lengths, never texts.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.llm import tokenize

SHARD_ITEMS = 100_000
STEP = 64  #: containers of a step group
TIERS = 8  #: at most; the windows of the last of so many are 2 ** (TIERS - 1) times as short as a container


class _Waiting:
    """The items that wait, by length."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(lengths, kind="stable")
        sizes, start = np.unique(lengths[order], return_index=True)
        self.items = {int(s): list(order[a:b]) for s, a, b in zip(sizes, start, np.append(start[1:], len(order))) if s > 0}
        self.sizes = sorted(self.items)

    def take(self, size: int) -> int:
        items = self.items[size]
        i = items.pop()
        if not items:
            del self.items[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        return i

    def longest(self, room: int) -> int:
        """The longest length that fits, 0 if none does."""
        at = bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else 0

    def filling(self, room: int) -> int:
        return _next(self.sizes, self.items, room)


def _next(left: list[int], waiting: dict[int, list], room: int) -> int:
    """The length to put into a room: one that fills it, the longer of two that do, or the longest that fits; 0 if none fits."""
    at = bisect_right(left, room)
    if not at:
        return 0
    longest = left[at - 1]
    if longest == room:
        return room
    for k in range(at - 1, -1, -1):
        rest = room - left[k]
        if rest > left[k]:
            break  # the longer of such two was tried
        if rest in waiting and (rest != left[k] or len(waiting[rest]) > 1):
            return left[k]
    return longest


def tiers_of(capacity: int) -> int:
    """The number of tiers: no window is shorter than a token."""
    return min(TIERS, int(capacity).bit_length())


def tier_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The tier whose windows are the shortest that hold a length."""
    windows = np.array([capacity >> t for t in range(tiers_of(capacity))])
    return np.maximum((windows[None, :] >= np.maximum(lengths, 1)[:, None]).sum(1) - 1, 0).astype(np.int32)


def pack_windows(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container, own tier and tier of its window of each item; every length must be between 0 and ``capacity``.

    Items of length 0 take no room and go into the first container.
    """
    container, window = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int32)
    tier, tiers = tier_of(lengths, capacity), tiers_of(capacity)
    window[lengths == 0] = tiers - 1
    waiting = _Waiting(lengths)
    number, room, carried = -1, 0, 0  # the open container, what windows have not taken of it, what they have left unused
    for t in range(tiers):
        size, shorter = capacity >> t, capacity >> (t + 1) if t < tiers - 1 else 0
        while waiting.sizes and waiting.sizes[-1] > shorter:
            if room < size:
                number, room, carried = number + 1, capacity, 0
            room -= size
            first = waiting.longest(size)
            i = waiting.take(first)
            container[i], window[i] = number, t
            left = size + carried - first
            if room < size and waiting.sizes and waiting.sizes[-1] > shorter:
                left, room = left + room, 0  # no window of this tier fits into what is left, and there will be one
            while take := waiting.filling(left):
                i = waiting.take(take)
                container[i], window[i] = number, t
                left -= take
            carried = left
    return container, tier, window


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and own tier of each item, as in ``pack_windows``."""
    return pack_windows(lengths, capacity)[:2]


PACKED = "target_id int, container_id long, step_group long, tier int, window_tier int, doc_id string, piece int, piece_start int, piece_tokens int, container_start int"


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["uid", "piece"], ignore_index=True)
    capacity, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
    length = pdf["piece_tokens"].to_numpy(np.int64)
    container, tier, window = pack_windows(length, capacity)
    cost, opened = np.zeros(container.max() + 1), np.full(container.max() + 1, TIERS)
    np.add.at(cost, container, length.astype(float) ** 2)
    np.minimum.at(opened, container, window)
    group, begun = np.empty(len(cost), np.int64), 0
    for t in np.unique(opened):
        mine = np.flatnonzero(opened == t)
        groups = -(-len(mine) // STEP)
        turn, place = np.divmod(np.arange(len(mine)), groups)
        group[mine[np.argsort(-cost[mine], kind="stable")]] = begun + np.where(turn % 2 == 0, place, groups - 1 - place)
        begun += groups
    order = np.argsort(container, kind="stable")
    run = np.cumsum(length[order]) - length[order]
    first = np.r_[True, container[order][1:] != container[order][:-1]]
    offset = np.empty(len(length), np.int64)
    offset[order] = run - np.repeat(run[first], np.diff(np.r_[np.flatnonzero(first), len(run)]))
    return pd.DataFrame(
        {
            "target_id": pdf["target_id"], "container_id": shard * (1 << 32) + container, "step_group": shard * (1 << 32) + group[container],
            "tier": tier, "window_tier": window, "doc_id": pdf["doc_id"], "piece": pdf["piece"], "piece_start": pdf["piece_start"],
            "piece_tokens": pdf["piece_tokens"], "container_start": offset.astype(np.int32),
        }
    )


def pack(documents: DataFrame, targets: DataFrame, folder: str = tokenize.FOLDER, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every document of the corpus assigned to containers of every target (``target_id, tokenizer, capacity``).

    One row per piece: ``target_id, container_id, step_group, tier, window_tier, doc_id, piece, piece_start, piece_tokens,
    container_start``. ``tier`` is that of the length of the piece, ``window_tier`` that of the window it lies in. A document within the capacity is one piece; a longer one is cut into pieces of the capacity and
    a rest. ``container_start`` is the place of the piece in its container. Containers and step groups are numbered per target.

    Null and empty texts have 0 tokens and are assigned too, taking no room. Repeated rows and null ids
    are items of their own. An empty corpus or no targets gives an empty result. Targets without tokenizer or a
    positive capacity are left out. Further columns are not carried. ``targets`` is a table of settings and is collected.
    """
    spark = documents.sparkSession
    goals = [tuple(r) for r in targets.where("tokenizer is not null and capacity > 0").select("target_id", "tokenizer", "capacity").distinct().collect()]
    key = documents.schema["doc_id"].dataType.simpleString()
    if not goals:
        return spark.createDataFrame([], PACKED).withColumn("doc_id", F.col("doc_id").cast(key))
    names = sorted({g[1] for g in goals})
    sized = storage.staged(tokenize.sizes(documents, names, folder).withColumn("uid", F.monotonically_increasing_id()), "sizes")
    per_goal = F.array(
        *[
            F.struct(F.lit(t).cast("int").alias("target_id"), F.lit(c).cast("int").alias("capacity"), F.element_at("sizes", names.index(n) + 1).alias("size"))
            for t, n, c in goals
        ]
    )
    # ids pass through pandas as text, where a null would turn numbers into floats
    items = sized.select(F.col("doc_id").cast("string").alias("doc_id"), "uid", F.inline(per_goal))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))).cast("int")
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    start = F.col("piece") * F.col("capacity")
    items = items.withColumns({"piece_start": start, "piece_tokens": F.least(F.col("capacity"), F.col("size") - start)})
    shards = max(1, -(-sized.count() // shard_items))
    items = items.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    packed = items.groupBy("target_id", "shard").applyInPandas(_pack_shard, PACKED)
    return packed.withColumn("doc_id", F.col("doc_id").cast(key))
