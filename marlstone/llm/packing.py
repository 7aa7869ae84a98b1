"""Problem 6: filling containers of fixed capacity with items that are never split.

First-fit decreasing: items by size, largest first, each into the lowest-numbered
container with room, found by a tournament tree over the rooms left. Groups of
about ``group_items`` items, drawn by a hash of the item and of its number among
equal items, are packed each on its own, so a task never holds more than its group however the data are skewed, and
one last container a group is all that grouping can waste.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.runtime import plain, staged

GROUP_ITEMS = 8_000
#: Copies of an item that are written out at a time.
CHUNK = 100_000
#: Kinds of containers at most; they are collected.
CONTAINER_KINDS = 1_000


class Tournament:
    """Rooms of containers in a complete binary tree; a node is its children's larger room."""

    def __init__(self, leaves: int, capacity: int) -> None:
        self.width = 1 << max(0, (leaves - 1).bit_length())
        self.capacity, self.used = capacity, 0
        self.room = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """The lowest-numbered container with room for ``size``, which it then holds."""
        room, node = self.room, 1
        while node < self.width:
            node *= 2
            if room[node] < size:
                node += 1
        chosen = node - self.width
        self.used = max(self.used, chosen + 1)
        room[node] -= size
        while node > 1:
            node //= 2
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
        return chosen


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each size; every size lies between 0 and ``capacity``; ties keep their order."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.zeros(len(sizes), dtype=np.int64)
    tree = Tournament(max(1, len(sizes)), capacity)
    for i in order.tolist():
        bins[i] = tree.place(int(sizes[i]))
    return bins


def pack(items: DataFrame, containers: DataFrame, item_id: str, size: str, name: str, capacity: str, group_items: int = GROUP_ITEMS, seed: int = 7) -> DataFrame:
    """Columns pack, item, part, group, container, tokens: the assignment of every item, for every row of ``containers``.

    An item larger than the capacity is cut into full parts, numbered from 0,
    and a rest; full parts are containers of their own. Items of null size
    count as size 0, which always fits. Container names are distinct and their
    capacities positive, others are left out. Repeated items are packed each;
    no items or no containers give no rows. Container numbers are unique
    within pack and group.
    """
    kinds = {"i": dict(items.dtypes)[item_id], "n": dict(containers.dtypes)[name]}
    sized = staged(items.select(F.col(item_id).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")), "sizes")
    groups = max(1, math.ceil(sized.count() / group_items))
    named = containers.where(F.col(capacity) > 0).select(F.col(name).alias("pack"), F.col(capacity).cast("long").alias("capacity")).dropDuplicates(["pack"])
    kinds_of = named.orderBy("pack").limit(CONTAINER_KINDS + 1).collect()
    if len(kinds_of) > CONTAINER_KINDS:
        raise ValueError(f"more than {CONTAINER_KINDS} kinds of containers")
    capacities = [(r["pack"], r["capacity"]) for r in kinds_of]
    # equal items are counted and numbered, so they are spread, and alike however the input is split
    copies = sized.groupBy("item", "size").agg(F.count("*").alias("n"))
    chunks = copies.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    each = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)
    numbered = chunks.select("item", "size", F.explode(each).alias("number"))
    drawn = numbered.select("item", "size", F.pmod(F.xxhash64("item", "size", "number", F.lit(seed)), F.lit(groups)).cast("int").alias("group"))

    def one(group: pd.DataFrame, pack: object, cap: int) -> pd.DataFrame:
        sizes = group["size"].to_numpy()
        whole = sizes <= cap
        full, rest = np.where(whole, 0, sizes // cap), np.where(whole, sizes, sizes % cap)
        parts = full + (whole | (rest > 0))
        at = np.repeat(np.arange(len(sizes)), parts)
        part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        loose = (part == full[at]) & (whole | (rest > 0))[at]
        tokens = np.where(loose, rest[at], cap)
        bins = np.empty(len(at), dtype=np.int64)
        bins[loose] = first_fit_decreasing(tokens[loose], cap)
        used = int(bins[loose].max()) + 1 if loose.any() else 0
        bins[~loose] = used + np.arange(int((~loose).sum()))
        pick = group.iloc[at]
        return pd.DataFrame({"pack": pack, "item": pick["item"].to_numpy(), "part": part, "group": pick["group"].to_numpy(), "container": bins, "tokens": tokens})

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        made = [one(group, pack, cap) for pack, cap in capacities]
        return plain(pd.concat(made)) if made else pd.DataFrame(columns=["pack", "item", "part", "group", "container", "tokens"])

    return drawn.groupBy("group").applyInPandas(packed, f"pack {kinds['n']}, item {kinds['i']}, part int, group int, container long, tokens long")
