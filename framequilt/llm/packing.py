"""Filling containers of fixed capacity: first-fit decreasing in randomised groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a randomised group on average: what one call of the packer holds.
GROUP_ITEMS = 4_000


class BinTree:
    """Tournament tree over the free room of bins: each node holds the most room below it, so the first bin with room for an item is found in log time."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.size = 1
        self.tree = [0, capacity]
        self.used = 1

    def _grow(self) -> None:
        old = self.tree[self.size : 2 * self.size]
        self.size *= 2
        leaves = old + [self.capacity] * (self.size - len(old))
        self.tree = [0] * self.size + leaves
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def place(self, item: int) -> int:
        """Puts an item of at most the capacity into the first bin with room; returns the bin."""
        while self.tree[1] < item:
            self._grow()
        tree, i = self.tree, 1
        while i < self.size:
            i *= 2
            if tree[i] < item:
                i += 1
        at = i - self.size
        tree[i] -= item
        i //= 2
        while i:
            most = tree[2 * i] if tree[2 * i] >= tree[2 * i + 1] else tree[2 * i + 1]
            if tree[i] == most:
                break
            tree[i] = most
            i //= 2
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item; larger items first, ties in the given order."""
    tree = BinTree(capacity)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = tree.place(sizes[i])
    return out


def pack(items: DataFrame, item_id: str, size: str, stages: list[tuple[str, int]], group_items: int = GROUP_ITEMS, seed: int = 0) -> DataFrame:
    """Containers of every stage: stage, group, bin, item_id, piece, n_pieces, tokens.

    An item above the capacity is cut into full pieces and a rest (n_pieces > 1); each piece is then an item. All others
    stay whole. Null sizes count as 0; items of size 0 take no room. Stages need a capacity above 0. Groups are drawn by
    the seeded hash of the id, ``group_items`` on average, so neither a frequent source nor a frequent size makes a
    group larger; repeated ids stay apart as items. An empty table gives an empty table.
    """
    for stage, capacity in stages:
        if capacity <= 0:
            raise ValueError(f"the capacity of {stage} must be above 0")
    base = items.select(F.col(item_id).alias("id"), F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0)).alias("size"))
    n_groups = max(1, -(-base.count() // group_items))
    id_type = dict(base.dtypes)["id"]
    grouped = base.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_groups)).cast("bigint"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, sizes, grp = pdf["id"].tolist(), pdf["size"].tolist(), int(pdf["grp"].iloc[0])
        cols: list[list] = [[], [], [], [], [], []]
        for stage, capacity in stages:
            pid, piece, of, tokens = [], [], [], []
            for i, s in zip(ids, sizes, strict=True):
                n = max(1, -(-s // capacity))
                for k in range(n):
                    pid.append(i)
                    piece.append(k)
                    of.append(n)
                    tokens.append(min(capacity, s - k * capacity))
            for c, v in zip(cols, ([stage] * len(pid), first_fit_decreasing(tokens, capacity), pid, piece, of, tokens), strict=True):
                c.extend(v)
        return pd.DataFrame({"stage": cols[0], "grp": grp, "bin": cols[1], "id": cols[2], "piece": cols[3], "n_pieces": cols[4], "tokens": cols[5]})

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by group: one group is held at a time
        held: list[pd.DataFrame] = []
        for batch in batches:
            for g, part in batch.groupby("grp", sort=True):
                if held and held[-1]["grp"].iloc[0] != g:
                    yield fill(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield fill(pd.concat(held))

    packed = grouped.repartition("grp").sortWithinPartitions("grp").mapInPandas(groups, f"stage string, grp bigint, bin bigint, id {id_type}, piece bigint, n_pieces bigint, tokens bigint")
    return packed.select("stage", F.col("grp").alias("group"), "bin", F.col("id").alias(item_id), "piece", "n_pieces", "tokens")


def pack_report(packed: DataFrame, stages: list[tuple[str, int]]) -> DataFrame:
    """Per stage: containers, tokens, pieces, and the share of room that is filled."""
    caps = packed.sparkSession.createDataFrame(stages, "stage string, capacity bigint")
    bins = packed.groupBy("stage", "group", "bin").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    per = bins.groupBy("stage").agg(F.count("*").alias("n_bins"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("tokens").alias("fullest"))
    return per.join(F.broadcast(caps), "stage").withColumn("fill", F.try_divide(F.col("tokens"), F.col("n_bins") * F.col("capacity")))
