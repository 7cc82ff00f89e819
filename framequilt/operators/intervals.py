"""Overlapping and gapped time intervals per entity.

The work is keyed by (entity, time block), not by entity, so that one entity that holds a large part of all rows is
spread over many tasks. A block's state is an ordered map of disjoint intervals; what earlier blocks cover reaches it as
one number, the carry: the furthest end of all blocks before it. Batches and streams keep the same states: a stream holds
them from one micro-batch to the next, and gaps are put together from them in the same way.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequilt.operators.blocks import with_position
from framequilt.session import cut

#: Width of a time block. A block's map holds at most half as many intervals as milliseconds, whatever the rows.
BLOCK_MS = 600_000
#: Intervals that the map-side state may hold before it is handed on.
STATE_LIMIT = 100_000


class IntervalMap:
    """Ordered disjoint intervals; an insertion finds what it overlaps or touches by binary search and merges it."""

    __slots__ = ("ends", "starts")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def insert(self, start: int, end: int) -> int:
        """Returns the number of intervals that the map gained (negative after merges)."""
        lo = bisect_left(self.ends, start)
        hi = bisect_right(self.starts, end)
        if lo < hi:
            start = min(start, self.starts[lo])
            end = max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]
        return 1 - (hi - lo)

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))


class KeyedIntervals:
    """Keyed state: an interval map for each (entity, block) that was seen, and the number of intervals in all of them."""

    def __init__(self) -> None:
        self.maps: dict[tuple[str, int], IntervalMap] = {}
        self.held = 0

    def update(self, key: tuple[str, int], starts: Iterable[int], ends: Iterable[int]) -> IntervalMap:
        m = self.maps.get(key)
        if m is None:
            m = self.maps[key] = IntervalMap()
        for s, e in zip(starts, ends, strict=True):
            self.held += m.insert(s, e)
        return m

    def rows(self) -> pd.DataFrame:
        rows = [(k, b, s, e) for (k, b), m in self.maps.items() for s, e in zip(m.starts, m.ends, strict=True)]
        return pd.DataFrame(rows, columns=["key", "block", "start_ms", "end_ms"])


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state = KeyedIntervals()
    for pdf in batches:
        for k, b, s, e in zip(pdf["key"], pdf["block"].tolist(), pdf["start_ms"].tolist(), pdf["end_ms"].tolist(), strict=True):
            state.update((k, b), (s,), (e,))
        if state.held > STATE_LIMIT:
            yield state.rows()
            state = KeyedIntervals()
    if state.held:
        yield state.rows()


def _block_gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by (key, block): one map is alive at a time. Each gap ends at a start that lies in its block."""
    now, state, out = None, KeyedIntervals(), []

    def close() -> None:
        out.extend((now[0], s, e) for s, e in state.maps[now].gaps())

    for pdf in batches:
        for k, b, s, e, carry in zip(pdf["key"], pdf["block"].tolist(), pdf["start_ms"].tolist(), pdf["end_ms"].tolist(), pdf["carry"].tolist(), strict=True):
            if now != (k, b):
                if now is not None:
                    close()
                now, state = (k, b), KeyedIntervals()
                if carry == carry and carry is not None:
                    # what earlier blocks cover, as one interval that ends at the carry
                    state.update(now, (min(int(carry), s) - 1,), (int(carry),))
            state.update(now, (s,), (e,))
        if out:
            yield pd.DataFrame(out, columns=["key", "gap_start_ms", "gap_end_ms"])
            out = []
    if now is not None:
        close()
    yield pd.DataFrame(out, columns=["key", "gap_start_ms", "gap_end_ms"])


def blocked(df: DataFrame, key: str, start_ms: str, end_ms: str, block_ms: int = BLOCK_MS) -> DataFrame:
    """key, block, start_ms, end_ms of the rows that hold an interval: key and times are there, and the end comes after the start."""
    rows = df.select(
        F.col(key).cast("string").alias("key"), F.col(start_ms).cast("bigint").alias("start_ms"), F.col(end_ms).cast("bigint").alias("end_ms")
    ).filter("key IS NOT NULL AND start_ms IS NOT NULL AND end_ms > start_ms")
    return rows.select("key", F.floor(F.col("start_ms") / F.lit(block_ms)).cast("bigint").alias("block"), "start_ms", "end_ms")


def combined_intervals(df: DataFrame, key: str, start_ms: str, end_ms: str, block_ms: int = BLOCK_MS) -> DataFrame:
    """Intervals merged within each (entity, block of the start) of a map task, before anything is shuffled.

    Rows with a null key or time, or whose end is not after the start, are left out. Other columns are ignored, whatever
    their names. Returns key, block, start_ms, end_ms.
    """
    return blocked(df, key, start_ms, end_ms, block_ms).mapInPandas(_combine, "key string, block bigint, start_ms bigint, end_ms bigint")


def interval_gaps(df: DataFrame, key: str, start_ms: str, end_ms: str, block_ms: int = BLOCK_MS, combined: DataFrame | None = None) -> DataFrame:
    """Every longest stretch between an entity's first start and last end that no interval covers.

    Intervals are half-open in effect: touching ones leave no gap. Ties and repeated rows change nothing; an entity with
    one interval has no gap; an empty table gives an empty table. Returns key, gap_start_ms, gap_end_ms.
    """
    parts = combined if combined is not None else cut(combined_intervals(df, key, start_ms, end_ms, block_ms))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per entity and block: the window sorts summaries, not intervals
    carry = parts.groupBy("key", "block").agg(F.max("end_ms").alias("furthest")).select("key", "block", F.max("furthest").over(before).alias("carry"))
    return (
        parts.join(carry, ["key", "block"])
        .select("key", "block", "start_ms", "end_ms", "carry")
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", "start_ms")
        .mapInPandas(_block_gaps, "key string, gap_start_ms bigint, gap_end_ms bigint")
    )


def interval_periods(df: DataFrame, key: str, start_ms: str, end_ms: str, block_ms: int = BLOCK_MS) -> DataFrame:
    """Continuous covered periods and the gaps between them: key, kind (covered or gap), start_ms, end_ms.

    Covered periods are the complement of the gaps within the entity's first start and last end.
    """
    parts = cut(combined_intervals(df, key, start_ms, end_ms, block_ms))
    gaps = cut(interval_gaps(df, key, start_ms, end_ms, block_ms, parts))
    span = parts.groupBy("key").agg(F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))
    # a covered period begins at the first start or where a gap ends, and the one of the same number ends where the next gap begins
    numbered = cut(with_position(gaps, ["gap_start_ms"], "no", ["key"]))
    n_gaps = gaps.groupBy("key").agg(F.count("*").alias("no"))
    last = span.join(n_gaps, "key", "left").select("key", F.coalesce("no", F.lit(0)).cast("bigint").alias("no"), F.col("last_ms").alias("end_ms"))
    begins = span.select("key", F.lit(0).cast("bigint").alias("no"), F.col("first_ms").alias("start_ms")).unionByName(numbered.select("key", (F.col("no") + 1).cast("bigint").alias("no"), F.col("gap_end_ms").alias("start_ms")))
    ends = last.unionByName(numbered.select("key", F.col("no").cast("bigint").alias("no"), F.col("gap_start_ms").alias("end_ms")))
    covered = begins.join(ends, ["key", "no"]).select("key", F.lit("covered").alias("kind"), "start_ms", "end_ms")
    return covered.unionByName(gaps.select("key", F.lit("gap").alias("kind"), F.col("gap_start_ms").alias("start_ms"), F.col("gap_end_ms").alias("end_ms")))
