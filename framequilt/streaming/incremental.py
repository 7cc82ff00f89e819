"""Incremental runs, and the interval map as a stateful stream operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framequilt.operators.intervals import BLOCK_MS, KeyedIntervals, combined_intervals, interval_gaps
from framequilt.session import cut


def run_available(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Works on all files that a streaming source has not shown before and ends. Each micro-batch is written under its own number, so a repeated one replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def interval_state(stream: DataFrame, key: str, start_ms: str, end_ms: str, block_ms: int = BLOCK_MS) -> DataFrame:
    """Intervals per (entity, block of the start) in keyed state: after each micro-batch, the state of each block that it touched.

    Returns key, block, version (grows with each update; the latest row of a block holds), intervals (array of struct
    start_ms, end_ms), gaps between these, first_ms, last_ms. Rows with a null, and those whose end is not after the
    start, are left out. Tasks merge what they read before it is sent to the state, so an entity, or a block, that holds a
    third of all rows sends its merged intervals only. ``gaps_of_states`` puts an entity's blocks together.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, version = KeyedIntervals(), 0
        if state.exists:
            starts, ends, version = state.get
            held.update(k, starts, ends)
        for pdf in batches:
            held.update(k, pdf["start_ms"].tolist(), pdf["end_ms"].tolist())
        m = held.maps[k]
        state.update((m.starts, m.ends, version + 1))
        spans = lambda pairs: [{"start_ms": a, "end_ms": b} for a, b in pairs]
        yield pd.DataFrame({"key": [k[0]], "block": [k[1]], "version": [version + 1], "intervals": [spans(zip(m.starts, m.ends, strict=True))], "gaps": [spans(m.gaps())], "first_ms": [m.starts[0]], "last_ms": [m.ends[-1]]})

    span = "array<struct<start_ms bigint, end_ms bigint>>"
    return combined_intervals(stream, key, start_ms, end_ms, block_ms).groupBy("key", "block").applyInPandasWithState(
        update, f"key string, block bigint, version bigint, intervals {span}, gaps {span}, first_ms bigint, last_ms bigint", "starts array<bigint>, ends array<bigint>, version bigint", "update", GroupStateTimeout.NoTimeout
    )


def gaps_of_states(states: DataFrame) -> DataFrame:
    """Gaps of each entity from the rows that ``interval_state`` has written so far: key, gap_start_ms, gap_end_ms. The batch operator's own way, from the states that are held instead of new ones."""
    latest = states.groupBy("key", "block").agg(F.max_by("intervals", "version").alias("i"))
    parts = cut(latest.select("key", "block", F.inline("i")))
    return interval_gaps(parts, "key", "start_ms", "end_ms", combined=parts)
