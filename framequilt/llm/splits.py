"""Splits that keep related records together: component swap search.

Large components come first: there are at most 1 / LARGE_SHARE of them, so they fit on the driver whatever the input.
They are placed one by one where they overfill least, and moved and exchanged in an annealing of their own. All others
start from hashed assignment and are improved by simulated annealing in parallel: random shards of components, each with its own part of what the large ones
leave, run several seeded chains of moves and exchanges and keep the best state. What falls short in one shard doesn't
depend on another, so the deviations add up to at most a few components per shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequilt.llm.components import connected_components
from framequilt.session import cut

#: A component with at least this share of all rows is placed before the search: at most 200 of them exist.
LARGE_SHARE = 0.005
#: Components of a shard: what one chain holds in memory.
SHARD_COMPONENTS = 2_000
#: Labels that are balanced each for itself, the most frequent ones; all others are balanced as one.
LABELS = 40
CHAINS = 3
STEPS_PER_COMPONENT = 12


def cost(totals: np.ndarray, want: np.ndarray) -> float:
    """Deviation of sizes (column 0) and of labels (the others) from what is wanted. Sizes are relative to all rows, labels to the geometric mean of all rows and theirs: rare labels count for more than their rows."""
    return deviation(totals - want, want)


def deviation(d: np.ndarray, want: np.ndarray) -> float:
    of = want.sum(axis=0)
    all_rows = max(1.0, float(of[0]))
    scale = np.sqrt(all_rows * np.maximum(1.0, of))
    part = np.abs(d).sum(axis=0) / scale
    return float(4.0 * part[0] + part[1:].sum())


def overfill(totals: np.ndarray, want: np.ndarray) -> float:
    """As ``cost``, but room that others will fill doesn't count."""
    return deviation(2.0 * np.maximum(totals - want, 0.0), want)


def anneal(weights: np.ndarray, start: np.ndarray, want: np.ndarray, seed: int, steps: int, cost: Callable[[np.ndarray, np.ndarray], float] = cost) -> tuple[np.ndarray, float]:
    """Moves a component to another split or exchanges two components of different splits; returns the best state seen.

    weights: components x (1 + labels); start: split of each; want: splits x (1 + labels); cost: of the totals beside what is wanted.
    """
    rng = np.random.default_rng(seed)
    n, k = len(start), len(want)
    at = start.copy()
    totals = np.zeros_like(want, dtype=float)
    np.add.at(totals, at, weights)
    now = cost(totals, want)
    best, best_cost = at.copy(), now
    if n == 0 or k < 2:
        return best, best_cost
    picks = rng.integers(0, n, (steps, 2))
    kinds = rng.random(steps)
    shifts = rng.integers(1, k, steps)
    luck = rng.random(steps)
    hot = max(now / 4, 1e-6)
    for i in range(steps):
        a, b = picks[i]
        old, to = at[a], (at[a] + shifts[i]) % k
        if kinds[i] < 0.5:
            delta = weights[a]
            swap = False
        else:
            to = at[b]
            if to == old:
                continue
            delta = weights[a] - weights[b]
            swap = True
        trial = totals.copy()
        trial[old] -= delta
        trial[to] += delta
        new = cost(trial, want)
        heat = hot * (1 - i / steps) ** 2 + 1e-12
        if new <= now or luck[i] < np.exp((now - new) / heat):
            at[a] = to
            if swap:
                at[b] = old
            totals, now = trial, new
            if now < best_cost:
                best, best_cost = at.copy(), now
    return best, best_cost


def place_large(weights: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Large components, largest first, each where the cost of what is placed so far is least."""
    left = want.astype(float).copy()
    out = np.zeros(len(weights), dtype=int)
    for i in np.argsort(-weights[:, 0], kind="stable"):
        # overshoot counts, room that others will fill doesn't
        over = [np.maximum(weights[i] - left[s], 0).sum() - 1e-9 * left[s, 0] for s in range(len(want))]
        out[i] = int(np.argmin(over))
        left[out[i]] -= weights[i]
    return out


def assign_splits(rows: DataFrame, entity: str, value: str, label: str, targets: list[tuple[str, float]], seed: int = 0) -> DataFrame:
    """Entities with their component and split: entity, component, n_rows, split.

    ``rows`` has one row per record; ``label`` may be null (then it counts as the label ''), as may ``value``; records
    with a null entity get no split, as nothing says what they belong to. ``targets`` are (split, share); shares are divided by their sum. Ties
    are resolved by the seeded hash of the component. An empty table gives an empty table.
    """
    names = [s for s, _ in targets]
    shares = np.array([max(0.0, w) for _, w in targets], dtype=float)
    shares = shares / shares.sum()
    base = rows.select(F.col(entity).cast("string").alias("entity"), F.col(value).cast("string").alias("value"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label")).filter("entity IS NOT NULL")
    member = cut(connected_components(base, "entity", "value"))
    counts = base.groupBy("entity", "label").agg(F.count("*").alias("n"))
    per = cut(counts.join(member, "entity").groupBy("component", "label").agg(F.sum("n").alias("n")))
    top = [r["label"] for r in per.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()]
    label_at = {x: i + 1 for i, x in enumerate(top)}
    width = len(top) + 2
    code = F.coalesce(F.create_map(*[F.lit(y) for kv in label_at.items() for y in kv])[F.col("label")], F.lit(width - 1)) if top else F.lit(1)
    # summed by code first: a component's list is as long as there are codes
    coded = per.groupBy("component", code.alias("c")).agg(F.sum("n").alias("n"))
    comp = coded.groupBy("component").agg(F.sum("n").alias("n_rows"), F.collect_list(F.struct("c", "n")).alias("labels"))
    comp = cut(comp.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(1_000_000)) / 1_000_000.0))
    totals = np.zeros(width)
    for r in per.select(code.alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n")).collect():
        totals[r["c"]] = r["n"]
    totals[0] = totals[1:].sum()
    want = shares[:, None] * totals[None, :]

    def vector(labels: list, n_rows: float) -> np.ndarray:
        v = np.zeros(width)
        v[0] = n_rows
        for x in labels:
            v[x["c"]] += x["n"]
        return v

    bound = max(1.0, LARGE_SHARE * totals[0])
    large = comp.filter(F.col("n_rows") >= bound).select("component", "labels", "n_rows").orderBy("component").collect()
    big_w = np.array([vector(r["labels"], r["n_rows"]) for r in large]).reshape(-1, width)
    placed_at = place_large(big_w, want)
    tries = [anneal(big_w, placed_at, want, seed * 1000 + c, STEPS_PER_COMPONENT * len(large) + 2000, overfill) for c in range(CHAINS)]
    big_at = min(tries, key=lambda t: t[1])[0]
    left = want.copy()
    np.subtract.at(left, big_at, big_w)
    left = np.maximum(left, 0)
    small_total = max(1.0, totals[0] - big_w[:, 0].sum())
    # a split that a large component overfills gets nothing more; the others share the rest in proportion
    left_shares = left[:, 0] / max(1e-9, left[:, 0].sum())
    rest = comp.filter(F.col("n_rows") < bound)
    n_shards = max(1, -(-rest.count() // SHARD_COMPONENTS))
    label_left = left / np.maximum(left.sum(axis=0, keepdims=True), 1e-9)
    edges = np.cumsum(left_shares)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by shard: one shard is held at a time
        held: list[pd.DataFrame] = []

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("component", kind="stable").reset_index(drop=True)
            w = np.array([vector(x, n) for x, n in zip(pdf["labels"], pdf["n_rows"], strict=True)]).reshape(-1, width)
            goal = label_left * w.sum(axis=0)[None, :]
            goal[:, 0] = left_shares * w[:, 0].sum()
            start = np.minimum(np.searchsorted(edges, pdf["start"].to_numpy(), side="right"), len(edges) - 1)
            tries = [anneal(w, start, goal, seed * 1000 + int(pdf["shard"].iloc[0]) * 10 + c, STEPS_PER_COMPONENT * len(w) + 2000) for c in range(CHAINS)]
            at = min(tries, key=lambda t: t[1])[0]
            return pd.DataFrame({"component": pdf["component"], "n_rows": pdf["n_rows"], "split": [names[i] for i in at]})

        for batch in batches:
            for _, part in batch.groupby("shard", sort=True):
                if held and held[-1]["shard"].iloc[0] != part["shard"].iloc[0]:
                    yield solve(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield solve(pd.concat(held))

    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "component"), F.lit(n_shards)).cast("int")
    found = rest.select("component", "n_rows", "labels", "start", shard.alias("shard")).repartition("shard").sortWithinPartitions("shard").mapInPandas(search, "component string, n_rows bigint, split string")
    # the entities of large components, a third of all or more, find theirs by a broadcast of 1 / LARGE_SHARE rows at most
    placed = F.broadcast(rows.sparkSession.createDataFrame([(r["component"], int(r["n_rows"]), names[i]) for r, i in zip(large, big_at, strict=True)], "component string, n_rows bigint, split string"))
    out = member.join(placed, "component").unionByName(member.join(placed.select("component"), "component", "left_anti").join(found, "component"), allowMissingColumns=True)
    return out.select("entity", "component", "n_rows", "split")


def split_report(assigned: DataFrame, rows: DataFrame, entity: str, label: str, targets: list[tuple[str, float]]) -> DataFrame:
    """Rows and share of each split and label beside the share asked for: split, label (null: all rows), n_rows, share, target."""
    base = rows.select(F.col(entity).cast("string").alias("entity"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label")).groupBy("entity", "label").agg(F.count("*").alias("n"))
    per = base.join(assigned.select("entity", "split"), "entity").groupBy("split", "label").agg(F.sum("n").alias("n"))
    total = sum(w for _, w in targets)
    aims = rows.sparkSession.createDataFrame([(s, w / total) for s, w in targets], "split string, target double")
    every = per.unionByName(per.groupBy("split").agg(F.sum("n").alias("n")).select("split", F.lit(None).cast("string").alias("label"), "n"))
    of = every.groupBy(F.col("label").alias("of_label")).agg(F.sum("n").alias("all_n"))
    return (
        every.join(of, F.col("label").eqNullSafe(F.col("of_label")))
        .select("split", "label", F.col("n").alias("n_rows"), F.try_divide("n", "all_n").alias("share"))
        .join(aims, "split")
        .select("split", "label", "n_rows", "share", "target")
    )
