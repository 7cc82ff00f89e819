import random
from collections import Counter

import numpy as np
import pytest

from framequilt.llm.components import connected_components
from framequilt.llm.splits import anneal, assign_splits, cost, overfill, place_large, split_report

TARGETS = [("train", 0.8), ("val", 0.08), ("test", 0.12)]
SCHEMA = "who string, seg string, kind string, component int, n_rows int"


def union_find(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, s in rows:
        if k is not None:
            find(("k", k))
            if s is not None:
                up[find(("s", s))] = find(("k", k))
    groups = {}
    for t, x in list(up):
        if t == "k":
            groups.setdefault(find((t, x)), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    rows = [(f"v{i:03}", f"s{i}") for i in range(60)] + [(f"v{i:03}", f"s{i + 1}") for i in range(60)]  # a long chain
    rows += [(f"w{rng.randrange(200)}", rng.choice([None, f"t{rng.randrange(150)}"])) for _ in range(300)] + [(None, "s1"), ("lone", None), ("Lone", None)]
    rows += [(f"h{i}", "hub") for i in range(100)] * 2
    df = spark.createDataFrame([(k, s, "", 1, 1) for k, s in rows], SCHEMA)
    got = [tuple(r) for r in connected_components(df, "who", "seg").collect()]
    assert len(got) == len(dict(got)) and dict(got) == union_find(rows)
    assert connected_components(df.limit(0), "who", "seg").collect() == []


def test_annealing_lowers_the_cost():
    rng = np.random.default_rng(1)
    w = np.column_stack([n := rng.integers(1, 30, 200), n]).astype(float)
    want = np.array([[0.8], [0.08], [0.12]]) * w.sum(axis=0)
    start = rng.integers(0, 3, 200)
    at, best = anneal(w, start, want, 1, 4000)
    totals = np.zeros_like(want)
    np.add.at(totals, at, w)
    assert best == pytest.approx(cost(totals, want)) and best < 0.02
    assert anneal(w[:0], start[:0], want, 1, 100)[0].size == 0


def test_large_components_go_where_there_is_room():
    want = np.array([[80.0], [8.0], [12.0]])
    assert place_large(np.array([[33.0], [10.0]]), want).tolist() == [0, 0]


def test_splits_keep_components_together(spark):
    rng = random.Random(9)
    rows = [("hot", "x0", "a", 0, 0)] * 1500
    rows += [(f"v{rng.randrange(600)}", rng.choice([None] * 9 + [f"seg{rng.randrange(3000)}"]), rng.choice(["a", "a", "b", None]), 0, 0) for _ in range(3000)] + [(None, "x", "a", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assigned = assign_splits(df, "who", "seg", "kind", TARGETS)
    got = assigned.collect()
    assert len(got) == len({r["entity"] for r in got}) == len({k for k, *_ in rows if k})
    assert all(len(x) == 1 for x in _by(got, "component", "split").values())
    size = Counter(k for k, *_ in rows if k)
    share = Counter()
    for r in got:
        share[r["split"]] += size[r["entity"]] / 4500
    assert share["train"] == pytest.approx(0.8, abs=0.03)
    again = {r["entity"]: r["split"] for r in assign_splits(df.repartition(5), "who", "seg", "kind", TARGETS).collect()}
    assert again == {r["entity"]: r["split"] for r in got}
    report = split_report(assigned, df, "who", "kind", TARGETS).filter("label IS NULL").collect()
    assert sum(r["n_rows"] for r in report) == 4500 and sum(r["share"] for r in report) == pytest.approx(1)
    assert assign_splits(df.limit(0), "who", "seg", "kind", TARGETS).collect() == []


def test_shards_meet_the_shares_together(spark, monkeypatch):
    monkeypatch.setattr("framequilt.llm.splits.SHARD_COMPONENTS", 100)
    rows = [(f"v{i}", None, "b" if i % 7 == 0 else "a", 0, 0) for i in range(900) for _ in range(1 + i % 5)] + [("giant", None, "a", 0, 0)] * 1300
    df = spark.createDataFrame(rows, SCHEMA)
    assigned = assign_splits(df, "who", "seg", "kind", TARGETS)
    report = {(r["split"], r["label"]): r["share"] for r in split_report(assigned, df, "who", "kind", TARGETS).collect()}
    for name, share in TARGETS:
        assert report[name, None] == pytest.approx(share, abs=0.02)


def _by(rows, key, value):
    out = {}
    for r in rows:
        out.setdefault(r[key], set()).add(r[value])
    return out


def test_hubs_go_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr("framequilt.llm.components.HUB_LINKS", 10)
    rng = random.Random(3)
    rows = [(f"h{i}", "hub") for i in range(200)] + [(f"h{rng.randrange(400)}", f"t{rng.randrange(150)}") for _ in range(200)]
    df = spark.createDataFrame([(k, s, "", 1, 1) for k, s in rows], SCHEMA)
    assert dict(tuple(r) for r in connected_components(df, "who", "seg").collect()) == union_find(rows)


def test_large_components_are_annealed_too():
    """Placed one by one, the largest first, these don't fit; exchanged, they do."""
    w = np.array([[30.0], [30.0], [20.0], [20.0], [20.0]])
    want = np.array([[60.0], [60.0]])
    at, best = anneal(w, place_large(w, want), want, 1, 2000, overfill)
    totals = np.zeros_like(want)
    np.add.at(totals, at, w)
    assert best == 0 and totals.tolist() == want.tolist()
    assert overfill(np.array([[50.0], [0.0]]), want) == 0 and overfill(np.array([[70.0], [0.0]]), want) > 0


def test_rare_labels_are_balanced(spark):
    rows = [(f"v{i}", None, "rare" if i % 40 == 0 else "a", 0, 0) for i in range(2000) for _ in range(1 + i % 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    report = {(r["split"], r["label"]): r["share"] for r in split_report(assign_splits(df, "who", "seg", "kind", TARGETS), df, "who", "kind", TARGETS).collect()}
    for name, share in TARGETS:
        assert report[name, "rare"] == pytest.approx(share, abs=0.03) and report[name, None] == pytest.approx(share, abs=0.01)
