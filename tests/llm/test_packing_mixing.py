import random

import pytest

from framequilt.llm.mixing import mix
from framequilt.llm.packing import first_fit_decreasing, pack, pack_report


def plain_ffd(sizes, cap):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, free in enumerate(bins):
            if free >= sizes[i]:
                break
        else:
            b = len(bins)
            bins.append(cap)
        bins[b] -= sizes[i]
        out[i] = b
    return out


def test_tree_equals_plain_first_fit():
    rng = random.Random(6)
    for _ in range(100):
        cap = rng.randrange(1, 60)
        sizes = [rng.randrange(0, cap + 1) for _ in range(rng.randrange(0, 120))]
        assert first_fit_decreasing(sizes, cap) == plain_ffd(sizes, cap)


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, None, 5, 4096, 4097, 20_000, rng.randrange(1, 4000)]), 1, "b") for i in range(500)] + [(7, 10, 1, "b")]
    df = spark.createDataFrame(rows, "doc bigint, n bigint, grp int, bin string")
    packed = pack(df, "doc", "n", [("s", 4096), ("l", 8192)], group_items=60)
    out = packed.collect()
    for stage, cap in (("s", 4096), ("l", 8192)):
        fill, total = {}, {}
        for r in out:
            if r["stage"] == stage:
                fill[r["group"], r["bin"]] = fill.get((r["group"], r["bin"]), 0) + r["tokens"]
                total[r["doc"]] = total.get(r["doc"], 0) + r["tokens"]
        assert max(fill.values()) <= cap
        want = {}
        for i, n, *_ in rows:
            want[i] = want.get(i, 0) + (n or 0)
        assert total == want
        assert {r["doc"] for r in out if r["stage"] == stage and r["n_pieces"] > 1} == {i for i, n, *_ in rows if (n or 0) > cap}
    report = {r["stage"]: r["fill"] for r in pack_report(packed, [("s", 4096), ("l", 8192)]).collect()}
    assert min(report.values()) > 0.85
    assert pack(df.limit(0), "doc", "n", [("s", 10)]).collect() == []
    with pytest.raises(ValueError):
        pack(df, "doc", "n", [("s", 0)])


TARGETS = [{"source": s, "weight": w, "max_repeats": m} for s, w, m in (("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.15, 2), ("absent", 0.05, 4))]


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big"] * 14 + ["small"] * 4 + ["other", None]), rng.randrange(0, 400), 3) for i in range(6000)] + [(9000 + i, "tiny", 50, 3) for i in range(10)]
    df = spark.createDataFrame(rows, "doc bigint, src string, n bigint, copies int")
    chosen, report = mix(df, "doc", "src", "n", TARGETS, block_tokens=500)
    got = chosen.collect()
    by = {r["source"]: r for r in report}
    assert len(got) == len({r["doc"] for r in got})
    assert all(1 <= r["copies"] <= {"big": 1, "small": 3, "tiny": 2}[r["src"]] for r in got)
    total = sum(n for _, _, n, _ in rows)
    assert sum(r["tokens"] for r in report) == pytest.approx(total, rel=0.02)
    assert by["tiny"]["short"] and by["absent"]["short"] and not by["big"]["short"]
    assert by["tiny"]["tokens"] <= 1000 and by["absent"]["tokens"] == 0
    assert sum(r["actual_share"] for r in report) == pytest.approx(1)
    assert by["big"]["actual_share"] / by["small"]["actual_share"] == pytest.approx(0.5 / 0.3, rel=0.1)
    again, _ = mix(df.repartition(9), "doc", "src", "n", TARGETS, block_tokens=500)
    assert {(r["doc"], r["copies"]) for r in again.collect()} == {(r["doc"], r["copies"]) for r in got}
    none, empty = mix(df.limit(0), "doc", "src", "n", TARGETS)
    assert none.count() == 0 and [r["short"] for r in empty] == [False] * 4


def test_mix_uses_partial_blocks(spark):
    """A source smaller than a block takes part, and what its block lacks goes to the others."""
    rows = [(i, "big", 100) for i in range(100)] + [(500, "tiny", 30), (501, "tiny", 20)]
    df = spark.createDataFrame(rows, "doc bigint, src string, n bigint")
    targets = [{"source": "big", "weight": 0.5, "max_repeats": 3}, {"source": "tiny", "weight": 0.5, "max_repeats": 2}]
    chosen, report = mix(df, "doc", "src", "n", targets, block_tokens=500)
    by = {r["source"]: r for r in report}
    assert by["tiny"]["tokens"] == 100 and abs(by["big"]["tokens"] + 100 - 10_050) <= 250
    assert {r["doc"]: r["copies"] for r in chosen.collect() if r["src"] == "tiny"} == {500: 2, 501: 2}
