import random

import pytest
from pyspark.sql import functions as F

from framequilt.llm.apportion import largest_remainder, sainte_lague
from framequilt.llm.sampling import cell_quotas, sample_to_targets, with_quotas


def plain_sainte_lague(w, seats, caps):
    out = [0] * len(w)
    for _ in range(seats):
        open_ = [i for i in range(len(w)) if w[i] > 0 and out[i] < caps[i]]
        if not open_:
            break
        i = max(open_, key=lambda i: (w[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_sainte_lague_equals_plain_version():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 7)
        w = [rng.choice([0.0, 0.1, 0.25, 0.5, rng.random()]) for _ in range(n)]
        caps = [rng.choice([0, 1, 5, 1000]) for _ in range(n)]
        seats = rng.randrange(0, 60)
        assert sum(sainte_lague(w, seats, caps)) == sum(plain_sainte_lague(w, seats, caps)), (w, seats, caps)
        assert sainte_lague(w, seats, caps) == plain_sainte_lague(w, seats, caps), (w, seats, caps)
    assert sum(sainte_lague([0.5, 0.3, 0.2], 10**12, [10**13] * 3)) == 10**12 and sainte_lague([], 5, []) == []


def test_largest_remainder():
    assert largest_remainder([0.5, 0.3, 0.2], 10, [0, 0, 0], [100] * 3) == [5, 3, 2]
    assert largest_remainder([1, 1, 1], 10, [0] * 3, [100] * 3) == [4, 3, 3]
    assert largest_remainder([0.9, 0.1], 10, [0, 3], [100, 100]) == [7, 3]
    assert largest_remainder([0.9, 0.1], 10, [0, 0], [4, 100]) == [4, 6]
    assert largest_remainder([0.5, 0.5], 10, [0, 0], [2, 3]) == [2, 3]
    assert largest_remainder([0.5, 0.5], 0, [1, 1], [0, 0]) == [0, 0] and largest_remainder([], 3, [], []) == []
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 8)
        share = [rng.random() for _ in range(n)]
        caps = [rng.randrange(0, 50) for _ in range(n)]
        floors = [rng.randrange(0, 5) for _ in range(n)]
        total = rng.randrange(0, 100)
        q = largest_remainder(share, total, floors, caps)
        low = [min(f, c) for f, c in zip(floors, caps, strict=True)]
        assert all(lo <= x <= c for lo, x, c in zip(low, q, caps, strict=True))
        assert sum(q) == min(max(total, sum(low)), sum(caps))


SCHEMA = "row_id bigint, topic array<string>, kind array<string>, cell string, key string"


def test_sample(spark):
    rng = random.Random(8)
    rows = [(i, rng.sample(["a", "b", "c"], rng.randrange(0, 3)) if i % 50 else None, [rng.choice("xxxxy")], "q", "q") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = [("topic", "a", 0.5, 5), ("topic", "b", 0.3, 5), ("topic", "zz", 0.2, 1), ("kind", "x", 0.5, 0), ("kind", "y", 0.5, 10)]
    targets = [dict(zip(("field", "category", "share", "min_rows"), t, strict=True)) for t in targets]
    sample, report = sample_to_targets(df, "row_id", ["topic", "kind"], targets, 1000)
    got = sample.collect()
    assert len(got) == len({r["row_id"] for r in got}) == 1000
    by = {(t["field"], t["category"]): t for t in report}
    assert by["topic", "zz"]["short"] and by["topic", "zz"]["available"] == 0 and not by["topic", "a"]["short"]
    assert by["kind", "y"]["available"] == sum(r[2] == ["y"] for r in rows)
    drawn_y = sum(r["kind"] == ["y"] for r in got)
    assert drawn_y == pytest.approx(by["kind", "y"]["quota"], abs=30)
    again, _ = sample_to_targets(df.repartition(6), "row_id", ["topic", "kind"], targets, 1000)
    assert {r["row_id"] for r in again.collect()} == {r["row_id"] for r in got}
    empty, short = sample_to_targets(df.limit(0), "row_id", ["topic", "kind"], targets, 0)
    assert empty.count() == 0 and [t["short"] for t in short] == [True, True, True, False, True]


def test_every_row_when_all_are_wanted(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), F.array(F.lit("a")).alias("topic"))
    sample, _ = sample_to_targets(df, "row_id", ["topic"], [{"field": "topic", "category": "a", "share": 1.0, "min_rows": 1}], 50)
    assert sample.count() == 50


def test_rows_count_for_all_their_categories(spark):
    """Three categories, most rows with two of them; shares of what is drawn, floors, and what is said to be missed."""
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        held = rng.sample(["a", "b", "c"], rng.choice([1, 2, 2])) + (["rare"] if i % 500 == 0 else [])
        rows.append((i, held, [rng.choice("xxxxxxy")], "q", "q"))
    df = spark.createDataFrame(rows, SCHEMA)
    targets = [("topic", "a", 0.55, 5), ("topic", "b", 0.25, 5), ("topic", "c", 0.1999, 5), ("topic", "rare", 0.0001, 11), ("kind", "x", 0.6, 0), ("kind", "y", 0.4, 0)]
    targets = [dict(zip(("field", "category", "share", "min_rows"), t, strict=True)) for t in targets]
    sample, report = sample_to_targets(df, "row_id", ["topic", "kind"], targets, 1500)
    got = sample.collect()
    by = {(t["field"], t["category"]): t for t in report}
    assert len(got) == 1500
    for (field, category), t in by.items():
        assert t["drawn"] == sum(category in r[field] for r in got)
        if category != "rare":
            assert t["category_share"] == pytest.approx(t["share"], abs=0.012)
    assert by["topic", "rare"]["drawn"] >= 11 and not by["topic", "rare"]["missed"] and not by["kind", "y"]["missed"]
    # half of the rows are wanted with y, but there are too few
    _, report = sample_to_targets(df, "row_id", ["kind"], [dict(field="kind", category="y", share=0.5, min_rows=0), dict(field="kind", category="x", share=0.5, min_rows=0)], 3000)
    y = next(t for t in report if t["category"] == "y")
    assert y["short"] and y["missed"] and y["drawn"] >= 0.97 * y["available"]


def test_cell_quotas_keep_their_bounds():
    rng = random.Random(2)
    for _ in range(60):
        cells = [(sorted(rng.sample("abcd", rng.randrange(0, 4))), [rng.choice("xy")]) for _ in range(rng.randrange(1, 30))]
        counts = [rng.randrange(1, 40) for _ in cells]
        have = {("f", c): sum(n for (f, _), n in zip(cells, counts, strict=True) if c in f) for c in "abcd"} | {("g", c): sum(n for (_, g), n in zip(cells, counts, strict=True) if c in g) for c in "xy"}
        report = [{"field": f, "category": c, "share": 0.25, "min_rows": rng.randrange(0, 6), "available": n} for (f, c), n in have.items()]
        n = rng.randrange(0, sum(counts) + 5)
        report = with_quotas(report, ["f", "g"], {"f": n, "g": n})
        out = cell_quotas(cells, counts, ["f", "g"], report, n)
        assert all(0 <= q <= c for q, c in zip(out, counts, strict=True)) and sum(out) == min(n, sum(counts))
