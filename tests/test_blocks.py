import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framequilt.functions.values import seeded
from framequilt.operators import selection
from framequilt.operators.blocks import smallest, sums_before, with_neighbours, with_position


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds most rows and reaches over several blocks; there is a null group too."""
    rng = np.random.default_rng(3)
    data = [("hot" if i % 3 else f"g{i % 7}" if i % 5 else None, int(n), int(v)) for i, (n, v) in enumerate(zip(rng.permutation(400), rng.integers(0, 9, 400), strict=True))]
    return spark.createDataFrame(data, "g string, n int, v int").repartition(5)


def _plain(rows):
    return rows.toPandas().sort_values("n").reset_index(drop=True)


def test_sums_and_positions_equal_plain_ones(rows):
    got = {r["n"]: (r["before"], r["place"]) for r in with_position(sums_before(rows, ["g"], ["n"], {"before": "v"}), ["n"], "place", ["g"]).collect()}
    pdf = _plain(rows)
    g = pdf["g"].fillna("-")
    before = pdf["v"].groupby(g).cumsum() - pdf["v"]
    place = pdf.groupby(g).cumcount()
    assert got == {int(n): (int(b), int(p)) for n, b, p in zip(pdf["n"], before, place, strict=True)}
    everywhere = {r["n"]: r["place"] for r in with_position(rows, ["n"], "place").collect()}
    assert everywhere == {i: i for i in range(400)}
    assert sums_before(rows.limit(0), ["g"], ["n"], {"before": "v"}).collect() == []


@pytest.mark.parametrize("radius", [1, 3])
def test_neighbours_across_blocks(rows, radius):
    got = {r["n"]: (r["b"], r["a"]) for r in with_neighbours(rows, ["g"], ["n"], "v", radius, "b", "a").collect()}
    pdf = _plain(rows)
    want = {}
    for _, part in pdf.groupby(pdf["g"].fillna("-")):
        n, v = part["n"].tolist(), part["v"].tolist()
        for i in range(len(n)):
            want[n[i]] = (v[max(0, i - radius) : i], v[i + 1 : i + 1 + radius])
    assert got == want


def test_neighbours_of_groups_smaller_than_the_radius(spark):
    df = spark.createDataFrame([("a", i, str(i)) for i in range(9)], "g string, n int, t string")
    got = {r["n"]: r["b"] for r in with_neighbours(df, ["g"], ["n"], "t", 5, "b", "a").collect()}
    assert got[8] == list("34567") and got[0] == [] and got[2] == list("01")


def test_smallest_is_exact(spark):
    df = spark.range(1000).withColumn("h", seeded(1, F.col("id")))
    every = [r["id"] for r in df.orderBy("h", "id").collect()]
    for n, most in ((0, 10), (1, 1), (333, 1), (333, 10**6), (999, 5), (1000, 5), (2000, 5)):
        assert sorted(r["id"] for r in smallest(df, "h", "id", n, 1, most).collect()) == sorted(every[:n])
    ties = spark.createDataFrame([(i, "ab" * 20) for i in range(10)], "id int, h string")
    assert sorted(r["id"] for r in smallest(ties, "h", "id", 4, 4, 1).collect()) == [0, 1, 2, 3]


def test_first_rows_and_ranks_count_rows(spark, monkeypatch):
    df = spark.createDataFrame(pd.DataFrame({"line_no": [0, 3, 4, 9, 17, 2**40, 2**41]}))
    assert [r[0] for r in selection.first_rows(df, "line_no", 3).orderBy("line_no").collect()] == [0, 3, 4]
    assert selection.first_rows(df, "line_no", 0).count() == 7 and selection.first_rows(df, "line_no", 99).count() == 7
    shards = [sorted(r[0] for r in selection.rank_shard(df, "line_no", k, 3).collect()) for k in range(3)]
    assert shards == [[0, 9, 2**41], [3, 17], [4, 2**40]]
    monkeypatch.setattr(selection, "TOP_ROWS", 1)
    assert [r[0] for r in selection.first_rows(df, "line_no", 3).orderBy("line_no").collect()] == [0, 3, 4]
