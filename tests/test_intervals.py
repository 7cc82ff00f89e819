import random

from framequilt.operators.intervals import IntervalMap, interval_gaps, interval_periods
from framequilt.streaming.incremental import gaps_of_states, interval_state

SCHEMA = "who string, a bigint, b bigint, gap_start_ms string, `start ms` int"


def brute(rows):
    """Gaps by a plain sweep."""
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, v in by.items():
        reach = None
        for s, e in sorted(v):
            if reach is not None and s > reach:
                out.add((k, reach, s))
            reach = e if reach is None else max(reach, e)
    return out


def test_map_merges_touching_nested_and_spanning():
    m = IntervalMap()
    for s, e in [(10, 20), (30, 40), (20, 25), (12, 13), (50, 60), (24, 31)]:
        m.insert(s, e)
    assert (m.starts, m.ends) == ([10, 50], [40, 60])
    assert m.gaps() == [(40, 50)]


def test_gaps_equal_brute_force_over_blocks(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        k = rng.choice(["hot"] * 5 + ["a", "b", None])
        s = rng.choice([None, rng.randrange(-5000, 200_000)])
        e = None if rng.random() < 0.05 else (s or 0) + rng.choice([0, -5, 1, 30, 400, 2500 if rng.random() < 0.1 else 7])
        rows += [(k, s, e)] * rng.choice([1, 1, 2])
    df = spark.createDataFrame([(k, s, e, "x", 1) for k, s, e in rows], SCHEMA)
    want = brute(rows)
    for block in (100, 1000, 10**9):
        got = [tuple(r) for r in interval_gaps(df, "who", "a", "b", block_ms=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_interval_that_spans_many_blocks_hides_later_gaps(spark):
    df = spark.createDataFrame([("v", 0, 10, "", 0), ("v", 20, 100_000, "", 0), ("v", 500, 600, "", 0), ("v", 100_500, 100_600, "", 0)], SCHEMA)
    assert {tuple(r) for r in interval_gaps(df, "who", "a", "b", block_ms=50).collect()} == {("v", 10, 20), ("v", 100_000, 100_500)}


def test_periods_and_empty_table(spark):
    df = spark.createDataFrame([("v", 0, 10, "", 0), ("v", 10, 30, "", 0), ("v", 40, 50, "", 0), ("w", 5, 6, "", 0), ("x", 5, 5, "", 0)], SCHEMA)
    got = {tuple(r) for r in interval_periods(df, "who", "a", "b", block_ms=20).collect()}
    assert got == {("v", "covered", 0, 30), ("v", "gap", 30, 40), ("v", "covered", 40, 50), ("w", "covered", 5, 6)}
    assert interval_periods(df.limit(0), "who", "a", "b").collect() == []


def test_stream_keeps_the_same_states(spark, tmp_path):
    """One entity over several blocks, in three micro-batches; an interval that covers a gap comes last."""
    rng = random.Random(12)
    rows = [(rng.choice(["hot", "hot", "a", None]), s := rng.randrange(0, 5_000_000), s + rng.randrange(-5, 9000)) for _ in range(600)]
    schema = "who string, a bigint, b bigint"
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "states")
    query = interval_state(stream, "who", "a", "b").writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.parquet(out)
    assert states.select("batch").distinct().count() == 3 and states.filter("key = 'hot'").select("block").distinct().count() > 5
    want = {tuple(r) for r in interval_gaps(spark.createDataFrame(rows, schema), "who", "a", "b").collect()}
    assert {tuple(r) for r in gaps_of_states(states).collect()} == want and want
