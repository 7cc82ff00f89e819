import random
import re

import pytest
from pyspark.sql import functions as F

from framequilt.llm.repetition import adaptive_thresholds, repeated_words, repetition, repetitive


def plain(text):
    w = re.findall(r"\w+", (text or "").lower())
    hit = set()
    seen = {}
    for i in range(len(w) - 5):
        g = tuple(w[i : i + 6])
        if g in seen:
            hit |= set(range(i, i + 6))
        seen.setdefault(g, i)
    return len(w), len(hit)


TEXTS = [None, "", " .. ", "one two", "a b c d e f", "a b c d e f a b c d e f", "A b, c d e f! a B c d e F g", "x " * 50, "x x x x x x", "x x x x x x x", "我们 现在 看到 肝脏 边缘 了 我们 现在 看到 肝脏 边缘 了", "word " * 100_000]


def test_equals_plain_version():
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices("ab", k=rng.randrange(40))) for _ in range(300)]
    n, r = repeated_words(texts)
    assert list(zip(n.tolist(), r.tolist(), strict=True)) == [plain(t) for t in texts]
    assert repeated_words([])[0].tolist() == [] and repeated_words([None])[1].tolist() == [0]


def test_windows_do_not_cross_texts():
    n, r = repeated_words(["a b c d e f", "a b c d e f", "a b c", "d e f a b c d e f"])
    assert r.tolist() == [0, 0, 0, 0]


def test_operator_and_thresholds(spark):
    rows = [(i, "en" if i % 2 else None, t, "shadow") for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "id int, lang string, body string, threshold string")
    m = repetition(df, "body", ["id", "lang"])
    got = {r["id"]: (r["n_words"], r["n_repeated"]) for r in m.collect()}
    assert got == {i: plain(t) for i, _, t, _ in rows}
    limits = {r["lang"]: r["threshold"] for r in adaptive_thresholds(m, ["lang"], quantile=0.5).collect()}
    assert set(limits) == {"en", None} and all(0.05 <= t <= 0.3 for t in limits.values())
    flagged = repetitive(m, ["lang"], quantile=0.5)
    assert {r["id"] for r in flagged.collect()} == {r["id"] for r in m.collect() if r["repeated_share"] >= limits[r["lang"]]}
    assert repetitive(repetition(df.limit(0), "body", ["id", "lang"]), ["lang"]).collect() == []


def test_sketch_quantile_is_near_the_exact_one(spark):
    df = spark.range(20_000).select((F.col("id") % 1000 / 1000.0).alias("repeated_share"), F.lit("a").alias("g"))
    t = adaptive_thresholds(df, ["g"], quantile=0.2, floor=0.0, ceiling=1.0).first()["threshold"]
    assert t == pytest.approx(0.2, abs=0.02)
