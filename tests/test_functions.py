import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framequilt.functions import values as V
from framequilt.functions.json_text import judge_reply, judge_score, lenient, lenient_json, strict_object, strip_code_fence
from framequilt.functions.scores import exact_match, lcs_length, rouge_l, token_f1
from framequilt.functions.text import clean_text, file_stem, first_turn, normalize_text, strip_ws, video_key

CASES = [("The clip.", "the clip", 1, 1, 1), ("a b c d", "b d c x", 0, 0.75, 0.5), ("a a b", "a b b", 0, 2 / 3, 2 / 3), ("?!", "...", 1, 1, 1), ("", "clip", 0, 0, 0), ("naïve", "na ve", 1, 1, 1), (None, None, 1, 1, 1)]


def test_scores_worked_by_hand(spark):
    df = spark.createDataFrame([(p, r) for p, r, *_ in CASES], "p string, r string")
    got = df.select(exact_match(F.col("p"), F.col("r")), token_f1(F.col("p"), F.col("r")), rouge_l(F.col("p"), F.col("r"))).collect()
    for row, case in zip(got, CASES, strict=True):
        assert list(row) == pytest.approx(list(case[2:])), case


def test_token_f1_and_lcs_equal_plain_versions(spark):
    rng = random.Random(3)
    pairs = [(" ".join(rng.choices("abcde", k=rng.randrange(0, 9))), " ".join(rng.choices("abcde", k=rng.randrange(0, 9)))) for _ in range(200)]

    def plain_lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    got = [r[0] for r in spark.createDataFrame(pairs, "p string, r string").select(token_f1(F.col("p"), F.col("r"))).collect()]
    for (p, r), f in zip(pairs, got, strict=True):
        a, b = p.split(), r.split()
        n = sum((Counter(a) & Counter(b)).values())
        want = 1.0 if not a and not b else 0.0 if not a or not b else 2 * n / (len(a) + len(b))
        assert f == pytest.approx(want)
        assert lcs_length(a, b) == plain_lcs(a, b)


def test_text(spark):
    row = spark.createDataFrame([("  x\t\r\n y ", "Naïve_Text 1!", "/a/b.c/zzzzzzzzzzzTAIL.tar.gz", " \t")], "a string, b string, c string, d string")
    got = row.select(clean_text(F.col("a")), normalize_text(F.col("b")), file_stem(F.col("c")), video_key(F.col("d"), F.col("c")), strip_ws(F.lit(None).cast("string")), clean_text(F.lit(None).cast("string"))).first()
    assert tuple(got) == ("x y", "na ve text 1", "zzzzzzzzzzzTAIL.tar", "zzzzzzzzzzz", None, "")


def test_first_turn(spark):
    turns = "array<struct<`from` string, value string>>"
    df = spark.createDataFrame([([(" GPT ", None), ("gpt", "x")],), ([(None, "y")],), (None,), ([],)], f"c {turns}")
    assert [r[0] for r in df.select(first_turn(F.col("c"), ("gpt",))).collect()] == [None, None, None, None]


def test_timestamps(spark):
    cases = {0.0: "00:00:00.000", 59.9996: "00:01:00.000", 3599.9999: "01:00:00.000", 360000.25: "100:00:00.250", 1.0005: "00:00:01.000", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "s double")
    assert [r[0] for r in df.select(V.timestamp(F.col("s"))).collect()] == list(cases.values())


def test_rounding_of_durations_and_uid(spark):
    import hashlib

    df = spark.createDataFrame([(0.0, 1.0005), (0.0, 0.0625), (5.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(V.duration(F.col("a"), F.col("b"))).collect()] == [1.0, 0.062, 0.0]
    uid = df.limit(1).select(V.record_uid(F.lit("v"), F.col("a"), F.col("b"), F.lit("c"), F.lit(" q \n x"), F.lit(None).cast("string"))).first()[0]
    assert uid == hashlib.sha1(b"v|0.000|1.000|c|q x|").hexdigest()


def test_sample_times_and_chunks(spark):
    df = spark.createDataFrame([(2.0, 5), (2.01, 3), (10.0, 1), (10.0, 3)], "d double, n int")
    got = [r[0] for r in df.select(V.crop_sample_times(F.col("d"), F.col("n"))).collect()]
    assert got[0] == [1.0] and got[2] == [5.0]
    assert got[1] == pytest.approx([0.1005, 1.005, 1.9095]) and got[3] == pytest.approx([0.5, 5.0, 9.5])
    assert df.limit(1).select(V.eval_sample_times(F.lit(8.0), F.lit(4))).first()[0] == [1.0, 3.0, 5.0, 7.0]
    with pytest.raises(Exception, match="above 0"):
        df.limit(1).select(V.eval_sample_times(F.lit(0.0), F.col("n"))).collect()
    mb = 1024 * 1024
    plans = spark.createDataFrame([(25 * mb, 100.0), (50 * mb, 0.0), (50 * mb, 100.0), (5000 * mb, 25.0)], "b bigint, s double").select(V.audio_chunk_plan(F.col("b"), F.col("s"))).collect()
    assert [len(p[0]) for p in plans] == [1, 1, 4, 3]
    assert plans[2][0][0]["end_sec"] == pytest.approx(32.0) and plans[2][0][-1]["end_sec"] == 100.0


def test_boxes(spark):
    one = spark.range(1)
    n = lambda x: F.lit(x).cast("bigint")
    even = [r for r in one.select(*[V.even_int(F.lit(float(x))) for x in (0, 2.5, 3.5, 7)]).first()]
    assert even == [2, 2, 4, 6]
    box = one.select(V.expand_box(n(0), n(1075), n(100), n(50), n(1920), n(1080), 0.04)).first()[0]
    assert tuple(box) == (0, 1073, 104, 7)
    small = one.select(V.borders(F.lit(1000), F.lit(1000), F.lit(15), F.lit(0), F.lit(985), F.lit(1000))).first()[0]
    exact = one.select(V.borders(F.lit(640), F.lit(640), F.lit(16), F.lit(0), F.lit(624), F.lit(640))).first()[0]
    below = one.select(V.borders(F.lit(641), F.lit(641), F.lit(16), F.lit(0), F.lit(625), F.lit(641))).first()[0]
    assert (small["crop_needed"], exact["crop_needed"], below["crop_needed"]) == (False, True, False)


def test_names(spark):
    one = spark.range(1)
    got = one.select(V.safe_folder_name(F.lit(' a<b>:"/\\|?* c\n d')), V.safe_dir_name(F.lit("  é é")), V.safe_dir_name(F.lit("a b/c"))).first()
    assert tuple(got) == ("a_b________ c d", "row", "a_b_c")


def test_lenient_json(spark):
    assert lenient('```json\n{"a": 1}\n```') == (True, {"a": 1})
    assert lenient('so: {"a": [1, 2]} ok') == (True, [1, 2])
    assert lenient('so: {"a": 1} ok') == (True, {"a": 1})
    assert lenient("nothing")[0] is False and lenient(None)[0] is False
    df = spark.createDataFrame([('x {"a": 1.0}',), ("-",), (None,)], "t string")
    got = [r[0] for r in df.select(lenient_json("t")).collect()]
    assert json.loads(got[0]) == {"a": 1.0} and got[1:] == [None, None]


def test_strict_object_and_judge(spark):
    lines = ['{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1} x', "[1]", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(strict_object("t")).collect()]
    assert got == ['{"a": 2}', '{"a": NaN}', None, None, None, None]
    replies = ['{"score": 1, "reason": "x"}', 'well: {"score": "1"}', '{"score": 0.7}', '{"score": 2}', '{"score": null}', "no", "3", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in replies], "t string").select(judge_reply("t")).collect()]
    assert [g["score"] for g in got] == [1, 1, 0, None, None, None, None, None]
    assert got[5]["reason"].startswith("Could not parse") and got[6]["reason"].startswith("Judge error")
    assert [judge_score(x) for x in (True, "0", "x", [], 5)] == [1, 0, None, None, None]


def test_code_fence(spark):
    got = spark.createDataFrame([("```\nx\n```",), ("x",)], "t string").select(strip_code_fence(F.col("t"))).collect()
    assert [r[0] for r in got] == ["x", "x"]
