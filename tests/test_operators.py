import pytest
from pyspark.sql import functions as F

from framequilt.operators import qa, selection, training, transcripts
from framequilt.operators.context import first_per_segment, load_clips, neighbour_context
from framequilt.operators.metrics import grouped_metrics, inference_key, metric_key, overall_metrics, score_rows

TURNS = "array<struct<`from` string, value string>>"


def test_context(spark):
    rows = [("v", i, t) for i, t in enumerate(["a", " ", "c", "d"])] + [("w", 0, "z"), ("w", 0, None)]
    df = spark.createDataFrame(rows, "g string, n int, t string").withColumn("line_no", F.monotonically_increasing_id())
    got = {(r["g"], r["n"], r["t"]): r["context"] for r in neighbour_context(df, "g", ["n", "line_no"], "t", 2).collect()}
    assert got["v", 2, "c"] == "PREV: a | NEXT: d"
    assert got["v", 0, "a"] == "NEXT: c" and got["v", 3, "d"] == "PREV: c"
    assert neighbour_context(df.limit(0), "g", ["n"], "t").collect() == []


def test_load_clips(spark):
    good = [(" gpt", "twelve chars")]
    rows = [
        (1, "d/v.mp4", "1.0", "3.0", "s", None, good), (2, "v", "x", "1", "s", "y", good), (3, "v", "1", "2", None, "y", good), (4, "v", "1", "2", "s", "y", [("gpt", " "), ("gpt", "long enough text")]),
        (5, "v", "5", "2", "s", "", [("GPT", "long enough text")]), (6, None, "1", "2", "s", "y", good), (7, "v", "1", "2", "s", "y", None), (8, "v", "1", "2", "s", "y", [("gpt", "eleven char")]),
    ]
    df = spark.createDataFrame(rows, f"line_no int, video string, video_start string, video_end string, segment_id string, youtube_id string, conversations {TURNS}")
    got = {r["line_no"]: r for r in load_clips(df).collect()}
    assert set(got) == {1, 5}
    assert got[1]["youtube_id"] == "v" and got[1]["duration_sec"] == 2.0 and got[5]["duration_sec"] == 0.0 and got[5]["youtube_id"] == ""


def test_first_per_segment_is_global(spark):
    df = spark.createDataFrame([("v", "s", 1), ("u", "s", 2), ("u", " ", 3), ("w", None, 4)], "y string, s string, n int")
    assert [r["n"] for r in first_per_segment(df, "s", ["y", "n"]).collect()] == [2]


def test_latest_first_and_ties(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "a", "y"), (4, None, "z"), (5, None, "zz")], "line_no int, k string, v string")
    latest = {r["k"]: (r["line_no"], r["first_seen"]) for r in selection.latest_per_key(df, F.col("k"), "line_no").collect()}
    assert latest == {"a": (3, 1), "b": (2, 2), None: (5, 4)}
    assert {r["line_no"] for r in selection.first_per_key(df, F.col("k"), "line_no").collect()} == {1, 2, 4}


def test_samples(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "b") for i in range(100)], "id int, g string")
    once = {r["id"] for r in selection.sample_per_group(df, "g", "id", 5, 1).collect()}
    assert len(once) == 10 and once == {r["id"] for r in selection.sample_per_group(df.repartition(7), "g", "id", 5, 1).collect()}
    assert selection.sample_fraction(df, "id", 33, 1).count() == 33 and selection.sample_fraction(df, "id", 150, 1).count() == 100 and selection.sample_fraction(df, "id", 0, 1).count() == 0
    assert selection.cap_groups(df, "g", 1, 1).select("g").distinct().count() == 1 and selection.cap_groups(df, "g", 0, 1).count() == 100


def test_filters(spark):
    df = spark.createDataFrame([("a", "Unknown", "open surgery"), ("unknown", "U", "Robotic"), (None, None, None)], "procedure string, specialty string, surgery string")
    assert selection.metadata_filter(df, types=["OPEN"]).count() == 1
    assert selection.metadata_filter(df, specialties=["Unknown"]).count() == 0 and selection.metadata_filter(df).count() == 3
    assert selection.split_filter(" a, ,b") == ["a", "b"] and selection.split_filter(None) == []
    labels = df.select(selection.procedure_label(F.col("procedure"), F.col("specialty"))).collect()
    assert [r[0] for r in labels] == ["a", "U", ""]
    yes = spark.createDataFrame([("Yes",), ("y ",), ("TRUE",), ("1",), ("1.0",), (None,)], "c string").select(selection.says_yes(F.col("c"))).collect()
    assert [r[0] for r in yes] == [True] * 4 + [False] * 2
    with pytest.raises(KeyError):
        selection.require_columns(df, ["nope"])
    assert selection.require_columns(df, ["surgery"], {"title": ""}).columns[-1] == "title"


def test_keys(spark):
    df = spark.createDataFrame([(0, None, "v", [("human", "<video> q ")]), (7, "s", "v", None), (None, "s", "v", []), (None, "", "v", [])], f"id int, segment_id string, video string, conversations {TURNS}")
    assert [r[0] for r in df.select(metric_key(df)).collect()] == ["None|||q", "7", "s|||", "v|||"]
    assert [r[0] for r in df.select(inference_key(df)).collect()] == ["|||q", "7", "s|||", "v"]


def test_metrics_counters(spark):
    rows = [("yes", "yes", None, "x", True, 1), ("", "yes", "none", "", True, None), ("", "", None, None, False, None), ("p", "r", "timeout", "x", None, 0), ("?!", "...", "NULL", "x", False, 3)]
    df = spark.createDataFrame(rows, "prediction string, gt_answer string, error string, category string, flag boolean, llm_judge_score int")
    scored = score_rows(df)
    o = overall_metrics(scored).first()
    assert (o["n_total"], o["n_success"], o["n_error"], o["n_missing_prediction"], o["n_missing_reference"]) == (5, 3, 1, 2, 1)
    assert (o["llm_judge_n"], o["llm_judge_accuracy"], o["llm_judge_missing"]) == (1, 1.0, 2)
    assert o["exact_match"] == pytest.approx(2 / 3, abs=1e-6)
    groups = {(r["field"], r["value"]): r["n_total"] for r in grouped_metrics(scored, ["category", "flag", "absent"]).collect()}
    assert groups == {("category", "x"): 3, ("category", ""): 1, ("flag", "True"): 2, ("flag", "False"): 2}
    empty = overall_metrics(score_rows(df.limit(0))).first()
    assert empty["n_total"] == 0 and empty["exact_match"] is None


def test_transcripts(spark):
    seg = "array<struct<`start` double, `end` double, text string>>"
    word = "array<struct<`start` double, `end` double, word string>>"
    chunks = [
        ("v", 1, ("one ", [(0.0, 5.0, "a")], [(0.0, 1.0, "Hi"), (1.0, 2.0, " "), (2.0, 3.0, "there."), (3.0, 4.0, "(")]), None),
        ("v", 2, None, None),
        ("v", 3, ("two", [], [(0.0, 2.0, "x")]), " "),
        ("v", 4, ("bad", [(0.0, 1.0, "no")], []), "failed"),
        ("v", 5, ("", [], []), None),
    ]
    df = spark.createDataFrame(chunks, f"k string, n int, transcript struct<text string, segments {seg}, words {word}>, error string")
    off = transcripts.with_offsets(df, "k", "n")
    assert [r["offset_sec"] for r in off.orderBy("n").collect()] == [0.0, 5.0, 605.0, 607.0, 1207.0]
    m = transcripts.merged_text(off, "k", "n").first()
    assert m["text"] == "one [ERROR: Failed to transcribe chunk 2] two [ERROR: Failed to transcribe chunk 4]" and (m["chunk_count"], m["chunks_transcribed"]) == (5, 3)
    words = transcripts.timed_rows(off, "k", "n", "words")
    got = [(r["start"], r["end"], r["text"]) for r in transcripts.sentences(words, "k", ["n", "position"]).orderBy("sentence_no").collect()]
    assert got == [(0.0, 3.0, "Hi there."), (3.0, 607.0, "(x")]
    cue = transcripts.vtt(transcripts.timed_rows(off, "k", "n", "segments"), "k", ["n", "position"]).first()["content"]
    assert cue == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:05.000\na\n"


def test_join_words(spark):
    df = spark.createDataFrame([(["a", ",", "(", "b", ")", "50", "%", "."],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(transcripts.join_words(F.col("w"))).collect()] == ["a, (b) 50%.", ""]


def test_candidates(spark):
    def c(category="entity_state", question="what is it?", answer="a long answer", fmt="open", choices=None, choice=None):
        return (category, question, answer, "", "", fmt, choices, choice)

    four = ["a", "b", "c", "d"]
    items = [c(answer="short"), c(), c(question="another one"), c("entity_existence", fmt="mcq", choices=four[:3], choice="0"), c("entity_existence", fmt="MCQ ", choices=four, choice="3"), c("spatial_relation", fmt="mcq", choices=four, choice="4"), c("operative_action", fmt="odd", choices=four), c("unknown")]
    df = spark.createDataFrame([(1, items, ["entity_state", "entity_existence", "spatial_relation", "operative_action"])], f"k int, c {qa.CANDIDATES}, allowed array<string>")
    got = {r["position"]: r["candidate"] for r in qa.valid_candidates(df, "k", "c", "allowed").collect()}
    assert set(got) == {1, 4, 6}
    assert got[4]["correct_choice"] == 3 and got[6]["format"] == "open" and got[6]["choices"] == []
    assert qa.valid_candidates(df.select("k", F.lit(None).cast(qa.CANDIDATES).alias("c"), "allowed"), "k", "c", "allowed").collect() == []


def test_verdicts(spark):
    full = {s: "4" for s in qa.SCORES}
    rows = [("true", full), ("false", full), ("yes", full | {"groundedness": "4.7"}), ("true", {}), ("true", full | {"answerability": "3"}), (None, full)]
    df = spark.createDataFrame(rows, "keep string, scores map<string,string>").withColumn("v", F.struct("scores"))
    got = df.select(qa.score_gate(qa.truthy(F.col("keep")), qa.scores_of(F.col("v")))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False, False]


def test_training_items(spark):
    a, e = training.ANSWER_TOKEN, training.END_TOKEN
    i = training.IGNORED
    assert training.mask_labels([1, a, 2, 3, e, 4, 5]) == [i, i, i, 3, e, 4, i]
    assert training.mask_labels([a, 2, 3]) == [i, i, i] and training.mask_labels([]) == []
    assert training.mask_labels([a, 2, a, 9, e, a, 7, 8, e]) == [i, i, a, 9, e, a, i, 8, e]
    df = spark.createDataFrame([([("human", "<video>x <video>"), ("gpt", "<video>")], "a"), ([("human", "x")], "a"), ([("human", "<video>")], "a"), ([], None)], f"c {TURNS}, v string")
    none = F.array().cast("array<string>")
    got = [r[0] for r in df.select(training.placeholder_defect(F.col("c"), none, training.as_list(F.col("v"), False))).collect()]
    assert got == ["more <video> placeholders than files", "video files remain unused", None, None]
    parts = spark.createDataFrame([(" a <video>b<image>",), (None,)], "t string").select(training.content_parts(F.col("t"))).collect()
    assert [r[0] for r in parts] == [["a", "<video>", "b", "<image>"], []]
    known = training.registry("/d", "own")
    assert len(known) == 21 and [d.percent for d in training.parse_mixture("own_qa%50,surg_step_descriptions_mis,own_qa%0", known)] == [50, 100, 0]
    with pytest.raises(ValueError, match="nope"):
        training.parse_mixture("nope%5", known)


def test_replacements_and_lengths(spark):
    df = spark.createDataFrame([(i, i % 3 == 0 if i % 10 else None) for i in range(60)], "k int, bad boolean")
    got = {r["k"]: r["replacement"] for r in training.replacements(df, "k", "bad", 1).collect()}
    assert set(got) == {i for i in range(60) if i % 10 == 0 or i % 3 == 0} and all(v % 3 and v % 10 for v in got.values()) and len(set(got.values())) > 5
    assert got == {r["k"]: r["replacement"] for r in training.replacements(df.repartition(7), "k", "bad", 1).collect()}
    none = training.replacements(df.withColumn("bad", F.lit(True)), "k", "bad", 1).collect()
    assert len(none) == 60 and all(r["replacement"] is None for r in none)
    assert [r[0] for r in df.limit(2).select(training.known_lengths(df)).collect()] == [1, 1]
    assert '"total_time" : 3.5' in transcripts.timing_json(spark.createDataFrame([("v", 1.5, 2.0, None)], "k string, a double, b double, c double"), "k", ["a", "b", "c"]).first()["content"]


def test_messages(spark):
    rows = [(1, [("human", "<image> a <video>b"), ("gpt", " said "), ("human", "<video>")], ["i.png"], ["v.mp4", "/abs.mp4"]), (2, [("gpt", None)], [], [])]
    df = spark.createDataFrame(rows, f"n int, c {TURNS}, i array<string>, v array<string>")
    got = {r["n"]: r["m"] for r in df.select("n", training.messages(F.col("c"), F.col("i"), F.col("v"), "/base").alias("m")).collect()}
    told = [(m["role"], [(p["type"], p["text"], p["path"]) for p in m["content"]]) for m in got[1]]
    assert told == [("user", [("image", None, "/base/i.png"), ("text", "a", None), ("video", None, "/base/v.mp4"), ("text", "b", None)]), ("assistant", [("text", " said ", None)]), ("user", [("video", None, "/abs.mp4")])]
    assert [(m["role"], m["content"][0]["text"]) for m in got[2]] == [("assistant", "")]
    with pytest.raises(Exception, match="more <video>"):
        df.select(training.messages(F.col("c"), F.col("i"), F.array().cast("array<string>"))).collect()
