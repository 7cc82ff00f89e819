import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from framequilt.models import Replay, ask, with_retries
from framequilt.operators.metrics import distribution, inference_answer, inference_question
from framequilt.operators.selection import first_rows
from framequilt.operators.transcripts import detailed_json, transcription_batch, with_offsets
from framequilt.options import CropOptions, GenerateOptions, InferenceOptions, MetricsOptions
from framequilt.plans.programs import choose_clips, crop_summary, evaluate, evaluate_judged, generate_questions, judge, predict, transcribe, transcription_counts
from framequilt.sources import readers, sinks
from framequilt.streaming.incremental import interval_state, run_available

TURNS = "array<struct<`from` string, value string>>"


def test_tolerant_strict_and_array_readers(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n not json\n[1]\n{"a": 2, "a": 3}\n', encoding="utf-8")
    rows = readers.tolerant_jsonl(spark, str(p), "a int").orderBy("line_no").collect()
    assert [r["a"] for r in rows] == [1, 3]
    with pytest.raises(Exception, match="malformed line"):
        readers.strict_jsonl(spark, str(p), "a int").collect()
    (tmp_path / "y.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [r["a"] for r in readers.training_items(spark, str(tmp_path / "y.json"), "a int").collect()] == [1, 2]
    assert readers.resume_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_object_map_sheets_and_lists(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"v": {"surgery": "open"}, "w": 5}')
    got = {r["key"]: r["surgery"] for r in readers.object_map(spark, str(tmp_path / "m.json"), "surgery string").collect()}
    assert got == {"v": "open", "w": None}
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="must be an object"):
        readers.object_map(spark, str(tmp_path / "bad.json"), "surgery string").collect()
    folder = tmp_path / "sheets"
    folder.mkdir()
    (folder / "b.csv").write_text("id, Crop\n1,Yes\n")
    (folder / "a.csv").write_text("id,title\n2,t\n")
    rows = readers.sheets(spark, str(folder)).orderBy("file_no").collect()
    assert [(r["id"], r["title"], r["Crop"]) for r in rows] == [("2", "t", None), ("1", None, "Yes")]
    (tmp_path / "ids.txt").write_text("a\n\n b \na\n")
    assert {r["id"] for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="unsupported"):
        readers.sheet(spark, "x.txt")


def test_catalogue_and_outputs(spark, tmp_path):
    for name in ("v/a.mp4", "v/sub/a.MKV", "v/sub/b.webm", "v/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r["stem"]: r["path"] for r in readers.video_catalogue(spark, str(tmp_path / "v")).collect()}
    assert set(got) == {"a", "b"} and got["a"].endswith("v/a.mp4")
    assert {r["stem"] for r in sinks.existing_outputs(spark, str(tmp_path / "v"), ["webm"]).collect()} == {"b"}
    paths = spark.createDataFrame([("/r/s/a.b.mp4",)], "p string").select(sinks.output_path(F.col("p"), "/o"), sinks.output_path(F.col("p"), "/o", "/r")).first()
    assert tuple(paths) == ("/o/a.b_cropped.mp4", "/o/s/a.b_cropped.mp4")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 1 else "é") for i in range(6)], "line_no bigint, t string")
    for _ in range(2):
        sinks.append_jsonl(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 12
    sinks.write_ranks(df, str(tmp_path / "ranks"), 3)
    merged = sinks.merge_ranks(spark, str(tmp_path / "ranks"), 3, "line_no bigint, t string")
    assert [r["line_no"] for r in merged.orderBy("rank", "line_no").collect()] == [0, 3, 1, 4, 2, 5]
    with pytest.raises(FileNotFoundError):
        sinks.merge_ranks(spark, str(tmp_path / "ranks"), 4, "line_no bigint")
    sinks.write_texts(df.select(F.col("line_no").cast("string").alias("k"), F.lit("x").alias("c")), "k", "c", str(tmp_path / "texts"), ".txt")
    assert sorted(os.listdir(tmp_path / "texts"))[0] == "0.txt"
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 6


def test_retries_and_ask(spark):
    waits, calls = [], []

    def flaky(requests):
        calls.append(requests)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return ["ok"]

    assert with_retries(flaky, sleep=waits.append)("r") == ("ok", None) and waits == [1.5, 3.0]
    df = spark.createDataFrame([("a",), ("b",), (None,)], "request string")
    got = {r["request"]: (r["reply"], r["reply_error"]) for r in ask(df, "request", "reply", Replay({"a": "1"}), first_wait=0).collect()}
    assert got["a"] == ("1", None) and got["b"][0] is None and "no reply recorded" in got["b"][1] and got[None][1] == "no request"


def _clips(spark):
    rows = [(1, "d/v1.mp4", 0.0, 5.0, "s1", "v1", [("gpt", "the surgeon cuts the tissue")]), (2, "d/v1.mp4", 5.0, 9.0, "s2", "v1", [("gpt", "the vessel is clipped now")]), (3, "d/v2.mp4", 0.0, 5.0, "s1", "v2", [("gpt", "another clip of the same id")])]
    return spark.createDataFrame(rows, f"line_no bigint, video string, video_start double, video_end double, segment_id string, youtube_id string, conversations {TURNS}")


def test_generation_end_to_end(spark):
    procedures = spark.createDataFrame([("v1", "robotic", "Urology", "Unknown", None, "A title")], "youtube_id string, surgery string, specialty string, procedure string, procedure_name string, title string")
    chosen = choose_clips(_clips(spark), procedures)
    got = {r["segment_id"]: r for r in chosen.collect()}
    assert set(got) == {"s1", "s2"} and got["s1"]["surgery_type"] == "A title" and got["s1"]["context"] == "NEXT: the vessel is clipped now"
    plan = json.dumps({"sgm_summary": "x", "applicable_categories": ["operative_action", "nonsense", "entity_state"]})
    items = [{"category": "operative_action", "question": "What is being done?", "answer": "The tissue is cut."}, {"category": "entity_state", "question": "How is the tissue?", "answer": "It is retracted."}]
    good = {"keep": True, "reason": " fine ", "scores": dict.fromkeys(("groundedness", "temporal_alignment", "answerability", "non_triviality", "hallucination_risk"), 5), "revised_answer": ""}
    accepted, rejected = generate_questions(chosen, Replay(default=f"```json\n{plan}\n```"), Replay(default="Here: " + json.dumps(items)), Replay(default=json.dumps(good)))
    rows = accepted.collect()
    assert len(rows) == 4 and len(accepted.columns) == 26 and rejected.count() == 0
    assert {r["broad_category"] for r in rows} == {"action_procedural_state", "perception_identification"} and rows[0]["messages"][1]["role"] == "assistant"
    done = accepted.select("id").limit(1)
    again, _ = generate_questions(chosen, Replay(default=plan), Replay(default=json.dumps(items)), Replay(default=json.dumps(good)), done_ids=done)
    assert again.count() == 3
    low, thrown = generate_questions(chosen, Replay(default=plan), Replay(default=json.dumps(items)), Replay(default=json.dumps(good | {"scores": {}})))
    assert low.count() == 0 and thrown.count() == 4
    none, failed = generate_questions(chosen, Replay(default="sorry"), Replay(), Replay(), options=GenerateOptions(skip_validator=True))
    assert none.count() == 0 and {r["stage"] for r in failed.collect()} == {"plan"}


def test_evaluation_judge_and_resume(spark):
    rows = [(1, "s", "v", "q", "old", "Yes", None), (2, "s", "v", "q", "yes", "Yes", None), (3, "t", "v", "q", "", "Yes", None), (4, "u", "v", "q", "x", "Yes", "HTTP 500"), (5, "w", "v", "q", "x", "", None)]
    df = spark.createDataFrame(rows, "line_no bigint, segment_id string, video string, question string, prediction string, gt_answer string, error string")
    overall, grouped = evaluate(df)
    assert overall.first()["n_total"] == 4 and overall.first()["exact_match"] == 0.5 and grouped.count() == 0
    judged = {r["line_no"]: r["llm_judge_score"] for r in judge(df, Replay(default='{"score": 1}')).collect()}
    assert judged == {1: 1, 2: 1, 3: 0, 4: None, 5: None}
    old = spark.createDataFrame([("t|||q", 1, "kept")], "row_key string, llm_judge_score int, llm_judge_reason string")
    assert {r["line_no"]: r["llm_judge_score"] for r in judge(df, Replay(default='{"score": 0}'), old).collect()}[3] == 1
    todo = df.select("line_no", "segment_id", "video", "question", "gt_answer")
    new = predict(todo, Replay(default="answer"), done=df)
    assert {r["line_no"] for r in new.collect()} == {3, 4}
    assert predict(todo, Replay(default="a"), options=InferenceOptions(limit=3)).count() == 3


def test_crop_summary(spark):
    selected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    catalogue = spark.createDataFrame([("a", "/a.mp4"), ("b", "/b.mp4"), ("c", "/c.mp4")], "stem string, path string")
    windows = spark.createDataFrame([("/a.mp4", 1000, 1000, 100, 0, 900, 1000), ("/b.mp4", 1000, 1000, 0, 0, 1000, 1000), ("/c.mp4", 1000, 1000, 100, 0, 900, 1000)], "path string, video_w int, video_h int, x int, y int, w int, h int")
    done = spark.createDataFrame([("c",)], "stem string")
    got = {r["id"]: r["status"] for r in crop_summary(selected, catalogue, windows, done, CropOptions(dry_run=True)).collect()}
    assert got == {"a": "dry_run", "b": "skipped_small_border", "c": "skipped_existing", "d": "missing_video"}
    with pytest.raises(ValueError):
        CropOptions(samples=0)


def test_streams(spark, tmp_path):
    schema = "who string, a bigint, b bigint"
    spark.createDataFrame([("v", 0, 10), ("v", 20, 30), ("w", 0, 5), (None, 1, 2), ("w", 5, 5)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run_available(source, lambda df: df.filter("who = 'v'"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    query = interval_state(source, "who", "a", "b").writeStream.outputMode("update").format("memory").queryName("gaps").start()
    query.processAllAvailable()
    spark.createDataFrame([("v", 9, 21)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("SELECT key, gaps FROM gaps").collect()
    assert [[tuple(g) for g in r["gaps"]] for r in rows if r["key"] == "v"] == [[(10, 20)], []]


def test_line_numbers_over_files_and_partitions(spark, tmp_path):
    for name, lines in (("a.jsonl", ['{"n": 0}', "", '{"n": 1}']), ("b.jsonl", [f'{{"n": {i}, "pad": "{"x" * 200}"}}' for i in range(2, 400)]), ("c.jsonl", ["[1]", '{"n": 400}', "broken"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.tolerant_jsonl(spark, str(tmp_path), "n int")
        assert rows.rdd.getNumPartitions() > 3
        assert [r["n"] for r in rows.orderBy("line_no").collect()] == list(range(401))
        assert sorted(r["n"] for r in first_rows(rows, "line_no", 3).collect()) == [0, 1, 2]
        lines = readers.numbered_lines(spark, str(tmp_path))
        assert sorted(r["line_no"] for r in lines.collect()) == list(range(404))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_resume_keeps_what_is_no_object_and_a_broken_array_is_an_error(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"n": 1}\n3\n[{"n": 2}]\nnull\nbroken\n\n')
    rows = readers.resume_jsonl(spark, str(tmp_path / "r.jsonl"), "n int").orderBy("line_no").collect()
    assert [r["n"] for r in rows] == [1, None, None, None] and readers.resume_jsonl(spark, str(tmp_path / "none"), "n int").count() == 0
    for text in ('[{"n": 1}', '{"n": 1}', "[1] x"):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(Exception, match="one JSON array"):
            readers.json_array(spark, str(tmp_path / "x.json"), "n int").collect()


def test_catalogue_takes_suffixes_in_any_case(spark, tmp_path):
    for name in ("a.mp4", "b.MP4", "c.Mp4", "d.txt", "e.mp4.part"):
        (tmp_path / name).write_text("x")
    assert {r["stem"] for r in readers.video_catalogue(spark, str(tmp_path)).collect()} == {"a", "b", "c"}


def _workbook(path, rows):
    """A small workbook, written part by part."""
    cells = []
    for i, row in enumerate(rows, 1):
        one = []
        for j, v in enumerate(row):
            ref = f"{chr(65 + j)}{i}"
            if v is None:
                continue
            one.append(f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
        cells.append(f'<row r="{i}">{"".join(one)}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(cells)}</sheetData></worksheet>")


def test_workbooks_and_type_map(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["id ", "Type"], ["v1", "n/a"], ["v2", "open surgery"], [7, "Robotic"], [None, "Open"], ["nan", "Open"]])
    _workbook(tmp_path / "b.xlsx", [["Type", "id"], ["laparoscopic", "v1"], ["robotic", "v2"], [None, "v3"]])
    _workbook(tmp_path / "c.xlsx", [["other"], ["x"]])
    got = {r["id"]: r["type"] for r in readers.type_map(spark, str(tmp_path)).collect()}
    assert got == {"v1": "Laparoscopic", "v2": "Open", "7": "Robotic"}
    both = readers.sheets(spark, str(tmp_path))
    assert both.count() == 9 and {"id", "Type", "other", "file_no", "line_no"} == set(both.columns)
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no sheets"):
        readers.type_map(spark, str(tmp_path / "empty"))


def test_earlier_verdicts(spark):
    df = spark.createDataFrame([(1, "t", "q", "new", "Yes"), (2, "u", "q", "x", "Yes"), (3, "w", "q", "x", "Yes")], "line_no bigint, segment_id string, question string, prediction string, gt_answer string")
    old = [(1, "t|||q", 1, "first", "old"), (2, "t|||q", 0, "last", "older"), (3, "u|||q", 1, "fine", "x"), (4, "u|||q", None, "lost", "x")]
    old = spark.createDataFrame(old, "line_no bigint, row_key string, llm_judge_score int, llm_judge_reason string, prediction string").repartition(3)
    got = {r["segment_id"]: r for r in judge(df, Replay(default='{"score": 1, "reason": "r"}'), old, MetricsOptions(judge_model="m")).collect()}
    # the last verdict of a key decides, and the earlier row is returned as it was; a lost one is asked again
    assert (got["t"]["llm_judge_score"], got["t"]["llm_judge_reason"], got["t"]["prediction"]) == (0, "last", "older")
    assert got["u"]["llm_judge_raw"] == '{"score": 1, "reason": "r"}' and got["u"]["llm_judge_model"] == "m" and got["w"]["llm_judge_score"] == 1
    judged, overall, _ = evaluate_judged(df.unionByName(df.withColumn("line_no", F.col("line_no") + 10)), Replay(default='{"score": 1}'))
    assert judged.count() == 3 and overall.first()["llm_judge_n"] == 3


def test_inference_resolution(spark):
    turns = "array<struct<`from` string, value string>>"
    rows = [
        (1, [("human", " "), ("user", "<video>\nfirst "), ("gpt", ""), ("assistant", "said")], "flat", "p", "gt", "a"),
        (2, None, None, "<image> prompt", None, " bare "),
        (3, [("Human", "other role")], "", "p", None, None),
    ]
    df = spark.createDataFrame(rows, f"n int, conversations {turns}, question string, prompt string, gt_answer string, answer string")
    got = [(r["q"], r["a"]) for r in df.select("n", inference_question(df).alias("q"), inference_answer(df).alias("a")).orderBy("n").collect()]
    assert got == [("first", "said"), ("prompt", "bare"), ("", "")]


def test_transcription_batch(spark):
    selected = spark.createDataFrame([(" a ",), ("b",), ("",), (None,), ("c",), ("d",)], "title string")
    catalogue = spark.createDataFrame([("a", "/a.mp4"), ("b", "/b.mp4"), ("d", "/d.mp4")], "stem string, path string")
    done = spark.createDataFrame([("b",)], "folder string")
    batch = transcription_batch(selected, catalogue, done)
    assert {(r["title"], r["status"]) for r in batch.collect()} == {("a", "to_run"), ("b", "skipped_done"), ("", "skipped_missing"), ("c", "skipped_missing"), ("d", "to_run")}
    sized = batch.withColumns({"size_bytes": F.when(F.col("title") == "a", 60_000_000).otherwise(10), "seconds": F.lit(100.0)})

    def model():
        def answer(requests):
            r = json.loads(requests[0])
            if r["path"] == "/d.mp4":
                raise OSError("gone")
            return [json.dumps({"text": f"{r['start_sec']:.0f}", "segments": [{"start": 0, "end": 2, "text": "s"}], "words": []})]

        return answer

    chunks = transcribe(sized, model)
    rows = {(r["folder"], r["chunk_no"]): r for r in chunks.collect()}
    assert len([k for k in rows if k[0] == "a"]) > 1 and rows["a", 0]["transcript"]["text"] == "0" and rows["d", 0]["transcript"] is None and "gone" in rows["d", 0]["error"]
    assert {r["status"]: r["n"] for r in transcription_counts(sized, chunks).collect()} == {"processed": 1, "failed": 1, "skipped_done": 1, "skipped_missing": 3}
    told = json.loads(detailed_json(with_offsets(chunks, "folder", "chunk_no"), "folder", "chunk_no").filter("folder = 'a'").first()["content"])
    assert told["chunk_count"] == told["chunks_transcribed"] == len(told["segments"]) and told["segments"][1]["start"] == 2.0 and "[ERROR" not in told["text"]


def test_reports(spark):
    overall = spark.createDataFrame([(3, 2, 0.5, None)], "n_total int, n_success int, exact_match double, llm_judge_accuracy double")
    grouped = spark.createDataFrame([("format", "open", 3, 2, 0.5, None)], "field string, value string, n_total int, n_success int, exact_match double, llm_judge_accuracy double")
    text = sinks.summary_report(sinks.summary(overall, grouped, file="x"))
    assert "exact_match: 0.5000" in text and "llm_judge_accuracy: N/A" in text and "[format = open]" in text
    counts = distribution(spark.createDataFrame([("a",), ("a",), ("b",)], "c string"), "c")
    assert sinks.distribution_report(counts, "By category").splitlines() == ["By category", "  a: 2 (66.67%)", "  b: 1 (33.33%)"]
