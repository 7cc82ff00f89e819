"""The programs: each takes DataFrames and options, and returns DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequilt.functions.json_text import judge_reply, lenient_json
from framequilt.functions.text import clean_text
from framequilt.functions.values import audio_chunk_plan, borders
from framequilt.models import Model, ask
from framequilt.operators.context import first_per_segment, load_clips, neighbour_context
from framequilt.operators.metrics import grouped_metrics, inference_answer, inference_key, inference_question, judge_without_call, metric_key, overall_metrics, prediction, question, reference, score_rows
from framequilt.operators.qa import CANDIDATES, PLAN, TAXONOMY, VERDICT, accepted_rows, finalize, normalize_plan, valid_candidates
from framequilt.operators.selection import cap_groups, count_by, first_rows, judged_before as judged_before_rows, latest_per_key, metadata_filter, procedure_label, rank_shard, sample_per_group
from framequilt.options import CropOptions, GenerateOptions, InferenceOptions, MetricsOptions, TranscribeOptions
from framequilt.session import cut


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def planner_prompt(options: GenerateOptions) -> Column:
    names = ", ".join(c for fines in TAXONOMY.values() for c in fines)
    return _lines(
        f"Choose at most {options.max_categories} question categories that this clip can support, in {options.question_style} style. Categories: {names}.",
        F.concat(F.lit("Procedure: "), F.col("surgery_type")), F.concat(F.lit("Clip: "), F.col("caption")), F.concat(F.lit("Around it: "), F.col("context")),
        "Reply with one JSON object: sgm_summary, salient_entities, applicable_broad_categories, applicable_categories, notes_for_generator.",
    )


def generator_prompt(options: GenerateOptions) -> Column:
    return _lines(
        f"Write one {options.question_style} question and its answer for each category of the plan, from the clip alone.",
        F.concat(F.lit("Procedure: "), F.col("surgery_type")), F.concat(F.lit("Clip: "), F.col("caption")), F.concat(F.lit("Around it: "), F.col("context")), F.concat(F.lit("Plan: "), F.to_json("plan")),
        "Reply with a JSON array of objects: category, question, answer, rationale, evidence, format, choices, correct_choice.",
    )


def validator_prompt() -> Column:
    return _lines(
        "Judge whether the question and answer follow from the clip; five scores from 1 to 5.",
        F.concat(F.lit("Procedure: "), F.col("surgery_type")), F.concat(F.lit("Clip: "), F.col("caption")), F.concat(F.lit("Around it: "), F.col("context")), F.concat(F.lit("Candidate: "), F.to_json("candidate")),
        "Reply with one JSON object: keep, reason, scores, revised_answer, revised_question, dedup_key_hint.",
    )


def judge_prompt(df: DataFrame) -> Column:
    return _lines("Does the prediction say the same as the reference? Reply with a JSON object: score (1 or 0), reason.", F.concat(F.lit("Question: "), question(df)), F.concat(F.lit("Reference: "), reference(df)), F.concat(F.lit("Prediction: "), prediction(df)))


def answer_prompt(question: Column, choices: Column | None) -> Column:
    """Request of the vision models: the question, and the choices where there are any."""
    lines = F.transform(F.coalesce(choices, F.array().cast("array<string>")), lambda c: F.concat(F.lit("- "), c)) if choices is not None else F.array().cast("array<string>")
    return F.when(
        F.size(lines) > 0, _lines("Look at the frames, which are in order of time, and answer from them alone.", F.concat(F.lit("Question: "), question), "Choices:", F.array_join(lines, "\n"), "Name the best choice, with a short reason.")
    ).otherwise(_lines("Look at the frames, which are in order of time, and answer from them alone.", F.concat(F.lit("Question: "), question), "Answer shortly."))


def vision_request(rows: DataFrame, options: InferenceOptions) -> Column:
    """One JSON object per row: prompt, video, num_frames, max_output_tokens. The adapter takes the frames where it runs, so no picture goes through the plan."""
    choices = F.col("choices") if "choices" in rows.columns else None
    video = F.coalesce(*[F.col(c).cast("string") for c in ("video", "video_path") if c in rows.columns], F.lit(""))
    return F.to_json(F.struct(answer_prompt(inference_question(rows), choices).alias("prompt"), video.alias("video"), F.lit(options.num_frames).alias("num_frames"), F.lit(options.max_output_tokens).alias("max_output_tokens")))


def choose_clips(clips: DataFrame, procedures: DataFrame, done_segments: DataFrame | None = None, options: GenerateOptions = GenerateOptions(), types: DataFrame | None = None) -> DataFrame:
    """Clips to work on, with context and label. Context sees all clips of the video; sampling comes before skipping what is done.

    With ``type_source`` excel, surgery types are filtered by ``types`` (id, type); a video that it lacks has none.
    """
    rows = load_clips(clips, options.min_caption_len)
    rows = neighbour_context(rows, "youtube_id", ["start_sec", "end_sec", "segment_id", "line_no"], "caption", options.segment_radius)
    label = procedure_label(F.col("procedure"), F.col("procedure_name"), F.col("title"), F.col("specialty"))
    rows = rows.join(procedures, "youtube_id", "left").withColumn("surgery_type", label)
    if options.type_source == "excel":
        if types is None:
            raise ValueError("type_source excel needs the types of the workbooks")
        rows = rows.drop("surgery").join(types.select(F.col("id").alias("youtube_id"), F.col("type").alias("surgery")), "youtube_id", "left")
    rows = metadata_filter(rows, options.procedures, options.specialties, options.surgery_types).drop("procedure", "procedure_name", "title", "specialty", "surgery")
    rows = cap_groups(rows, "youtube_id", options.max_videos, options.seed)
    rows = sample_per_group(rows, "youtube_id", "line_no", options.segments_per_video, options.seed)
    if done_segments is not None:
        rows = rows.join(done_segments.select("segment_id").distinct(), "segment_id", "left_anti")
    return first_per_segment(rows, "segment_id", ["youtube_id", "start_sec", "end_sec", "line_no"])


def generate_questions(chosen: DataFrame, planner: Callable[[], Model], generator: Callable[[], Model], validator: Callable[[], Model], done_ids: DataFrame | None = None, options: GenerateOptions = GenerateOptions()) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected records. Each model stage is materialised; rules stand between the stages, so that no call is made for a row that they drop."""
    planned = ask(chosen.withColumn("request", planner_prompt(options)), "request", "reply", planner).withColumn("json", lenient_json("reply"))
    is_object = F.trim("json").startswith("{")
    failed_plan = planned.filter(F.col("reply_error").isNotNull() | ~F.coalesce(is_object, F.lit(False)))
    plans = planned.filter(F.col("reply_error").isNull() & is_object).withColumn("plan", normalize_plan(F.from_json("json", PLAN), F.col("caption"), options.max_categories)).drop("request", "reply", "reply_error", "json")
    usable = plans.filter(F.size("plan.applicable_categories") > 0)
    told = ask(usable.withColumn("request", generator_prompt(options)), "request", "reply", generator)
    failed_generate = told.filter("reply_error IS NOT NULL")
    parsed = told.filter("reply_error IS NULL").withColumn("candidates", F.from_json(lenient_json("reply"), CANDIDATES)).withColumn("allowed", F.col("plan.applicable_categories"))
    candidates = valid_candidates(parsed.drop("request", "reply", "reply_error"), "line_no", "candidates", "allowed").drop("allowed")
    if options.skip_validator:
        scores = "map('groundedness','5','temporal_alignment','5','answerability','5','non_triviality','5','hallucination_risk','5')"
        verdict = F.expr(f"named_struct('keep','true','reason','validator skipped','scores',{scores},'revised_answer',cast(null as string),'revised_question',cast(null as string),'dedup_key_hint','')")
        judged = candidates.withColumn("verdict", verdict)
        failed_validate = judged.limit(0)
    else:
        asked = ask(candidates.withColumn("request", validator_prompt()), "request", "reply", validator)
        failed_validate = asked.filter("reply_error IS NOT NULL")
        judged = asked.filter("reply_error IS NULL").withColumn("verdict", F.from_json(lenient_json("reply"), VERDICT)).drop("request", "reply", "reply_error")
    final = cut(finalize(judged, ["youtube_id", "start_sec", "line_no", "position"], options.min_score))
    if done_ids is not None:
        final = final.join(done_ids.select("id").distinct(), "id", "left_anti")
    rejected = (
        final.filter("NOT keep").select("segment_id", "youtube_id", F.lit("validate").alias("stage"), clean_text(F.col("verdict.reason")).alias("reason"), F.lit(None).cast("string").alias("error"), F.to_json("candidate").alias("candidate"))
        .unionByName(failed_plan.select("segment_id", "youtube_id", F.lit("plan").alias("stage"), F.lit(None).cast("string").alias("reason"), F.coalesce("reply_error", F.lit("the plan is no object")).alias("error"), F.lit(None).cast("string").alias("candidate")))
        .unionByName(failed_generate.select("segment_id", "youtube_id", F.lit("generate").alias("stage"), F.lit(None).cast("string").alias("reason"), F.col("reply_error").alias("error"), F.lit(None).cast("string").alias("candidate")))
        .unionByName(plans.filter(F.size("plan.applicable_categories") == 0).select("segment_id", "youtube_id", F.lit("plan").alias("stage"), F.lit("no applicable category").alias("reason"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("candidate")))
    )
    if not options.skip_validator:
        rejected = rejected.unionByName(failed_validate.select("segment_id", "youtube_id", F.lit("validate").alias("stage"), F.lit(None).cast("string").alias("reason"), F.col("reply_error").alias("error"), F.to_json("candidate").alias("candidate")))
    return accepted_rows(final, options.include_rationale), rejected


def evaluate(rows: DataFrame, options: MetricsOptions = MetricsOptions(), order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Overall and grouped metrics of the latest attempt of every row."""
    scored = cut(score_rows(latest_per_key(rows, metric_key(rows), order)))
    return overall_metrics(scored), grouped_metrics(scored, options.group_by)


def judge(rows: DataFrame, make_judge: Callable[[], Model], judged_before: DataFrame | None = None, options: MetricsOptions = MetricsOptions(), order: str = "line_no") -> DataFrame:
    """Rows with row_key, llm_judge_score, llm_judge_reason, llm_judge_model and llm_judge_raw: earlier verdicts of 0 or 1 are kept, rules decide what they can, the judge is asked for the rest only.

    Of several earlier rows of a key the last one in ``order`` decides. What is kept is the earlier row with all that it
    holds, an older prediction included; fields that it lacks come from the row of now.
    """
    keyed = rows.withColumn("row_key", metric_key(rows))
    verdict = ["llm_judge_score", "llm_judge_reason", "llm_judge_model", "llm_judge_raw"]
    fields = [c for c in rows.columns if c not in verdict]
    columns = [*fields, "row_key", *verdict]
    reused = None
    if judged_before is not None:
        old = judged_before if order in judged_before.columns else judged_before.withColumn(order, F.lit(0))
        both = cut(judged_before_rows(keyed.drop(*verdict), old, "row_key", order))
        kept = [F.col(f"old_row.{c}").alias(c) if c in judged_before.columns and c != "row_key" else F.col(c) for c in fields]
        said = [F.col(f"old_row.{c}").alias(c) if c in judged_before.columns else F.lit(None).cast("string").alias(c) for c in verdict]
        reused = both.filter("old_row IS NOT NULL").select(*kept, "row_key", *said)
        keyed = both.filter("old_row IS NULL").drop("old_score", "old_row")
    ruled = judge_without_call(keyed.drop(*verdict)).withColumns({"llm_judge_model": F.lit(options.judge_model), "llm_judge_raw": F.lit(None).cast("string")})
    asked = ask(ruled.filter("needs_call").drop("llm_judge_score", "llm_judge_reason", "llm_judge_raw", "needs_call").withColumn("request", judge_prompt(rows)), "request", "reply", make_judge)
    told = asked.withColumn("j", judge_reply("reply"))
    reason = F.when(F.col("reply_error").isNotNull(), F.concat(F.lit("Judge error: "), F.col("reply_error"))).otherwise(F.col("j.reason"))
    out = ruled.filter("NOT needs_call").select(*columns).unionByName(told.withColumns({"llm_judge_score": F.when(F.col("reply_error").isNull(), F.col("j.score")), "llm_judge_reason": reason, "llm_judge_raw": F.col("reply")}).select(*columns))
    return out if reused is None else out.unionByName(reused)


def evaluate_judged(rows: DataFrame, make_judge: Callable[[], Model], judged_before: DataFrame | None = None, options: MetricsOptions = MetricsOptions(), order: str = "line_no") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The latest attempt of every row, judged; overall and grouped metrics of these rows. Returns (judged, overall, grouped)."""
    judged = cut(judge(latest_per_key(rows, metric_key(rows), order).drop("first_seen"), make_judge, judged_before, options, order))
    scored = cut(score_rows(judged))
    return judged, overall_metrics(scored), grouped_metrics(scored, options.group_by)


def predict(rows: DataFrame, make_model: Callable[[], Model], done: DataFrame | None = None, options: InferenceOptions = InferenceOptions(), order: str = "line_no") -> DataFrame:
    """Predictions for rows without a successful one, with gt_answer and error; failures keep their error and are tried again next time. Duplicate input rows are each asked.

    The limit counts input rows in their order; a rank takes every ``world``-th of these. Successful is a row without any
    error (a text of whatever kind is one here) and with a prediction.
    """
    if options.limit > 0:
        rows = first_rows(rows, order, options.limit)
    if options.world > 1:
        rows = rank_shard(rows, order, options.rank, options.world)
    keyed = rows.withColumn("row_key", inference_key(rows))
    if done is not None and not options.overwrite:
        good = done.filter(F.col("error").isNull() & (prediction(done) != "")) if "error" in done.columns else done.filter(prediction(done) != "")
        keyed = keyed.join(good.select(inference_key(good).alias("row_key")).distinct(), "row_key", "left_anti")
    fresh = keyed.drop("prediction", "error")
    asked = ask(fresh.withColumn("request", vision_request(rows, options)), "request", "prediction", make_model)
    return asked.withColumn("gt_answer", inference_answer(rows)).withColumnRenamed("prediction_error", "error").drop("request")


TRANSCRIPT = "struct<text string, segments array<struct<start double, end double, text string>>, words array<struct<start double, end double, word string>>>"


def transcribe(batch: DataFrame, make_model: Callable[[], Model], options: TranscribeOptions = TranscribeOptions()) -> DataFrame:
    """Chunks of the videos that are to run, each with its transcript (null and an error where the model failed): folder, path, chunk_no, start_sec, end_sec, transcript, error.

    ``batch`` is a ``transcription_batch`` with size_bytes and seconds of the audio; each chunk is asked for on its own,
    so a long video is spread over many tasks. The reply is a JSON object with text, segments and words.
    """
    chunks = batch.filter("status = 'to_run'").select("folder", "path", F.explode(audio_chunk_plan(F.col("size_bytes"), F.col("seconds"), options.max_file_mb)).alias("c")).select("folder", "path", "c.*")
    request = F.to_json(F.struct("path", "start_sec", "end_sec", F.lit(options.backend).alias("backend")))
    told = ask(chunks.withColumn("request", request), "request", "reply", make_model)
    read = F.from_json(lenient_json("reply"), TRANSCRIPT)
    error = F.coalesce("reply_error", F.when(F.col("transcript.text").isNull(), F.lit("the reply is no transcript")))
    rows = told.withColumn("transcript", read).withColumn("error", error)
    return rows.withColumn("transcript", F.when(F.col("error").isNull(), F.col("transcript"))).drop("request", "reply", "reply_error")


def transcription_counts(batch: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many titles were processed, skipped as missing, skipped as done, or failed (all of their chunks did): status, n."""
    bad = chunks.groupBy("folder").agg(F.every(F.col("error").isNotNull()).alias("__failed"))
    rows = batch.join(bad, "folder", "left")
    return count_by(rows, "status", F.when(F.col("status") != "to_run", F.col("status")).when(F.col("__failed"), "failed").otherwise("processed"))


def crop_summary(selected: DataFrame, catalogue: DataFrame, windows: DataFrame, done: DataFrame | None = None, options: CropOptions = CropOptions()) -> DataFrame:
    """Status of every selected id: missing_video, skipped_existing, skipped_small_border, dry_run or to_crop, with the borders.

    windows: path, video_w, video_h, x, y, w, h as an analysis of frames gives them.
    """
    rows = selected.join(catalogue, selected["id"] == catalogue["stem"], "left").drop("stem")
    if done is not None:
        rows = rows.join(done.select(F.col("stem").alias("id"), F.lit(True).alias("exists")), "id", "left")
    else:
        rows = rows.withColumn("exists", F.lit(False))
    rows = rows.join(windows, "path", "left").withColumn("b", borders(*[F.col(c) for c in ("video_w", "video_h", "x", "y", "w", "h")], options.min_border_pct, options.min_border_px))
    status = (
        F.when(F.col("path").isNull(), "missing_video").when(F.col("exists"), "skipped_existing").when(~F.col("b.crop_needed"), "skipped_small_border").otherwise("dry_run" if options.dry_run else "to_crop")
    )
    return rows.withColumn("status", status)
