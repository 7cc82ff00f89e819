"""Evaluation metrics of predictions, overall and by groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequilt.functions.scores import exact_match, rouge_l, token_f1
from framequilt.functions.text import clean_str, strip_media, strip_ws
from framequilt.operators.selection import stated_error

# Names under which tables hold the fields, first non-null wins.
IDS = ("id", "uid", "sample_id", "question_id")
PREDICTION = ("prediction", "pred", "model_prediction", "model_answer", "response", "output_text", "generated_text")
REFERENCE = ("gt_answer", "reference", "ground_truth", "target", "label", "gold_answer")
QUESTION = ("question", "prompt", "query")
GROUPS = ("category", "broad_category", "open_split", "merged_specialty", "specialty", "surgery_type", "merged_surgery_type", "format")


def _have(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(n).cast("string") for n in names if n in df.columns]


def _turn(df: DataFrame, *roles: str) -> list[Column]:
    """First turn of exactly these speakers (no folding of case here)."""
    if "conversations" not in df.columns:
        return []
    said = F.filter("conversations", lambda t: t["from"].isin(*roles))
    return [F.get(said, F.lit(0))["value"]]


def prediction(df: DataFrame) -> Column:
    return clean_str(F.coalesce(*_have(df, PREDICTION), F.lit("")))


def reference(df: DataFrame) -> Column:
    return clean_str(F.coalesce(*_have(df, REFERENCE), *_turn(df, "gpt", "assistant"), F.lit("")))


def question(df: DataFrame) -> Column:
    return strip_ws(strip_media(clean_str(F.coalesce(*_have(df, QUESTION), *_turn(df, "human", "user"), F.lit("")))))


def _truthy_id(df: DataFrame) -> list[Column]:
    """Ids as text; empty text, zero and false fall through."""
    out = []
    for name in IDS:
        if name in df.columns:
            kind = dict(df.dtypes)[name]
            c = F.col(name)
            bad = (c == "") if kind == "string" else (~c) if kind == "boolean" else (c == 0)
            out.append(F.when(~bad, c.cast("string")))
    return out


def metric_key(df: DataFrame) -> Column:
    """Row key of the metrics: an id, else segment (null reads as 'None') and question, else video and question."""
    q = question(df)
    has = "segment_id" in df.columns
    segment = F.coalesce(F.col("segment_id").cast("string"), F.lit("None")) if has else F.lit("")
    video = F.coalesce(*_have(df, ("video", "video_path")), F.lit(""))
    return F.coalesce(*_truthy_id(df), F.when((segment != "") | (q != ""), F.concat(segment, F.lit("|||"), q)), F.concat(video, F.lit("|||"), q))


def _first_said(df: DataFrame, *roles: str) -> list[Column]:
    """First turn of these speakers that isn't blank."""
    if "conversations" not in df.columns:
        return []
    said = F.filter(F.transform(F.filter("conversations", lambda t: t["from"].isin(*roles)), lambda t: clean_str(t["value"])), lambda v: v != "")
    return [F.get(said, F.lit(0))]


def inference_question(df: DataFrame) -> Column:
    """Question of the inference programs: the conversation comes first, then question, prompt. A field that is null counts as absent."""
    return strip_ws(strip_media(F.coalesce(*_first_said(df, "human", "user"), clean_str(F.coalesce(*_have(df, ("question", "prompt")), F.lit(""))))))


def inference_answer(df: DataFrame) -> Column:
    """Reference answer of the inference programs: the conversation comes first, then gt_answer, reference, answer."""
    return F.coalesce(*_first_said(df, "gpt", "assistant"), clean_str(F.coalesce(*_have(df, ("gt_answer", "reference", "answer")), F.lit(""))))


def inference_key(df: DataFrame) -> Column:
    """Row key of the inference programs: as above, but by their own question; a null segment reads as '' and the last resort is the video alone."""
    q = inference_question(df)
    segment = clean_str(F.col("segment_id")) if "segment_id" in df.columns else F.lit("")
    video = clean_str(F.coalesce(*_have(df, ("video", "video_path")), F.lit("")))
    return F.coalesce(*_truthy_id(df), F.when((segment != "") | (q != ""), F.concat(segment, F.lit("|||"), q)), video)


def score_rows(df: DataFrame) -> DataFrame:
    """Adds status columns and the three scores. Scores are computed once per row, null unless the row counts as a success."""
    judged = "llm_judge_score" in df.columns
    out = df.withColumns({"m_error": stated_error(F.col("error")) if "error" in df.columns else F.lit(None).cast("string"), "m_pred": prediction(df), "m_ref": reference(df)})
    ok = F.col("m_error").isNull() & (F.col("m_ref") != "")
    p, r = F.when(ok, F.col("m_pred")).otherwise(""), F.when(ok, F.col("m_ref")).otherwise("")
    return out.withColumns(
        {
            "m_ok": ok,
            "m_em": F.when(ok, exact_match(p, r)),
            "m_f1": F.when(ok, token_f1(p, r)),
            "m_rouge": F.when(ok, rouge_l(p, r)),
            "m_judge": F.when(ok & F.col("llm_judge_score").isin(0, 1), F.col("llm_judge_score")) if judged else F.lit(None).cast("int"),
            "m_unjudged": (ok & ~F.coalesce(F.col("llm_judge_score").isin(0, 1), F.lit(False))) if judged else F.lit(False),
        }
    )


def _aggregates(fine: Column, no_prediction: Column, no_reference: Column) -> list[Column]:
    n = F.count_if("m_ok")

    def mean(c: str) -> Column:
        # six decimals: sums of doubles depend on the order of rows
        return F.round(F.try_divide(F.sum(c), n), 6)

    return [
        F.count("*").alias("n_total"), n.alias("n_success"), F.count_if(~fine).alias("n_error"),
        F.count_if(fine & no_prediction).alias("n_missing_prediction"), F.count_if(fine & no_reference).alias("n_missing_reference"),
        mean("m_em").alias("exact_match"), mean("m_f1").alias("token_f1"), mean("m_rouge").alias("rouge_l"),
        F.count("m_judge").alias("llm_judge_n"), F.round(F.avg("m_judge"), 6).alias("llm_judge_accuracy"), F.count_if("m_unjudged").alias("llm_judge_missing"),
    ]


def overall_metrics(scored: DataFrame) -> DataFrame:
    return scored.agg(*_aggregates(F.col("m_error").isNull(), F.col("m_pred") == "", F.col("m_ref") == ""))


def grouped_metrics(scored: DataFrame, fields: Sequence[str] = GROUPS) -> DataFrame:
    """One row per field and non-null value ('' is a value); fields that the table lacks are skipped. Each field is grouped for itself; one shuffle serves all."""
    have = [f for f in fields if f in scored.columns]
    kinds = dict(scored.dtypes)

    def text(f: str) -> Column:
        c = F.col(f)
        return F.initcap(c.cast("string")) if kinds[f] == "boolean" else c.cast("string")

    # texts stay behind: only what they say about the row is spread over the fields
    scored = scored.withColumns({"m_no_pred": F.col("m_pred") == "", "m_no_ref": F.col("m_ref") == "", "m_fine": F.col("m_error").isNull()})
    entries = F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in have]).cast("array<struct<field string, value string>>")
    long = scored.select("m_fine", "m_no_pred", "m_no_ref", "m_ok", "m_em", "m_f1", "m_rouge", "m_judge", "m_unjudged", F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("g"))
    return long.groupBy(F.col("g.field").alias("field"), F.col("g.value").alias("value")).agg(*_aggregates(F.col("m_fine"), F.col("m_no_pred"), F.col("m_no_ref")))


def judge_without_call(df: DataFrame) -> DataFrame:
    """The verdicts that need no judge: columns llm_judge_score, llm_judge_reason, needs_call. Split on needs_call before calling: a branch around a UDF would still call it for every row."""
    error = stated_error(F.col("error")) if "error" in df.columns else F.lit(None).cast("string")
    empty, missing = prediction(df) == "", reference(df) == ""
    # Reasons that need no judge.
    reason = F.when(error.isNotNull(), F.concat(F.lit("Skipped due to row error: "), error)).when(empty, "Empty prediction.").when(missing, "Missing reference answer.")
    return df.withColumns({"llm_judge_score": F.when(error.isNull() & empty, F.lit(0)), "llm_judge_reason": reason, "needs_call": error.isNull() & ~empty & ~missing})


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and percentage of each value, most frequent first, ties by name. The total is summed from the groups, not from the rows again."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / total, 4)).orderBy(F.desc("n"), *columns)
