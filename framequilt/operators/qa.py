"""Rules around question generation: taxonomy, plans, candidates, verdicts, final records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequilt.functions.text import clean_text
from framequilt.functions.values import record_uid

# The categories by broad category, in their order.
TAXONOMY = {
    "perception_identification": ("entity_existence", "entity_state", "spatial_relation"),
    "action_procedural_state": ("instrument_tissue_interaction", "operative_action"),
    "operative_reasoning": ("maneuver_rationale", "decision_justification"),
    "temporal_predictive": ("procedural_sequence", "next_step_prediction"),
    "risk_anatomy_identification": ("risk_anatomy_identification",),
}
# Names of the scores of a verdict, and the least length of questions and answers.
SCORES = ("groundedness", "temporal_alignment", "answerability", "non_triviality", "hallucination_risk")
LEAST_LENGTH = 8

BROAD = {fine: broad for broad, fines in TAXONOMY.items() for fine in fines}
PLAN = "struct<sgm_summary string, salient_entities array<string>, applicable_broad_categories array<string>, applicable_categories array<string>, notes_for_generator array<string>>"
CANDIDATES = "array<struct<category string, question string, answer string, rationale string, evidence string, format string, choices array<string>, correct_choice string>>"
VERDICT = "struct<keep string, reason string, scores map<string,string>, revised_answer string, revised_question string, dedup_key_hint string>"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def broad_category(fine: Column) -> Column:
    """Broad category, '' for an unknown one."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in BROAD.items() for x in kv])[fine], F.lit(""))


def known_categories(categories: Column, most: int) -> Column:
    """The first ``most`` known categories in the given order, repetitions kept."""
    return F.slice(F.filter(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.array_contains(_strings(BROAD), c)), 1, most)


def normalize_plan(plan: Column, caption: Column, most: int = 3) -> Column:
    """Plan with known categories only; broad ones are derived where none is given."""
    fine = known_categories(plan["applicable_categories"], most)
    given = F.filter(F.coalesce(plan["applicable_broad_categories"], F.array().cast("array<string>")), lambda b: F.array_contains(_strings(TAXONOMY), b))
    derived = F.array_distinct(F.transform(fine, broad_category))

    def cleaned(field: str) -> Column:
        return F.filter(F.transform(F.coalesce(plan[field], F.array().cast("array<string>")), clean_text), lambda s: s != "")

    return F.struct(
        clean_text(F.coalesce(plan["sgm_summary"], F.substring(caption, 1, 180))).alias("sgm_summary"), cleaned("salient_entities").alias("salient_entities"),
        F.when(F.size(given) > 0, given).otherwise(derived).alias("applicable_broad_categories"), fine.alias("applicable_categories"), cleaned("notes_for_generator").alias("notes_for_generator"),
    )


def valid_candidates(df: DataFrame, key: str, candidates: str, allowed: str) -> DataFrame:
    """Candidates exploded and filtered by the rules; of each category the first that passes them all. Adds position and candidate."""
    rows = df.select("*", F.posexplode(candidates).alias("position", "__item")).drop(candidates)
    fmt = F.lower(F.trim(F.coalesce(F.col("__item.format"), F.lit("open"))))
    fmt = F.when(fmt.isin("open", "mcq"), fmt).otherwise("open")
    mcq = fmt == "mcq"
    choice = F.expr("try_cast(__item.correct_choice AS int)")
    c = F.struct(
        F.trim(F.coalesce(F.col("__item.category"), F.lit(""))).alias("category"), clean_text(F.col("__item.question")).alias("question"), clean_text(F.col("__item.answer")).alias("answer"),
        clean_text(F.col("__item.rationale")).alias("rationale"), clean_text(F.col("__item.evidence")).alias("evidence"), fmt.alias("format"),
        F.when(mcq, F.transform(F.col("__item.choices"), clean_text)).otherwise(F.array().cast("array<string>")).alias("choices"), F.when(mcq, choice).alias("correct_choice"),
    )
    rows = rows.withColumn("candidate", c).drop("__item")
    ok = F.array_contains(F.col(allowed), F.col("candidate.category")) & (F.length("candidate.question") >= LEAST_LENGTH) & (F.length("candidate.answer") >= LEAST_LENGTH)
    ok = ok & ((F.col("candidate.format") == "open") | ((F.size("candidate.choices") == 4) & F.col("candidate.correct_choice").between(0, 3)))
    first = F.row_number().over(Window.partitionBy(key, "candidate.category").orderBy("position"))
    return rows.filter(F.coalesce(ok, F.lit(False))).withColumn("__first", first).filter("__first = 1").drop("__first")


def scores_of(verdict: Column) -> Column:
    """The five scores as integers (towards zero); a missing one counts 1."""
    return F.struct(*[F.coalesce(F.try_element_at(verdict["scores"], F.lit(s)).try_cast("double").cast("int"), F.lit(1)).alias(s) for s in SCORES])


def score_gate(keep: Column, scores: Column, least: int = 4) -> Column:
    """Kept where the verdict says so and its lowest score suffices."""
    return F.coalesce(keep, F.lit(False)) & (F.least(*[scores[s] for s in SCORES]) >= least)


def truthy(text: Column) -> Column:
    """A flag as text: everything but '', 0, null and the JSON value false counts, the word "False" in quotes included."""
    return F.coalesce(~text.isin("", "false", "0", "null"), F.lit(False))


def finalize(df: DataFrame, order: list[str], least: int = 4) -> DataFrame:
    """Adds final_question, final_answer, id, scores, keep; rows that repeat the id of an earlier kept row are dropped.

    Needs video_path, start_sec, end_sec, candidate and verdict. Rejected rows register no id.
    """
    q = F.coalesce(F.nullif(clean_text(F.col("verdict.revised_question")), F.lit("")), F.col("candidate.question"))
    a = F.coalesce(F.nullif(clean_text(F.col("verdict.revised_answer")), F.lit("")), F.col("candidate.answer"))
    rows = df.withColumns({"final_question": q, "final_answer": a, "scores": scores_of(F.col("verdict"))})
    rows = rows.withColumns({"id": record_uid(F.col("video_path"), F.col("start_sec"), F.col("end_sec"), F.col("candidate.category"), F.col("final_question"), F.col("final_answer")), "keep": score_gate(truthy(F.col("verdict.keep")), F.col("scores"), least)})
    kept_before = F.sum(F.col("keep").cast("int")).over(Window.partitionBy("id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__before", F.coalesce(kept_before, F.lit(0))).filter("__before = 0").drop("__before")


def chat_messages(question: Column, answer: Column, rationale: Column | None = None) -> Column:
    """A user and an assistant message; the rationale follows the answer where it is asked for and not blank."""
    told = answer if rationale is None else F.when(F.coalesce(F.trim(rationale), F.lit("")) != "", F.concat(answer, F.lit("\n\nReasoning: "), rationale)).otherwise(answer)
    return F.array(F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), told.alias("content")))


def accepted_rows(final: DataFrame, include_rationale: bool = False) -> DataFrame:
    """Accepted records in their wide form."""
    c, p, v = (lambda f, s=s: F.col(f"{s}.{f}") for s in ("candidate", "plan", "verdict"))
    chat = chat_messages(F.col("final_question"), F.col("final_answer"), c("rationale") if include_rationale else None)
    return final.filter("keep").select(
        "id", "video_path", "youtube_id", "segment_id", "start_sec", "end_sec", "duration_sec", "surgery_type",
        broad_category(c("category")).alias("broad_category"), c("category"), F.col("final_question").alias("question"), F.col("final_answer").alias("answer"), c("format"), c("choices"), c("correct_choice"),
        F.col("caption").alias("source_caption"), F.col("context").alias("context_caption"), p("sgm_summary"), p("salient_entities"), p("applicable_broad_categories"), p("applicable_categories"),
        c("rationale").alias("generator_rationale"), c("evidence").alias("generator_evidence"), clean_text(v("reason")).alias("validator_reason"), F.col("scores").alias("validator_scores"), chat.alias("messages"),
    )
