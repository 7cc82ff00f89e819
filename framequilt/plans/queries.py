"""Queries of the core operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequilt.functions.scores import exact_match, rouge_l, token_f1
from framequilt.functions.text import ANSWERING, ASKING, clean_text, file_name, file_stem, first_turn, normalize_text, strip_media, strip_ws, video_key
from framequilt.functions.values import audio_chunk_plan, borders, component_score, crop_filter, crop_sample_times, eval_sample_times, even_int, expand_box, implausible_box, record_uid, restrict_window, safe_dir_name, safe_folder_name, timestamp
from framequilt.operators import qa, selection, training, transcripts
from framequilt.operators.context import first_per_segment, load_clips, neighbour_context
from framequilt.operators.metrics import distribution, grouped_metrics, inference_answer, inference_key, inference_question, judge_without_call, metric_key, overall_metrics, prediction, question, reference, score_rows
from framequilt.session import scratch, table
from framequilt.sources.readers import first_types, tolerant_jsonl
from framequilt.sources.sinks import output_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Parts of the SQL that many queries share.
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
CLEAN = r"trim(regexp_replace(coalesce({}, ''), '[\s\p{{Z}}]+', ' ', 'g'))"
NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"
TURN = r"""(list_filter({}, lambda t: lower(regexp_replace(t."from", '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) IN ({}))[1]).value"""
EXACT_TURN = """(list_filter({}, lambda t: t."from" IN ({}))[1]).value"""
QUESTION = STRIP.format("replace(replace(coalesce(" + EXACT_TURN.format("conversations", "'human','user'") + ", ''), '<video>', ''), '<image>', '')")
ERROR = f"CASE WHEN lower({STRIP.format('''coalesce(error, '')''')}) NOT IN ('', 'none', 'null') THEN {STRIP.format('error')} END"
PRED = STRIP.format("coalesce(prediction, '')")
REF = STRIP.format("coalesce(gt_answer, " + EXACT_TURN.format("conversations", "'gpt','assistant'") + ", '')")
KEY = rf"""coalesce(nullif({STRIP.format('youtube_id')}, ''), nullif(substr(regexp_extract({STRIP.format('video')}, '([^/\\]*)$', 1), 1, 11), ''))"""
TOKENS = "list_filter(string_split({}, ' '), lambda t: t <> '')"
TIME = """CASE WHEN {0} IS NOT NULL THEN printf('%02d:%02d:%02d.%03d',
  CAST(floor((floor({0}) + CASE WHEN round_even(({0} - floor({0})) * 1000, 0) = 1000 THEN 1 ELSE 0 END) / 3600) AS BIGINT),
  CAST(floor((floor({0}) + CASE WHEN round_even(({0} - floor({0})) * 1000, 0) = 1000 THEN 1 ELSE 0 END) % 3600 / 60) AS BIGINT),
  CAST((floor({0}) + CASE WHEN round_even(({0} - floor({0})) * 1000, 0) = 1000 THEN 1 ELSE 0 END) % 60 AS BIGINT),
  CAST(round_even(({0} - floor({0})) * 1000, 0) AS BIGINT) % 1000) END"""


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


# ---- text


@query(f"SELECT doc_id, {CLEAN.format('text')} AS cleaned FROM documents")
def clean_text_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {NORM.format('text')} AS normalized FROM documents")
def normalize_text_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", normalize_text(F.col("text")).alias("normalized"))


@query(f"""SELECT line_no, {KEY} AS video_key, regexp_extract(video, '([^/]*)$', 1) AS file_name, regexp_replace(regexp_extract(video, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS stem FROM clip_captions""")
def video_names(spark, d):
    v = F.col("video")
    return _t(spark, d, "clip_captions").select("line_no", video_key(F.col("youtube_id"), v).alias("video_key"), file_name(v).alias("file_name"), file_stem(v).alias("stem"))


@query(f"""SELECT row_id, {STRIP.format("replace(replace(" + TURN.format('conversations', "'human','user'") + ", '<video>', ''), '<image>', '')")} AS question, {TURN.format('conversations', "'gpt','assistant'")} AS answer FROM vqa_rows""")
def first_turns(spark, d):
    c = F.col("conversations")
    return _t(spark, d, "vqa_rows").select("row_id", strip_ws(strip_media(first_turn(c, ASKING))).alias("question"), first_turn(c, ANSWERING).alias("answer"))


@query(f"""SELECT pred_id, {STRIP.format("trim(regexp_replace(translate(prediction, '<>:\"/\\|?*', '_________'), '[\\s\\p{Z}]+', ' ', 'g'))").replace('{Z}', '{Z}')}[1:200] AS folder FROM predictions""")
def safe_folder_names(spark, d):
    return _t(spark, d, "predictions").select("pred_id", F.when(F.col("prediction").isNotNull(), safe_folder_name(F.col("prediction"))).alias("folder"))


@query("SELECT line_no, coalesce(nullif(regexp_replace(substr(regexp_replace(segment_id, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80), '^_+|_+$', '', 'g'), ''), 'row') AS dir FROM clip_captions")
def safe_dir_names(spark, d):
    return _t(spark, d, "clip_captions").select("line_no", safe_dir_name(F.col("segment_id")).alias("dir"))


@query("""SELECT line_no, 'out/' || regexp_replace(regexp_extract(video, '([^/]*)$', 1), '^(.+)\\.([^.]*)$', '\\1_cropped.\\2') AS target FROM clip_captions""")
def output_paths(spark, d):
    return _t(spark, d, "clip_captions").select("line_no", output_path(F.col("video"), "out").alias("target"))


# ---- scores and metrics

_SCORED = f"""latest AS (SELECT max_by(p, pred_id) AS r FROM (SELECT p, p.pred_id, coalesce(p.segment_id, 'None') || '|||' || {QUESTION.replace('conversations', 'p.conversations')} AS k FROM predictions p) GROUP BY k),
f AS (SELECT r.pred_id, r.category, r.format, r.model, {ERROR.replace('error', 'r.error')} AS e, {PRED.replace('prediction', 'r.prediction')} AS p, {REF.replace('gt_answer', 'r.gt_answer').replace('conversations', 'r.conversations')} AS g FROM latest),
n AS (SELECT *, e IS NULL AND g <> '' AS ok, {NORM.format('p')} AS np, {NORM.format('g')} AS ng FROM f),
w AS (SELECT *, {TOKENS.format('np')} AS tp, {TOKENS.format('ng')} AS tg FROM n),
s AS (SELECT *, CASE WHEN ok THEN CAST(np = ng AS DOUBLE) END AS em,
  CASE WHEN NOT ok THEN NULL WHEN len(tp) = 0 AND len(tg) = 0 THEN 1.0 WHEN len(tp) = 0 OR len(tg) = 0 THEN 0.0
       ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(tp), lambda t: least(len(list_filter(tp, lambda x: x = t)), len(list_filter(tg, lambda x: x = t))))), 0) / (len(tp) + len(tg)) END AS f1 FROM w)"""
_AGG = """count(*) AS n_total, count(*) FILTER (ok) AS n_success, count(*) FILTER (e IS NOT NULL) AS n_error, count(*) FILTER (e IS NULL AND p = '') AS n_missing_prediction,
count(*) FILTER (e IS NULL AND g = '') AS n_missing_reference, round(sum(em) / nullif(count(*) FILTER (ok), 0), 6) AS exact_match, round(sum(f1) / nullif(count(*) FILTER (ok), 0), 6) AS token_f1"""


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "predictions").withColumnRenamed("pred_id", "line_no")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = _numbered(spark, d)
    return score_rows(selection.latest_per_key(rows, metric_key(rows), "line_no", ["category", "format", "model", "prediction", "gt_answer", "conversations", "error"]))


_METRICS = ["n_total", "n_success", "n_error", "n_missing_prediction", "n_missing_reference", "exact_match", "token_f1"]


@query(f"WITH {_SCORED} SELECT {_AGG} FROM s")
def metrics_overall(spark, d):
    return overall_metrics(_scored(spark, d)).select(*_METRICS)


@query(f"WITH {_SCORED}, l AS (SELECT unnest([{{'field': 'category', 'value': category}}, {{'field': 'format', 'value': format}}, {{'field': 'model', 'value': model}}]) AS q, * FROM s) SELECT q.field AS field, q.value AS value, {_AGG} FROM l WHERE q.value IS NOT NULL GROUP BY 1, 2")
def metrics_grouped(spark, d):
    return grouped_metrics(_scored(spark, d), ["category", "format", "model"]).select("field", "value", *_METRICS)


@query(f"""WITH RECURSIVE {_SCORED}, dp AS (SELECT pred_id, tp, tg, 0 AS i, list_transform(range(len(tg) + 1), lambda x: CAST(0 AS BIGINT)) AS r FROM s WHERE ok
 UNION ALL SELECT pred_id, tp, tg, i + 1, list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND tg[k - 1] = tp[i + 1] THEN greatest(r[k], r[k - 1] + 1) ELSE r[k] END))) FROM dp WHERE i < len(tp)),
c AS (SELECT pred_id, max(list_max(r)) AS n FROM dp GROUP BY pred_id),
sr AS (SELECT s.*, CASE WHEN NOT ok THEN NULL WHEN len(tp) = 0 AND len(tg) = 0 THEN 1.0 WHEN len(tp) = 0 OR len(tg) = 0 THEN 0.0 ELSE 2.0 * c.n / (len(tp) + len(tg)) END AS rg FROM s LEFT JOIN c USING (pred_id)),
l AS (SELECT unnest([{{'field': 'category', 'value': category}}, {{'field': 'format', 'value': format}}, {{'field': 'model', 'value': model}}]) AS q, * FROM sr)
SELECT q.field AS field, q.value AS value, {_AGG}, round(sum(rg) / nullif(count(*) FILTER (ok), 0), 6) AS rouge_l, 0 AS llm_judge_n, CAST(NULL AS DOUBLE) AS llm_judge_accuracy, 0 AS llm_judge_missing FROM l WHERE q.value IS NOT NULL GROUP BY 1, 2""")
def metrics_with_rouge(spark, d):
    return grouped_metrics(_scored(spark, d), ["category", "format", "model"])


@query(f"""WITH n AS (SELECT pred_id, {NORM.format('prediction')} AS p, {NORM.format('gt_answer')} AS g FROM predictions), w AS (SELECT *, {TOKENS.format('p')} AS tp, {TOKENS.format('g')} AS tg FROM n)
SELECT pred_id, CAST(p = g AS DOUBLE) AS em, CASE WHEN len(tp) = 0 AND len(tg) = 0 THEN 1.0 WHEN len(tp) = 0 OR len(tg) = 0 THEN 0.0 ELSE round(2.0 * coalesce(list_sum(list_transform(list_distinct(tp), lambda t: least(len(list_filter(tp, lambda x: x = t)), len(list_filter(tg, lambda x: x = t))))), 0) / (len(tp) + len(tg)), 6) END AS f1 FROM w""")
def token_f1_pairs(spark, d):
    p, g = F.col("prediction"), F.col("gt_answer")
    return _t(spark, d, "predictions").select("pred_id", exact_match(p, g).alias("em"), F.round(token_f1(p, g), 6).alias("f1"))


@query(f"""WITH RECURSIVE n AS (SELECT pred_id, {NORM.format('prediction')} AS p, {NORM.format('gt_answer')} AS g FROM predictions), w AS (SELECT pred_id, {TOKENS.format('p')} AS tp, {TOKENS.format('g')} AS tg FROM n),
dp AS (SELECT pred_id, 0 AS i, list_transform(range(len(tg) + 1), lambda x: CAST(0 AS BIGINT)) AS r FROM w
 UNION ALL SELECT dp.pred_id, i + 1, list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND tg[k - 1] = tp[i + 1] THEN greatest(r[k], r[k - 1] + 1) ELSE r[k] END)))
 FROM dp JOIN w USING (pred_id) WHERE i < len(tp)),
l AS (SELECT pred_id, max(list_max(r)) AS n FROM dp GROUP BY pred_id)
SELECT pred_id, CASE WHEN len(tp) = 0 AND len(tg) = 0 THEN 1.0 WHEN len(tp) = 0 OR len(tg) = 0 THEN 0.0 ELSE round(2.0 * n / (len(tp) + len(tg)), 6) END AS rouge_l FROM w JOIN l USING (pred_id)""")
def rouge_l_pairs(spark, d):
    return _t(spark, d, "predictions").select("pred_id", F.round(rouge_l(F.col("prediction"), F.col("gt_answer")), 6).alias("rouge_l"))


@query(f"SELECT pred_id, {PRED} AS p, {REF} AS g, {QUESTION} AS q, {ERROR} AS e FROM predictions")
def resolved_fields(spark, d):
    rows = _t(spark, d, "predictions")
    return rows.select("pred_id", prediction(rows).alias("p"), reference(rows).alias("g"), question(rows).alias("q"), selection.stated_error(F.col("error")).alias("e"))


@query(f"""SELECT pred_id, coalesce(segment_id, 'None') || '|||' || {QUESTION} AS metric_key,
CASE WHEN {STRIP.format("coalesce(segment_id, '')")} <> '' OR {QUESTION} <> '' THEN {STRIP.format("coalesce(segment_id, '')")} || '|||' || {QUESTION} ELSE {STRIP.format("coalesce(video, '')")} END AS inference_key FROM predictions""")
def row_keys(spark, d):
    rows = _t(spark, d, "predictions")
    return rows.select("pred_id", metric_key(rows).alias("metric_key"), inference_key(rows).alias("inference_key"))


_SAID = "list_filter(list_transform(list_filter(conversations, lambda t: t.\"from\" IN ({0})), lambda t: " + STRIP.format("coalesce(t.value, '')").replace("{", "{{").replace("}", "}}") + "), lambda v: v <> '')[1]"


@query(f"""SELECT pred_id, {STRIP.format("replace(replace(coalesce(" + _SAID.format("'human','user'") + ", ''), '<video>', ''), '<image>', '')")} AS question, coalesce({_SAID.format("'gpt','assistant'")}, {STRIP.format("coalesce(gt_answer, '')")}) AS answer FROM predictions""")
def inference_fields(spark, d):
    rows = _t(spark, d, "predictions")
    return rows.select("pred_id", inference_question(rows).alias("question"), inference_answer(rows).alias("answer"))


@query(f"""WITH k AS (SELECT pred_id, attempt, coalesce(segment_id, 'None') || '|||' || {QUESTION} AS key FROM predictions)
SELECT max(pred_id) AS pred_id, max_by(attempt, pred_id) AS attempt, min(pred_id) AS first_seen FROM k GROUP BY key""")
def dedup_latest(spark, d):
    rows = _numbered(spark, d)
    return selection.latest_per_key(rows, metric_key(rows), "line_no", ["line_no", "attempt"]).select(F.col("line_no").alias("pred_id"), "attempt", "first_seen")


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {NORM.format('text')}")
def first_wins(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "text")
    return selection.first_per_key(rows, normalize_text(F.col("text")), "doc_id", ["doc_id"])


@query(f"SELECT pred_id, CASE WHEN {ERROR} IS NULL AND {PRED} = '' THEN 0 END AS llm_judge_score, CASE WHEN {ERROR} IS NOT NULL THEN 'Skipped due to row error: ' || {ERROR} WHEN {PRED} = '' THEN 'Empty prediction.' WHEN {REF} = '' THEN 'Missing reference answer.' END AS llm_judge_reason, {ERROR} IS NULL AND {PRED} <> '' AND {REF} <> '' AS needs_call FROM predictions")
def judge_rules(spark, d):
    return judge_without_call(_t(spark, d, "predictions")).select("pred_id", "llm_judge_score", "llm_judge_reason", "needs_call")


@query("SELECT p.pred_id, o.pred_id % 3 AS old_score FROM predictions p LEFT JOIN (SELECT max(pred_id) AS pred_id, row_id FROM predictions WHERE attempt = 1 GROUP BY row_id) o ON o.row_id = p.row_id AND o.pred_id % 3 IN (0, 1)")
def judge_cache(spark, d):
    rows = _t(spark, d, "predictions")
    judged = rows.filter("attempt = 1").groupBy("row_id").agg(F.max("pred_id").alias("pred_id")).withColumn("llm_judge_score", F.col("pred_id") % 3)
    return selection.judged_before(rows.select("pred_id", "row_id"), judged.select("row_id", "llm_judge_score", "pred_id"), "row_id", "pred_id").select("pred_id", "old_score")


@query("SELECT broad_category, category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM vqa_rows GROUP BY ALL")
def category_distribution(spark, d):
    return distribution(_t(spark, d, "vqa_rows"), "broad_category", "category")


# ---- selection and joins


@query(f"""SELECT line_no, youtube_id, caption FROM (SELECT line_no, coalesce(youtube_id, regexp_replace(regexp_extract(video, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')) AS youtube_id, {CLEAN.format(TURN.format('conversations', "'gpt'"))} AS caption, video, segment_id, video_start, video_end FROM clip_captions)
WHERE length(caption) >= 12 AND video IS NOT NULL AND segment_id IS NOT NULL AND video_start IS NOT NULL AND video_end IS NOT NULL""")
def loaded_clips(spark, d):
    return load_clips(_t(spark, d, "clip_captions")).select("line_no", "youtube_id", "caption")


@query("SELECT line_no, CAST(printf('%.3f', greatest(0.0, video_end - video_start)) AS DOUBLE) AS duration_sec FROM clip_captions WHERE video_end IS NOT NULL AND video_start IS NOT NULL")
def clip_durations(spark, d):
    from framequilt.functions.values import duration

    c = _t(spark, d, "clip_captions").filter("video_start IS NOT NULL AND video_end IS NOT NULL")
    return c.select("line_no", duration(F.col("video_start"), F.col("video_end")).alias("duration_sec"))


def _context(spark, d):
    clips = load_clips(_t(spark, d, "clip_captions"))
    return neighbour_context(clips, "youtube_id", ["start_sec", "end_sec", "segment_id", "line_no"], "caption", 1)


_CLIPS = f"""c AS (SELECT line_no, coalesce(youtube_id, regexp_replace(regexp_extract(video, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')) AS youtube_id, {CLEAN.format(TURN.format('conversations', "'gpt'"))} AS caption, segment_id, video_start, video_end FROM clip_captions
WHERE video IS NOT NULL AND segment_id IS NOT NULL AND video_start IS NOT NULL AND video_end IS NOT NULL), clips AS (SELECT * FROM c WHERE length(caption) >= 12)"""


@query(f"""WITH {_CLIPS} SELECT line_no, concat_ws(' | ', 'PREV: ' || lag(caption) OVER w, 'NEXT: ' || lead(caption) OVER w) AS context FROM clips WINDOW w AS (PARTITION BY youtube_id ORDER BY video_start, video_end, segment_id, line_no)""")
def clip_context(spark, d):
    return _context(spark, d).select("line_no", "context")


@query(f"WITH {_CLIPS} SELECT line_no FROM clips WHERE trim(segment_id) <> '' QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY youtube_id, video_start, video_end, line_no) = 1")
def first_of_segment(spark, d):
    return first_per_segment(load_clips(_t(spark, d, "clip_captions")), "segment_id", ["youtube_id", "start_sec", "end_sec", "line_no"]).select("line_no")


@query(f"WITH {_CLIPS} SELECT line_no, youtube_id FROM clips QUALIFY row_number() OVER (PARTITION BY youtube_id ORDER BY sha1('42|' || line_no), line_no) <= 7")
def segments_per_video(spark, d):
    return selection.sample_per_group(load_clips(_t(spark, d, "clip_captions")), "youtube_id", "line_no", 7, 42).select("line_no", "youtube_id")


@query(f"WITH {_CLIPS}, n AS (SELECT youtube_id, count(*) AS n FROM clips GROUP BY 1) SELECT CAST(sum(least(n, 7)) AS BIGINT) AS selected FROM n")
def selected_clip_total(spark, d):
    return selection.selected_total(load_clips(_t(spark, d, "clip_captions")), "youtube_id", 7)


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY sha1('7|' || doc_id), doc_id) <= (SELECT count(*) * 30 // 100 FROM documents)")
def fraction_sample(spark, d):
    return selection.sample_fraction(_t(spark, d, "documents").select("doc_id"), "doc_id", 30, 7)


@query("SELECT row_id, uid FROM vqa_rows WHERE source IN (SELECT source FROM (SELECT DISTINCT source FROM vqa_rows) ORDER BY sha1('3|' || source), source LIMIT 2)")
def capped_groups(spark, d):
    return selection.cap_groups(_t(spark, d, "vqa_rows"), "source", 2, 3).select("row_id", "uid")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 2")
def rank_shard_orders(spark, d):
    return selection.rank_shard(_t(spark, d, "orders"), "o_orderkey", 2, 6).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_id < 100")
def first_input_rows(spark, d):
    return selection.first_rows(_t(spark, d, "events"), "event_id", 100).select("event_id")


_LINES = "l AS (SELECT *, row_number() OVER (ORDER BY pred_id) - 1 AS line_no FROM predictions)"


def _jsonl(spark, d):
    """The predictions written as several JSON Lines files and read again; the names of the files follow the ids."""
    path = scratch(spark, "predictions")
    rows = _t(spark, d, "predictions").select("pred_id", "row_id", "attempt")
    rows.repartitionByRange(7, "pred_id").sortWithinPartitions("pred_id").write.json(path)
    return tolerant_jsonl(spark, path, "pred_id bigint, row_id bigint, attempt int")


@query(f"WITH {_LINES} SELECT line_no, pred_id, row_id FROM l")
def read_jsonl(spark, d):
    return _jsonl(spark, d).select("line_no", "pred_id", "row_id")


@query(f"WITH {_LINES} SELECT pred_id FROM l WHERE attempt = 1 QUALIFY row_number() OVER (ORDER BY line_no) <= 150")
def first_read_rows(spark, d):
    return selection.first_rows(_jsonl(spark, d).filter("attempt = 1"), "line_no", 150).select("pred_id")


@query(f"WITH {_LINES} SELECT pred_id FROM l WHERE attempt = 1 QUALIFY row_number() OVER (ORDER BY line_no) % 6 = 3")
def rank_shard_read_rows(spark, d):
    return selection.rank_shard(_jsonl(spark, d).filter("attempt = 1"), "line_no", 2, 6).select("pred_id")


@query(f"WITH {_LINES} SELECT row_id, arg_max(pred_id, line_no) AS pred_id FROM l GROUP BY row_id")
def latest_read_rows(spark, d):
    rows = _jsonl(spark, d)
    return selection.latest_per_key(rows, F.col("row_id"), "line_no", ["row_id", "pred_id"]).select("row_id", "pred_id")


@query("SELECT c_nationkey AS id, arg_min(CASE lower(trim(c_mktsegment)) WHEN 'building' THEN 'Open' ELSE c_mktsegment END, c_custkey) AS type FROM (SELECT CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, c_custkey FROM customer) WHERE lower(c_mktsegment) <> 'machinery' GROUP BY 1")
def first_surgery_types(spark, d):
    """Customers stand in for rows of workbooks: one segment stands for a type that states nothing, one for a spelling of an open operation."""
    segment = F.col("c_mktsegment")
    kind = F.when(segment == "MACHINERY", " N/A ").when(segment == "BUILDING", "open surgery").otherwise(segment)
    return first_types(_t(spark, d, "customer").withColumn("kind", kind), "c_nationkey", "kind", "c_custkey")


@query(rf"""WITH s AS (SELECT DISTINCT entry, youtube_id, {STRIP.format("coalesce(youtube_id, '')")} AS title FROM procedure_map),
v AS (SELECT regexp_replace(regexp_extract(video, '([^/\\]*)$', 1), '^(.+)\.[^.]*$', '\1') AS stem, min(video) AS path FROM clip_captions WHERE video IS NOT NULL GROUP BY 1),
done AS (SELECT DISTINCT {STRIP.format("coalesce(youtube_id, '')")} AS folder FROM transcripts WHERE error IS NULL AND transcript_id % 2 = 0)
SELECT s.title, v.path, CASE WHEN s.title = '' OR v.path IS NULL THEN 'skipped_missing' WHEN done.folder IS NOT NULL THEN 'skipped_done' ELSE 'to_run' END AS status
FROM s LEFT JOIN v ON v.stem = s.title LEFT JOIN done ON done.folder = s.title""")
def transcription_statuses(spark, d):
    selected = _t(spark, d, "procedure_map").select("entry", F.col("youtube_id").alias("title")).distinct()
    files = _t(spark, d, "clip_captions").filter("video IS NOT NULL")
    catalogue = files.groupBy(file_stem(F.col("video")).alias("stem")).agg(F.min("video").alias("path"))
    done = _t(spark, d, "transcripts").filter("error IS NULL AND transcript_id % 2 = 0").select(strip_ws(F.coalesce("youtube_id", F.lit(""))).alias("folder"))
    return transcripts.transcription_batch(selected, catalogue, done).select("title", "path", "status")


@query(f"""WITH done AS (SELECT DISTINCT row_id FROM predictions WHERE {ERROR} IS NULL AND {PRED} <> '') SELECT row_id FROM vqa_rows v WHERE split <> 'train' AND NOT EXISTS (SELECT 1 FROM done d WHERE d.row_id = v.row_id)""")
def resume_anti_join(spark, d):
    p = _t(spark, d, "predictions")
    done = p.filter(selection.stated_error(F.col("error")).isNull() & (prediction(p) != "")).select("row_id")
    return selection.without_done(_t(spark, d, "vqa_rows").filter("split <> 'train'"), done, "row_id").select("row_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def allow_list(spark, d):
    allowed = _t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return selection.only_listed(_t(spark, d, "orders"), allowed, "o_custkey").select("o_orderkey")


@query("SELECT row_id, coalesce(map {'entity_existence': 'perception_identification', 'entity_state': 'perception_identification', 'spatial_relation': 'perception_identification', 'instrument_tissue_interaction': 'action_procedural_state', 'operative_action': 'action_procedural_state', 'maneuver_rationale': 'operative_reasoning', 'decision_justification': 'operative_reasoning', 'procedural_sequence': 'temporal_predictive', 'next_step_prediction': 'temporal_predictive', 'risk_anatomy_identification': 'risk_anatomy_identification'}[category], '') AS broad FROM vqa_rows")
def fine_to_broad(spark, d):
    return _t(spark, d, "vqa_rows").select("row_id", qa.broad_category(F.col("category")).alias("broad"))


def _procedures(spark, d):
    """One row per video with an entry that is an object."""
    from framequilt.functions.json_text import strict_object

    fields = "surgery string, specialty string, procedure string, procedure_name string, title string"
    rows = _t(spark, d, "procedure_map").select("youtube_id", F.from_json(strict_object("entry"), fields).alias("e"))
    return rows.select("youtube_id", "e.*")


_PROC = "p AS (SELECT youtube_id, CASE WHEN json_valid(entry) AND json_type(entry) = 'OBJECT' THEN CAST(entry AS JSON) END AS e FROM procedure_map), m AS (SELECT youtube_id, e->>'$.surgery' AS surgery, e->>'$.specialty' AS specialty, e->>'$.procedure' AS procedure, e->>'$.procedure_name' AS procedure_name, e->>'$.title' AS title FROM p)"
_VALID = "CASE WHEN lower({0}) <> 'unknown' THEN nullif({0}, '') END"


@query(f"WITH {_PROC} SELECT youtube_id, coalesce({', '.join(_VALID.format(STRIP.format(c)) for c in ('procedure', 'procedure_name', 'title', 'specialty'))}, '') AS label FROM m")
def procedure_labels(spark, d):
    label = selection.procedure_label(F.col("procedure"), F.col("procedure_name"), F.col("title"), F.col("specialty"))
    return _procedures(spark, d).select("youtube_id", label.alias("label"))


_TYPE = "CASE lower({0}) WHEN 'robotic' THEN 'Robotic' WHEN 'laparoscopic' THEN 'Laparoscopic' WHEN 'open' THEN 'Open' WHEN 'open surgery' THEN 'Open' WHEN 'other' THEN 'Other' ELSE {0} END"


@query(f"WITH {_PROC} SELECT c.line_no FROM clip_captions c JOIN m USING (youtube_id) WHERE {STRIP.format('''coalesce(specialty, '')''')} IN ('Urology', 'Gynecology') AND {_TYPE.format(STRIP.format('''coalesce(surgery, '')'''))} IN ('Open', 'Robotic')")
def metadata_filter_join(spark, d):
    rows = _t(spark, d, "clip_captions").join(_procedures(spark, d), "youtube_id", "left")
    return selection.metadata_filter(rows, specialties=["Urology", "Gynecology"], types=["open surgery", "robotic"]).select("line_no")


@query("SELECT o_orderkey FROM orders WHERE lower(trim(o_orderstatus)) = 'f' AND lower(o_orderpriority) LIKE '%urgent%'")
def sheet_selection(spark, d):
    o = _t(spark, d, "orders")
    renamed = selection.trim_headers(o.withColumnRenamed("o_orderpriority", " Phase Info "))
    kind = F.when(F.col("o_orderstatus") == "F", " Surgery ").otherwise("No Surgery")
    return renamed.filter(selection.narrated_surgery(kind, F.replace(F.lower("Phase Info"), F.lit("urgent"), F.lit("Surgeon Narration")))).select("o_orderkey")


@query(f"SELECT pred_id, lower({STRIP.format('prediction')}) IN ('yes', 'y', 'true', '1') AND prediction IS NOT NULL AS yes FROM predictions")
def yes_flags(spark, d):
    return _t(spark, d, "predictions").select("pred_id", selection.says_yes(F.col("prediction")).alias("yes"))


@query("SELECT doc_id AS id, text, NULL AS answer FROM documents UNION ALL SELECT pred_id, NULL, prediction FROM predictions")
def union_by_name(spark, d):
    a = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return a.unionByName(_t(spark, d, "predictions").select(F.col("pred_id").alias("id"), F.col("prediction").alias("answer")), allowMissingColumns=True)


@query("SELECT coalesce(error, 'none') AS status, count(*) AS n FROM predictions GROUP BY 1")
def status_counts(spark, d):
    return selection.count_by(_t(spark, d, "predictions"), "status", F.coalesce("error", F.lit("none")))


# ---- questions


@query(f"""SELECT row_id, sha1(coalesce(video, '') || '|' || printf('%.3f', coalesce(start_sec, 0)) || '|' || printf('%.3f', coalesce(end_sec, 0)) || '|' || coalesce(category, '') || '|' || {CLEAN.format(TURN.format('conversations', "'human','user'"))} || '|' || {CLEAN.format(TURN.format('conversations', "'gpt','assistant'"))}) AS id FROM vqa_rows""")
def record_ids(spark, d):
    c = F.col("conversations")
    return _t(spark, d, "vqa_rows").select("row_id", record_uid(F.col("video"), F.col("start_sec"), F.col("end_sec"), F.col("category"), first_turn(c, ASKING), first_turn(c, ANSWERING)).alias("id"))


@query("SELECT row_id, array_to_string(list_filter(applicable_categories, lambda c: c IN ('entity_existence', 'entity_state', 'spatial_relation', 'instrument_tissue_interaction', 'operative_action', 'maneuver_rationale', 'decision_justification', 'procedural_sequence', 'next_step_prediction', 'risk_anatomy_identification'))[1:2], ',') AS known FROM vqa_rows WHERE applicable_categories IS NOT NULL")
def plan_categories(spark, d):
    return _t(spark, d, "vqa_rows").filter("applicable_categories IS NOT NULL").select("row_id", F.array_join(qa.known_categories(F.col("applicable_categories"), 2), ",").alias("known"))


@query(f"""WITH r AS (SELECT row_id, trim(coalesce(category, '')) AS category, {CLEAN.format(TURN.format('conversations', "'human','user'"))} AS q, {CLEAN.format(TURN.format('conversations', "'gpt','assistant'"))} AS a, format, choices, applicable_categories AS ok FROM vqa_rows)
SELECT row_id, category, q AS question FROM r WHERE list_contains(ok, category) AND length(q) >= 8 AND length(a) >= 8 AND (format <> 'mcq' OR len(choices) = 4)""")
def candidate_rules(spark, d):
    c = F.col("conversations")
    one = F.struct(
        "category", first_turn(c, ASKING).alias("question"), first_turn(c, ANSWERING).alias("answer"), F.lit("").alias("rationale"), F.lit("").alias("evidence"), "format", "choices", F.lit("0").alias("correct_choice")
    )
    rows = _t(spark, d, "vqa_rows").select("row_id", F.array(one, one).alias("candidates"), F.col("applicable_categories").alias("allowed"))
    return qa.valid_candidates(rows, "row_id", "candidates", "allowed").select("row_id", "candidate.category", "candidate.question")


@query("SELECT l_orderkey, l_linenumber, l_discount >= 0.05 AND least(1 + CAST(l_quantity AS BIGINT) % 5, 4, CASE WHEN l_linenumber = 1 THEN 1 ELSE 5 END) >= 4 AS keep FROM lineitem")
def score_gates(spark, d):
    named = {"groundedness": 1 + F.col("l_quantity").cast("bigint") % 5, "answerability": F.lit(4), "temporal_alignment": F.lit(5.9), "non_triviality": F.lit(5)}
    scores = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v.cast("string"))])
    full = F.when(F.col("l_linenumber") == 1, scores).otherwise(F.map_concat(scores, F.create_map(F.lit("hallucination_risk"), F.lit("5"))))
    verdict = F.struct(full.alias("scores"))
    rows = _t(spark, d, "lineitem").withColumn("verdict", verdict)
    return rows.select("l_orderkey", "l_linenumber", qa.score_gate(F.col("l_discount") >= 0.05, qa.scores_of(F.col("verdict"))).alias("keep"))


@query(f"""SELECT row_id, 'user' AS role, q AS content FROM (SELECT row_id, {TURN.format('conversations', "'human','user'")} AS q FROM vqa_rows) UNION ALL SELECT row_id, 'assistant', {TURN.format('conversations', "'gpt','assistant'")} || chr(10) || chr(10) || 'Reasoning: ' || category FROM vqa_rows WHERE trim(coalesce(category, '')) <> '' UNION ALL SELECT row_id, 'assistant', {TURN.format('conversations', "'gpt','assistant'")} FROM vqa_rows WHERE trim(coalesce(category, '')) = ''""")
def chat_messages(spark, d):
    c = F.col("conversations")
    rows = _t(spark, d, "vqa_rows").select("row_id", F.explode(qa.chat_messages(first_turn(c, ASKING), first_turn(c, ANSWERING), F.col("category"))).alias("m"))
    return rows.select("row_id", "m.role", "m.content")


# ---- transcripts

_OFF = f"""o0 AS (SELECT *, transcript IS NULL OR {STRIP.format("coalesce(error, '')")} <> '' AS failed FROM transcripts),
o1 AS (SELECT *, CASE WHEN NOT failed AND coalesce(transcript.segments[-1]."end", transcript.words[-1]."end") > 0 THEN coalesce(transcript.segments[-1]."end", transcript.words[-1]."end") ELSE 600.0 END AS sec FROM o0),
o AS (SELECT *, coalesce(sum(sec) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, row_number() OVER w AS no FROM o1 WINDOW w AS (PARTITION BY youtube_id ORDER BY transcript_id))"""


def _offsets(spark, d):
    return transcripts.with_offsets(_t(spark, d, "transcripts"), "youtube_id", "transcript_id")


@query(f"WITH {_OFF} SELECT transcript_id, round(off, 3) AS offset_sec, round(sec, 3) AS chunk_sec, failed FROM o")
def chunk_offsets(spark, d):
    return _offsets(spark, d).select("transcript_id", F.round("offset_sec", 3).alias("offset_sec"), F.round("chunk_sec", 3).alias("chunk_sec"), "failed")


@query(f"WITH {_OFF}, t AS (SELECT youtube_id, transcript_id, failed, {STRIP.format('''CASE WHEN failed THEN '[ERROR: Failed to transcribe chunk ' || no || ']' ELSE coalesce(transcript.text, '') END''')} AS t FROM o) SELECT youtube_id, coalesce(string_agg(t, ' ' ORDER BY transcript_id) FILTER (t <> ''), '') AS text, count(*) AS chunk_count, count(*) FILTER (NOT failed) AS chunks_transcribed FROM t GROUP BY youtube_id")
def merged_transcripts(spark, d):
    return transcripts.merged_text(_offsets(spark, d), "youtube_id", "transcript_id")


@query(f"WITH {_OFF}, s AS (SELECT youtube_id, transcript_id, off, unnest(transcript.segments) AS s, generate_subscripts(transcript.segments, 1) - 1 AS position FROM o WHERE NOT failed) SELECT youtube_id, transcript_id, position, round(s.start + off, 3) AS start, round(s.\"end\" + off, 3) AS \"end\", s.text AS text FROM s")
def timed_segments(spark, d):
    rows = transcripts.timed_rows(_offsets(spark, d), "youtube_id", "transcript_id", "segments")
    return rows.withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})


@query(f"""WITH s AS (SELECT transcript_id, unnest(transcript.words) AS w, generate_subscripts(transcript.words, 1) AS i FROM transcripts), k AS (SELECT transcript_id, i, w.word AS t, {STRIP.format('w.word')} AS b, w.start AS st, w."end" AS en FROM s WHERE {STRIP.format('w.word')} <> ''),
n AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(b, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS no FROM k)
SELECT transcript_id, CAST(no AS BIGINT) AS sentence_no, count(*) AS n_words, round(min_by(st, i), 3) AS start, round(max_by(en, i), 3) AS "end", max_by(b, i) AS last_word FROM n GROUP BY transcript_id, no""")
def sentence_bounds(spark, d):
    rows = _t(spark, d, "transcripts").select("transcript_id", F.posexplode("transcript.words").alias("position", "w")).select("transcript_id", "position", "w.start", "w.end", F.col("w.word").alias("text"))
    spoken = transcripts.sentences(rows, "transcript_id", ["position"])
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return spoken.select("transcript_id", "sentence_no", n.cast("bigint").alias("n_words"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.element_at(F.split("text", r"\s+"), -1).alias("last_word"))


@query(f"""WITH {_OFF}, w AS (SELECT youtube_id, transcript_id, off, unnest(transcript.words) AS w, generate_subscripts(transcript.words, 1) AS position FROM o WHERE NOT failed),
k AS (SELECT youtube_id, transcript_id, position, w.start + off AS st, w."end" + off AS en, w.word AS t, {STRIP.format('w.word')} AS b FROM w WHERE {STRIP.format('w.word')} <> ''),
n AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(b, '[.!?]$') THEN 1 ELSE 0 END) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS no, row_number() OVER v AS i FROM k WINDOW v AS (PARTITION BY youtube_id ORDER BY transcript_id, position)),
p AS (SELECT *, lag(t) OVER (PARTITION BY youtube_id, no ORDER BY i) AS before FROM n)
SELECT youtube_id, CAST(no AS BIGINT) AS sentence_no, round(min_by(st, i), 3) AS start, round(max_by(en, i), 3) AS "end",
{STRIP.format("string_agg(CASE WHEN before IS NULL OR t IN ('.', ',', '!', '?', ';', ':', '%', ')', ']', '}') OR right(before, 1) IN ('(', '[', '{') THEN t ELSE ' ' || t END, '' ORDER BY i)")} AS text FROM p GROUP BY youtube_id, no""")
def sentences(spark, d):
    words = transcripts.timed_rows(_offsets(spark, d), "youtube_id", "transcript_id", "words")
    return transcripts.sentences(words, "youtube_id", ["transcript_id", "position"]).withColumns({"sentence_no": F.col("sentence_no").cast("bigint"), "start": F.round("start", 3), "end": F.round("end", 3)})


_SEG = f"{_OFF}, s AS (SELECT youtube_id, transcript_id, off, unnest(transcript.segments) AS s, generate_subscripts(transcript.segments, 1) AS position FROM o WHERE NOT failed), q AS (SELECT youtube_id, transcript_id, position, s.start + off AS st, s.\"end\" + off AS en, {STRIP.format('s.text')} AS t FROM s)"


@query(f"WITH {_SEG} SELECT youtube_id, string_agg('[' || {TIME.format('st')} || ' --> ' || {TIME.format('en')} || '] ' || t, chr(10) ORDER BY transcript_id, position) AS content FROM q GROUP BY youtube_id")
def segment_lines(spark, d):
    return transcripts.text_lines(transcripts.timed_rows(_offsets(spark, d), "youtube_id", "transcript_id", "segments"), "youtube_id", ["transcript_id", "position"])


@query(f"WITH {_SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY youtube_id ORDER BY transcript_id, position) AS n FROM q) SELECT youtube_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(n || chr(10) || {TIME.format('st')} || ' --> ' || {TIME.format('en')} || chr(10) || t || chr(10), chr(10) ORDER BY n) AS content FROM r GROUP BY youtube_id")
def vtt_files(spark, d):
    return transcripts.vtt(transcripts.timed_rows(_offsets(spark, d), "youtube_id", "transcript_id", "segments"), "youtube_id", ["transcript_id", "position"])


@query(f"SELECT l_orderkey, l_linenumber, {TIME.format('(l_extendedprice / 7)')} AS stamp FROM lineitem")
def timestamps(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", timestamp(F.col("l_extendedprice") / 7).alias("stamp"))


@query("""WITH x AS (SELECT p_partkey, p_partkey * 1000003 % 200000000 AS size, p_retailprice AS sec FROM part), y AS (SELECT *, greatest(10.0, 20971520.0 / size * sec * 0.8) AS part FROM x),
z AS (SELECT p_partkey, size, sec, part, unnest(range(CASE WHEN size <= 26214400 OR sec = 0 THEN 1 ELSE CAST(ceil(sec / part) AS BIGINT) END)) AS i FROM y)
SELECT p_partkey, i AS chunk_no, round(CASE WHEN size <= 26214400 THEN 0 ELSE i * part END, 6) AS start_sec, round(CASE WHEN size <= 26214400 THEN sec ELSE least((i + 1) * part, sec) END, 6) AS end_sec FROM z""")
def audio_chunks(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.explode(audio_chunk_plan(F.col("p_partkey") * 1000003 % 200000000, F.col("p_retailprice"))).alias("c"))
    return rows.select("p_partkey", F.col("c.chunk_no").cast("bigint").alias("chunk_no"), F.round("c.start_sec", 6).alias("start_sec"), F.round("c.end_sec", 6).alias("end_sec"))


@query("""WITH x AS (SELECT p_partkey, p_retailprice / 1000 * (p_partkey % 4) AS s, 1 + p_size % 6 AS n FROM part), y AS (SELECT *, least(1.0, s * 0.05) AS a, greatest(least(1.0, s * 0.05), s - least(1.0, s * 0.05)) AS b FROM x),
z AS (SELECT *, s <= 2.0 OR n <= 1 OR b <= a AS few FROM y), u AS (SELECT *, unnest(range(CASE WHEN few THEN 1 ELSE n END)) AS i FROM z)
SELECT p_partkey, i, round(CASE WHEN few THEN greatest(0.0, s / 2) ELSE a + i * (b - a) / (n - 1) END, 3) AS t FROM u""")
def crop_times(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.posexplode(crop_sample_times(F.col("p_retailprice") / 1000 * (F.col("p_partkey") % 4), 1 + F.col("p_size") % 6)).alias("i", "t"))
    return rows.select("p_partkey", F.col("i").cast("bigint").alias("i"), F.round("t", 3).alias("t"))


@query("WITH u AS (SELECT p_partkey, p_retailprice AS s, unnest(range(4)) AS i FROM part) SELECT p_partkey, i, round((i + 0.5) * s / 4, 6) AS t FROM u")
def eval_times(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.posexplode(eval_sample_times(F.col("p_retailprice"), F.lit(4))).alias("i", "t"))
    return rows.select("p_partkey", F.col("i").cast("bigint").alias("i"), F.round("t", 6).alias("t"))


# ---- boxes: parts stand in for detections in frames of 1920 x 1080

_BOX = "b AS (SELECT p_partkey, p_partkey * 37 % 900 AS x, p_partkey * 53 % 500 AS y, 60 + p_partkey * 71 % 1000 AS w, 40 + p_partkey * 29 % 560 AS h FROM part)"


def _boxes(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select("p_partkey", (k * 37 % 900).alias("x"), (k * 53 % 500).alias("y"), (60 + k * 71 % 1000).alias("w"), (40 + k * 29 % 560).alias("h"))


_XYWH = ("x", "y", "w", "h")


@query(f"""WITH {_BOX}, c AS (SELECT *, 1920 - (x + w) AS r, 1080 - (y + h) AS bt FROM b) SELECT p_partkey, x AS "left", y AS top, r AS "right", bt AS bottom, greatest(x, y, r, bt) AS largest_border_px, round(greatest(x / 1920, y / 1080, r / 1920, bt / 1080), 6) AS largest_border_pct, round(w * h / (1920 * 1080), 6) AS kept_area_ratio, greatest(x, y, r, bt) >= 16 AND greatest(x / 1920, y / 1080, r / 1920, bt / 1080) >= 0.025 AS crop_needed FROM c""")
def crop_decisions(spark, d):
    rows = _boxes(spark, d).select("p_partkey", borders(F.lit(1920), F.lit(1080), *map(F.col, _XYWH)).alias("b")).select("p_partkey", "b.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("largest_border_pct", "kept_area_ratio")})


@query(f"""WITH {_BOX}, p AS (SELECT *, CAST(round_even(w * 0.04, 0) AS BIGINT) AS px, CAST(round_even(h * 0.04, 0) AS BIGINT) AS py FROM b), l AS (SELECT *, greatest(0, least(1918, x - px)) AS lx, greatest(0, least(1078, y - py)) AS ly FROM p)
SELECT p_partkey, lx AS x, ly AS y, greatest(lx + 2, least(1920, x + w + px)) - lx AS w, greatest(ly + 2, least(1080, y + h + py)) - ly AS h FROM l""")
def expanded_boxes(spark, d):
    return _boxes(spark, d).select("p_partkey", expand_box(*map(F.col, _XYWH), F.lit(1920).cast("bigint"), F.lit(1080).cast("bigint"), 0.04).alias("b")).select("p_partkey", "b.*")


_EVEN = "(greatest(2, {0}) - greatest(2, {0}) % 2)"


@query(f"""WITH {_BOX}, c AS (SELECT p_partkey, greatest(100, least(1698, x)) AS cx, greatest(50, least(998, y)) AS cy, w, h FROM b), e AS (SELECT *, greatest(cx + 2, least(1700, cx + w)) AS r, greatest(cy + 2, least(1000, cy + h)) AS bt, {_EVEN.format('cx')} AS ex, {_EVEN.format('cy')} AS ey FROM c)
SELECT p_partkey, ex AS x, ey AS y, greatest(2, least(1920 - ex, {_EVEN.format('(r - ex)')})) AS w, greatest(2, least(1080 - ey, {_EVEN.format('(bt - ey)')})) AS h FROM e""")
def restricted_windows(spark, d):
    big = lambda n: F.lit(n).cast("bigint")
    inner = F.struct(big(100).alias("left"), big(50).alias("top"), big(1700).alias("right"), big(1000).alias("bottom"))
    return _boxes(spark, d).select("p_partkey", restrict_window(*map(F.col, _XYWH), inner, big(1920), big(1080)).alias("b")).select("p_partkey", "b.*")


@query(f"WITH {_BOX} SELECT p_partkey, w / h > 3.8 OR w / h < 0.45 OR w * h / 2073600 < 0.05 AS implausible, {_EVEN.format('w')} AS even_w, 'crop=' || w || ':' || h || ':' || x || ':' || y AS filter FROM b")
def box_checks(spark, d):
    x, y, w, h = map(F.col, _XYWH)
    return _boxes(spark, d).select("p_partkey", implausible_box(w, h, F.lit(1920), F.lit(1080)).alias("implausible"), even_int(w).alias("even_w"), crop_filter(x, y, w, h).alias("filter"))


@query(f"WITH {_BOX} SELECT p_partkey % 20 AS frame, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM b GROUP BY 1")
def box_unions(spark, d):
    return _boxes(spark, d).groupBy((F.col("p_partkey") % 20).alias("frame")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))


@query(f"""WITH {_BOX}, s AS (SELECT p_partkey, p_partkey % 20 AS frame, w * h * (1 - 0.35 * least(1, pow(abs(x + w / 2 - 960) / 960, 2) + pow(abs(y + h / 2 - 540) / 540, 2))) AS score FROM b WHERE w * h >= 20000) SELECT frame, p_partkey AS best FROM s QUALIFY row_number() OVER (PARTITION BY frame ORDER BY round(score, 6) DESC, p_partkey) = 1""")
def best_components(spark, d):
    x, y, w, h = map(F.col, _XYWH)
    score = F.round(component_score(x, y, w, h, w * h, F.lit(1920), F.lit(1080)), 6)
    rows = _boxes(spark, d).filter("w * h >= 20000").withColumn("score", score)
    return rows.groupBy((F.col("p_partkey") % 20).alias("frame")).agg(F.max_by("p_partkey", F.struct(F.col("score"), -F.col("p_partkey"))).alias("best"))


# ---- training items

_HUMAN = """array_to_string(list_transform(list_filter(conversations, lambda t: t."from" = 'human'), lambda t: coalesce(t.value, '')), chr(10))"""


@query(f"WITH n AS (SELECT row_id, (length({_HUMAN}) - length(replace({_HUMAN}, '<video>', ''))) // 7 AS n FROM vqa_rows) SELECT row_id, CASE WHEN n > 1 THEN 'more <video> placeholders than files' WHEN n < 1 THEN 'video files remain unused' END AS defect FROM n")
def placeholder_checks(spark, d):
    rows = _t(spark, d, "vqa_rows")
    return rows.select("row_id", training.placeholder_defect(F.col("conversations"), training.as_list(F.lit(None).cast("string"), False), training.as_list(F.coalesce("video", F.lit("missing")), False)).alias("defect"))


_WORDS = "coalesce(list_sum(list_transform(conversations, lambda t: len(list_filter(regexp_split_to_array(coalesce(t.value, ''), '\\s+'), lambda w: w <> '')))), 0)"


@query(f"SELECT row_id, CAST({_WORDS} AS BIGINT) AS words, CAST({_WORDS} + CASE WHEN format = 'mcq' THEN 128 ELSE 0 END AS BIGINT) AS item_length, CAST(CASE WHEN video IS NULL THEN -{_WORDS} ELSE {_WORDS} END AS BIGINT) AS modality_length FROM vqa_rows")
def item_lengths(spark, d):
    c = F.col("conversations")
    columns = {"words": training.word_length(c), "item_length": training.item_length(c, F.col("format") == "mcq"), "modality_length": training.modality_length(c, F.col("video").isNotNull())}
    return _t(spark, d, "vqa_rows").select("row_id", *[v.cast("bigint").alias(k) for k, v in columns.items()])


@query(f"WITH w AS (SELECT row_id, source, CAST({_WORDS} AS BIGINT) AS n FROM vqa_rows) SELECT row_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM w")
def packed_offsets(spark, d):
    rows = _t(spark, d, "vqa_rows").select("row_id", "source", training.word_length(F.col("conversations")).cast("bigint").alias("n"))
    return training.sequence_offsets(rows, "source", "row_id", "n").select("row_id", "n", "offset")


@query("SELECT l_orderkey, l_linenumber, list_transform(range(1, 9), lambda i: CASE WHEN i <= l_quantity THEN i ELSE 0 END) AS ids FROM lineitem")
def padded_sequences(spark, d):
    ids = F.sequence(F.lit(1).cast("bigint"), F.col("l_quantity").cast("bigint"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", training.pad_right(ids, F.lit(12), 0, 8).alias("ids"))


@query("""SELECT row_id, array_to_string(list_filter(list_transform(string_split(replace(replace(q, '<video>', chr(1) || '<video>' || chr(1)), '<image>', chr(1) || '<image>' || chr(1)), chr(1)), lambda s: regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda s: s <> ''), '#') AS parts FROM (SELECT row_id, coalesce((list_filter(conversations, lambda t: t."from" = 'human')[1]).value, '') AS q FROM vqa_rows)""")
def content_parts(spark, d):
    human = F.get(F.filter("conversations", lambda t: t["from"] == "human"), F.lit(0))["value"]
    return _t(spark, d, "vqa_rows").select("row_id", F.array_join(training.content_parts(human), "#").alias("parts"))


@query("SELECT row_id, 'user' AS role, unnest(list_filter(list_transform(string_split(replace(t.value, '<video>', chr(1) || '<video>' || chr(1)), chr(1)), lambda s: CASE WHEN s = '<video>' THEN 'video=media/' || video ELSE 'text=' || regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') END), lambda s: s <> 'text=')) AS part FROM (SELECT row_id, video, unnest(conversations) AS t FROM vqa_rows WHERE len(list_filter(conversations, lambda t: t.\"from\" = 'human' AND t.value LIKE '%<video>%')) = 1 AND len(list_filter(conversations, lambda t: t.\"from\" = 'human' AND (t.value LIKE '%<video>%<video>%' OR t.value LIKE '%<image>%'))) = 0 AND video IS NOT NULL AND video NOT LIKE '/%') WHERE t.\"from\" = 'human'")
def training_messages(spark, d):
    """Parts of the human turns, of the items whose placeholders and files match."""
    turns, none = F.col("conversations"), F.array().cast("array<string>")
    rows = _t(spark, d, "vqa_rows").filter("video IS NOT NULL AND video NOT LIKE '/%'").select("row_id", "conversations", F.array("video").alias("videos"))
    sound = rows.filter(training.placeholder_defect(turns, none, F.col("videos")).isNull())
    told = sound.select("row_id", F.explode(training.messages(turns, none, F.col("videos"), "media")).alias("m")).filter("m.role = 'user'")
    parts = told.select("row_id", F.col("m.role").alias("role"), F.explode("m.content").alias("c"))
    return parts.select("row_id", "role", F.concat("c.type", F.lit("="), F.coalesce("c.path", "c.text")).alias("part"))


@query("WITH a AS (SELECT 'surg_segment_captions' AS dataset, 0 AS dataset_no, doc_id FROM documents WHERE source = 'captions' QUALIFY row_number() OVER (ORDER BY sha1('1|' || doc_id), doc_id) <= (SELECT count(*) // 2 FROM documents WHERE source = 'captions')), b AS (SELECT 'surg_step_descriptions_open', 1, doc_id FROM documents WHERE source = 'steps') SELECT * FROM a UNION ALL SELECT * FROM b")
def data_mixture(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source")
    chosen = training.parse_mixture("surg_segment_captions%50, surg_step_descriptions_open", training.registry("/data"))
    frames = [docs.filter(F.col("source") == source).drop("source") for source in ("captions", "steps")]
    return training.mixture(list(zip(chosen, frames, strict=True)), "doc_id", 1)


@query("""WITH s AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place FROM vqa_rows WHERE format <> 'mcq'),
b AS (SELECT row_id, CAST('0x' || substr(sha1('5|' || row_id), 1, 15) AS BIGINT) % (SELECT count(*) FROM s) AS place FROM vqa_rows WHERE format = 'mcq' OR format IS NULL)
SELECT b.row_id, s.row_id AS replacement FROM b LEFT JOIN s USING (place)""")
def item_replacements(spark, d):
    rows = _t(spark, d, "vqa_rows").select("row_id", (F.col("format") == "mcq").alias("failed"))
    return training.replacements(rows, "row_id", "failed", 5)


@query("SELECT doc_id, CAST(n_chars AS BIGINT) AS n FROM documents")
def known_lengths(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", training.known_lengths(docs, "n_chars").alias("n"))


@query(f"""WITH n AS (SELECT row_id, len(string_split(coalesce({TURN.format('conversations', "'gpt','assistant'")}, ''), ' ')) AS n FROM vqa_rows)
SELECT row_id, [-100, -100, -100] || range(10, n + 11) || [151645, 3] || CASE row_id % 3 WHEN 0 THEN [-100, -100] || range(20, 22) || [151645, 4] WHEN 1 THEN [-100, -100, -100, -100] ELSE [-100, -100] || [151645, 77091, -100, -100] END AS labels FROM n""")
def label_masks(spark, d):
    """Sequences with an answer between markers, made from the rows' words; then a second one, one that never ends, or one that ends at once and is followed by a marker."""
    n = F.size(F.split(F.coalesce(first_turn(F.col("conversations"), ANSWERING), F.lit("")), " "))
    a, e = F.lit(training.ANSWER_TOKEN), F.lit(training.END_TOKEN)
    first = F.concat(F.array(F.lit(1), a, F.lit(2)), F.sequence(F.lit(10), n + 10), F.array(e, F.lit(3)))
    kinds = F.pmod("row_id", F.lit(3))
    second = F.when(kinds == 0, F.array(a, F.lit(2), F.lit(20), F.lit(21), e, F.lit(4))).when(kinds == 1, F.array(a, F.lit(2), F.lit(20), F.lit(21))).otherwise(F.array(a, F.lit(2), e, a, F.lit(7), F.lit(8)))
    rows = _t(spark, d, "vqa_rows").select("row_id", F.concat(first, second).cast("array<int>").alias("ids"))
    return rows.select("row_id", F.transform(training.label_mask(F.col("ids")), lambda x: x.cast("bigint")).alias("labels"))
