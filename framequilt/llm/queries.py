"""Queries pN_ of the training-data operators, with their SQL where SQL can say the same."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequilt.functions.text import ANSWERING, ASKING, blank_to_null, clean_str, first_turn, strip_ws, video_key
from framequilt.llm.bytecnn import ByteCNN
from framequilt.llm.defects import SAMPLE_CHARS, SAMPLE_PAIRS, Corpus, corpus_counts, defective_pairs, plain, train_tagger
from framequilt.llm.languages import LANGUAGE_NAMES, code_column, identify, labelled_sample, sentences, trained, weight
from framequilt.llm.mixing import mix
from framequilt.llm.overlaps import canonical_records, cross_split_counts, cross_split_links, cross_split_pairs
from framequilt.llm.packing import pack, pack_report
from framequilt.llm.repetition import repetition, repetitive
from framequilt.llm.sampling import sample_to_targets
from framequilt.llm.splits import assign_splits, split_report
from framequilt.session import cut, table


def _key():
    return video_key(F.col("youtube_id"), F.col("video"))


def _low(c):
    return F.lower(strip_ws(c))


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("surgery", "specialty")]))
def _entry(entries: pd.Series) -> pd.DataFrame:
    rows = []
    for e in entries:
        try:
            v = json.loads(e) if isinstance(e, str) else None
        except ValueError:
            v = None
        v = v if isinstance(v, dict) else {}
        rows.append([x.strip().lower() if isinstance(x := v.get(k), str) and x.strip() else None for k in ("surgery", "specialty")])
    return pd.DataFrame(rows, columns=["surgery", "specialty"])


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, surgery and specialty (arrays, lower case) of each video with an entry."""
    p = table(spark, sf_dir, "procedure_map").select(blank_to_null(F.col("youtube_id")).alias("key"), _entry("entry").alias("e")).filter("key IS NOT NULL")
    surgery = F.when(F.col("e.surgery") == "open surgery", "open").otherwise(F.col("e.surgery"))
    return p.groupBy("key").agg(F.collect_set(surgery).alias("surgery"), F.collect_set("e.specialty").alias("specialty"))


# ---- 1: splits that keep related records together


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clip_captions").select(_key().alias("key"), blank_to_null(F.col("segment_id")).alias("segment"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = p1_assigned(spark, sf_dir)[0]
    tied = assigned.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return assigned.join(tied, "component").select(F.col("entity").alias("youtube_id"), F.col("component").alias("group_id"))


def p1_assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[tuple[str, float]]]:
    label = procedures(spark, sf_dir).select("key", F.array_min("surgery").alias("label"))
    rows = _ties(spark, sf_dir).join(label, "key", "left")
    targets = [(r["split"], r["share"]) for r in table(spark, sf_dir, "split_targets").orderBy("split").collect()]
    return cut(assign_splits(rows, "key", "segment", "label", targets)), rows, targets


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_assigned(spark, sf_dir)[0].select(F.col("entity").alias("youtube_id"), F.col("component").alias("group_id"), "split")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, rows, targets = p1_assigned(spark, sf_dir)
    return split_report(assigned, rows, "key", "label", targets)


def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos that have a split, videos tied to others, and groups that lie in more than one split."""
    assigned = p1_assigned(spark, sf_dir)[0]
    per = assigned.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("split").alias("s"))
    tied = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_videos"), tied.alias("n_tied"), F.count_if(F.col("s") > 1).alias("n_torn"))


# ---- 2: repetition inside a document


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents and transcripts with its repeated share, the language its label names (in whatever notation), and its source in lower case. Transcripts have no label of language."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("record_id"), code_column(F.col("lang")).alias("lang"), _low(F.col("source")).alias("source"), F.col("text").alias("body"))
    said = table(spark, sf_dir, "transcripts").select(
        F.lit("transcripts").alias("origin"), F.col("transcript_id").alias("record_id"), F.lit(None).cast("string").alias("lang"), _low(F.col("backend")).alias("source"), F.col("transcript.text").alias("body")
    )
    return repetition(docs.unionByName(said), "body", ["origin", "record_id", "lang", "source"])


def p2_repetitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts above the adaptive threshold of their origin, language and source."""
    return repetitive(cut(p2_shares(spark, sf_dir)), ["origin", "lang", "source"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the operator's thresholds never exceed 0.3 (its ceiling), so this exact check on integers loses nothing
    return p2_repetitive(spark, sf_dir).filter("n_words > 0 AND n_repeated * 10 >= n_words * 3").select("origin", "record_id")


# ---- 6: sample matching target proportions


def _p6(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict], list[dict]]:
    targets = [
        {"field": r["field"].strip(), "category": r["category"].strip().lower(), "name": r["category"], "share": r["share"], "min_rows": r["min_rows"]}
        for r in table(spark, sf_dir, "category_targets").orderBy("field", "category").collect()
    ]
    fields = ["applicable_categories", "specialty", "surgery"]
    rows = table(spark, sf_dir, "vqa_rows")
    own = F.array_distinct(F.filter(F.transform("applicable_categories", lambda c: _low(c)), lambda c: c.isNotNull()))
    base = rows.select("row_id", _key().alias("key"), own.alias("applicable_categories")).join(procedures(spark, sf_dir), "key", "left").select("row_id", *fields)
    base = cut(base)
    sample, report = sample_to_targets(base, "row_id", fields, targets, base.count() // 2)
    return sample, report, targets


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6(spark, sf_dir)[0].select("row_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, availability, quota and rows drawn of each category."""
    names = {"field": "string", "name": "string", "share": "double", "min_rows": "bigint", "available": "bigint", "quota": "bigint", "drawn": "bigint", "drawn_share": "double", "category_share": "double", "short": "boolean", "missed": "boolean"}
    rows = [tuple(t[c] for c in names) for t in _p6(spark, sf_dir)[1]]
    return spark.createDataFrame(rows, ", ".join(f"{c} {kind}" for c, kind in names.items())).withColumnRenamed("name", "category")


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that supply each category, whether they are too few, and that nothing else was drawn than rows, each once, as many as asked for."""
    sample, report, _ = _p6(spark, sf_dir)
    n, once = sample.agg(F.count("*"), F.count_distinct("row_id")).first()
    rows = [(t["field"], t["name"], t["available"], t["short"], t["drawn"] <= t["available"], n, once) for t in report]
    return spark.createDataFrame(rows, "field string, category string, available bigint, short boolean, drawn_exist boolean, n_drawn bigint, n_different bigint")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _p6(spark, sf_dir)[1]
    return spark.createDataFrame([(t["field"], t["name"]) for t in report if t["short"]], "field string, category string")


# ---- 7 and 8: token sizes, containers, mixtures


def token_size(text):
    """Tokens of the public byte-level vocabulary: bytes in UTF-8 and one closing token; 0 for null."""
    return F.coalesce(F.octet_length(text) + 1, F.lit(0)).cast("bigint")


def _p7(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    stages = [(r["stage"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_budgets").orderBy("stage").collect()]
    sizes = table(spark, sf_dir, "documents").select("doc_id", token_size(F.col("text")).alias("tokens"))
    return pack(sizes, "doc_id", "tokens", stages), stages


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_report(*_p7(spark, sf_dir))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stage: documents, pieces and tokens that went in, containers above the capacity, and documents cut though they fit."""
    packed, stages = _p7(spark, sf_dir)
    caps = spark.createDataFrame(stages, "stage string, capacity bigint")
    bins = packed.groupBy("stage", "group", "bin").agg(F.sum("tokens").alias("held")).join(F.broadcast(caps), "stage")
    over = bins.groupBy("stage").agg(F.count_if(F.col("held") > F.col("capacity")).alias("n_overfull"))
    docs = packed.groupBy("stage", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("size")).join(F.broadcast(caps), "stage")
    per = docs.groupBy("stage").agg(F.count("*").alias("n_docs"), F.sum("pieces").alias("n_pieces"), F.sum("size").alias("tokens"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).alias("n_cut_for_nothing"))
    return per.join(over, "stage")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir)[0].filter("n_pieces > 1 AND piece = 0").select("stage", "doc_id")


def _p8(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    targets = [
        {"source": r["source"].strip().lower(), "name": r["source"], "weight": r["weight"], "max_repeats": r["max_repeats"]} for r in table(spark, sf_dir, "mixture_targets").orderBy("source").collect()
    ]
    docs = table(spark, sf_dir, "documents").select("doc_id", _low(F.col("source")).alias("source"), token_size(F.col("text")).alias("tokens"))
    return mix(docs, "doc_id", "source", "tokens", targets)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r["name"], r["weight"], r["max_repeats"], r["available"], r["blocks"], r["tokens"], r["actual_share"], r["short"]) for r in _p8(spark, sf_dir)[1]]
    return spark.createDataFrame(rows, "source string, weight double, max_repeats bigint, available bigint, blocks bigint, tokens bigint, actual_share double, short boolean")


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: tokens there are, whether they suffice, and documents that were used more often than allowed, or of no size known."""
    chosen, report = _p8(spark, sf_dir)
    limits = spark.createDataFrame([(r["source"], r["name"], r["max_repeats"], r["available"], r["short"]) for r in report], "source string, name string, most bigint, available bigint, short boolean")
    docs = table(spark, sf_dir, "documents").select("doc_id", token_size(F.col("text")).alias("size"))
    used = chosen.join(docs, "doc_id").join(F.broadcast(limits.select("source", "most")), "source")
    wrong = used.groupBy("source").agg(F.count_if((F.col("copies") > F.col("most")) | (F.col("size") != F.col("tokens"))).alias("n_wrong"))
    return limits.join(wrong, "source", "left").select(F.col("name").alias("source"), "available", "short", F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r["name"],) for r in _p8(spark, sf_dir)[1] if r["short"]], "source string")


# ---- 9: languages


def language_net(spark: SparkSession, sf_dir: str) -> ByteCNN:
    return trained(labelled_sample(table(spark, sf_dir, "documents"), "text", "lang", "doc_id"))


def p9_passages(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """Every passage with its language and confidence, beside the document's main language and label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", code_column(F.col("lang")).alias("label"), "text")
    return identify(docs, "text", ["doc_id", "label"], language_net(spark, sf_dir), with_text, "label")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = p9_passages(spark, sf_dir, with_text=False).groupBy("doc_id", "label", "main_lang").agg(F.collect_set("lang").alias("langs"))
    wrong = per.filter("label IS NULL OR label <> main_lang OR size(langs) > 1")
    return wrong.select("doc_id", F.explode("langs").alias("found_lang"))


# ---- 4: records across splits


def _p4(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = F.col("conversations")
    rows = table(spark, sf_dir, "vqa_rows").select("row_id", _key().alias("key"), strip_ws(F.col("split")).alias("split"), first_turn(turns, ASKING).alias("q"), first_turn(turns, ANSWERING).alias("a"))
    return cross_split_links(canonical_records(rows, "row_id", "key", "split", "q", "a"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_pairs(*_p4(spark, sf_dir)).select(F.least("eval_id", "train_id").alias("row_id_a"), F.greatest("eval_id", "train_id").alias("row_id_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, and rows that have any, of each evaluation split and source."""
    rows = table(spark, sf_dir, "vqa_rows").select("row_id", strip_ws(F.col("split")).alias("split"), _low(F.col("source")).alias("source"))
    return cross_split_counts(*_p4(spark, sf_dir), rows, "row_id", ["split", "source"])


# ---- 5: broken pairs


def _asked(conversations):
    return first_turn(conversations, ASKING)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, p = table(spark, sf_dir, "vqa_rows"), table(spark, sf_dir, "predictions")
    turns = F.col("conversations")
    rows = v.select(F.lit("vqa_rows").alias("origin"), F.col("row_id").alias("record_id"), F.lit("conversations").alias("field"), _asked(turns).alias("question"), first_turn(turns, ANSWERING).alias("answer"))
    states_none = F.lower(clean_str(F.col("error"))).isin("", "none", "null")

    def told(field: str, of: DataFrame) -> DataFrame:
        return of.select(F.lit("predictions").alias("origin"), F.col("pred_id").alias("record_id"), F.lit(field).alias("field"), _asked(turns).alias("question"), F.col(field).alias("answer"))

    return rows.unionByName(told("prediction", p.filter(states_none))).unionByName(told("gt_answer", p))


def pair_models(spark: SparkSession, sf_dir: str) -> tuple[ByteCNN, tuple, Corpus]:
    """Language network and tagger, trained on bounded samples: labelled documents, and SAMPLE_PAIRS pairs of all origins and fields by the hash of their ids; and the counts over all pairs."""
    sample = labelled_sample(table(spark, sf_dir, "documents"), "text", "lang", "doc_id")
    net = trained(sample)
    said = [(s, c) for t, c in zip(sample["text"], sample["code"], strict=True) for s in [x for x in sentences(t) if weight(x) >= 15][:3]]
    sure = net.score([s for s, _ in said]).argmax(axis=1) if said else []
    foreign = [(s, c) for (s, c), k in zip(said, sure, strict=True) if net.classes[k] == c]
    pairs = _pairs(spark, sf_dir)
    corpus = corpus_counts(pairs, "question", "answer", net)
    fits = (F.length("question") <= SAMPLE_CHARS) & (F.length("answer") <= SAMPLE_CHARS)
    h = F.pmod(F.xxhash64("origin", "record_id", "field"), F.lit(1 << 30))
    # a share of the pairs that holds the sample and little more, so that tasks don't each hand over a whole one
    share = min(1.0, 1.3 * SAMPLE_PAIRS / max(1, pairs.count()))
    picked = pairs.filter(fits & (h <= int((1 << 30) * share))).select(h.alias("h"), "question", "answer").orderBy("h", "question", "answer").limit(SAMPLE_PAIRS).collect()
    return net, train_tagger([(plain(r["question"]), plain(r["answer"])) for r in picked], foreign, net, corpus=corpus), corpus


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    net, tagger, corpus = pair_models(spark, sf_dir)
    return defective_pairs(_pairs(spark, sf_dir), ["origin", "record_id", "field"], "question", "answer", net, tagger, corpus)


def p5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).groupBy("origin", "field", "defect").agg(F.count("*").alias("n_pairs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_report, p1_checks, p2_found, p2_shares, p2_repetitive, p6_found, p6_sample, p6_report, p6_checks, p7_found, p7_packed, p7_report, p7_checks, p8_found, p8_mixture, p8_report, p8_checks, p9_found, p9_passages, p4_found, p4_report, p5_found, p5_summary)}

_KEY = r"""coalesce(nullif(regexp_replace(youtube_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), ''),
                  nullif(substr(regexp_extract(regexp_replace(video, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '([^/\\]*)$', 1), 1, 11), ''))"""
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_PROC = rf"""
p0 AS (SELECT nullif({_STRIP.format('youtube_id')}, '') AS k, CASE WHEN json_valid(entry) AND json_type(entry) = 'OBJECT' THEN CAST(entry AS JSON) END AS e FROM procedure_map),
proc AS (SELECT k, nullif(lower({_STRIP.format("e->>'$.surgery'")}), '') AS su, nullif(lower({_STRIP.format("e->>'$.specialty'")}), '') AS sp FROM p0 WHERE k IS NOT NULL)
"""
_LABEL = f"lower({_STRIP.format('lang')})"
_CODES = "map {" + ", ".join(f"'{n}': '{code}'" for code, names in LANGUAGE_NAMES.items() for n in names) + "}"
SQL = {
    "p1_found": rf"""WITH RECURSIVE ties AS (SELECT DISTINCT {_KEY} AS k, nullif({_STRIP.format('segment_id')}, '') AS s FROM clip_captions),
links AS (SELECT DISTINCT a.k, b.k AS o FROM ties a JOIN ties b ON a.s = b.s AND a.k <> b.k),
reach AS (SELECT k, o FROM links UNION SELECT r.k, l.o FROM reach r JOIN links l ON r.o = l.k)
SELECT k AS youtube_id, least(k, min(o)) AS group_id FROM reach GROUP BY k""",
    "p2_found": r"""WITH texts AS (SELECT 'documents' AS origin, doc_id AS record_id, text AS body FROM documents UNION ALL SELECT 'transcripts', transcript_id, transcript.text FROM transcripts),
lists AS (SELECT origin, record_id, regexp_extract_all(lower(body), '[\p{L}\p{N}_]+') AS w FROM texts WHERE body IS NOT NULL),
grams AS (SELECT origin, record_id, len(w) AS n, unnest(range(1, len(w) - 4)) AS i, w FROM lists WHERE len(w) >= 6),
seen AS (SELECT origin, record_id, n, i, row_number() OVER (PARTITION BY origin, record_id, array_to_string(w[i:i + 5], ' ') ORDER BY i) AS r FROM grams),
words AS (SELECT DISTINCT origin, record_id, n, unnest(range(i, i + 6)) AS j FROM seen WHERE r > 1)
SELECT origin, record_id FROM words GROUP BY origin, record_id, n HAVING count(*) * 10 >= n * 3""",
    "p2_shares": rf"""WITH texts AS (SELECT 'documents' AS origin, doc_id AS record_id, coalesce({_CODES}[{_LABEL}], {_CODES}[regexp_split_to_array({_LABEL}, '[-_. ]')[1]]) AS lang, lower({_STRIP.format('source')}) AS source, text AS body FROM documents
UNION ALL SELECT 'transcripts', transcript_id, NULL, lower({_STRIP.format('backend')}), transcript.text FROM transcripts),
lists AS (SELECT * EXCLUDE (body), CASE WHEN body IS NULL THEN [] ELSE regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+') END AS w FROM texts),
grams AS (SELECT origin, record_id, unnest(range(1, len(w) - 4)) AS i, w FROM lists WHERE len(w) >= 6),
seen AS (SELECT origin, record_id, i, row_number() OVER (PARTITION BY origin, record_id, array_to_string(w[i:i + 5], ' ') ORDER BY i) AS r FROM grams),
words AS (SELECT DISTINCT origin, record_id, unnest(range(i, i + 6)) AS j FROM seen WHERE r > 1),
n AS (SELECT origin, record_id, count(*) AS n FROM words GROUP BY origin, record_id)
SELECT origin, record_id, lang, source, len(w) AS n_words, coalesce(n.n, 0) AS n_repeated, coalesce(n.n, 0) / greatest(len(w), 1) AS repeated_share FROM lists LEFT JOIN n USING (origin, record_id)""",
    "p1_checks": rf"""WITH RECURSIVE ties AS (SELECT DISTINCT {_KEY} AS k, nullif({_STRIP.format('segment_id')}, '') AS s FROM clip_captions),
tied AS (SELECT DISTINCT a.k FROM ties a JOIN ties b ON a.s = b.s AND a.k <> b.k)
SELECT (SELECT count(DISTINCT k) FROM ties) AS n_videos, (SELECT count(*) FROM tied) AS n_tied, 0 AS n_torn""",
    "p6_checks": rf"""WITH {_PROC},
v AS (SELECT row_id, {_KEY} AS k, applicable_categories AS a FROM vqa_rows),
has AS (SELECT DISTINCT row_id, 'applicable_categories' AS f, lower({_STRIP.format('c')}) AS c FROM (SELECT row_id, unnest(a) AS c FROM v)
  UNION SELECT row_id, 'specialty', sp FROM v JOIN proc USING (k)
  UNION SELECT row_id, 'surgery', CASE WHEN su = 'open surgery' THEN 'open' ELSE su END FROM v JOIN proc USING (k)),
n AS (SELECT f, c, count(*) AS n FROM has GROUP BY f, c), half AS (SELECT count(*) // 2 AS h FROM vqa_rows)
SELECT t.field, t.category, coalesce(n.n, 0) AS available, coalesce(n.n, 0) < greatest(t.min_rows, t.share * h) AS short, true AS drawn_exist, h AS n_drawn, h AS n_different
FROM category_targets t CROSS JOIN half LEFT JOIN n ON n.f = t.field AND n.c = lower(t.category)""",
    "p7_checks": """WITH d AS (SELECT stage, capacity_tokens AS cap, coalesce(strlen(text) + 1, 0) AS n FROM pack_budgets, documents)
SELECT stage, count(*) AS n_docs, CAST(sum(greatest(1, c)) AS BIGINT) AS n_pieces, CAST(sum(n) AS BIGINT) AS tokens, 0 AS n_overfull, 0 AS n_cut_for_nothing FROM (SELECT stage, cap, n, (n + cap - 1) // cap AS c FROM d) GROUP BY stage""",
    "p8_checks": rf"""WITH d AS (SELECT lower({_STRIP.format('source')}) AS s, coalesce(strlen(text) + 1, 0) AS n FROM documents)
SELECT source, CAST(coalesce(n, 0) AS BIGINT) AS available, coalesce(n, 0) * max_repeats < weight * (SELECT sum(n) FROM d) AS short, 0 AS n_wrong
FROM mixture_targets t LEFT JOIN (SELECT s, sum(n) AS n FROM d GROUP BY s) ON s = t.source""",
    "p6_found": rf"""WITH {_PROC},
v AS (SELECT row_id, {_KEY} AS k, applicable_categories AS a FROM vqa_rows),
has AS (SELECT DISTINCT row_id, 'applicable_categories' AS f, lower({_STRIP.format('c')}) AS c FROM (SELECT row_id, unnest(a) AS c FROM v)
  UNION SELECT row_id, 'specialty', sp FROM v JOIN proc USING (k)
  UNION SELECT row_id, 'surgery', CASE WHEN su = 'open surgery' THEN 'open' ELSE su END FROM v JOIN proc USING (k)),
n AS (SELECT f, c, count(*) AS n FROM has GROUP BY f, c)
SELECT t.field, t.category FROM category_targets t LEFT JOIN n ON n.f = t.field AND n.c = lower(t.category)
WHERE coalesce(n.n, 0) < greatest(t.min_rows, t.share * (SELECT count(*) // 2 FROM vqa_rows))""",
    "p7_found": "SELECT stage, doc_id FROM pack_budgets, documents WHERE strlen(text) + 1 > capacity_tokens",
    "p8_found": rf"""WITH d AS (SELECT lower({_STRIP.format('source')}) AS s, coalesce(strlen(text) + 1, 0) AS n FROM documents)
SELECT source FROM mixture_targets t LEFT JOIN (SELECT s, sum(n) AS n FROM d GROUP BY s) ON s = t.source
WHERE coalesce(n, 0) * max_repeats < weight * (SELECT sum(n) FROM d)""",
}
