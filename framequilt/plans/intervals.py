"""Queries on the clip intervals of each video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequilt.functions.text import video_key
from framequilt.operators.intervals import interval_gaps, interval_periods
from framequilt.session import scratch, table
from framequilt.streaming.incremental import gaps_of_states, interval_state


def clip_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, start_ms, end_ms of every clip; times that are missing, NaN or infinite become null."""
    clips = table(spark, sf_dir, "clip_captions")

    def ms(c: str):
        t = F.col(c)
        return F.when(F.isnan(t) | (F.abs(t) > 9e15), None).otherwise(F.round(t * 1000).cast("bigint"))

    return clips.select(video_key(F.col("youtube_id"), F.col("video")).alias("key"), ms("video_start").alias("start_ms"), ms("video_end").alias("end_ms"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_gaps(clip_times(spark, sf_dir), "key", "start_ms", "end_ms").withColumnRenamed("key", "youtube_id")


def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_periods(clip_times(spark, sf_dir), "key", "start_ms", "end_ms").withColumnRenamed("key", "youtube_id")


def p3_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps of p3_found from the keyed state of a stream over the same rows, read in several micro-batches."""
    folder = scratch(spark, "clips")
    rows = clip_times(spark, sf_dir)
    for part in range(3):  # files that arrive one after another
        rows.filter(F.pmod(F.xxhash64("start_ms", "end_ms"), F.lit(3)) == part).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, rows.rdd.getNumPartitions())).parquet(f"{folder}/in")
    states = interval_state(stream, "key", "start_ms", "end_ms")

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    query = states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return gaps_of_states(spark.read.parquet(f"{folder}/states")).withColumnRenamed("key", "youtube_id")


QUERIES = {"p3_found": p3_found, "p3_periods": p3_periods, "p3_stream": p3_stream}

_CLIPS = r"""
clips AS (
  SELECT coalesce(nullif(regexp_replace(youtube_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), ''),
                  nullif(substr(regexp_extract(regexp_replace(video, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '([^/\\]*)$', 1), 1, 11), '')) AS k,
         CAST(round(video_start * 1000) AS BIGINT) AS s, CAST(round(video_end * 1000) AS BIGINT) AS e
  FROM clip_captions WHERE NOT isnan(video_start) AND NOT isnan(video_end)),
ok AS (SELECT DISTINCT * FROM clips WHERE k IS NOT NULL AND e > s),
reach AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok)
"""
SQL = {
    "p3_found": f"WITH {_CLIPS} SELECT k AS youtube_id, before AS gap_start_ms, s AS gap_end_ms FROM reach WHERE s > before",
    "p3_periods": f"""WITH {_CLIPS},
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM reach)
SELECT k AS youtube_id, 'covered' AS kind, min(s) AS start_ms, max(e) AS end_ms FROM runs GROUP BY k, run
UNION ALL SELECT k, 'gap', before, s FROM reach WHERE s > before""",
}
SQL["p3_stream"] = SQL["p3_found"]
