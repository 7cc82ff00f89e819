"""Clips in the order of their video, with what is said around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequilt.functions.text import ANSWERING, clean_text, file_stem, first_turn
from framequilt.functions.values import duration
from framequilt.operators.blocks import with_neighbours


def load_clips(rows: DataFrame, min_caption: int = 12) -> DataFrame:
    """Typed clips: video_path, youtube_id, segment_id, start_sec, end_sec, duration_sec, caption, line_no.

    Rows lacking video, times (numeric text is accepted) or segment_id are dropped, as are those whose caption (the first
    gpt turn, blank or not) is shorter than ``min_caption`` characters. A null or absent youtube_id becomes the stem of the file name.
    """
    caption = clean_text(first_turn(F.col("conversations"), ANSWERING[:1]))
    start, end = F.expr("try_cast(video_start AS double)"), F.expr("try_cast(video_end AS double)")
    return rows.select(
        F.col("video").alias("video_path"), F.coalesce(F.col("youtube_id"), file_stem(F.col("video"))).alias("youtube_id"), "segment_id",
        start.alias("start_sec"), end.alias("end_sec"), duration(start, end).alias("duration_sec"), caption.alias("caption"), "line_no",
    ).filter((F.length("caption") >= max(1, min_caption)) & F.col("video_path").isNotNull() & F.col("segment_id").isNotNull() & F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull())


def neighbour_context(df: DataFrame, group: str, order: list[str], text: str, radius: int = 1) -> DataFrame:
    """``context``: texts of up to ``radius`` rows before and after in the group, in order, marked PREV and NEXT, blank ones skipped.

    ``order`` must end with a unique column. Groups may be of any size: neighbours across blocks are looked up.
    """
    if radius <= 0:
        return df.withColumn("context", F.lit(""))
    rows = with_neighbours(df.withColumn("__said", clean_text(F.col(text))), [group], order, "__said", radius, "__before", "__after")

    def around(mark: str, said: str) -> Column:
        return F.transform(F.filter(said, lambda t: t != ""), lambda t: F.concat(F.lit(f"{mark}: "), t))

    return rows.withColumn("context", F.array_join(F.concat(around("PREV", "__before"), around("NEXT", "__after")), " | ")).drop("__said", "__before", "__after")


def first_per_segment(df: DataFrame, segment: str, order: list[str]) -> DataFrame:
    """One row per segment id over all groups, the first in processing order; rows with a blank id are dropped."""
    rank = F.row_number().over(Window.partitionBy(segment).orderBy(*order))
    return df.filter(F.trim(F.col(segment)) != "").withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
