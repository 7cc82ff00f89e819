"""Numbers, times, boxes and names."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequilt.functions.text import clean_text, strip_ws


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm; milliseconds are rounded half to even and carried; hours may take more than two digits."""
    whole = F.floor(seconds)
    ms = F.rint((seconds - whole) * 1000).cast("bigint")
    carry = F.when(ms == 1000, 1).otherwise(0)
    total = whole.cast("bigint") + carry
    ms = F.when(ms == 1000, 0).otherwise(ms)
    return F.when(
        seconds.isNotNull(),
        F.format_string("%02d:%02d:%02d.%03d", F.floor(total / 3600).cast("bigint"), F.floor(total % 3600 / 60).cast("bigint"), total % 60, ms),
    )


@F.pandas_udf(T.DoubleType())
def round3(values: pd.Series) -> pd.Series:
    """Three decimals as the exact binary value rounds, half to even."""
    return values.map(lambda v: None if v is None or v != v else round(v, 3)).astype("float64")


def duration(start: Column, end: Column) -> Column:
    """Seconds from start to end, never negative, to three decimals."""
    return round3(F.greatest(F.lit(0.0), (end - start).cast("double")))


def even_int(x: Column) -> Column:
    """Half to even, at least 2, odd numbers lowered by one."""
    n = F.greatest(F.rint(x).cast("bigint"), F.lit(2).cast("bigint"))
    return n - n % 2


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def expand_box(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column, share: float) -> Column:
    """Box padded by a share of its size and kept within the frame: struct x, y, w, h."""
    zero = F.lit(0).cast("bigint")
    px, py = F.rint(w * share).cast("bigint"), F.rint(h * share).cast("bigint")
    left, top = clamp(x - px, zero, frame_w - 2), clamp(y - py, zero, frame_h - 2)
    right, bottom = clamp(x + w + px, left + 2, frame_w), clamp(y + h + py, top + 2, frame_h)
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def restrict_window(x: Column, y: Column, w: Column, h: Column, inner: Column, frame_w: Column, frame_h: Column) -> Column:
    """A box moved into ``inner`` (struct left, top, right, bottom) and brought to even sizes: struct x, y, w, h."""
    bx = clamp(x, inner["left"], F.greatest(inner["left"], inner["right"] - 2))
    by = clamp(y, inner["top"], F.greatest(inner["top"], inner["bottom"] - 2))
    right, bottom = clamp(bx + w, bx + 2, inner["right"]), clamp(by + h, by + 2, inner["bottom"])
    ex, ey = even_int(bx), even_int(by)
    two = F.lit(2).cast("bigint")
    return F.struct(ex.alias("x"), ey.alias("y"), clamp(even_int(right - ex), two, frame_w - ex).alias("w"), clamp(even_int(bottom - ey), two, frame_h - ey).alias("h"))


def borders(frame_w: Column, frame_h: Column, x: Column, y: Column, w: Column, h: Column, min_share: float = 0.025, min_px: int = 16) -> Column:
    """What a crop cuts off, and whether it is worth it: the largest border and the largest share are taken independently of each other."""
    right, bottom = frame_w - (x + w), frame_h - (y + h)
    px = F.greatest(x, y, right, bottom)
    share = F.greatest(x / frame_w, y / frame_h, right / frame_w, bottom / frame_h)
    return F.struct(
        x.alias("left"), y.alias("top"), right.alias("right"), bottom.alias("bottom"), px.alias("largest_border_px"), share.alias("largest_border_pct"),
        (w * h / (frame_w * frame_h)).alias("kept_area_ratio"), ((px >= min_px) & (share >= min_share)).alias("crop_needed"),
    )


def implausible_box(w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """Too wide, too tall or too small for a procedure window."""
    aspect = w / F.greatest(h, F.lit(1))
    area = w * h / F.greatest((frame_w * frame_h).cast("double"), F.lit(1.0))
    return (aspect > 3.8) | (aspect < 0.45) | (area < 0.05)


def component_score(x: Column, y: Column, w: Column, h: Column, area: Column, frame_w: Column, frame_h: Column) -> Column:
    """Large and central components score high."""
    half_w, half_h = frame_w / 2.0, frame_h / 2.0
    dx = F.abs(x + w / 2.0 - half_w) / F.greatest(half_w, F.lit(1.0))
    dy = F.abs(y + h / 2.0 - half_h) / F.greatest(half_h, F.lit(1.0))
    return area.cast("double") * (1.0 - 0.35 * F.least(dx * dx + dy * dy, F.lit(1.0)))


def crop_sample_times(seconds: Column, n: Column) -> Column:
    """``n`` evenly spaced times inside a margin of 5 %, one second at most; the middle where the clip or ``n`` is too small."""
    margin = F.least(F.lit(1.0), seconds * 0.05)
    first, last = margin, F.greatest(margin, seconds - margin)
    few = (seconds <= 2.0) | (n <= 1) | (last <= first)
    step = (last - first) / F.greatest(n - 1, F.lit(1))
    times = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), lambda i: first + i * step)
    return F.when(few, F.array(F.greatest(F.lit(0.0), seconds / 2.0))).otherwise(times)


def eval_sample_times(seconds: Column, n: Column) -> Column:
    """Middles of ``n`` equal parts; an error where there is nothing to sample."""
    ok = (seconds > 0) & (n > 0)
    times = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), lambda i: (i + 0.5) * seconds / n)
    return F.when(ok, times).otherwise(F.raise_error(F.lit("duration and number of frames must be above 0")).cast("array<double>"))


def audio_chunk_plan(size_bytes: Column, seconds: Column, max_mb: float = 25.0) -> Column:
    """Parts of an audio file: array of struct chunk_no, start_sec, end_sec. One part (0 to the duration) where the file is small enough or its duration unknown."""
    part = F.greatest(F.lit(10.0), F.lit(20.0 * 1024 * 1024) / size_bytes * seconds * 0.8)
    n = F.ceil(seconds / part).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("chunk_no"), F.lit(0.0).alias("start_sec"), seconds.cast("double").alias("end_sec")))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(i.alias("chunk_no"), (i * part).alias("start_sec"), F.least((i + 1) * part, seconds).alias("end_sec")))
    return F.when((size_bytes <= max_mb * 1024 * 1024) | seconds.isNull() | (seconds == 0), whole).otherwise(cut)


def crop_filter(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.format_string("crop=%d:%d:%d:%d", w, h, x, y)


def safe_folder_name(c: Column) -> Column:
    """Characters that file systems refuse become underscores, blanks are collapsed, at most 200 characters."""
    return F.substring(strip_ws(clean_text(F.translate(c, '<>:"/\\|?*', "_________"))), 1, 200)


def safe_dir_name(c: Column, most: int = 80) -> Column:
    """Only ASCII letters, digits, dot, dash and underscore; 'row' where nothing is left."""
    cut = F.substring(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), 1, most)
    return F.coalesce(F.nullif(F.regexp_replace(cut, "^_+|_+$", ""), F.lit("")), F.lit("row"))


@F.pandas_udf(T.StringType())
def _uid(video: pd.Series, start: pd.Series, end: pd.Series, category: pd.Series, question: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha1(f"{v}|{s:.3f}|{e:.3f}|{c}|{q}|{a}".encode()).hexdigest() for v, s, e, c, q, a in zip(video, start, end, category, question, answer, strict=True)])


def record_uid(video: Column, start: Column, end: Column, category: Column, question: Column, answer: Column) -> Column:
    """sha1 over the record's fields joined by bars; seconds to three decimals of the exact binary value, texts cleaned. Null texts count as ''."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return _uid(blank(video), zero(start), zero(end), blank(category), clean_text(question), clean_text(answer))


def seeded(seed: int, *keys: Column) -> Column:
    """Order for reproducible choices: the same in every engine and on any number of partitions."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
