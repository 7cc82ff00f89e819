"""Repetition inside a single document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequilt.llm.batches import in_batches

#: Words of a stretch that counts as repeated.
STRETCH = 6
_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words, and words that lie in a stretch of STRETCH or more words that began already earlier in the same text.

    Words are runs of letters, digits or underscores without regard to case. Every window of STRETCH words is hashed
    (64 bits, mixed with the text's number); a window whose hash occurred before marks its words. Null and empty texts
    have no words.
    """
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    total = int(n.sum())
    if not total:
        return n, np.zeros(len(texts), dtype=np.int64)
    ids = np.fromiter((hash(w) for ws in words for w in ws), dtype=np.int64, count=total).view(np.uint64)
    doc = np.repeat(np.arange(len(texts)), n)
    if total < STRETCH:
        return n, np.zeros(len(texts), dtype=np.int64)
    m = total - STRETCH + 1
    key = np.zeros(m, dtype=np.uint64)
    for k in range(STRETCH):
        key = (key ^ (key >> np.uint64(29))) * _STEP + ids[k : k + m]
    key = (key ^ (key >> np.uint64(32))) * _STEP + doc[:m].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    inside = doc[:m] == doc[STRETCH - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    later = order[1:][key[order[1:]] == key[order[:-1]]]
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, later, 1)
    np.add.at(edge, later + STRETCH, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return n, np.bincount(doc[covered], minlength=len(texts)).astype(np.int64)


def repetition(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Repeated share of every text: the columns ``keep`` (names other than n_words, n_repeated and repeated_share), n_words, n_repeated, repeated_share.

    A text without words (null, empty, signs only) has share 0. Whole texts are read, whatever their length.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(*keep, F.col(text).alias("__text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in in_batches(pdf, "__text"):
                n, r = repeated_words([t if isinstance(t, str) else None for t in part["__text"]])
                out = part[keep].copy()
                out["n_words"], out["n_repeated"] = n, r
                out["repeated_share"] = r / np.maximum(n, 1)
                yield out

    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "n_words bigint", "n_repeated bigint", "repeated_share double"])
    return rows.mapInPandas(measure, schema)


def adaptive_thresholds(measured: DataFrame, groups: list[str], quantile: float = 0.9, floor: float = 0.05, ceiling: float = 0.3) -> DataFrame:
    """Threshold of each group: the quantile of its shares, kept between floor and ceiling. Columns: groups, threshold, n_texts.

    KLL sketches are built per map task and merged in the shuffle, so a group of any size costs one sketch per task.
    """
    sketch = F.kll_sketch_agg_double("repeated_share")
    at = F.kll_sketch_get_quantile_double(F.col("sketch"), F.lit(quantile))
    per = measured.groupBy(*groups).agg(sketch.alias("sketch"), F.count("*").alias("n_texts"))
    return per.select(*groups, F.greatest(F.lit(floor), F.least(F.lit(ceiling), at)).alias("threshold"), "n_texts")


def repetitive(measured: DataFrame, groups: list[str], **options: float) -> DataFrame:
    """Texts whose share reaches the threshold of their group. Null group values form a group of their own."""
    limits = adaptive_thresholds(measured, groups, **options)
    renamed = limits.select(*[F.col(g).alias(f"__{g}") for g in groups], "threshold")
    same: Column = F.lit(True)
    for g in groups:
        same = same & measured[g].eqNullSafe(renamed[f"__{g}"])
    return measured.join(renamed, same).filter("repeated_share >= threshold").drop(*[f"__{g}" for g in groups])
