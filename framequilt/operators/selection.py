"""Filters, de-duplication and joins that choose rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequilt.functions.text import blank_to_null, clean_str, strip_ws
from framequilt.functions.values import seeded
from framequilt.operators.blocks import smallest, with_position

# Spellings that say yes, and spellings that state no error.
YES = ("yes", "y", "true", "1")
NO_ERROR = ("", "none", "null")
# Display names of the ways of operating.
SURGERY_TYPES = {"robotic": "Robotic", "laparoscopic": "Laparoscopic", "open": "Open", "open surgery": "Open", "other": "Other"}


def trim_headers(df: DataFrame) -> DataFrame:
    """Column names without blanks at the ends."""
    return df.toDF(*[str(c).strip() for c in df.columns])


def require_columns(df: DataFrame, required: Sequence[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Raises KeyError for a missing column; adds the columns of ``defaults`` that are missing."""
    if missing := [c for c in required if c not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    for name, value in (defaults or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def says_yes(c: Column) -> Column:
    """Null says no."""
    return F.coalesce(F.lower(strip_ws(c.cast("string"))).isin(*YES), F.lit(False))


def narrated_surgery(kind: Column, phase: Column) -> Column:
    """Rows of surgeries whose phase info names a surgeon's narration; null says no."""
    return F.coalesce((F.lower(strip_ws(kind)) == "surgery") & F.lower(phase).contains("surgeon narration"), F.lit(False))


def stated_error(c: Column) -> Column:
    """The error a row states, or null."""
    return F.when(~F.lower(clean_str(c)).isin(*NO_ERROR), clean_str(c))


def surgery_type(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SURGERY_TYPES.items() for x in kv])
    s = clean_str(c)
    return F.coalesce(known[F.lower(s)], s)


def split_filter(value: str | None) -> list[str]:
    """Values of a comma-separated option; a value can't hold a comma."""
    return [v for p in (value or "").split(",") if (v := p.strip())]


def metadata_filter(df: DataFrame, procedures: Sequence[str] = (), specialties: Sequence[str] = (), types: Sequence[str] = ()) -> DataFrame:
    """Rows that match every filter given, any value within one. Exact and case-sensitive for procedure and specialty (where 'unknown' is blank), normalised for surgery."""
    known = lambda c: F.when(F.lower(clean_str(c)) == "unknown", "").otherwise(clean_str(c))
    if procedures:
        df = df.filter(known(F.col("procedure")).isin(*procedures))
    if specialties:
        df = df.filter(known(F.col("specialty")).isin(*specialties))
    if types:
        df = df.filter(surgery_type(F.col("surgery")).isin(*[SURGERY_TYPES.get(t.strip().lower(), t.strip()) for t in types]))
    return df


def procedure_label(*candidates: Column) -> Column:
    """The first candidate that is neither blank nor 'unknown'; '' where there is none."""
    return F.coalesce(*[F.when(F.lower(strip_ws(c)) != "unknown", blank_to_null(c)) for c in candidates], F.lit(""))


def latest_per_key(df: DataFrame, key: Column, order: str, keep: Sequence[str] | None = None) -> DataFrame:
    """The last row of each key, with ``first_seen``: the place where the key came first. ``order`` is unique.

    Rows are reduced to one per key and task before the shuffle. Name in ``keep`` the columns that are needed: a row
    travels whole, so the scan reads whatever is in it.
    """
    cols = list(keep) if keep is not None else df.columns
    named = df.select(key.alias("__key"), F.col(order).alias("__order"), F.struct(*cols).alias("__row"))
    kept = named.groupBy("__key").agg(F.max_by("__row", "__order").alias("r"), F.min("__order").alias("first_seen"))
    return kept.select("r.*", "first_seen")


def first_per_key(df: DataFrame, key: Column, order: str, keep: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key; ``keep`` as above."""
    cols = list(keep) if keep is not None else df.columns
    named = df.select(key.alias("__key"), F.col(order).alias("__order"), F.struct(*cols).alias("__row"))
    return named.groupBy("__key").agg(F.min_by("__row", "__order").alias("r")).select("r.*")


def without_done(df: DataFrame, done: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """Rows that aren't done yet."""
    return df.join(done, on, "left_anti")


def only_listed(df: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    return df.join(allowed.select(on).distinct(), on, "left_semi")


def sample_per_group(df: DataFrame, group: str, row_key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows of each group by seeded hash, all for k = 0. Ranks within a group are taken on key columns only by Spark's window group limit, which prunes before the shuffle."""
    if k <= 0:
        return df
    rank = F.row_number().over(Window.partitionBy(group).orderBy(seeded(seed, F.col(row_key)), row_key))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def sample_fraction(df: DataFrame, row_key: str, percent: int, seed: int) -> DataFrame:
    """Exactly floor(n * percent / 100) rows by seeded hash; 100 or more means all. ``row_key`` is unique. The limit is found by counting hashes, so no task sorts the rows that are taken."""
    if percent >= 100:
        return df
    n = df.count() * max(0, percent) // 100
    return smallest(df.withColumn("__h", seeded(seed, F.col(row_key))), "__h", row_key, n).drop("__h")


def cap_groups(df: DataFrame, group: str, most: int, seed: int) -> DataFrame:
    """Rows of ``most`` groups, chosen by seeded hash; 0 means all."""
    if most <= 0:
        return df
    chosen = df.select(group).distinct().orderBy(seeded(seed, F.col(group)), group).limit(most)
    return df.join(chosen, group, "left_semi")


def rank_shard(df: DataFrame, order: str, rank: int, world: int) -> DataFrame:
    """Every ``world``-th of these rows from ``rank`` on, counted in their order, whatever numbers ``order`` holds."""
    return with_position(df, [order], "__place").filter(F.pmod(F.col("__place"), F.lit(world)) == rank).drop("__place")


#: Rows up to which the first ones are found by a top-k; more are found by their place.
TOP_ROWS = 100_000


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` of these rows in their order, whatever numbers ``order`` holds; all for n = 0 or less. Nulls come first, ties are broken by chance: ``order`` should be unique."""
    if n <= 0:
        return df
    if n <= TOP_ROWS:
        return df.orderBy(order).limit(n)
    return with_position(df, [order], "__place").filter(F.col("__place") < n).drop("__place")


def judged_before(df: DataFrame, judged: DataFrame, key: str, order: str) -> DataFrame:
    """Rows beside an earlier verdict (columns old_score, old_row): the last row of the key decides, and counts only where its score is 0 or 1, whatever has changed in the row since. Rows without one have nulls."""
    row = F.struct(*judged.columns)
    last = judged.select(F.col(key), F.col(order).alias("__order"), row.alias("old_row")).groupBy(key).agg(F.max_by("old_row", "__order").alias("old_row"))
    old = last.filter(F.col("old_row.llm_judge_score").isin(0, 1)).select(key, F.col("old_row.llm_judge_score").alias("old_score"), "old_row")
    return df.join(old, key, "left")


def count_by(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows of each value of an expression: ``name``, n."""
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def selected_total(df: DataFrame, group: str, most: int) -> DataFrame:
    """How many rows a choice of ``most`` per group will take (0 means all): selected."""
    n = F.least(F.col("n"), F.lit(most)) if most > 0 else F.col("n")
    return df.groupBy(group).agg(F.count("*").alias("n")).agg(F.sum(n).alias("selected"))
