"""Running sums, positions and neighbours in groups of any size.

A window over a group sorts the whole group in one task. Here rows are laid out by ranges of (group, order), so that a
group lies in as many blocks as its size asks for; windows work inside a block, and what earlier blocks add reaches it
as one row. At most one group reaches over each border between blocks, so those rows are fewer than the blocks, whatever
the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequilt.session import cut, parallelism

BLOCK = "__block"


def in_blocks(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``__block``, ascending in (group, order). Materialised, as the ranges come from a sample of the rows."""
    n = parallelism(df.sparkSession)
    return cut(df.repartitionByRange(n, *group, *order).withColumn(BLOCK, F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"__r_{n}"]) for n in names])


def with_sums_before(blocks: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Adds to rows from ``in_blocks``, for each (name, value column) of ``sums``, the sum over the rows of the group that stand before; 0 for the first. Null groups form a group of their own; ``order`` must be unique within a group."""
    w = Window.partitionBy(BLOCK, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumns({n: F.coalesce(F.sum(v).over(w), F.lit(0)) for n, v in sums.items()})
    keys = [*group, BLOCK]
    per = blocks.groupBy(*keys).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    earlier = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # a block has such a row only for the one group that began before it
    carry = per.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.count(F.lit(1)).over(earlier).alias("__r_count"), *[F.sum(n).over(earlier).alias(f"__r_{n}") for n in sums])
    carry = carry.filter("__r_count > 0")
    joined = inside.join(F.broadcast(carry), _same(inside, carry, keys), "left")
    plus = {n: F.col(n) + F.coalesce(F.col(f"__r_{n}"), F.lit(0)) for n in sums}
    return joined.withColumns(plus).select(*blocks.columns, *sums)


def sums_before(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``with_sums_before`` for rows that aren't laid out yet."""
    return with_sums_before(in_blocks(df, group, order), group, order, sums).drop(BLOCK)


def with_position(df: DataFrame, order: Sequence[str], name: str = "position", group: Sequence[str] = ()) -> DataFrame:
    """Adds the place of each row (from 0, without gaps) in the order, over all rows or within a group."""
    return sums_before(df.withColumn("__one", F.lit(1).cast("bigint")), group, order, {name: "__one"}).drop("__one")


def with_neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, radius: int, before: str, after: str) -> DataFrame:
    """Adds the values of up to ``radius`` rows before and after each row of a group, as arrays in their order.

    Only the first and last ``radius`` rows of a block can have neighbours in another one. Those of the groups that reach
    over a border, 2 * radius for each block and group, are looked up in a table of such rows, which is broadcast.
    """
    blocks = in_blocks(df, group, order)
    keys = [*group, BLOCK]
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    inside = blocks.withColumns(
        {
            before: F.collect_list(value).over(w.rowsBetween(-radius, -1)),
            after: F.collect_list(value).over(w.rowsBetween(1, radius)),
            "__from_start": F.row_number().over(w),
            "__to_end": F.count(F.lit(1)).over(whole),
        }
    ).withColumn("__to_end", F.col("__to_end") - F.col("__from_start") + 1)
    spread = blocks.groupBy(*keys).agg(F.lit(1).alias("__here")).groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    # at most one group for each border between blocks
    spread = spread.select(*[F.col(g).alias(f"__r_{g}") for g in group])
    edge = inside.filter((F.col("__from_start") <= radius) | (F.col("__to_end") <= radius))
    edge = edge.join(F.broadcast(spread), _same(edge, spread, group), "left_semi") if group else edge
    over = Window.partitionBy(*group).orderBy(*order)
    names = [*group, *order]
    edge = edge.select(*[F.col(n).alias(f"__r_{n}") for n in names], F.collect_list(value).over(over.rowsBetween(-radius, -1)).alias("__r_before"), F.collect_list(value).over(over.rowsBetween(1, radius)).alias("__r_after"))
    joined = inside.join(F.broadcast(edge), _same(inside, edge, names), "left")
    out = joined.withColumns(
        {
            before: F.when((F.col("__from_start") <= radius) & F.col("__r_before").isNotNull(), F.col("__r_before")).otherwise(F.col(before)),
            after: F.when((F.col("__to_end") <= radius) & F.col("__r_after").isNotNull(), F.col("__r_after")).otherwise(F.col(after)),
        }
    )
    return out.select(*df.columns, before, after)


def smallest(df: DataFrame, key: str, tie: str, n: int, step: int = 4, most: int = 1_000_000) -> DataFrame:
    """The ``n`` rows with the smallest ``key``, a hexadecimal hash of 40 digits; ties by ``tie``.

    Keys are counted by their leading digits, a few more at a time, until the rows that share the prefix at which n is
    reached are few enough to be ranked. What lies below that prefix is taken by a filter, without any sort.
    """
    if n <= 0:
        return df.limit(0)
    prefix, left, inside = "", n, None
    while len(prefix) < 40 and (inside is None or inside > most):
        size = len(prefix) + step
        rows = df if not prefix else df.filter(F.col(key).startswith(prefix))
        # at most 16^step rows
        counts = rows.groupBy(F.substring(key, 1, size).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        for r in counts:
            if left <= r["n"]:
                prefix, inside = r["p"], r["n"]
                break
            left -= r["n"]
        else:
            return df  # there are no more than n rows
    below = df.filter((F.col(key) < prefix) & ~F.col(key).startswith(prefix))
    return below.unionByName(df.filter(F.col(key).startswith(prefix)).orderBy(key, tie).limit(left))
