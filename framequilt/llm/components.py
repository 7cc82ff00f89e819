"""Connected components of entities that share values, by alternating star contraction.

Links and components stay distributed: every step is an aggregate and a join, and each round is cut by a reliable
checkpoint. A value shared by a third of all entities is reduced to a star by one aggregate. Links of hubs (nodes with
more than HUB_LINKS links) find their hub's least neighbour by a broadcast of at most one row for so many links, so no
join puts a hub's links in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequilt.session import cut, discard

#: Stars halve the longest path, roughly; this many rounds reach through paths of far over a million entities.
MAX_ROUNDS = 60


#: Links above which a node is a hub.
HUB_LINKS = 100_000


def _joined(rows: DataFrame, least: DataFrame, key: str, used: list[DataFrame]) -> DataFrame:
    """Rows with the columns of ``least`` (key, m, n: links of the key): those of hubs by a broadcast, the others by a join on the key."""
    least = cut(least)
    used.append(least)
    hubs = F.broadcast(least.filter(F.col("n") > HUB_LINKS).drop("n"))
    return rows.join(hubs, key).unionByName(rows.join(hubs.select(key), key, "left_anti").join(least.filter(F.col("n") <= HUB_LINKS).drop("n"), key))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Each node links its larger neighbours to the least node around."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _joined(both, least, "u", used).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of these. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    rest = _joined(edges, least, "u", used).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(pairs: DataFrame, entity: str, value: str) -> DataFrame:
    """Entities that share a value, directly or through others: entity, component (the least entity of all).

    One row per entity of ``pairs`` with a non-null key; an entity that shares nothing is its own component. Null values tie nothing.
    Repeated rows change nothing; an empty table gives an empty table. Raises if MAX_ROUNDS don't suffice, instead of
    returning a partial result.
    """
    known = pairs.select(F.col(entity).cast("string").alias("e"), F.col(value).cast("string").alias("s")).filter("e IS NOT NULL").distinct()
    known = cut(known)
    least = known.filter("s IS NOT NULL").groupBy("s").agg(F.min("e").alias("m"), F.count("*").alias("n"))
    used: list[DataFrame] = []
    edges = cut(_joined(known.filter("s IS NOT NULL"), least, "s", used).filter("e > m").select(F.col("e").alias("u"), F.col("m").alias("v")).distinct())
    before = _fingerprint(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        used.append(edges)
        stars = cut(_large_star(edges, used))
        used.append(stars)
        edges = cut(_small_star(stars, used))
        while used:  # what this round was made from
            discard(used.pop())
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't complete after {MAX_ROUNDS} rounds")
    everyone = known.select("e").distinct()
    return everyone.join(edges, F.col("e") == F.col("u"), "left").select(F.col("e").alias("entity"), F.coalesce("v", "e").alias("component"))
