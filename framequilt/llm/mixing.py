"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequilt.llm.apportion import sainte_lague
from framequilt.session import cut

BLOCK_TOKENS = 4_096
#: Tokens that a shard should hold, and the most shards: (source, shard) sums come to the driver, at most MAX_SHARDS per source of the targets.
SHARD_TOKENS = 16_000_000
MAX_SHARDS = 10_000


def mixture_report(docs: DataFrame, source: str, tokens: str, targets: list[dict]) -> tuple[list[dict], int]:
    """Available tokens of each target source beside what its weight asks for, and the tokens of all documents.

    short: the source's tokens times max_repeats stay below weight times all tokens.
    """
    sums = docs.groupBy(F.col(source).alias("s")).agg(F.sum(tokens).alias("n"))
    wanted = docs.sparkSession.createDataFrame([(t["source"],) for t in targets], "s string")
    have = {r["s"]: int(r["n"] or 0) for r in sums.join(F.broadcast(wanted), "s").collect()}
    total = int(docs.agg(F.sum(tokens)).first()[0] or 0)
    out = []
    for t in targets:
        a = have.get(t["source"], 0)
        out.append(t | {"available": a, "wanted": t["weight"] * total, "short": a * t["max_repeats"] < t["weight"] * total})
    return out, total


def mix(docs: DataFrame, doc_id: str, source: str, tokens: str, targets: list[dict], block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """Documents of the mixture with their number of copies, and the report with actual tokens and shares.

    targets: dictionaries with source, weight, max_repeats. The mixture is as large as all documents together. Seats are
    blocks of ``block_tokens``, the last one of a source that gives out may be partial: first apportioned to the sources, then, for each source, to hashed shards by their tokens.
    Within (source, shard) the documents stand in seeded order and form blocks; whole passes give every document a copy,
    the rest takes the first blocks of that order. No document gets more than max_repeats copies. What a
    source can't supply goes to the others by the same quotients. Sources without target, null included, are left out;
    an empty table gives an empty mixture. Returns (doc_id, source, shard, tokens, copies), report.
    """
    base = cut(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("src"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n")))
    report, total = mixture_report(base, "src", "n", targets)
    n_shards = max(1, min(MAX_SHARDS, -(-total // SHARD_TOKENS)))
    sharded = base.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_shards)).cast("int"))
    names = docs.sparkSession.createDataFrame([(t["source"],) for t in targets], "src string")
    mine = sharded.join(F.broadcast(names), "src", "left_semi")
    sums: dict[str, dict[int, int]] = {t["source"]: {} for t in targets}
    for r in mine.groupBy("src", "shard").agg(F.sum("n").alias("n")).collect():
        sums[r["src"]][r["shard"]] = int(r["n"])
    most = [r["available"] * r["max_repeats"] for r in report]
    caps = [-(-m // block_tokens) for m in most]
    blocks = round(total / block_tokens)
    seats = sainte_lague([r["weight"] for r in report], blocks, caps)
    # what partial blocks lack is given out again; seats only grow, so this ends after at most as many rounds as there are sources
    while (want := blocks + round(sum(max(0, s * block_tokens - m) for s, m in zip(seats, most, strict=True)) / block_tokens)) > sum(seats):
        more = sainte_lague([r["weight"] for r in report], want, caps)
        if more == seats:
            break
        seats = more
    plan = []
    for r, s in zip(report, seats, strict=True):
        r["blocks"] = s
        own = sorted((k, n) for k, n in sums[r["source"]].items() if n > 0)
        # a shard's own cap is rounded up: copies are bounded below, document by document
        for (k, n), q in zip(own, sainte_lague([float(n) for _, n in own], s, [-(-n * r["max_repeats"] // block_tokens) for _, n in own]), strict=True):
            whole, rest = divmod(q * block_tokens, n)
            plan.append((r["source"], k, int(whole), int(rest), int(r["max_repeats"])))
    quotas = docs.sparkSession.createDataFrame(plan, "src string, shard int, whole bigint, rest bigint, most bigint")
    order = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id")
    # a document belongs to the rest while less than that stands before its middle: the sum comes out near it
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2
    placed = mine.withColumn("before", before).join(F.broadcast(quotas), ["src", "shard"])
    copies = F.least(F.col("most"), F.col("whole") + (F.col("before") < F.col("rest")).cast("bigint"))
    chosen = cut(placed.withColumn("copies", copies).filter("copies > 0").select(F.col("id").alias(doc_id), F.col("src").alias(source), "shard", F.col("n").alias(tokens), "copies"))
    got = {r[0]: int(r[1]) for r in chosen.groupBy(source).agg(F.sum(F.col(tokens) * F.col("copies"))).collect()}
    mixed = max(1, sum(got.values()))
    for r in report:
        r["tokens"] = got.get(r["source"], 0)
        r["actual_share"] = r["tokens"] / mixed
    return chosen, report
