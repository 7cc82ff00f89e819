"""Sample that matches target proportions of categories in several fields at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequilt.llm.apportion import largest_remainder
from framequilt.session import cut

#: Rows that a bucket of random keys should hold: only the bucket in which a quota ends is ranked row by row.
BUCKET_ROWS = 10_000
#: Target categories of a field that a row's cell names, the scarcest first: there are at most as many cells as the targets have such subsets.
CELL_CATEGORIES = 4
#: Weight of even drawing against the quotas: a relative miss of 1 shifts the log odds of a row by 1 / SOFTNESS.
SOFTNESS = 0.005
#: Deviation of a category's share from its target that still counts as met.
TOLERANCE = 0.01


def _array(field: str) -> Column:
    return F.coalesce(F.col(field), F.array().cast("array<string>"))


def _tagged(field: str) -> Column:
    return F.transform(_array(field), lambda c: F.struct(F.lit(field).alias("field"), c.alias("category")))


def _held(field: str, ranked: list[str]) -> Column:
    """The first CELL_CATEGORIES of ``ranked`` that the row's array holds, in that order."""
    return F.slice(F.filter(F.array(*[F.lit(c) for c in ranked]).cast("array<string>"), lambda c: F.array_contains(_array(field), c)), 1, CELL_CATEGORIES)


def category_report(rows: DataFrame, fields: list[str], targets: list[dict], n_sample: int) -> list[dict]:
    """Availability and integer quota of each target, one dictionary per (field, category) of ``targets``.

    ``rows`` has an array of strings per field, each category at most once, in the targets' spelling. Counted before the
    shuffle by partial aggregation, so a category of any size costs one row per task.
    """
    pairs = F.explode(F.flatten(F.array(*[_tagged(f) for f in fields])))
    wanted = rows.sparkSession.createDataFrame([(t["field"], t["category"]) for t in targets], "field string, category string")
    counts = rows.select(pairs.alias("p")).select("p.field", "p.category").groupBy("field", "category").agg(F.count("*").alias("n"))
    have = {(r["field"], r["category"]): r["n"] for r in counts.join(F.broadcast(wanted), ["field", "category"]).collect()}
    counted = [t | {"available": have.get((t["field"], t["category"]), 0)} for t in targets]
    return [t | {"short": t["available"] < max(t["min_rows"], t["share"] * n_sample)} for t in with_quotas(counted, fields, dict.fromkeys(fields, n_sample))]


def with_quotas(report: list[dict], fields: list[str], totals: dict[str, int]) -> list[dict]:
    """Integer quotas of each field's categories, which add up to the field's total where availability allows it."""
    out = []
    for field in fields:
        own = [t for t in report if t["field"] == field]
        quotas = largest_remainder([t["share"] for t in own], totals[field], [t["min_rows"] for t in own], [t["available"] for t in own])
        out += [t | {"quota": q} for t, q in zip(own, quotas, strict=True)]
    return out


def categories_to_draw(cells: list[tuple[list[str], ...]], counts: list[int], n_sample: int) -> list[int]:
    """How many categories a sample should hold in each field, counting a row once for each.

    Where rows hold one category or none, that is one for each row. Where they hold several, it lies half-way between
    the fewest that rows with a category can hold and what they hold on average: fewer would tie the draw to rows of a
    single category, and spoil the other fields.
    """
    out = []
    for j in range(len(cells[0]) if cells else 0):
        size = np.array([len(c[j]) for c in cells])
        many = np.array(counts)[size > 0]
        size = size[size > 0]
        if not len(size):
            out.append(n_sample)
            continue
        order = np.argsort(size, kind="stable")
        upto = np.minimum(np.cumsum(many[order]), n_sample)
        fewest = float((np.diff(np.concatenate([[0], upto])) * size[order]).sum()) / max(1, min(n_sample, int(many.sum())))
        mean = float((size * many).sum() / many.sum())
        out.append(round(n_sample * (fewest + mean) / 2))
    return out




def cell_quotas(cells: list[tuple[list[str], ...]], counts: list[int], fields: list[str], report: list[dict], n_sample: int) -> list[int]:
    """Rows to draw from each cell (the categories that its rows hold, field by field), so that each category is held by as many rows as its quota says, or as near as the cells allow.

    A row counts for all its categories. The share drawn of a cell is a logistic function of its categories' weights, so
    it lies between none and all; Newton's method finds the weights. Where quotas contradict each other (rows with many
    categories), their relative misses are kept small together, and even.
    """
    cap = np.array(counts, dtype=float)
    total = int(cap.sum())
    if n_sample >= total:
        return list(counts)
    if n_sample <= 0:
        return [0] * len(counts)
    wanted = [t for t in report if t["quota"] > 0]
    at = {(t["field"], t["category"]): i for i, t in enumerate(wanted)}
    a = np.zeros((len(cells), len(wanted) + 1))
    a[:, -1] = 1.0
    for i, cell in enumerate(cells):
        for f, held in zip(fields, cell, strict=True):
            for c in held:
                if (f, c) in at:
                    a[i, at[f, c]] = 1.0
    goal = np.array([*[float(t["quota"]) for t in wanted], float(n_sample)])
    ridge = np.array([*(SOFTNESS * goal[:-1]), 1e-9])
    w = np.zeros(len(goal))
    w[-1] = np.log(n_sample / (total - n_sample))

    def state(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(a @ v, -500, 500)
        return float((cap * np.logaddexp(0, z)).sum() - goal @ v + 0.5 * (ridge * v * v).sum()), cap / (1 + np.exp(-z))

    value, x = state(w)
    for _ in range(200):
        slope = a.T @ x - goal + ridge * w
        if np.abs(slope).max() < 1e-6 * n_sample:
            break
        curve = (a * (x * (1 - x / np.maximum(cap, 1e-9)))[:, None]).T @ a + np.diag(ridge + 1e-9)
        move = np.linalg.solve(curve, slope)
        step = 1.0
        while step > 1e-6:
            new_value, new_x = state(w - step * move)
            if new_value <= value - 1e-4 * step * (slope @ move):
                break
            step /= 2
        if step <= 1e-6:
            break
        w, value, x = w - step * move, new_value, new_x
    # whole numbers by rounding the running sum: every stretch of cells, so every set of categories, keeps its sum
    upto = np.floor(np.cumsum(x * (n_sample / x.sum())) + 0.5)
    upto[-1] = n_sample
    out = np.minimum(np.diff(np.concatenate([[0.0], upto])), cap)
    return _keep_floors(out.astype(int), cap.astype(int), a[:, :-1] > 0, [min(t["min_rows"], t["available"]) for t in wanted], n_sample).tolist()


def _keep_floors(out: np.ndarray, cap: np.ndarray, has: np.ndarray, floors: list[int], n_sample: int) -> np.ndarray:
    """Tops up categories that hold fewer rows than their floor, from cells with few other categories; what that adds is taken where no floor is touched."""
    for c in sorted(range(len(floors)), key=lambda c: floors[c]):
        need = floors[c] - int(out[has[:, c]].sum())
        for i in sorted(np.flatnonzero(has[:, c] & (out < cap)).tolist(), key=lambda i: (int(has[i].sum()), i)):
            if need <= 0:
                break
            add = min(need, int(cap[i] - out[i]))
            out[i] += add
            need -= add
    gap = n_sample - int(out.sum())  # also what rounding left
    held = np.array([int(out[has[:, c]].sum()) for c in range(len(floors))])
    for i in np.argsort(-out if gap < 0 else out - cap, kind="stable").tolist():
        if gap == 0:
            break
        if gap > 0:
            move = min(gap, int(cap[i] - out[i]))
        else:
            spare = [held[c] - floors[c] for c in np.flatnonzero(has[i])]
            move = -min(-gap, int(out[i]), *[max(0, int(v)) for v in spare]) if spare else -min(-gap, int(out[i]))
        out[i] += move
        held[has[i]] += move
        gap -= move
    for i in np.argsort(-out, kind="stable").tolist():  # floors that add up to more than the sample
        cut_off = min(max(0, -gap), int(out[i]))
        out[i] -= cut_off
        gap += cut_off
    return out


def smallest_keys(rows: DataFrame, cell: str, key: str, row_id: str, quotas: DataFrame, n_rows: int) -> DataFrame:
    """The ``quota`` rows of each cell with the smallest keys (0 to 2^63 - 1), ties by ``row_id``.

    Keys are counted by bucket first, their leading bits; there are as many buckets as the rows ask for. Whole buckets below the limit are taken without any ranking; only the bucket in
    which the quota ends is sorted, so no task sorts a whole cell.
    """
    bits = min(30, max(1, (n_rows // BUCKET_ROWS).bit_length()))
    keyed = rows.withColumn("__bucket", F.shiftright(F.col(key), 63 - bits).cast("int"))
    hist = keyed.groupBy(cell, "__bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(cell).orderBy("__bucket"))
    limits = hist.join(F.broadcast(quotas), cell).withColumn("upto", upto).withColumn("whole", F.col("upto") <= F.col("quota"))
    limits = limits.filter(F.col("upto") - F.col("n") < F.col("quota")).select(cell, "__bucket", "whole", (F.col("quota") - F.col("upto") + F.col("n")).alias("__left"))
    hit = keyed.join(limits, [cell, "__bucket"])
    rank = F.row_number().over(Window.partitionBy(cell, "__bucket").orderBy(key, row_id))
    part = hit.filter("NOT whole").withColumn("__rank", rank).filter("__rank <= __left").drop("__rank")
    return hit.filter("whole").unionByName(part).drop("__bucket", "whole", "__left")


def sample_to_targets(rows: DataFrame, row_id: str, fields: list[str], targets: list[dict], n_sample: int, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """A sample of ``n_sample`` distinct rows whose categories follow the targets, and the report of quotas and shortfalls.

    targets: dictionaries with field, category, share, min_rows. A row counts for every category that it holds. Null
    arrays count as empty; an empty table gives an empty sample and a report of shortfalls. Returns (sample with row_id
    and the fields, report). The quota is the number of rows that should hold the category; the report has beside it how
    many were drawn, their share of the sample, their share of all categories drawn in the field (rows with several
    categories count for each, so it is these that can match shares which add up to 1), whether there are too few rows
    for the target (short), and whether the draw missed it: that share off by more than TOLERANCE, or fewer rows than
    min_rows.
    """
    report = category_report(rows, fields, targets, n_sample)
    scarce = {f: [t["category"] for t in sorted((t for t in report if t["field"] == f), key=lambda t: (t["available"] / max(1, t["quota"]), t["category"]))] for f in fields}
    sets = F.array(*[_held(f, scarce[f]) for f in fields])
    celled = rows.select(row_id, *fields, F.to_json(sets).alias("cell"), sets.alias("cats"), F.xxhash64(F.lit(seed), row_id).bitwiseAND(F.lit((1 << 63) - 1)).alias("key"))
    # as many as the targets have subsets of CELL_CATEGORIES, field by field
    found = celled.groupBy("cell").agg(F.count("*").alias("n"), F.first("cats").alias("cats")).orderBy("cell").collect()
    cells, counts = [tuple(r["cats"]) for r in found], [r["n"] for r in found]
    report = with_quotas(report, fields, dict(zip(fields, categories_to_draw(cells, counts, n_sample) or [n_sample] * len(fields), strict=True)))
    quotas = cell_quotas(cells, counts, fields, report, n_sample)
    q = rows.sparkSession.createDataFrame([(r["cell"], int(n)) for r, n in zip(found, quotas, strict=True) if n > 0], "cell string, quota bigint")
    sample = cut(smallest_keys(celled.drop("cats"), "cell", "key", row_id, q, sum(counts)).select(row_id, *fields))
    return sample, drawn_report(sample, fields, report)


def drawn_report(sample: DataFrame, fields: list[str], report: list[dict]) -> list[dict]:
    """The report with what the sample really holds."""
    pairs = sample.select(F.explode(F.flatten(F.array(*[_tagged(f) for f in fields]))).alias("p")).select("p.field", "p.category")
    wanted = sample.sparkSession.createDataFrame([(t["field"], t["category"]) for t in report], "field string, category string")
    counted = pairs.groupBy("field", "category").agg(F.count("*").alias("n")).join(F.broadcast(wanted), ["field", "category"]).collect()
    drawn = {(r["field"], r["category"]): r["n"] for r in counted}
    n = max(1, sample.count())
    out = []
    for t in report:
        d = drawn.get((t["field"], t["category"]), 0)
        every = sum(v for (f, _), v in drawn.items() if f == t["field"])
        missed = abs(d / max(1, every) - t["share"]) > TOLERANCE or d < t["min_rows"]
        out.append(t | {"drawn": d, "drawn_share": d / n, "category_share": d / max(1, every), "missed": missed})
    return out
