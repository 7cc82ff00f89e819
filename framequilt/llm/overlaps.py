"""Same or near-same question-answer records across splits.

Records are canonicalised (case, punctuation, white space, media tags) and hashed. Equal hashes give the exact overlaps.
For the near ones a token alignment decides; every evaluation record is compared with every training record of its group
that it may be like by lower bounds of the alignment's cost, so the result is that of aligning all pairs. Groups with few
records go through one join. All others are put into bands by the words of the answer, bands with many pairs into a grid,
and the bounds of a cell are matrix products. Copies add no work: they are joined to the links at the end.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequilt.session import cut

#: Edits a text may have, by its words; a substitution counts one and a half, a misspelling half.
EDIT_SHARE = 0.25
#: Words that may come or go on a side where the answer is long, whatever that side's length, as long as both sides together keep to EDIT_SHARE.
FILLERS = 4.0
#: Answers of at most so many words say little: then the question may not have another word in place of one.
SHORT = 4

#: A group goes through one join where it has at most so many distinct records, and so many pairs for each of them; its pairs are the same either way.
WHOLE_GROUP = 10_000
BANDS = 40
#: Pairs of a band above which it is split into a grid, records on a side of a cell (a side of ten times as many is split too), and most bands that are split for their pairs (their table is broadcast; with more, the bound on pairs is raised).
BAND_PAIRS = 1_000_000
CELL_RECORDS = 1_000
SPLIT_BANDS = 1_000_000

_MEDIA = re.compile(r"<(?:video|image)>")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W㐀-鿿_]+")
#: Columns that the words of a cell are told apart by; words that share one only weaken the bounds.
_COLUMNS = 512
#: Letters above which words aren't told apart.
_LONG = 40


def canonical(text: str | None) -> str:
    """Lower-case tokens joined by one blank; ideographs are tokens of their own; null gives ''."""
    if not isinstance(text, str):
        return ""
    return " ".join(_TOKEN.findall(unicodedata.normalize("NFKC", _MEDIA.sub(" ", text)).lower()))


def misspelt(a: str, b: str) -> bool:
    """Whether two words are one with a letter more, less or other, or two neighbours exchanged. Digits and short words must agree."""
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1 or any(c.isdigit() for c in a + b):
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[:2] == y[1::-1] and x[2:] == y[2:])


def edits(a: list[str], b: list[str], most: float) -> tuple[float, bool]:
    """Cost of turning a into b, and whether the cheapest way puts a word in place of another; (inf, True) beyond ``most``.

    Long texts are aligned within a narrow band first, as most pairs that are alike at all differ in little.
    """
    limit = 8.0
    while limit < most:
        told = _edits(a, b, limit)
        if told[0] <= limit:
            return told
        limit *= 4
    return _edits(a, b, most)


def _edits(a: list[str], b: list[str], most: float) -> tuple[float, bool]:
    if a == b:
        return 0.0, False
    if abs(len(a) - len(b)) > most:
        return float("inf"), True
    common = sum((Counter(a) & Counter(b)).values())
    # each token without partner costs at least a quarter: half a misspelling
    if (len(a) + len(b) - 2 * common) * 0.25 > most:
        return float("inf"), True
    # what both begin or end with costs nothing
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    far = (float("inf"), 0)
    reach = int(most) + 1  # places further off the diagonal cost more than allowed
    row = [(float(j), 0) if j <= reach else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        first, end = max(1, i - reach), min(len(b), i + reach)
        last = row[first - 1]
        row[first - 1] = (float(i), 0) if first == 1 else far
        for j in range(first, end + 1):
            y, up = b[j - 1], row[j]
            if x == y:
                best = last
            else:
                wrong = 0 if misspelt(x, y) else 1
                left = row[j - 1]
                best = min((last[0] + (1.5 if wrong else 0.5), last[1] + wrong), (up[0] + 1, up[1]), (left[0] + 1, left[1]))
            last, row[j] = up, best
    cost, swaps = row[-1]
    return (cost, swaps > 0) if cost <= most else (float("inf"), True)


def budget(n: int) -> float:
    return 0.5 if n < SHORT else max(1.0, EDIT_SHARE * n)


def alike(q1: str, a1: str, q2: str, a2: str) -> bool:
    """Whether two records say the same in question and answer but for small edits."""
    sides = [(x.split(), y.split()) for x, y in ((a1, a2), (q1, q2))]
    size = [max(len(x), len(y)) for x, y in sides]
    short = min(map(len, sides[0])) <= SHORT
    total = 0.0
    for (x, y), n in zip(sides, size, strict=True):
        most = budget(n)
        cost, swapped = edits(x, y, most if short else max(most, FILLERS))
        if cost > most and swapped:
            return False
        if short and swapped:
            return False
        total += cost
    return total <= max(1.0, EDIT_SHARE * sum(size))


def word_classes(words: set[str]) -> dict[str, int]:
    """A number for each word, the same for words that are ``misspelt`` forms of each other (maybe by others in between): such words are equal without one letter each."""
    first: dict[str, str] = {}
    parent = {w: w for w in words}

    def root(w: str) -> str:
        while parent[w] != w:
            parent[w] = parent[parent[w]]
            w = parent[w]
        return w

    for w in words:
        if len(w) < 4 or any(c.isdigit() for c in w):
            continue
        forms = [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))] if len(w) <= _LONG else []
        for v in [*forms, " "] if len(w) >= _LONG else forms:
            parent[root(w)] = root(first.setdefault(v, w))
    numbers: dict[str, int] = {}
    return {w: numbers.setdefault(root(w), len(numbers)) for w in words}


def candidates(e: list[tuple[str, str]], t: list[tuple[str, str]]) -> np.ndarray:
    """Which (question, answer) of e may be ``alike`` which of t: never False where they are.

    A misspelling costs half and changes no class; a word more or less costs one and stands alone, two that are
    exchanged cost one and a half and stand alone both. So a side costs at least three quarters for each class that only
    one text has, and a quarter for each word of their difference in length.
    """
    parts = [[[x[side].split() for x in rows] for rows in (e, t)] for side in (0, 1)]
    classes = word_classes({w for side in parts for rows in side for x in rows for w in x})
    least, size = [], []
    for side in parts:
        here = []
        for rows in side:
            m = np.zeros((len(rows), _COLUMNS), dtype=np.float32)
            for i, x in enumerate(rows):
                m[i, [classes[w] % _COLUMNS for w in x]] = 1
            here.append(m)
        n_e, n_t = (np.array([len(x) for x in rows], dtype=np.float32) for rows in side)
        alone = here[0].sum(axis=1)[:, None] + here[1].sum(axis=1)[None, :] - 2 * (here[0] @ here[1].T)
        least.append(0.75 * alone + 0.25 * np.abs(n_e[:, None] - n_t[None, :]))
        size.append((n_e, n_t, np.maximum(n_e[:, None], n_t[None, :])))
    may = least[0] + least[1] <= np.maximum(1.0, EDIT_SHARE * (size[0][2] + size[1][2]))
    short = np.minimum(size[1][0][:, None], size[1][1][None, :]) <= SHORT
    for low, (_, _, n) in zip(least, size, strict=True):
        most = np.where(n < SHORT, 0.5, np.maximum(1.0, EDIT_SHARE * n))
        may &= low <= np.where(short, most, np.maximum(most, FILLERS))
    return may


def _compare(e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of a cell."""
    found: list[tuple[str, str]] = []
    step = max(1, CELL_RECORDS)
    sides = [list(zip(x[f"q_{tag}"], x[f"a_{tag}"], x[f"digest_{tag}"], strict=True)) for x, tag in ((e, "e"), (t, "t"))]
    for i in range(0, len(e), step):
        for j in range(0, len(t), step):
            one, two = sides[0][i : i + step], sides[1][j : j + step]
            for x, y in np.argwhere(candidates([r[:2] for r in one], [r[:2] for r in two])).tolist():
                (q, a, d), (r, b, f) = one[x], two[y]
                if d != f and alike(q, a, r, b):
                    found.append((d, f))
    return pd.DataFrame(found, columns=["digest_e", "digest_t"], dtype=object)


def _canonicalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(q=[canonical(t) for t in pdf["q"]], a=[canonical(t) for t in pdf["a"]])


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        hit = [alike(*t) for t in zip(pdf["q_e"], pdf["a_e"], pdf["q_t"], pdf["a_t"], strict=True)]
        yield pdf.loc[hit, ["digest_e", "digest_t"]]


def canonical_records(rows: DataFrame, row_id: str, group: str, split: str, question: str, answer: str, train: str = "train") -> DataFrame:
    """row_id, grp, q, a (canonical), is_train, digest of (grp, q, a). Rows with a null group or split, or without any word in question or answer, are left out: two records without answer have only the question in common."""
    base = rows.select(F.col(row_id).alias("row_id"), F.col(group).cast("string").alias("grp"), (F.lower(F.trim(F.col(split))) == train).alias("is_train"), F.col(question).cast("string").alias("q"), F.col(answer).cast("string").alias("a"))
    base = base.filter("grp IS NOT NULL AND is_train IS NOT NULL")
    kind = dict(base.dtypes)["row_id"]
    told = base.mapInPandas(_canonicalise, f"row_id {kind}, grp string, is_train boolean, q string, a string").filter("q <> '' AND a <> ''")
    return told.withColumn("digest", F.md5(F.concat_ws("\u0001", "grp", "q", "a")))


def _group_sizes(texts: DataFrame) -> DataFrame:
    """Records of each side of each group, and whether it goes through one join: a matter of time only, as either way finds all pairs."""
    sizes = texts.groupBy("grp").agg(F.count_if("eval").alias("n_e"), F.count_if("train").alias("n_t"))
    n = F.col("n_e") + F.col("n_t")
    return sizes.withColumn("whole", (n <= WHOLE_GROUP) & (F.col("n_e") * F.col("n_t") <= BANDS * n))


def _near_length(nq_e: Column, nq_t: Column) -> Column:
    return F.abs(nq_e - nq_t) <= F.greatest(F.lit(FILLERS), F.greatest(nq_e, nq_t) * EDIT_SHARE)


def _words(c: str) -> Column:
    return F.size(F.split(F.col(c), " "))


def _words_suffice(e: str, t: str) -> Column:
    """Whether two texts have enough words in common to be alike at all: each word that only one of them has costs a quarter at least (half a misspelling)."""
    a, b = (F.array_distinct(F.split(F.col(c), " ")) for c in (e, t))
    alone = F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))
    return alone * 0.25 <= F.greatest(F.lit(FILLERS), F.greatest(_words(e), _words(t)) * EDIT_SHARE)


def _by_kind(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of groups that go through one join, and the others. Groups above WHOLE_GROUP go by a broadcast: there is at most one for so many records; no group that is joined by its key is larger."""
    sizes = cut(_group_sizes(texts))
    hot = F.broadcast(sizes.filter(F.col("n_e") + F.col("n_t") > WHOLE_GROUP).select("grp"))
    rest = texts.join(hot, "grp", "left_anti").join(sizes.filter("n_e > 0 AND n_t > 0").select("grp", "whole"), "grp")
    return rest.filter("whole").drop("whole"), texts.join(hot, "grp", "left_semi").unionByName(rest.filter("NOT whole").drop("whole"))


def _side(rows: DataFrame, side: str, tag: str, *columns: str) -> DataFrame:
    return rows.filter(side).select(*[F.col(c).alias(f"{c}_{tag}") for c in columns])


def _whole_groups(texts: DataFrame) -> DataFrame:
    """Near pairs of the groups that go through one join, and their texts straight to the alignment."""
    rows = _by_kind(texts)[0]
    e, t = (_side(rows, s, tag, "grp", "digest", "q", "a") for s, tag in (("eval", "e"), ("train", "t")))
    pairs = e.join(t, (F.col("grp_e") == F.col("grp_t")) & (F.col("digest_e") != F.col("digest_t")) & _near_length(_words("q_e"), _words("q_t")) & _near_length(_words("a_e"), _words("a_t")))
    pairs = pairs.filter(_words_suffice("q_e", "q_t")).filter(_words_suffice("a_e", "a_t"))
    return pairs.select("digest_e", "digest_t", "q_e", "a_e", "q_t", "a_t").mapInPandas(_verify, "digest_e string, digest_t string")


def _heavy_bands(e: DataFrame, t: DataFrame) -> DataFrame:
    """Bands that are split (band, cells_e, cells_t): those with more than BAND_PAIRS pairs, at most SPLIT_BANDS, and those with a large side, at most one for so many records."""
    n_e, n_t = (x.groupBy("band").agg(F.count("*").alias(n)) for x, n in ((e, "n_e"), (t, "n_t")))
    large = F.greatest("n_e", "n_t") > 10 * CELL_RECORDS
    many = cut(n_e.join(n_t, "band").filter((F.col("n_e") * F.col("n_t") > BAND_PAIRS) | large))
    most = BAND_PAIRS
    while many.filter(F.col("n_e") * F.col("n_t") > most).count() > SPLIT_BANDS:
        most *= 4
    cells = lambda n: F.ceil(F.col(n) / CELL_RECORDS).cast("int")
    return many.filter((F.col("n_e") * F.col("n_t") > most) | large).select("band", cells("n_e").alias("cells_e"), cells("n_t").alias("cells_t"))


def _in_grid(rows: DataFrame, heavy: DataFrame, own: str, other: str, row: str, column: str, record: str) -> DataFrame:
    """Records of a split band in their row of the grid, once for each of its columns; all others in cell 0, 0."""
    joined = rows.join(F.broadcast(heavy), "band", "left").withColumn(row, F.coalesce(F.pmod(F.col(record), F.col(own)), F.lit(0)).cast("int"))
    return joined.withColumn(column, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))).drop("cells_e", "cells_t")


def _band(n: Column) -> Column:
    """Band of a number of words; never less for more words."""
    return F.when(n < 32, F.floor(n / 8)).otherwise(4 + F.floor(F.log(n / 32) / F.log(F.lit(1.5)))).cast("int")


def _banded(texts: DataFrame) -> DataFrame:
    """Near pairs of all other groups. A training record is in the band of its answer's length, an evaluation record in all bands of lengths that ``_near_length`` allows, so each pair meets in one cell."""
    n = _words("a")
    rows = cut(_by_kind(texts)[1])
    least, most = n - F.greatest(F.lit(FILLERS), n * EDIT_SHARE), F.greatest(n + FILLERS, n / (1 - EDIT_SHARE))
    told = lambda x, side, no: x.filter(side).withColumn("no", no).select(F.concat_ws("\u0001", F.col("grp"), F.col("no").cast("string")).alias("band"), "id", "digest", "q", "a")
    e = told(rows, "eval", F.explode(F.sequence(_band(F.greatest(F.lit(0.0), F.floor(least))), _band(F.ceil(most)))))
    t = told(rows, "train", _band(n))
    heavy = cut(_heavy_bands(e, t))
    e = _in_grid(e, heavy, "cells_e", "cells_t", "__row", "__column", "id")
    t = _in_grid(t, heavy, "cells_t", "cells_e", "__column", "__row", "id")
    cell = ["band", "__row", "__column"]
    # both come from one table: new names keep their columns apart
    e, t = (x.select(*[F.col(c).alias(f"{c}_{tag}") for c in (*cell, "digest", "q", "a")]).groupBy(*[f"{c}_{tag}" for c in cell]) for x, tag in ((e, "e"), (t, "t")))
    return e.cogroup(t).applyInPandas(_compare, "digest_e string, digest_t string")


def cross_split_links(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between distinct records, evaluation side first (digest_e, digest_t, kind: exact or near), and their members (digest, row_id, is_train).

    A record that stands on both sides is linked to itself (exact). Copies add no links and no candidates. Near links
    aren't transitive; groups aren't mixed. Empty tables give empty tables.
    """
    records = cut(records)
    members = records.select("digest", "row_id", "is_train")
    texts = cut(
        records.groupBy("digest", "grp", "q", "a")
        .agg(F.max("is_train").alias("train"), F.max(~F.col("is_train")).alias("eval"))
        .withColumn("id", F.xxhash64("digest"))
    )
    exact = texts.filter("train AND eval").select(F.col("digest").alias("digest_e"), F.col("digest").alias("digest_t"), F.lit("exact").alias("kind"))

    near = _whole_groups(texts).unionByName(_banded(texts)).distinct().withColumn("kind", F.lit("near"))
    return cut(exact.unionByName(near)), members


def cross_split_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of an evaluation row and a training row behind the links: eval_id, train_id, kind."""
    e = members.filter("NOT is_train").select(F.col("digest").alias("digest_e"), F.col("row_id").alias("eval_id"))
    t = members.filter("is_train").select(F.col("digest").alias("digest_t"), F.col("row_id").alias("train_id"))
    return links.join(e, "digest_e").join(t, "digest_t").select("eval_id", "train_id", "kind")


def cross_split_counts(links: DataFrame, members: DataFrame, rows: DataFrame, row_id: str, by: list[str]) -> DataFrame:
    """Pairs, and evaluation rows that have any, by the columns ``by`` of the evaluation rows and by kind: by, kind, n_pairs, n_rows.

    Nothing is expanded: copies are counted on each side, and the counts are multiplied for each link.
    """
    e = members.filter("NOT is_train").join(rows.select(F.col(row_id).alias("row_id"), *by), "row_id").groupBy(F.col("digest").alias("digest_e"), *by).agg(F.count("*").alias("n_e"))
    t = members.filter("is_train").groupBy(F.col("digest").alias("digest_t")).agg(F.count("*").alias("n_t"))
    partners = links.join(t, "digest_t").groupBy("digest_e", "kind").agg(F.sum("n_t").alias("n_t"))
    return partners.join(e, "digest_e").groupBy(*by, "kind").agg(F.sum(F.col("n_e") * F.col("n_t")).alias("n_pairs"), F.sum("n_e").alias("n_rows"))
