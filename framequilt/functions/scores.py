"""Text scores of a prediction against a reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequilt.functions.text import normalize_text


def tokens(c: Column) -> Column:
    """Tokens of the normalised text; an empty text has none."""
    return F.filter(F.split(normalize_text(c), " "), lambda t: t != "")


def exact_match(prediction: Column, reference: Column) -> Column:
    return (normalize_text(prediction) == normalize_text(reference)).cast("double")


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the shared tokens, each counted as often as on the poorer side. Both empty: 1; one empty: 0."""
    p, r = tokens(prediction), tokens(reference)
    n_p, n_r = F.size(p), F.size(r)

    def count(of: Column, t: Column) -> Column:
        return F.size(F.filter(of, lambda x: x == t))

    shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, t: acc + F.least(count(p, t), count(r, t)))
    f1 = F.when(shared == 0, 0.0).otherwise(2.0 * shared / (n_p + n_r))
    return F.when((n_p == 0) & (n_r == 0), 1.0).when((n_p == 0) | (n_r == 0), 0.0).otherwise(f1)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one numpy row at a time."""
    if not a or not b:
        return 0
    if len(b) < len(a):
        a, b = b, a
    ids: dict[str, int] = {}
    y = np.array([ids.setdefault(t, len(ids)) for t in b])
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for t in a:
        k = ids.get(t)
        if k is None:
            continue
        # where the token matches, the diagonal neighbour plus one; then the running maximum
        row[1:] = np.maximum.accumulate(np.where(y == k, np.maximum(row[1:], row[:-1] + 1), row[1:]))
    return int(row[-1])


@F.pandas_udf(T.DoubleType())
def _rouge(p: pd.Series, r: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(p, r, strict=True):
        a, b = a.split(), b.split()
        if not a or not b:
            out.append(1.0 if not a and not b else 0.0)
        else:
            n = lcs_length(a, b)
            out.append(2.0 * n / (len(a) + len(b)))
    return pd.Series(out, dtype="float64")


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of tokens. The table of subsequences is quadratic: it runs in Arrow batches, not as a fold over arrays."""
    return _rouge(normalize_text(prediction), normalize_text(reference))
