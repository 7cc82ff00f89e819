"""Batches of bounded size: Arrow hands over rows by their number, whatever the length of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Characters and rows that one batch may have; a row with more characters is a batch of its own.
BATCH_CHARS = 1_000_000
BATCH_ROWS = 2_000


def in_batches(pdf: pd.DataFrame, *texts: str, chars: int = BATCH_CHARS, rows: int = BATCH_ROWS) -> Iterator[pd.DataFrame]:
    """The rows in their order, in parts whose texts together keep to the bounds."""
    size = sum((pdf[c].str.len().fillna(0) for c in texts), start=pd.Series(0, index=pdf.index)).astype("int64").tolist()
    start = held = 0
    for i, n in enumerate(size):
        if i > start and (held + n > chars or i - start >= rows):
            yield pdf.iloc[start:i]
            start, held = i, 0
        held += n
    if start < len(pdf):
        yield pdf.iloc[start:]
