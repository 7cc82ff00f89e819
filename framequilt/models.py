"""External models and media tools as batch functions, with replay for tests.

A model takes a list of requests and returns as many replies; it is built once per partition, where its client lives.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequilt.session import cut

Model = Callable[[Sequence[str]], Sequence[str]]


@dataclass(frozen=True)
class Replay:
    """Answers from a table of replies; a request without one is an error."""

    replies: dict[str, str] = field(default_factory=dict)
    default: str | None = None

    def __call__(self) -> Model:
        def answer(requests: Sequence[str]) -> list[str]:
            out = [self.replies.get(r, self.default) for r in requests]
            if None in out:
                raise LookupError("no reply recorded")
            return out

        return answer


def with_retries(model: Model, attempts: int = 3, first_wait: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, str | None]]:
    """One request at a time, (reply, error); waits double after each failure. Retrying here repeats one request, a task retry would repeat the batch."""

    def call(request: str) -> tuple[str | None, str | None]:
        error = ""
        for i in range(attempts):
            try:
                return model([request])[0], None
            except Exception as e:  # noqa: BLE001
                error = repr(e)
                if i + 1 < attempts:
                    sleep(first_wait * 2**i)
        return None, error

    return call


def ask(df: DataFrame, request: str, reply: str, make_model: Callable[[], Model], attempts: int = 3, first_wait: float = 1.5) -> DataFrame:
    """Adds the model's reply (null after failures) and ``{reply}_error``, and materialises the rows: a later stage must not repeat calls that cost money."""
    names = df.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{reply}` string", f"`{reply}_error` string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(make_model(), attempts, first_wait)
        for pdf in batches:
            told = [call(r) if isinstance(r, str) else (None, "no request") for r in pdf["__request"]]
            out = pdf[names].copy()
            out[reply], out[f"{reply}_error"] = [t[0] for t in told], [t[1] for t in told]
            yield out

    return cut(df.select("*", F.col(request).alias("__request")).mapInPandas(run, schema))
