"""JSON as models and exporters write it. Python's reader decides what is accepted, in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = "```"


def strip_fences(text: str) -> str:
    """Without the lines that open or close a code fence, where the text begins with one."""
    t = text.strip()
    if not t.startswith(_FENCE):
        return t
    return "\n".join(line for line in t.splitlines() if not line.strip().startswith(_FENCE)).strip()


def _load(text: str):
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def lenient(text: str | None):
    """(found, value): the whole text without fences, else its widest array, else its widest object. An array is tried first, also within an object's prose."""
    t = strip_fences(text or "")
    ok, value = _load(t)
    for opening, closing in ("[]", "{}"):
        if ok:
            break
        a, b = t.find(opening), t.rfind(closing)
        if 0 <= a < b:
            ok, value = _load(t[a : b + 1])
    return ok, value


@F.pandas_udf(T.StringType())
def lenient_json(texts: pd.Series) -> pd.Series:
    """The JSON found in a reply, written plainly; null where there is none."""
    out = []
    for t in texts:
        ok, value = lenient(t)
        out.append(json.dumps(value, ensure_ascii=False) if ok else None)
    return pd.Series(out, dtype="object")


def json_object(text: str | None) -> str | None:
    ok, value = _load(text.strip()) if isinstance(text, str) else (False, None)
    return json.dumps(value, ensure_ascii=False) if ok and isinstance(value, dict) else None


@F.pandas_udf(T.StringType())
def strict_object(lines: pd.Series) -> pd.Series:
    """The line's JSON object with duplicate keys resolved (the last wins); null for blank, malformed and other values."""
    return pd.Series([json_object(x) for x in lines], dtype="object")


def json_value(text: str | None) -> str | None:
    ok, value = _load(text.strip()) if isinstance(text, str) else (False, None)
    return json.dumps(value, ensure_ascii=False) if ok else None


@F.pandas_udf(T.StringType())
def any_value(lines: pd.Series) -> pd.Series:
    """The line's JSON value of whatever kind, written plainly; null for blank and malformed lines."""
    return pd.Series([json_value(x) for x in lines], dtype="object")


def judge_score(value) -> int | None:
    """0 or 1 after truncation to an integer; everything else is no score."""
    try:
        n = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return n if n in (0, 1) else None


@F.pandas_udf(T.StructType([T.StructField("score", T.IntegerType()), T.StructField("reason", T.StringType())]))
def judge_reply(texts: pd.Series) -> pd.DataFrame:
    """Score and reason of a judge's reply: the whole text, else its widest braces. A reply that is JSON but no object is an error of the judge."""
    rows = []
    for t in texts:
        t = (t or "").strip()
        ok, value = _load(t)
        if not ok and (m := re.search(r"\{.*\}", t, re.DOTALL)):
            ok, value = _load(m.group(0))
        if not ok:
            rows.append((None, f"Could not parse judge JSON. Raw: {t[:500]}"))
        elif not isinstance(value, dict):
            rows.append((None, "Judge error: the reply is no object"))
        else:
            reason = value.get("reason", "")
            rows.append((judge_score(value.get("score")), "" if reason is None else str(reason).strip()))
    return pd.DataFrame({"score": pd.array([r[0] for r in rows], dtype="Int32"), "reason": [r[1] for r in rows]})


def strip_code_fence(c: Column) -> Column:
    """``strip_fences`` as an expression."""
    t = F.trim(c)
    kept = F.array_join(F.filter(F.split(t, "\n"), lambda line: ~F.trim(line).startswith(_FENCE)), "\n")
    return F.when(t.startswith(_FENCE), F.trim(kept)).otherwise(t)
