"""Texts inside a JSON value of any shape."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING_CHARS, TOTAL_CHARS, DEPTH = 4000, 20_000, 6


def texts(body: object) -> list[str]:
    """Strings of a JSON value in order, each cut at STRING_CHARS, down to DEPTH levels; none is begun once TOTAL_CHARS are reached."""
    found, size, rest = [], 0, [(body, 0)]
    while rest and size < TOTAL_CHARS:
        value, depth = rest.pop()
        if depth > DEPTH:
            continue
        if isinstance(value, str):
            found.append(value[:STRING_CHARS])
            size += len(found[-1])
        elif isinstance(value, dict | list):
            inner = value.values() if isinstance(value, dict) else value
            rest.extend((x, depth + 1) for x in reversed(list(inner)))
    return [x for x in found if x]


@F.pandas_udf(T.StringType())
def body_text(body: pd.Series) -> pd.Series:
    """The strings of a JSON body joined by a space, without empty ones; empty for a body that is no JSON."""

    def one(b: str | None) -> str:
        try:
            return " ".join(texts(json.loads(b or "")))
        except ValueError:
            return ""

    return body.map(one)
