"""Comparison form of nested values. Flat columns have a JVM form in ``text``; this one is for structs,
maps and variants, whose shape is not known to the plan."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _plain(value):
    if isinstance(value, str):
        text = value.strip()
        if text.startswith("[") and text.endswith("]"):
            try:
                return _plain(json.loads(text))
            except json.JSONDecodeError:
                pass
        return " ".join(text.casefold().split())
    if isinstance(value, list):
        return sorted((p for p in map(_plain, value) if p is not None), key=str)
    if isinstance(value, dict):
        return {key: _plain(value[key]) for key in sorted(value)}
    return int(value) if isinstance(value, float) and value.is_integer() else value


@F.pandas_udf(StringType())
def _normalised_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else json.dumps(_plain(json.loads(t)), ensure_ascii=False, sort_keys=True))


def normalised_nested(value: str | Column) -> Column:
    """Canonical JSON of a struct, map, array or variant: folded texts, sorted lists and keys."""
    return _normalised_json(F.to_json(value))
