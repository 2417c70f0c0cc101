"""Tolerant reading of model responses: fenced, prefixed or wrapped JSON text to variant values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskweave.functions.text import FENCE_PATTERN

# Other names under which a response may give a field, best name first.
FIELD_ALIASES: Mapping[str, Sequence[str]] = {"support_level": ("support_tier", "tier", "level")}


def strip_fence(response: Column) -> Column:
    text = F.regexp_replace(response, r"(?U)^\s+|\s+$", "")
    return F.when(text.rlike(FENCE_PATTERN), F.regexp_extract(text, FENCE_PATTERN, 1)).otherwise(text)


def tolerant_json(response: str | Column) -> Column:
    """Variant of the text, else of its span from the first ``{`` to the last ``}``, else null."""
    text = strip_fence(F.col(response) if isinstance(response, str) else response)
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.when(span != "", span)))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def prediction_object(response: str | Column) -> Column:
    """The prediction fields of a response, unwrapped from a ``prediction`` object if there is one."""
    payload = tolerant_json(response)
    inner = F.try_variant_get(payload, "$.prediction", "variant")
    return F.when(is_object(inner), inner).when(is_object(payload), payload)


def response_field(prediction: Column, field: str, kind: str = "string") -> Column:
    names = [field, *FIELD_ALIASES.get(field, ())]
    return F.coalesce(*[F.try_variant_get(prediction, f"$.{name}", kind) for name in names])


def record_array(response: str | Column, key: str) -> Column:
    """``array<variant>`` under ``key`` (or a bare array); items that are not objects are dropped."""
    payload = tolerant_json(response)
    nested = F.try_variant_get(payload, f"$.{key}", "variant")
    chosen = F.when(is_array(payload), payload).when(is_array(nested), nested)
    return F.filter(F.try_variant_get(chosen, "$", "array<variant>"), is_object)
