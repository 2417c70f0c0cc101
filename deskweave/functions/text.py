"""Column expressions over ticket and document text. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "i", "in", "is", "it",
    "of", "on", "or", "our", "that", "the", "this", "to", "was", "we", "what", "when", "where", "with",
)
TOKEN_PATTERN = r"[a-z0-9][a-z0-9_.-]+"
EMAIL_PATTERN = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
FENCE_PATTERN = r"(?is)^```(?:json)?\s*(.*?)\s*```$"
SECTION_PATTERN = r"(?md)(?=^#{1,3}\s+)|\n{3,}"
ASSISTANT_ROLES = ("machine", "ai", "assistant")
DOCUMENT_LIMIT, VALUE_LIMIT, TITLE_LIMIT = 12000, 4000, 240


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def collapse(value: str | Column) -> Column:
    """Whitespace of any kind to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_col(value), r"(?U)\s+", " "))


def clean_text(value: str | Column, limit: int = DOCUMENT_LIMIT) -> Column:
    return F.substring(collapse(F.coalesce(_col(value).cast("string"), F.lit(""))), 1, limit)


def present(value: str | Column, kind: str = "string") -> Column:
    """Not null, and for floating point columns not NaN either."""
    value = _col(value)
    if kind in ("double", "float"):
        return value.isNotNull() & ~F.isnan(value)
    if kind.startswith("array"):
        return value.isNotNull() & (F.size(value) > 0)
    return value.isNotNull()


def nan_to_null(value: str | Column) -> Column:
    return F.nanvl(_col(value), F.lit(None).cast("double"))


def folded(value: Column) -> Column:
    """Case-blind, whitespace-blind form of one text. Sharp s folds to ss, as full case folding does."""
    return F.replace(F.lower(collapse(value)), F.lit("ß"), F.lit("ss"))


def normalised(value: str | Column) -> Column:
    """Comparison form of a text column; a JSON list becomes its sorted, folded items."""
    value = _col(value)
    text = collapse(value)
    items = F.from_json(F.when(text.startswith("[") & text.endswith("]"), text), "array<string>")
    return F.coalesce(normalised_list(items), folded(value))


def normalised_list(items: str | Column) -> Column:
    """Comparison form of an array column: nulls dropped, duplicates kept, order ignored."""
    kept = F.filter(F.transform(_col(items), folded), lambda x: x.isNotNull())
    return F.to_json(F.array_sort(kept))


def equal_after_normalising(expected: str | Column, actual: str | Column, kind: str = "string") -> Column:
    """True only when a prediction is present and equals the truth. Never null."""
    expected, actual = _col(expected), _col(actual)
    if kind == "string":
        same = normalised(expected).eqNullSafe(normalised(actual))
    elif kind.startswith(("struct", "map", "variant")) or kind.startswith("array<") and kind != "array<string>":
        from deskweave.functions.nested import normalised_nested

        same = normalised_nested(expected).eqNullSafe(normalised_nested(actual))
    elif kind.startswith("array"):
        same = normalised_list(expected).eqNullSafe(normalised_list(actual))
    else:
        same = expected.eqNullSafe(actual.try_cast(kind))
    return F.coalesce(present(actual, kind) & same, F.lit(False))


def tokens(value: str | Column) -> Column:
    """ASCII word tokens of two or more characters without stop words, duplicates kept."""
    found = F.regexp_extract_all(F.lower(_col(value)), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def redact_email(value: str | Column) -> Column:
    return F.regexp_replace(_col(value), EMAIL_PATTERN, "[REDACTED_EMAIL]")


def slug(value: str | Column) -> Column:
    squeezed = F.regexp_replace(F.lower(_col(value)), r"[^\p{L}\p{Nd}]+", "_")
    return F.regexp_replace(squeezed, "^_+|_+$", "")


def chat_role(value: str | Column) -> Column:
    return F.when(F.lower(_col(value)).isin(*ASSISTANT_ROLES), "assistant").otherwise("user")


def percent(value: str | Column) -> Column:
    return F.format_string("%.1f%%", _col(value) * 100)


def bar(value: str | Column, width: int = 12) -> Column:
    filled = F.least(F.greatest(F.bround(_col(value) * width, 0).cast("int"), F.lit(0)), F.lit(width))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def fingerprint(columns: Sequence[str]) -> Column:
    """Content hash over the named columns, independent of their order in the table."""
    row = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def sections(text: str | Column) -> Column:
    """Parts of a text file: cut before level 1–3 headings and at three or more line ends."""
    text = _col(text)
    parts = F.filter(
        F.transform(F.split(text, SECTION_PATTERN), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")),
        lambda p: p != "",
    )
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(int(value), high))
