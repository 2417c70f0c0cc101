"""Text of an HTML page: entities first, then markup removed, text nodes joined by one blank."""

from __future__ import annotations

import html as html_entities
import json
import re
from collections.abc import Mapping
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# References: by number, by hexadecimal number, or by name. A name may lack its semicolon.
REFERENCE_PATTERN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)|&|[^&]+"
# Script and style bodies are text nodes of their own, comments and tags are not text. A '>' inside a quoted
# attribute does not end a tag.
TAG_REST = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
MARKUP_PATTERN = (
    rf"(?is)<script\b{TAG_REST}>.*?</script\s*>|<style\b{TAG_REST}>.*?</style\s*>|<!--.*?-->|<[a-z/!?]{TAG_REST}>|[^<]+|<"
)
WESTERN = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
LONGEST_BARE_NAME = max(len(name) for name in html5 if not name.endswith(";"))


def _code_point(number: Column) -> Column:
    """The character of a numeric reference: some numbers stand for the characters that the western single-byte set has
    there, some for none, and what is no character for the replacement character."""
    western = F.substring(F.lit(WESTERN), (number - 0x7F).cast('int'), F.lit(1))
    in_western = number.between(0x80, 0x9F) & ~number.isin(0x81, 0x8D, 0x8F, 0x90, 0x9D)
    none = (
        number.between(0x1, 0x8) | (number == 0xB) | number.between(0xE, 0x1F) | (number == 0x7F) | number.between(0xFDD0, 0xFDEF)
        | ((number % 0x10000) >= 0xFFFE)
    )
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    wrong = number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return F.when(wrong, "\ufffd").when(in_western, western).when(none, "").otherwise(plain)


def _named(names: Mapping[str, str]) -> Column:
    """The standard table of names as one literal."""
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def resolved(text: Column) -> Column:
    """Text with its character references resolved, as a page parser does it."""
    full = _named(html5)
    bare = _named({name: value for name, value in html5.items() if not name.endswith(";")})

    def of(piece: Column) -> Column:
        name = F.substring(piece, 2, 2**15)
        digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+)", 1)
        # More digits than a character's number can have are cut to as many as still tell that it is none.
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        number = F.when(F.length(short) > 8, F.lit(0x110000)).otherwise(
            F.when(piece.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(short).cast("long")).cast("long")
        begins = [F.concat(F.try_element_at(bare, F.substring(name, 1, n)), F.substring(name, n + 1, 2**15)) for n in range(LONGEST_BARE_NAME, 1, -1)]
        by_name = F.coalesce(F.try_element_at(full, name), *begins, piece)
        return F.when(F.length(piece) == 1, piece).when(~piece.startswith("&"), piece).when(piece.startswith("&#"), _code_point(number)).otherwise(by_name)

    pieces = F.regexp_extract_all(text, F.lit(REFERENCE_PATTERN), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, of), "")).otherwise(text)


def html_text(value: str | Column) -> Column:
    """JVM-only form; equals the exact one for well-formed pages.

    References are resolved in the page, and once more in its text nodes, as a page parser does.
    """
    text = F.col(value) if isinstance(value, str) else value
    pieces = F.regexp_extract_all(resolved(text), F.lit(MARKUP_PATTERN), F.lit(0))

    def text_of(piece: Column) -> Column:
        lowered = F.lower(F.substring(piece, 1, 8))
        raw = lowered.rlike("^<(script|style)")
        body = F.regexp_replace(piece, rf"(?is)^<(?:script|style)\b{TAG_REST}>|</(?:script|style)\s*>$", "")
        markup = piece.startswith("<") & (F.length(piece) > 1)
        return F.when(raw, F.concat(F.lit(" "), body, F.lit(" "))).when(markup, " ").otherwise(resolved(piece))

    return F.trim(F.regexp_replace(F.array_join(F.transform(pieces, text_of), ""), r"(?U)\s+", " "))


class _TextNodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.nodes: list[str] = []

    def handle_data(self, data: str) -> None:
        self.nodes.append(data)


def _page_text(page: str | None) -> str:
    parser = _TextNodes()
    parser.feed(html_entities.unescape(page or ""))
    return re.sub(r"\s+", " ", " ".join(parser.nodes)).strip()


@F.pandas_udf(StringType())
def html_text_exact(pages: pd.Series) -> pd.Series:
    """Arrow form over the standard-library parser, for pages the native form does not cover."""
    return pages.map(_page_text)
