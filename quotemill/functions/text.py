"""Cleaning of article text: HTML, Markdown, whitespace."""

from __future__ import annotations

import html
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags replaced by a space. An opening tag may carry anything up to its bracket, so
# it also covers longer tag names with the same beginning; a closing tag must match exactly.
OPENING_TAGS = [
    "a", "p", "strong", "em", "b", "i", "u", "h[1-6]", "ul", "ol", "li", "div", "span",
    "blockquote", "code", "pre", "img", "figure",
]
CLOSING_TAGS = [
    "a", "p", "strong", "em", "b", "i", "u", "h[1-6]", "ul", "ol", "li", "div", "span",
    "blockquote", "code", "pre", "figure",
]
EMPTY_TAGS = ["br", "hr"]

# What counts as whitespace: the Unicode property plus the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"
SPACE_CHARACTERS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

SCRIPT_PATTERN = r"(?iusU)<script\b[^>]*>.*?</script>"
TAG_PATTERN = (
    rf"(?iuU)<(?:(?:{'|'.join(OPENING_TAGS)})[^>]*"
    rf"|/(?:{'|'.join(CLOSING_TAGS)})"
    rf"|(?:{'|'.join(EMPTY_TAGS)}){SPACE}*/?)>"
)

# Markdown marks, what stays of them, and a text that every match contains, in the order they are applied.
# The flags make only a newline end a line, and digits and whitespace Unicode.
MARKDOWN_PATTERNS = [
    (r"!\[([^\]]*)\]\([^)]*\)", "$1", "!["),
    (r"\[([^\]]+)\]\([^)]*\)", "$1", "]("),
    (rf"(?mdU)^#{{1,6}}{SPACE}+", "", "#"),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1", "*"),
    (r"_{1,3}([^_]+)_{1,3}", "$1", "_"),
    (r"~~([^~]+)~~", "$1", "~~"),
    (r"`{1,3}([^`]+)`{1,3}", "$1", "`"),
    (rf"(?mdU)^>{SPACE}+", "", ">"),
    (rf"(?mdU)^[-*+]{SPACE}+", "", ""),
    (rf"(?mdU)^\d+\.{SPACE}+", "", "."),
    (rf"(?mdU)^{SPACE}*[-*_]{{3,}}{SPACE}*$", "", ""),
    (rf"(?mdU)^({SPACE}*\|.*\|{SPACE}*)$", "", "|"),
]


# A reference to a character, as the HTML rules find it; whatever follows a name stays as it is.
ENTITY_PATTERN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def _characters(references: pa.Array) -> pa.Array:
    """Each row's references with their characters; a reference is decoded once per batch."""
    found = references.flatten().dictionary_encode()
    decoded = pa.array([html.unescape(r) for r in found.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(references), 0).to_numpy()
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.MapArray.from_arrays(offsets, found.dictionary_decode(), decoded.take(found.indices))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _replace(text: Column, pattern: str, replacement: str, needs: str) -> Column:
    """Replace a pattern that only matches where the text contains ``needs``; others are not searched for it."""
    return _bind(
        text, lambda t: F.when(F.contains(t, F.lit(needs)), F.regexp_replace(t, F.lit(pattern), F.lit(replacement))).otherwise(t)
    )


def _decode(text: Column, characters: Column) -> Column:
    """The text with its references replaced by the characters that a map has for them."""

    def parts(t: Column) -> Column:
        between = F.split(t, F.lit(ENTITY_PATTERN), F.lit(-1))
        references = F.regexp_extract_all(t, F.lit(ENTITY_PATTERN), F.lit(0))
        decoded = F.transform(references, lambda r: F.element_at(characters, r))
        return F.array_join(F.zip_with(between, decoded, lambda b, d: F.concat(b, F.coalesce(d, F.lit("")))), "")

    return _bind(text, lambda t: F.when(F.contains(t, F.lit("&")), parts(t)).otherwise(t))


def _strip_tags(text: Column) -> Column:
    return _replace(_replace(text, SCRIPT_PATTERN, " ", "<"), TAG_PATTERN, " ", "<")


def strip_tags(column) -> Column:
    """Remove script blocks and the known tags; missing text becomes empty."""
    return _strip_tags(F.coalesce(_col(column), F.lit("")))


def strip_html(column) -> Column:
    """Text without tags, its references as characters.

    Only the references go through Python, not the texts: those of the text with its tags are all that can be left without them, as a
    reference ends where a tag begins.
    """
    text = F.coalesce(_col(column), F.lit(""))
    references = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY_PATTERN), F.lit(0)))
    both = F.struct(text.alias("text"), _characters(references).alias("characters"))
    return _bind(both, lambda b: _decode(_strip_tags(b["text"]), b["characters"]))


def unescape_entities(column) -> Column:
    """HTML references to characters; a missing text stays missing."""
    text = _col(column)
    references = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY_PATTERN), F.lit(0)))
    return _bind(F.struct(text.alias("text"), _characters(references).alias("characters")), lambda b: _decode(b["text"], b["characters"]))


def strip_markdown(column) -> Column:
    text = F.coalesce(_col(column), F.lit(""))
    for pattern, replacement, needs in MARKDOWN_PATTERNS:
        text = _replace(text, pattern, replacement, needs) if needs else F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text


def tidy_whitespace(text: Column) -> Column:
    # A single space stays as it is.
    text = F.regexp_replace(text, F.lit(r"[ \t]{2,}|\t"), F.lit(" "))
    text = _replace(text, r"\n{3,}", "\n\n", "\n\n\n")
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def clean_text(column) -> Column:
    """HTML, then Markdown, then whitespace."""
    return tidy_whitespace(strip_markdown(strip_html(column)))


def clean_article_text(df: DataFrame, columns) -> DataFrame:
    """Clean whole text columns of an article table or stream."""
    return df.withColumns({c: clean_text(c) for c in columns})


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
