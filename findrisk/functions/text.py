"""String helpers. All of them stay inside generated code: no lambdas, no Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as blank at the ends of a field.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)

# One non-blank entry of a comma-separated list, from its first visible character.
LIST_ENTRY = r"[^,\s][^,]*"


def strip(column: Column) -> Column:
    """Remove blanks of every kind at both ends (``trim`` alone removes only spaces)."""
    return F.trim(column, F.lit(BLANKS))


def upper_strip(column: Column) -> Column:
    return F.upper(strip(column))


def lower_strip(column: Column) -> Column:
    return F.lower(strip(column))


def text_or_blank(column: Column) -> Column:
    """Null and the text "nan" both mean "no value"."""
    return F.when(column.isNull() | (column == "nan"), "").otherwise(column)


def list_size(column: Column) -> Column:
    """Number of non-blank entries in a comma-separated list."""
    return F.coalesce(F.size(F.regexp_extract_all(text_or_blank(column), F.lit(LIST_ENTRY), F.lit(0))), F.lit(0))


def list_head(column: Column) -> Column:
    """First non-blank entry of a comma-separated list, else the empty string."""
    return strip(F.regexp_extract(text_or_blank(column), LIST_ENTRY, 0))


def mentions(column: Column, word: str) -> Column:
    """Case-insensitive containment; null does not mention anything."""
    return F.coalesce(F.lower(column).contains(word.lower()), F.lit(False))
