"""Text cleaning, name normalisation and output coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a value.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Text that means "no value" after trimming.
NULL_TOKENS = ["nan", "none", "null", "", "NaN", "None", "NULL"]

# Cells a CSV reader takes for missing.
CSV_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def _visible(c: Column) -> Column:
    """Text that begins with an ASCII character other than white space; null and empty text does not."""
    return (c >= "!") & (c < "\x80")


def strip_cell(c: Column) -> Column:
    """As :func:`strip`, for a plain column: text with nothing to cut, the usual case, is not searched for it."""
    return F.when(_visible(c) & _visible(F.substring(c, -1, 1)), c).otherwise(strip(c))


def has_text(c: Column) -> Column:
    """The plain column holds more than white space."""
    return F.when(_visible(c), F.lit(True)).otherwise(strip(c) != "")


def csv_missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(CSV_NA_TOKENS), c)


def clean_text(c: Column) -> Column:
    trimmed = strip_cell(c)
    return F.when(~trimmed.isin(NULL_TOKENS), trimmed)


def clean_item_code(c: Column) -> Column:
    return F.upper(clean_text(c))


def clean_unit_text(c: Column) -> Column:
    return F.lower(clean_text(c))


def is_blank(c: Column) -> Column:
    """Null, empty, or the word for a missing value in any case."""
    return c.isNull() | F.lower(strip_cell(c)).isin("", "nan", "none", "null")


def normalise_barcode(c: Column) -> Column:
    return blank_to_null(F.upper(strip_cell(c)))


def _collapse(c: Column) -> Column:
    """Drop punctuation, turn runs of white space into one space, trim."""
    words = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]+", "")
    return F.btrim(F.regexp_replace(words, r"(?U)\s+", " "))


def basic_name(c: Column) -> Column:
    return _collapse(F.lower(F.coalesce(c, F.lit(""))))


def improved_name(c: Column) -> Column:
    """As :func:`basic_name`, after cutting bracketed parts, expiry tags and hash tags."""
    # What is cut, in order.
    cut_patterns = [
        r"\([^)]*\)",
        r"\[[^\]]*\]",
        r"\{[^\}]*\}",
        r"#exp[0-9-]*",
        r"exp[0-9-]*",
        r"#[a-z0-9-]+",
    ]
    text = F.lower(F.coalesce(c, F.lit("")))
    cut = text
    for pattern in cut_patterns:
        cut = F.regexp_replace(cut, pattern, "")
    # Names without any mark to cut, the usual case, skip the six patterns.
    return _collapse(F.when(text.rlike(r"[(\[{#]|exp"), cut).otherwise(text))


def blank_to_null(c: Column) -> Column:
    trimmed = strip(c.cast("string"))
    return F.when(trimmed != "", trimmed)


def number_text(c: Column) -> Column:
    """A double as text that is equal for equal numbers and for no others: whole numbers without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.try_cast("bigint").cast("string")).otherwise(c.cast("string"))


def contains_search(c: Column, query: str) -> Column:
    return F.lower(c).contains(query.lower())
