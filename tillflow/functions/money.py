"""Numbers out of report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillflow.functions.text import strip


def _decimal_point(c: Column, thousands_comma: bool) -> Column:
    """Give text of digits, commas, dots and minus signs a single decimal point.

    The separator that comes last is the decimal mark, so a lone comma is a decimal
    comma. ``thousands_comma`` reads ``1,234,567`` as a whole number instead.
    """
    without_commas = F.translate(c, ",", "")
    plain = F.when(c.rlike(r",[^.]*$"), F.translate(c, ",.", ".")).otherwise(without_commas)
    if thousands_comma:
        return F.when(c.rlike(r"^-?\d{1,3}(,\d{3})+$"), without_commas).otherwise(plain)
    return plain


def _to_double(c: Column, thousands_comma: bool, raw: Column) -> Column:
    """``raw`` is the text that ``c`` was made of; without a comma, as usual, nothing is left to decide."""
    kept = F.regexp_replace(c, r"[^\d,.-]", "")
    return F.when(raw.contains(","), _decimal_point(kept, thousands_comma)).otherwise(kept).try_cast("double")


def _plain_or(c: Column, parsed: Column) -> Column:
    """Cast what already is a plain number; most values are, and skip the rewriting."""
    return F.when(c.rlike(r"^-?\d+(\.\d*)?$"), c.try_cast("double")).otherwise(parsed)


def _brackets_to_minus(c: Column) -> Column:
    return F.when(c.startswith("("), F.regexp_replace(c, r"^\(([^)]+)\)$", "-$1")).otherwise(c)


def money_parse(c: Column, paren_negative: bool = True, thousands_comma: bool = False) -> Column:
    """Money text to double: trailing minus, bracketed negatives and CR/DR marks."""
    text = strip(c)
    if paren_negative:
        text = _brackets_to_minus(text)
    text = F.when(c.contains("-"), F.regexp_replace(text, r"^\s*([0-9.,]+)\s*-\s*$", "-$1")).otherwise(text)
    credit = text.rlike(r"(?i)\bCR\b")
    bare = strip(F.regexp_replace(text, r"(?i)\b[CD]R\b", ""))
    signed = F.when(credit, F.concat(F.lit("-"), bare)).otherwise(bare)
    # Amounts without the letter both marks end in skip the search for them.
    signed = F.when(c.contains("r") | c.contains("R"), signed).otherwise(text)
    return _plain_or(c, _to_double(signed, thousands_comma, c))


def numeric_clean(c: Column, paren_negative: bool = True, thousands_comma: bool = False) -> Column:
    """Quantities and amounts of the report columns; null where nothing numeric is left."""
    text = _brackets_to_minus(strip(c)) if paren_negative else c
    return _plain_or(c, _to_double(text, thousands_comma, c))


def strict_numeric(c: Column) -> Column:
    """Digits, dots and minus signs only; commas have no meaning."""
    return F.regexp_replace(c, r"[^\d.-]", "").try_cast("double")


def plain_number(c: Column) -> Column:
    """Text that already is a number; anything else is null."""
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return F.when(c.rlike(number), c.try_cast("double"))


def is_nonzero(c: Column) -> Column:
    return F.coalesce(F.abs(c) > 1e-9, F.lit(False))
