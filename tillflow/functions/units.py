"""Units of measure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillflow.functions.text import strip, strip_cell

# Spellings of each unit.
UNIT_ALIASES = {
    "pcs": ["pc", "pcs", "piece", "pieces", "unit", "units"],
    "box": ["box", "boxes", "bx"],
    "pack": ["pack", "packs", "pkt", "packet", "packets"],
    "kg": ["kg", "kilogram", "kilograms"],
    "g": ["g", "gram", "grams"],
    "l": ["l", "liter", "liters"],
    "ml": ["ml", "milliliter", "milliliters"],
}

# Forms and dosages that are counted in pieces.
PIECE_FORMS = [
    "tab", "tabs", "tablet", "tablets", "cap", "caps", "capsule", "capsules",
    "vial", "vials", "amp", "ampule", "ampoule", "sachet", "sachets",
    "bottle", "bottles", "bot", "btl", "tube", "tubes", "jar", "jars",
    "can", "cans", "tin", "tins", "strip", "blister", "blisters",
    "roll", "rolls", "pair", "pairs", "set", "sets", "mg", "mcg", "iu",
]

# Units recognised inside longer text, in order.
UNIT_PATTERNS = [
    (r"\bpcs?\b", "pcs"),
    (r"\bpieces?\b", "pcs"),
    (r"\bboxes?\b", "box"),
    (r"\bpacks?\b|\bpkt\b|\bpackets?\b", "pack"),
    (r"\bkg\b|\bkilograms?\b", "kg"),
    (r"\bgrams?\b|\bg\b", "g"),
    (r"\bliters?\b|\bl\b", "l"),
    (r"\bmilliliters?\b|\bml\b", "ml"),
]

# Unit words looked for in a description, in order.
DESCRIPTION_UNITS = [
    "pc", "pcs", "piece", "pieces", "unit", "units",
    "box", "boxes", "pack", "packs", "pkt", "packet", "packets",
    "sachet", "sachets", "vial", "vials", "amp", "ampule", "ampoule",
    "tube", "tubes", "bottle", "bottles", "bot", "btl",
    "jar", "jars", "can", "cans", "tin", "tins",
    "strip", "blister", "blisters", "cap", "caps", "capsule", "capsules",
    "tab", "tabs", "tablet", "tablets", "roll", "rolls", "pair", "pairs",
    "set", "sets", "kg", "g", "mg", "ml", "iu",
]

# Tokens of a unit column that mean "no value".
UNIT_NULL_TOKENS = ["", "nan", "None", "NULL"]


def canonical_unit(c: Column, piece_forms: bool = True) -> Column:
    text = F.lower(strip(c))
    chain = F.when(text.isin(UNIT_ALIASES["pcs"] + (PIECE_FORMS if piece_forms else [])), "pcs")
    for unit, spellings in UNIT_ALIASES.items():
        chain = chain.when(text.isin(spellings), unit)
    for pattern, unit in UNIT_PATTERNS:
        chain = chain.when(text.rlike(f"(?U){pattern}"), unit)
    return chain


def _by_letter(words: list[str]) -> str:
    """An alternation grouped by first letters, so that a word is compared with the few that begin as it does."""
    rests: dict[str, list[str]] = {}
    for word in words:
        rests.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in rests.items())


def unit_from_description(c: Column) -> Column:
    """First unit word that no letter touches; a digit may, as in ``195ml``.

    Since no letter may follow, at most one of the words fits a place, whatever their order.
    """
    found = F.regexp_extract(c, f"(?i)(?<![A-Za-z])({_by_letter(DESCRIPTION_UNITS)})(?![A-Za-z])", 1)
    return F.nullif(found, F.lit(""))


def unit_is_given(c: Column) -> Column:
    return F.coalesce(~strip_cell(c).isin(UNIT_NULL_TOKENS), F.lit(False))


def scaled_unit(unit: Column) -> Column:
    return F.when(unit == "g", "kg").when(unit == "ml", "l").otherwise(unit)


def scaled_qty(unit: Column, number: Column, qty: Column) -> Column:
    """Quantity in kg or l; ``number`` is the quantity as plainly written."""
    return F.when(unit.isin("g", "ml"), number / 1000.0).otherwise(qty)
