"""Dates and expiry dates out of report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.functions.text import is_blank, strip, strip_cell

# Rewrites of numeric dates to ISO order by how they begin, month before day. Two-digit years from 69 on are in
# the last century.
MONTH_FIRST = [
    (r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(?!\d)", "$4-$1-$3"),
    (r"^(\d{1,2})([/.-])(\d{1,2})\2(69|[7-9]\d)(?= |$)", "19$4-$1-$3"),
    (r"^(\d{1,2})([/.-])(\d{1,2})\2([0-6]\d)(?= |$)", "20$4-$1-$3"),
]
TO_ISO = [
    (r"^\d{1,2}[/.-]", MONTH_FIRST),
    (r"^\d{4}[/.]", [(r"^(\d{4})([/.])(\d{1,2})\2(\d{1,2})(?= |$)", "$1-$3-$4")]),
    (r"^\d{8}$", [(r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")]),
]
PLAIN_ISO = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?Z?)?$"
# As above, with an offset from UTC behind the time of day.
ISO = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z| ?[+-]\d{2}:?\d{2})?)?$"
WEEKDAY = r"(?i)^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?,? +"

# Shapes with letters. A failed parse throws inside the JVM, so each is tried only on text
# that looks like it.
LETTER_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2} ?[AaPp][Mm]$", "yyyy-M-d h:mm[ ]a"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2} ?[AaPp][Mm]$", "yyyy-M-d h:mm:ss[ ]a"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4} \d{1,2}:\d{2} [AaPp][Mm]$", "MMM d, yyyy h:mm a"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4} \d{1,2}:\d{2} [AaPp][Mm]$", "MMMM d, yyyy h:mm a"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4} \d{1,2}:\d{2}$", "MMM d, yyyy H:mm"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "d-MMM-yy"),
    (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"),
    (r"^[A-Za-z]{4,9} \d{4}$", "MMMM yyyy"),
]

EXPIRY_YEARS = (2020, 2045)

# Where an expiry date is looked for in a description, in order.
EXPIRY_PATTERNS = [
    r"[#\$\s]?EXP\s*(\d{4}-\d{2}-\d{2})\$?",
    r"(?:exp(?:iry|iration)?|best\s*by|use\s*by|expires?|bb)[:\s\-]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s*(?:exp|bb)\b",
    r"\b(\d{4}-\d{2}-\d{2})\b",
]

# What is cut from a description once the date is out.
EXPIRY_RESIDUE = [
    r"#exp\w*",
    r"exp\d+",
    r"bb\d+",
    r"#bb\w*",
    r"exp[:\s]*$",
    r"bb[:\s]*$",
    r"#\s*$",
    r"\s+#\s*",
]


def _rewrite(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, order in steps:
        c = F.regexp_replace(c, pattern, order)
    return c


def _iso_order(c: Column) -> Column:
    chain = F.when(F.lit(False), c)
    for start, steps in TO_ISO:
        chain = chain.when(c.rlike(start), _rewrite(c, steps))
    return chain.otherwise(c)


def _without_offset(c: Column) -> Column:
    """A sale belongs to the day its till shows, so an offset from UTC moves nothing."""
    return F.regexp_replace(c, r" ?[+-]\d{2}:?\d{2}$", "")


def _numeric_timestamp(c: Column) -> Column:
    return _without_offset(F.regexp_extract(_iso_order(c), ISO, 0)).try_cast("timestamp")


def _letter_timestamp(c: Column) -> Column:
    # Of the shapes with letters only those with a time of day before noon or after begin with a digit order.
    c = F.when(c.rlike(r"^\d.*[AaPp][Mm]$"), F.upper(_iso_order(c))).otherwise(c)
    chain = F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for shape, fmt in LETTER_SHAPES:
        chain = chain.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(fmt)))
    return chain


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used; for the rare shapes."""
    return F.get(F.transform(F.array(value), use), 0)


def _worded_timestamp(c: Column) -> Column:
    """Text with letters; the name of a weekday goes unchecked."""
    return F.when(c.rlike("[A-SU-Ya-z]"), _letter_timestamp(c)).otherwise(_numeric_timestamp(c))


def parse_timestamp(c: Column) -> Column:
    """Text to timestamp by its shape; null where no shape fits or the date is impossible."""
    trimmed = strip(c)
    return (
        F.when(trimmed.rlike(PLAIN_ISO), trimmed.try_cast("timestamp"))
        .when(trimmed.rlike("[A-SU-Ya-z]"), _once(F.regexp_replace(trimmed, WEEKDAY, ""), _worded_timestamp))
        .otherwise(_numeric_timestamp(trimmed))
    )


def clean_date(c: Column) -> Column:
    """As :func:`parse_timestamp`, where 1970-01-01 means no date."""
    return F.nullif(parse_timestamp(c), F.lit("1970-01-01 00:00:00").cast("timestamp"))


def normalise_expiry(c: Column, years: tuple[int, int] = EXPIRY_YEARS) -> Column:
    """Expiry text to date, or null outside the range of sensible years."""
    day = parse_timestamp(c).cast("date")
    return F.when(F.year(day).between(*years), day)


def lenient_expiry_text(c: Column) -> Column:
    """ISO text of the date, or the input where it is not one."""
    return F.coalesce(F.date_format(parse_timestamp(c), "yyyy-MM-dd"), c)


def _may_hold_expiry(c: Column) -> Column:
    return c.rlike(r"(?i)exp|bb|best|use|#|\d[/-]\d")


def split_expiry(rows: DataFrame, column: str, expiry: str, bare: str) -> DataFrame:
    """Add the expiry date found in a description, and the description without it.

    The first pattern that gives a valid date wins, and all its matches are cut out; then
    left-over marks go. The date of each pattern is a column of its own, so no pattern is
    evaluated twice.
    """
    c = F.col(column)
    places = range(len(EXPIRY_PATTERNS))
    texts, days = [f"_{expiry}_text_{i}" for i in places], [f"_{expiry}_{i}" for i in places]
    marked, cut = f"_{expiry}_marked", f"_{expiry}_cut"
    low, high = EXPIRY_YEARS
    iso_like, other_like = f"_{expiry}_iso", f"_{expiry}_other"

    def iso(pattern: str) -> bool:
        """A pattern that wants the year first is in ISO order as it is."""
        return r"(\d{4}-" in pattern

    # Only a date in plain digits can be valid, so a pattern is tried where there is one in its order.
    found = rows.withColumn(marked, _may_hold_expiry(c)).withColumns({
        iso_like: F.col(marked) & c.rlike(r"\d{4}-\d{2}-\d{2}"),
        other_like: F.col(marked) & c.rlike(r"\d[/-]\d{1,2}[/-]\d{2}"),
    }).withColumns({
        t: F.when(F.col(iso_like if iso(p) else other_like), F.regexp_extract(c, f"(?iU){p}", 1))
        for t, p in zip(texts, EXPIRY_PATTERNS)})

    def day(text: Column, pattern: str) -> Column:
        return F.when(text != "", text.try_cast("date") if iso(pattern) else _rewrite(text, MONTH_FIRST).try_cast("date"))

    dated = found.withColumns({d: day(F.col(t), p) for d, t, p in zip(days, texts, EXPIRY_PATTERNS)})
    dated = dated.withColumns({d: F.when(F.year(d).between(low, high), F.col(d)) for d in days})
    chosen = F.when(F.lit(False), c)
    for d, pattern in zip(days, EXPIRY_PATTERNS):
        chosen = chosen.when(F.col(d).isNotNull(), F.regexp_replace(c, f"(?iU){pattern}", ""))
    left = dated.withColumns({expiry: F.coalesce(*[F.col(d) for d in days]), cut: chosen.otherwise(c)})
    residue = F.col(cut)
    for pattern in EXPIRY_RESIDUE:
        residue = F.regexp_replace(residue, f"(?iU){pattern}", "")
    left = left.withColumn(bare, F.when(F.col(cut).rlike("(?i)exp|bb|#"), residue).otherwise(F.col(cut)))
    left = left.withColumn(bare, F.btrim(F.regexp_replace(bare, r"(?U)\s+", " "), F.lit(" ,-#:()")))
    return left.withColumn(bare, F.when(is_empty(c) | (F.col(bare) == ""), c).otherwise(F.col(bare))).drop(
        marked, cut, iso_like, other_like, *texts, *days)


def is_empty(c: Column) -> Column:
    return c.isNull() | (strip_cell(c) == "")


def clean_expiry_column(c: Column) -> Column:
    return F.when(~is_blank(c), normalise_expiry(c))
