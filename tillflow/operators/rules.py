"""Reject rules as one CASE chain: the first rule that fires names the stage and reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.functions.text import is_blank, strip_cell
from tillflow.schema import IMPORTANT_COLUMNS

# Text that marks summary lines, in order.
SUMMARY_PATTERNS = ["grand total", "total:", "subtotal"]

# Adjustment words of a description and adjustment codes.
ADJUSTMENT_TEXT = (
    r"(sales\s*discount|^discount$|less\s*discount|void|cancel|round(?:ing|[-\s]*off)|"
    r"change|senior|pwd|rebate|price\s*adj|adjustment)"
)
ADJUSTMENT_CODES = ["sd", "disc", "discount", "void", "sc", "pwd", "rebate"]

# Stages and reasons.
PRE_MAP = "pre-map"
INCOMPLETE = "remove_incomplete_rows"
EMPTY_ROW = "completely empty row"
MISSING_SUPPORT = "financial data present but missing supporting fields"
ALL_EMPTY = "all important fields empty"
PLACEHOLDER = 'placeholder/non-item row (e.g., header like "Account : ...")'
ADJUSTMENT = "non-item adjustment (e.g., Sales Discount/VOID/rounding)"
DUPLICATE_STAGE, DUPLICATE = "duplicates", "duplicate row"
POST_MAP, ALL_EMPTY_POST = "post-map", "all important fields empty (post-map)"

# Above this share of lines without any important field the file gets a warning.
GATE_SHARE = 0.95


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)) == 0


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def all_important_null(columns: list[str] = IMPORTANT_COLUMNS) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull()


def summary_pattern(raw_text: Column) -> Column:
    """The first summary pattern found anywhere in a raw line, or null."""
    text = F.lower(raw_text)
    # A word of all the patterns comes first, since hardly any line has it.
    return F.when(text.contains("total"), F.coalesce(*[F.when(text.contains(p), p) for p in SUMMARY_PATTERNS]))


def reject_rules(stopped: Column | None = None) -> list[tuple[str, str, Column]]:
    """(stage, reason, condition) of every row-local rule, in the order they apply.

    Expects typed columns plus ``summary`` and ``row_is_empty``, both taken from the raw line. Where ``stopped``
    holds, the quality gate has ended the cleaning of the file after its blank and summary lines.
    """
    going = F.lit(True) if stopped is None else ~stopped
    code = strip_cell(F.col("item_code"))
    description = strip_cell(F.col("description"))
    no_money = _all(_zero("sales"), _zero("cost"), _zero("profit"))
    has_money = ~no_money
    blank_description = description.isNull() | (description == "")
    not_a_code = code.isNotNull() & ~code.rlike(r"^\d+$")
    adjustment = F.coalesce(F.lower(description).rlike(ADJUSTMENT_TEXT), F.lit(False)) | F.coalesce(
        F.lower(code).isin(ADJUSTMENT_CODES), F.lit(False)
    )
    return [
        *[(PRE_MAP, f"summary/total row matched '{p}'", F.coalesce(F.col("summary") == p, F.lit(False)))
          for p in SUMMARY_PATTERNS],
        (PRE_MAP, EMPTY_ROW, F.col("row_is_empty")),
        (INCOMPLETE, MISSING_SUPPORT, going & has_money & (is_blank(F.col("item_code")) | is_blank(F.col("description")))),
        (INCOMPLETE, ALL_EMPTY, going & all_important_null()),
        (INCOMPLETE, PLACEHOLDER, going & _zero("qty") & no_money & (F.coalesce(not_a_code, F.lit(False)) | blank_description)),
        (INCOMPLETE, ADJUSTMENT, going & no_money & adjustment),
    ]


def label_rejects(rows: DataFrame, stopped: Column | None = None) -> DataFrame:
    """Add ``error_stage`` and ``error_reason``; both null where the line is kept."""
    rules = reject_rules(stopped)
    label = reduce(
        lambda chain, rule: chain.when(rule[2], F.struct(F.lit(rule[0]).alias("stage"), F.lit(rule[1]).alias("reason"))),
        rules[1:],
        F.when(rules[0][2], F.struct(F.lit(rules[0][0]).alias("stage"), F.lit(rules[0][1]).alias("reason"))),
    )
    labelled = rows.withColumn("_label", label)
    return labelled.withColumns({
        "error_stage": F.col("_label.stage"),
        "error_reason": F.col("_label.reason"),
    }).drop("_label")


def label_repeats(rows: DataFrame, flag: str = "is_repeat", stopped: Column | None = None) -> DataFrame:
    """Turn flagged repeats into rejects, then apply the post-map rule to what is left."""
    going = F.lit(True) if stopped is None else ~stopped
    kept = F.col("error_reason").isNull()
    repeat = kept & F.col(flag)
    empty = kept & going & all_important_null()
    return rows.withColumns({
        "error_stage": F.when(repeat, DUPLICATE_STAGE).when(empty, POST_MAP).otherwise(F.col("error_stage")),
        "error_reason": F.when(repeat, DUPLICATE).when(empty, ALL_EMPTY_POST).otherwise(F.col("error_reason")),
    }).drop(flag)


def kept(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error_reason").isNull()).drop("error_stage", "error_reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error_reason").isNotNull())


def gate_measures(important_null: Column, share: float = GATE_SHARE, counted: Column | None = None) -> list[Column]:
    """Aggregates of a file: lines whose important fields are all null, and whether they are too many.

    Only ``counted`` lines are looked at, all where it is left out; a file without any does not fire.
    """
    looked = F.lit(True) if counted is None else counted
    fired = F.avg(F.when(looked, important_null.cast("double"))) > share
    return [
        F.count_if(looked & important_null).alias("empty_rows"), F.coalesce(fired, F.lit(False)).alias("gate_fired"),
    ]


def quality_gate(rows: DataFrame, important_null: Column, share: float = GATE_SHARE) -> DataFrame:
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *gate_measures(important_null, share))


def needs_category(either: bool = False) -> Column:
    """Products without a category; with ``either``, without a category or without a tab."""
    def missing(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    return missing("category") | missing("tab") if either else missing("category")


def key_lookup(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value)
