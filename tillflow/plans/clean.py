"""Raw report rows to cleaned and rejected sales lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.functions import dates, keys, money, text, txn, units
from tillflow.operators import dedup, rules
from tillflow.operators.recovery import file_basics, recovered_sales, sales_sources
from tillflow.operators.skew import file_lookup
from tillflow.schema import IDENTITY_COLUMNS, POSITION
from tillflow.session import materialise
from tillflow.sources.reports import FILE_NOT_FOUND, below_header, missing_paths, read_scan, require_readable, store_rows

QUALITY_WARNING = "QUALITY_WARNING"
NUMBERS = ["qty", "discount", "sales", "cost", "profit"]
TEXTS = ["receipt", "so", "payment", "cashier_id"]

LINE_COLUMNS = [
    *POSITION, "date", "receipt", "so", "item_code", "description", "expiration_date", "qty", "unit",
    "discount", "sales", "cost", "profit", "payment", "cashier_id", "match_name",
]
#: What is stored of labelled lines: the columns of both outputs, the label, and what tells repeats.
LABELLED_COLUMNS = [*LINE_COLUMNS, *[f"raw_{c}" for c in NUMBERS], "error_stage", "error_reason", "gate_fired", "_identity"]


@dataclass
class Cleaned:
    lines: DataFrame
    rejects: DataFrame
    files: DataFrame


def type_lines(raw: DataFrame) -> DataFrame:
    """Every cell parsed once. Text of numbers that did not parse is kept for the error table."""
    staged = dates.split_expiry(raw, "description", "_found_expiry", "_bare_description")
    # What is used more than once is a column of its own, so it is evaluated once and the generated code stays small.
    staged = staged.withColumns({
        **{f"_{c}": money.numeric_clean(F.col(c)) for c in NUMBERS},
        "_unit_word": units.unit_from_description(F.col("_bare_description")),
        "_unit_text": F.lower(text.strip_cell(F.col("unit"))),
    })
    typed: dict[str, Column] = {
        "summary": rules.summary_pattern(F.col("raw_text")),
        "row_is_empty": F.col("row_is_empty"),
        "important_null": rules.all_important_null(),
        "match_name": text.improved_name(F.col("description")),
        "date": dates.clean_date(F.col("date")),
        **{c: text.clean_text(F.col(c)) for c in TEXTS},
        "item_code": text.clean_item_code(F.col("item_code")),
        "description": text.clean_text(F.col("_bare_description")),
        "expiration_date": F.coalesce("_found_expiry", dates.clean_expiry_column(F.col("expiration_date"))),
        **{c: F.col(f"_{c}") for c in NUMBERS},
        **{f"raw_{c}": F.when(F.col(f"_{c}").isNull(), F.col(c)) for c in NUMBERS},
        "plain_qty": money.plain_number(F.col("qty")),
        "plain_sales": money.plain_number(F.col("sales")),
        "payment_amount": F.when(F.col("payment").rlike(r"\d"), money.money_parse(F.col("payment"))),
        "literal_amounts": F.col("literal_amounts"),
        "other_amounts": F.col("other_amounts"),
        "unit_given": units.unit_is_given(F.col("unit")),
        "unit_column": units.canonical_unit(F.col("_unit_text")),
        "unit_found": units.canonical_unit(F.col("_unit_word")),
    }
    carried = [c for c in ("is_header", "open_quote", "has_zero") if c in raw.columns]
    return staged.select(*POSITION, *carried, *[e.alias(c) for c, e in typed.items()])


def file_facts(typed: DataFrame) -> DataFrame:
    """What the rules need to know about a whole file, from one aggregation: one row each."""
    # The gate looks at what is left without summary and blank lines.
    gate = rules.gate_measures(F.col("important_null"), counted=F.col("summary").isNull() & ~F.col("row_is_empty"))
    # Lines with a description and nothing else that identifies them; hardly any file has one.
    bare = F.coalesce(*[F.col(c).cast("string") for c in IDENTITY_COLUMNS]).isNull() & F.col("description").isNotNull()
    unit = F.max("unit_given").alias("has_unit")
    basics = materialise(file_basics(typed, *gate, unit, F.count_if(bare).alias("bare_lines")), "files")
    return sales_sources(typed, basics)


def finish_values(typed: DataFrame, per_file: DataFrame, scale_inferred: bool = False) -> DataFrame:
    """Sales, unit, quantity and profit, which depend on the whole file."""
    rows = file_lookup(typed, per_file.select("file", "rows", "sales_source", "sales_slot", "has_unit", "gate_fired"))
    rows = rows.withColumns({
        "sales": recovered_sales(),
        "_unit": F.when(F.col("has_unit"), F.col("unit_column")).otherwise(F.col("unit_found")),
    })
    scale = F.col("has_unit") | F.lit(scale_inferred)
    unit = F.when(scale, units.scaled_unit(F.col("_unit"))).otherwise(F.col("_unit"))
    return rows.withColumns({
        "qty": F.when(scale, units.scaled_qty(F.col("_unit"), F.col("plain_qty"), F.col("qty"))).otherwise(F.col("qty")),
        "unit": F.coalesce(unit, F.when(F.col("plain_qty").isNotNull(), "pcs")),
        "profit": txn.filled_profit(F.col("profit"), F.col("sales"), F.col("cost")),
    })


def label_lines(values: DataFrame, per_file: DataFrame) -> DataFrame:
    """Reject rules, then keep-first duplicates among what they keep, then the post-map rule.

    A file whose gate fired is left as it is but for its blank and summary lines.
    """
    stopped = F.col("gate_fired")
    labelled = rules.label_rejects(values, stopped)
    kept = F.col("error_reason").isNull() & ~stopped
    if per_file.where(F.col("bare_lines") > 0).isEmpty():
        key = dedup.identity_key()
    else:
        labelled = _flag_files_without_identity(labelled, kept)
        whole_row = [c for c in LINE_COLUMNS if c not in (*POSITION, "match_name")]
        key = dedup.identity_key(whole_row=whole_row, by_whole_row=F.col("_no_identity"))
    # Stored with their keys, so that no rule is asked twice: for the keys, then for the lines they come back to.
    # Columns that only the rules look at end here.
    keyed = labelled.withColumn("_identity", F.when(kept, key))
    keyed = materialise(keyed.select(*[c for c in LABELLED_COLUMNS if c in keyed.columns]), "labelled")
    marked = dedup.mark_repeats(keyed, F.col("_identity")).drop("_identity")
    return rules.label_repeats(marked, stopped=stopped).drop("gate_fired")


def _flag_files_without_identity(labelled: DataFrame, kept: Column) -> DataFrame:
    """Flag files none of whose kept lines has an identity value; their duplicates are whole rows."""
    has_identity = F.coalesce(*[F.col(c).cast("string") for c in IDENTITY_COLUMNS]).isNotNull()
    flags = labelled.where(kept).groupBy("file").agg(
        F.count(F.lit(1)).alias("_kept"), (~F.max(has_identity)).alias("_no_identity")
    )
    return file_lookup(labelled, materialise(flags, "flags"))


def finish_lines(labelled: DataFrame) -> DataFrame:
    """Kept lines with filled-down receipts, row key and transaction type."""
    lines = dedup.fill_down(rules.kept(labelled).select(*LINE_COLUMNS), ["receipt", "so"])
    return lines.withColumns({
        "row_hash": keys.row_key(*[F.col(c) for c in IDENTITY_COLUMNS]),
        "txn_type": txn.txn_type(F.col("description"), F.col("qty")),
    })


def reject_rows(labelled: DataFrame) -> DataFrame:
    """Rejected lines with numbers as text: the parsed number, or what could not be parsed."""
    columns = [c for c in LINE_COLUMNS if c != "match_name"]
    out = rules.rejected(labelled)
    return out.select(
        *[F.coalesce(text.number_text(F.col(c)), F.col(f"raw_{c}")).alias(c) if c in NUMBERS else F.col(c)
          for c in columns],
        "error_stage", "error_reason",
    )


def clean_scan(scan: DataFrame, mode: str = "strict") -> Cleaned:
    """Clean scanned report lines. Typed, labelled and finished lines are each written once.

    Text is parsed a single time, which also fixes the lines' places. Headers and per-file facts
    are read from columns of the typed table, duplicate keys and both outputs from the labelled one.
    """
    typed, files = store_rows(scan, mode, type_lines, "typed")
    require_readable(files)
    body = below_header(typed, files)
    per_file = file_facts(body)
    labelled = label_lines(finish_values(body, per_file), per_file)
    return Cleaned(
        materialise(finish_lines(labelled), "lines"),
        reject_rows(labelled),
        file_report(files.select("file", "status", "lines"), per_file),
    )


def file_report(files: DataFrame, per_file: DataFrame) -> DataFrame:
    facts = per_file.select("file", "rows", "empty_rows", "sales_source", "gate_fired")
    warned = F.when(F.col("gate_fired"), QUALITY_WARNING).otherwise(F.col("status"))
    return files.join(facts, "file", "left").withColumn("status", warned).drop("gate_fired")


def clean_reports(spark: SparkSession, paths: str | list[str], mode: str = "strict") -> Cleaned:
    """Read and clean all reports below ``paths``; bad and missing files are reported in ``files``."""
    cleaned = clean_scan(read_scan(spark, paths), mode)
    missing = missing_paths(spark, [paths] if isinstance(paths, str) else list(paths))
    if missing:
        absent = spark.createDataFrame([(p, FILE_NOT_FOUND, 0) for p in missing], "file string, status string, lines long")
        cleaned.files = cleaned.files.unionByName(absent, allowMissingColumns=True)
    return cleaned
