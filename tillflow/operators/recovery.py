"""Filling Sales for files in which the column is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.functions.money import is_nonzero
from tillflow.operators.skew import file_lookup
from tillflow.session import materialise

# Names of further columns that may hold line amounts.
AMOUNT_NAME = (
    r"(sales?|sale\s*amount|sales?\s*(?:amount|value|price)|"
    r"line\s*(?:amount|total)|extended|ext|net\s*(?:amount|total|sales?)|"
    r"line\s*price|unit\s*price)"
)

# Payment is taken for a line amount when this share of receipts has several payments.
VARYING_SHARE = 0.30


def payment_variety(rows: DataFrame) -> DataFrame:
    """Per file: receipts, and the share of them with more than one distinct payment."""
    per_receipt = rows.where(F.col("receipt").isNotNull()).groupBy("file", "receipt").agg(
        F.countDistinct("payment").alias("payments")
    )
    return per_receipt.groupBy("file").agg(
        F.count(F.lit(1)).alias("receipts"),
        F.avg((F.col("payments") > 1).cast("double")).alias("varying_share"),
    )


def _candidates(rows: DataFrame, column: str) -> DataFrame:
    """Per file and position in the array: values that parsed, and those that are not zero."""
    return (
        rows.select("file", F.posexplode(column).alias("slot", "amount"))
        .groupBy("file", "slot")
        .agg(F.count("amount").alias("parsed"), F.count_if(is_nonzero(F.col("amount"))).alias("nonzero"))
    )


def file_basics(rows: DataFrame, *more: Column) -> DataFrame:
    """One row per file with the counts :func:`sales_sources` starts from, and any ``more``."""
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_nonzero(F.col("plain_sales"))).alias("sales_nonzero"),
        F.count_if(is_nonzero(F.col("payment_amount"))).alias("payment_nonzero"),
        F.count("receipt").alias("with_receipt"),
        *more,
    )


def sales_sources(rows: DataFrame, basics: DataFrame) -> DataFrame:
    """Add where Sales comes from: ``sales``, ``literal``, ``other``, ``payment`` or ``none``.

    ``rows`` has ``plain_sales`` (the column where it already is a number), the parsed arrays
    ``literal_amounts`` and ``other_amounts``, ``payment_amount``, ``payment`` and ``receipt``.
    Only files with an empty column are looked at again; where there are none, as is usual,
    the lines are not read a second time.
    """
    empty = basics.where(F.col("sales_nonzero") == 0)
    if empty.isEmpty():
        return basics.withColumns({"sales_source": F.lit("sales"), "sales_slot": F.lit(0)})
    in_empty = rows.join(empty.select("file"), "file", "left_semi")
    literal = _candidates(in_empty, "literal_amounts").where(F.col("nonzero") > 0).groupBy("file").agg(
        F.min("slot").alias("literal_slot")
    )
    fullest = F.max(F.struct("parsed", (-F.col("slot")).alias("neg"), "nonzero")).alias("best")
    other = _candidates(in_empty, "other_amounts").groupBy("file").agg(fullest).where(
        F.col("best.nonzero") > 0
    ).select("file", (-F.col("best.neg")).alias("other_slot"))
    variety = payment_variety(in_empty)
    source = (
        F.when(F.col("sales_nonzero") > 0, "sales")
        .when(F.col("literal_slot").isNotNull(), "literal")
        .when(F.col("other_slot").isNotNull(), "other")
        .when((F.col("payment_nonzero") > 0)
              & ((F.col("with_receipt") == 0) | (F.col("varying_share") >= VARYING_SHARE)), "payment")
        .otherwise("none")
    )
    sources = basics.join(literal, "file", "left").join(other, "file", "left").join(variety, "file", "left")
    return materialise(sources.select(
        *basics.columns, source.alias("sales_source"),
        F.coalesce("literal_slot", "other_slot", F.lit(0)).alias("sales_slot"),
    ), "sources")


def recovered_sales():
    """The Sales value given ``sales_source`` and ``sales_slot`` of the row's file."""
    slot = F.col("sales_slot")
    return (
        F.when(F.col("sales_source") == "literal", F.get("literal_amounts", slot))
        .when(F.col("sales_source") == "other", F.get("other_amounts", slot))
        .when(F.col("sales_source") == "payment", F.col("payment_amount"))
        .otherwise(F.col("sales"))
    )


def recover_sales(rows: DataFrame) -> DataFrame:
    """Replace ``sales`` by the recovered value where the file's column is empty."""
    basics = materialise(file_basics(rows), "files")
    sources = sales_sources(rows, basics).select("file", "rows", "sales_source", "sales_slot")
    return file_lookup(rows, sources).withColumn("sales", recovered_sales()).drop("rows", "sales_slot")
