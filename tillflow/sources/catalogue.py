"""The product catalogue."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillflow.schema import CATALOGUE
from tillflow.session import materialise
from tillflow.sources.tables import SnapshotTable

# Catalogue headers -> column names; headers match in any case.
CATALOGUE_HEADERS = {
    "Product Name": "product_name",
    "Tab": "tab",
    "Category": "category",
    "Barcode": "barcode",
    "SKU Number": "sku_number",
}


def empty_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOGUE)


def read_catalogue(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The catalogue as text columns with row positions; empty where it cannot be read."""
    try:
        reader = spark.read.option("header", "true").option("quote", '"').option("escape", '"')
        found = reader.format(fmt).load(path)
        return to_catalogue(in_file_order(found.selectExpr("*", "_metadata.file_path AS _file", "_metadata.file_block_start AS _start")))
    except AnalysisException:
        return empty_catalogue(spark)


def in_file_order(rows: DataFrame) -> DataFrame:
    """Add ``position``, the place of each row by file name and place in its file.

    Spark reads files in the order of their sizes. Rows of one split are numbered in a run, so their places
    follow from one row per split: how many rows the splits before it hold.
    """
    numbered = materialise(rows.withColumn("_number", F.monotonically_increasing_id()), "catalogue")
    splits = numbered.groupBy("_file", "_start").agg(F.min("_number").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    placed = numbered.join(splits, ["_file", "_start"])
    return placed.withColumn("position", F.col("_before") + F.col("_number") - F.col("_least")) \
        .drop("_file", "_start", "_number", "_least", "_rows", "_before")


def to_catalogue(rows: DataFrame) -> DataFrame:
    """Select the catalogue columns whatever the case of their names; missing ones are null."""
    by_name = {c.strip().lower(): c for c in rows.columns}

    def column(header: str, name: str):
        source = by_name.get(header.lower()) or by_name.get(name)
        return (F.col(f"`{source}`").cast("string") if source else F.lit(None).cast("string")).alias(name)

    position = F.col("position").cast("long") if "position" in rows.columns else F.monotonically_increasing_id()
    return rows.select(*[column(h, n) for h, n in CATALOGUE_HEADERS.items()], position.alias("position"))


def catalogue_version(catalogue: DataFrame) -> str:
    """A name for what the catalogue holds: equal rows at equal positions give equal names."""
    row = F.xxhash64(*[F.coalesce(F.col(f.name).cast("string"), F.lit("\0")) for f in CATALOGUE.fields])
    found = catalogue.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).first()
    return "-".join(f"{abs(value or 0):x}" for value in found)


def append_products(catalogue: DataFrame, added: DataFrame) -> DataFrame:
    """New rows go below the existing ones."""
    last = catalogue.agg(F.coalesce(F.max("position"), F.lit(-1)).cast("long")).scalar()
    placed = added.withColumn("position", F.monotonically_increasing_id() + 1 + last)
    return catalogue.unionByName(placed)


def save_catalogue(catalogue: DataFrame, root: str) -> str:
    """Write a new version; the previous one stays as the backup."""
    return SnapshotTable(catalogue.sparkSession, root, CATALOGUE).write(catalogue)


def load_saved_catalogue(spark: SparkSession, root: str) -> DataFrame:
    return SnapshotTable(spark, root, CATALOGUE).read()
