"""Fixed names and schemas of the feed, the cleaned lines and the warehouse tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The report header, in order.
REQUIRED_HEADER = [
    "Date", "Receipt", "SO", "Item Code", "Description", "Qty",
    "Discount", "Sales", "Cost", "Profit", "Payment", "Cashier ID",
]

# Target columns of a sales line: report name -> column name.
TARGET_COLUMNS = {
    "Date": "date",
    "Receipt": "receipt",
    "SO": "so",
    "Item Code": "item_code",
    "Description": "description",
    "Expiration Date": "expiration_date",
    "Qty": "qty",
    "Unit": "unit",
    "Discount": "discount",
    "Sales": "sales",
    "Cost": "cost",
    "Profit": "profit",
    "Payment": "payment",
    "Cashier ID": "cashier_id",
    "Category": "category",
    "Tab": "tab",
}

# Columns the raw feed can fill; category and tab come from the catalogue.
RAW_COLUMNS = [c for c in TARGET_COLUMNS.values() if c not in ("category", "tab")]

# A line is placed by its file, the chunk of the file (the byte offset of the scan split)
# and its index, which only has to grow within a chunk.
POSITION = ["file", "chunk", "row_index"]

IDENTITY_COLUMNS = ["date", "receipt", "so", "item_code", "qty", "sales", "cost"]

IMPORTANT_COLUMNS = ["item_code", "description", "qty", "sales", "cost"]

STAGING = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("receipt", T.StringType()),
    T.StructField("so", T.StringType()),
    T.StructField("item_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("expiration_date", T.DateType()),
    T.StructField("qty", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("discount", T.DoubleType()),
    T.StructField("sales", T.DoubleType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("profit", T.DoubleType()),
    T.StructField("payment", T.StringType()),
    T.StructField("cashier_id", T.StringType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("tab", T.StringType()),
    T.StructField("row_hash", T.StringType()),
    T.StructField("run_id", T.StringType()),
])

# Numbers stay text here so that values which do not parse survive.
ERRORS = T.StructType([
    T.StructField("error_stage", T.StringType()),
    T.StructField("error_reason", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("receipt", T.StringType()),
    T.StructField("so", T.StringType()),
    T.StructField("item_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("expiration_date", T.DateType()),
    T.StructField("qty", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("discount", T.StringType()),
    T.StructField("sales", T.StringType()),
    T.StructField("cost", T.StringType()),
    T.StructField("profit", T.StringType()),
    T.StructField("payment", T.StringType()),
    T.StructField("cashier_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
])

DIM_PRODUCT = T.StructType([
    T.StructField("product_key", T.LongType()),
    T.StructField("item_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("tab", T.StringType()),
    T.StructField("first_seen_date", T.DateType()),
    T.StructField("last_seen_date", T.DateType()),
])

#: What the catalogue of a version says about a product's code and name, found once.
SETTLED = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("item_code", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("tab", T.StringType()),
    T.StructField("method", T.StringType()),
])

FACT_SALES = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("date_key", T.DateType()),
    T.StructField("product_key", T.LongType()),
    T.StructField("receipt_number", T.StringType()),
    T.StructField("sales_order_number", T.StringType()),
    T.StructField("quantity_sold", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("discount_rate", T.DoubleType()),
    T.StructField("sales_amount", T.DoubleType()),
    T.StructField("gross_amount", T.DoubleType()),
    T.StructField("cost_amount", T.DoubleType()),
    T.StructField("profit_amount", T.DoubleType()),
    T.StructField("payment", T.StringType()),
    T.StructField("cashier_id", T.StringType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("expiration_date", T.DateType()),
    T.StructField("row_hash", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
])

CATALOGUE = T.StructType([
    T.StructField("product_name", T.StringType()),
    T.StructField("tab", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("barcode", T.StringType()),
    T.StructField("sku_number", T.StringType()),
    T.StructField("position", T.LongType()),
])

# Which months of the fact table a run wrote; what is not listed is not read.
FACT_MONTHS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("rows", T.LongType()),
])

# Which months of staging a run wrote, and the level of its key filter there. Every run has a row without a month.
STAGED_MONTHS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("level", T.IntegerType()),
])

# Words of the filters of stored row keys.
KEY_WORDS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("slot", T.LongType()),
    T.StructField("bits", T.LongType()),
])

# The run that loads a micro-batch, and the files of the batch.
BATCHES = T.StructType([
    T.StructField("stream", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("status", T.StringType()),
])

BATCH_FILES = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("run_id", T.StringType()),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("rows_in", T.LongType()),
    T.StructField("rows_cleaned", T.LongType()),
    T.StructField("rows_out", T.LongType()),
    T.StructField("rows_removed", T.LongType()),
    T.StructField("removed_breakdown", T.StringType()),
    T.StructField("notes", T.StringType()),
])
