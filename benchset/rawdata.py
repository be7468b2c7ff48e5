"""Sales data derived from the supplied tables by SQL that both engines run.

The supplied tables are clean, so each kind of dirt is placed by integer arithmetic on the
keys. Amounts are rendered from whole cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillflow.session import keep_compiled

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; one stored in fewer pieces than there are cores is spread over them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in SPREAD and len(rows.inputFiles()) < cores else rows


#: Tables that derived inputs are computed from, row by row.
SPREAD = {"lineitem"}


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run portable SQL with the supplied tables in place of ``{name}``."""
    keep_compiled(spark)
    used = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """The same SQL for an engine in which the tables are views of those names."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


def half(value: str, divisor: int) -> str:
    """Whole-number division, written so that both engines agree."""
    return f"CAST(floor(({value}) / {divisor}) AS BIGINT)"


def text(value: str) -> str:
    return f"CAST({value} AS STRING)"


def cents_text(cents: str, point: str = ".") -> str:
    """Digits of whole cents with a point before the last two."""
    digits = f"lpad({text(cents)}, CAST(greatest(3, length({text(cents)})) AS INT), '0')"
    return f"left({digits}, length({digits}) - 2) || '{point}' || right({digits}, 2)"


def grouped_text(cents: str, comma: str = ",", point: str = ".") -> str:
    """With a thousands separator; amounts stay below a million."""
    shown = cents_text(cents, point)
    return (
        f"CASE WHEN ({cents}) >= 100000 THEN left({text(cents)}, length({text(cents)}) - 5) || '{comma}' "
        f"|| right({shown}, 6) ELSE {shown} END"
    )


def spark_cents_text(cents: str, point: str = ".") -> str:
    """As :func:`cents_text`, for any whole number, from one division instead of repeated padding and cutting."""
    return (
        f"CASE WHEN ({cents}) > -100 AND ({cents}) < -9 THEN '-{point}' || {text(f'0 - ({cents})')} "
        f"WHEN ({cents}) > -10 AND ({cents}) < 0 THEN '0{point}' || {text(cents)} "
        f"ELSE {text(f'({cents}) div 100')} || '{point}' || {_digits(f'abs(({cents}) % 100)', 2)} END"
    )


def spark_grouped_text(cents: str, comma: str = ",", point: str = ".") -> str:
    """As :func:`grouped_text`; of an amount of a million or more all digits before the last five stand together too."""
    return (
        f"CASE WHEN ({cents}) >= 100000 THEN {text(f'({cents}) div 100000')} || '{comma}' || "
        f"{_digits(f'({cents}) % 100000 div 100', 3)} || '{point}' || {_digits(f'({cents}) % 100', 2)} "
        f"ELSE {spark_cents_text(cents, point)} END"
    )


def _digits(value: str, n: int) -> str:
    """A whole number from 0 on as text of exactly ``n`` digits."""
    return f"substr({text(f'{value} + {10 ** n}')}, 2, {n})"


def date_text(stamp: str, shape: str = "iso") -> str:
    y, m, d = (text(f"{part}({stamp})") for part in ("year", "month", "day"))
    if shape == "iso":
        return f"{y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"
    if shape == "us":
        return f"{m} || '/' || {d} || '/' || {y}"
    if shape == "us-dash":
        return f"{m} || '-' || {d} || '-' || {y}"
    return f"{m} || '/' || {d} || '/' || right({y}, 2)"


BASE = f"""
SELECT l_orderkey AS o, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS n, l_suppkey AS s,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
       CAST(round(l_discount * 100) AS BIGINT) AS rate,
       CAST(l_quantity AS BIGINT) AS q, l_returnflag AS rf, l_shipdate AS d, p_name AS name,
       l_orderkey * 7 + l_partkey * 3 + l_linenumber AS k
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
"""

PRICED = f"""
SELECT *, {half('cents * rate', 100)} AS off, {half('cents * 7', 10)} AS cost_cents,
       ((o * 8 + n) * 16777216 + cents) * 2 AS line
FROM ({BASE}) b
"""

# Text of an amount in the many ways reports write one.
MONEY_TEXT = f"""
SELECT line, CASE CAST(k % 15 AS INT)
  WHEN 0 THEN {cents_text('cents')}
  WHEN 1 THEN '$' || {grouped_text('cents')}
  WHEN 2 THEN {grouped_text('cents', '.', ',')}
  WHEN 3 THEN {cents_text('cents')} || '-'
  WHEN 4 THEN {cents_text('cents')} || ' CR'
  WHEN 5 THEN {cents_text('cents')} || ' dr'
  WHEN 6 THEN '(' || {grouped_text('cents')} || ')'
  WHEN 7 THEN '1.' || lpad({text('p % 1000')}, 3, '0') || '.' || lpad({text('o % 1000')}, 3, '0') || ',89'
  WHEN 8 THEN '1,' || lpad({text('p % 1000')}, 3, '0') || ',' || lpad({text('o % 1000')}, 3, '0') || '.89'
  WHEN 9 THEN {cents_text('cents', ',')}
  WHEN 10 THEN '1,' || lpad({text('p % 1000')}, 3, '0') || ',' || lpad({text('o % 1000')}, 3, '0')
  WHEN 11 THEN '  PHP ' || {cents_text('cents')} || ' '
  WHEN 12 THEN 'abc'
  WHEN 13 THEN '-' || {text('q')} || ' CR'
  ELSE '.5' END AS amount
FROM ({PRICED}) x
"""


def _raw(cents_text=cents_text, grouped_text=grouped_text) -> str:
    empty = "k % 89 = 0"
    hollow = "k % 79 = 0"
    zero = "(k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0)"
    net = "(cents - off)"
    profit = "(cents - off - cost_cents)"
    cells = {
        "date": f"""CASE WHEN {empty} THEN '' WHEN k % 50 = 8 THEN '13/45/2023' WHEN k % 50 = 18 THEN '1970-01-01'
            WHEN k % 50 = 28 THEN '' WHEN k % 10 = 6 THEN {date_text('d', 'us')}
            WHEN k % 10 = 7 THEN {date_text('d', 'short')} WHEN k % 10 = 9 THEN {date_text('d')} || ' 14:30:00'
            ELSE {date_text('d')} END""",
        "receipt": f"""CASE WHEN {empty} THEN '' WHEN k % 97 = 0 THEN 'GRAND TOTAL' WHEN k % 4 = 0 THEN ''
            WHEN k % 23 = 0 THEN 'NaN' ELSE 'R' || {text('o')} END""",
        "so": f"CASE WHEN {empty} OR k % 6 = 0 THEN '' ELSE ' SO' || {text('s')} END",
        "item_code": f"""CASE WHEN {empty} OR {hollow} OR k % 29 = 0 THEN '' WHEN k % 31 = 0 THEN 'Account : ' || {text('o')}
            WHEN k % 37 = 0 THEN 'disc' ELSE ' ' || lpad({text('p')}, 8, '0') END""",
        "description": f"""CASE WHEN {empty} OR {hollow} OR k % 43 = 0 THEN '' WHEN k % 101 = 0 THEN name || ' Total: '
            WHEN k % 67 = 0 THEN name || chr(10) || '5" wide, ' || chr(10) || chr(10) || 'blue'
            WHEN k % 41 = 0 THEN 'Senior discount' WHEN k % 47 = 0 THEN name || ' refund'
            WHEN k % 59 = 0 THEN name || ' EXP 2011-01-01' WHEN k % 8 = 0 THEN name || ' #EXP2024-11-01'
            WHEN k % 8 = 1 THEN name || ' 195ml' WHEN k % 8 = 2 THEN upper(name) || '  exp: 3/15/2026'
            WHEN k % 8 = 3 THEN name || ' 12/31/25 BB' WHEN k % 8 = 4 THEN name || ' tablet (white)'
            WHEN k % 8 = 5 THEN name || ' 2 boxes 2027-02-03' ELSE name END""",
        "qty": f"""CASE WHEN {empty} OR {hollow} OR k % 61 = 0 THEN '' WHEN k % 31 = 0 THEN '0'
            WHEN rf = 'R' THEN '-' || {text('q')} ELSE {text('q')} END""",
        "discount": f"CASE WHEN {empty} OR off = 0 THEN '' ELSE {cents_text('off')} END",
        "sales": f"""CASE WHEN {empty} OR {hollow} THEN '' WHEN {zero} THEN '0.00' WHEN k % 9 = 1 THEN '$' || {grouped_text(net)}
            WHEN k % 9 = 2 THEN {grouped_text(net, '.', ',')} WHEN k % 9 = 3 THEN '(' || {cents_text(net)} || ')'
            WHEN k % 9 = 4 THEN {cents_text(net, ',')} WHEN k % 81 = 5 THEN 'abc' ELSE {cents_text(net)} END""",
        "cost": f"""CASE WHEN {empty} OR {hollow} THEN '' WHEN {zero} THEN '0' WHEN k % 7 = 0 THEN '$' || {cents_text('cost_cents')}
            ELSE {cents_text('cost_cents')} END""",
        "profit": f"""CASE WHEN {empty} OR {hollow} OR k % 5 = 0 THEN '' WHEN {zero} THEN '0' WHEN {profit} < 0 THEN
            '-' || {cents_text(f'(0 - {profit})')} ELSE {cents_text(profit)} END""",
        "payment": f"""CASE WHEN {empty} THEN '' WHEN o % 4 = 0 THEN 'Cash' WHEN o % 4 = 1 THEN ' Card' WHEN o % 4 = 2 THEN 'None'
            ELSE 'GCash' END""",
        "cashier_id": f"CASE WHEN {empty} THEN '' ELSE 'C' || {text('o % 17')} END",
    }
    columns = ", ".join(f"{sql} AS {name}" for name, sql in cells.items())
    place = f"'f' || {text(half('o', 2500))} AS file, {half('o', 500)} AS chunk"
    rows = f"SELECT {place}, line AS row_index, k, {columns} FROM ({PRICED}) x"
    names = ", ".join(cells)
    return f"""
    SELECT file, chunk, row_index, {names} FROM ({rows}) a
    UNION ALL
    SELECT file, chunk, row_index + 1, {names} FROM ({rows}) a WHERE k % 53 = 0
    """


# The twelve cells of every report line, with file, chunk and order.
RAW = _raw()
# The same cells for Spark, whose amounts are rendered with fewer steps; only how they are built differs.
SPARK_RAW = _raw(spark_cents_text, spark_grouped_text)

# Staged lines of two runs, as the loader leaves them.
STAGED = f"""
SELECT CASE WHEN o % 2 = 0 THEN 'run-a' ELSE 'run-b' END AS run_id,
       CASE WHEN k % 50 = 0 THEN NULL ELSE CAST(d AS DATE) END AS date,
       'R' || {text('o')} AS receipt, 'SO' || {text('s')} AS so,
       CASE WHEN k % 29 = 0 THEN NULL ELSE lpad({text('p')}, 8, '0') END AS item_code,
       CASE WHEN k % 8 = 1 THEN '' WHEN k % 8 = 2 THEN NULL ELSE name END AS description,
       CASE WHEN k % 3 = 0 THEN CAST('2026-03-15' AS DATE) ELSE NULL END AS expiration_date,
       CASE WHEN k % 61 = 0 THEN 0.0 WHEN rf = 'R' THEN CAST(0 - q AS DOUBLE) ELSE CAST(q AS DOUBLE) END AS qty,
       CASE WHEN k % 4 = 0 THEN 'box' ELSE 'pcs' END AS unit,
       CASE WHEN off = 0 THEN NULL ELSE CAST(off AS DOUBLE) / 100 END AS discount,
       CASE WHEN k % 71 = 0 THEN NULL ELSE CAST(cents - off AS DOUBLE) / 100 END AS sales,
       CAST(cost_cents AS DOUBLE) / 100 AS cost,
       CAST(cents - off - cost_cents AS DOUBLE) / 100 AS profit,
       CASE WHEN o % 3 = 0 THEN 'Cash' ELSE 'Card' END AS payment, 'C' || {text('o % 17')} AS cashier_id,
       CASE WHEN k % 13 = 0 THEN NULL WHEN rf = 'R' THEN 'RETURN' ELSE 'SALE' END AS txn_type,
       CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN NULL ELSE 'cat' || {text('p % 9')} END AS category,
       CASE WHEN k % 4 = 0 THEN NULL ELSE 'tab' || {text('p % 5')} END AS tab,
       md5({text('line')}) AS row_hash
FROM ({PRICED}) x
"""

# The product catalogue: repeated barcodes, missing categories and tabs.
CATALOGUE = f"""
SELECT p_name AS product_name,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS tab,
       CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN ' ' || p_type ELSE p_type END AS category,
       CASE WHEN p_partkey % 17 = 0 THEN NULL
            ELSE ' ' || lpad({text(f"CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 1 ELSE p_partkey END")}, 8, '0') END AS barcode,
       'SKU' || {text('p_partkey')} AS sku_number, p_partkey AS position
FROM {{part}}
"""

# The product dimension before the run: older dates, missing values.
PRODUCTS = f"""
SELECT p_partkey + 1 AS product_key, lpad({text('p_partkey')}, 8, '0') AS item_code,
       CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN p_name || ' old' ELSE p_name END AS description,
       CAST('pcs' AS STRING) AS unit,
       CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN NULL ELSE p_type END AS category,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS tab,
       CAST('1996-06-01' AS DATE) AS first_seen_date, CAST('1999-06-01' AS DATE) AS last_seen_date
FROM {{part}}
"""

# The same with two of three products, for what lines without a product and products without a key become.
SOME_PRODUCTS = f"{PRODUCTS} WHERE p_partkey % 3 <> 2"

# Names to look up: plain, misspelt, extended and unknown ones.
PROBES = """
SELECT DISTINCT CASE CAST((l_orderkey + l_partkey) % 6 AS INT)
  WHEN 0 THEN p_name
  WHEN 1 THEN replace(p_name, 'l', 'll') || ' 20s'
  WHEN 2 THEN replace(replace(p_name, 'i', 'e'), 'o', 'u')
  WHEN 3 THEN p_name || ' ' || lower(p_type)
  WHEN 4 THEN reverse(p_name)
  ELSE lower(p_type) || ' ' || lower(o_orderpriority) END AS name
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey
"""

PURCHASES = """
SELECT o_orderkey AS id, o_totalprice AS price, o_orderdate AS date,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'refunded' END AS status
FROM {orders}
"""

INVENTORY = """
SELECT p_partkey AS product, p_name AS name, (p_partkey * 7) % 60 AS stock, CAST(p_size AS BIGINT) AS min_stock
FROM {part}
"""
