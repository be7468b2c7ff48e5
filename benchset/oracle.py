"""SQL each query is checked against, written for DuckDB and apart from the library's expressions."""

from __future__ import annotations

from benchset import queries as Q
from benchset import rawdata as R
# The SQL is its own; only the fixed values are those of the library.
from tillflow.functions.dates import EXPIRY_PATTERNS, EXPIRY_RESIDUE
from tillflow.functions.text import CSV_NA_TOKENS, NULL_TOKENS
from tillflow.functions.txn import ADJUSTMENT_WORDS, RETURN_WORDS
from tillflow.functions.units import DESCRIPTION_UNITS, PIECE_FORMS, UNIT_ALIASES, UNIT_PATTERNS
from tillflow.operators.rules import ADJUSTMENT_CODES, ADJUSTMENT_TEXT

ORACLE: dict[str, str] = {}

RAW = R.duck(R.RAW)
STAGED = R.duck(R.STAGED)
CATALOGUE = R.duck(R.CATALOGUE)
PRODUCTS = R.duck(R.PRODUCTS)
SOME_PRODUCTS = R.duck(R.SOME_PRODUCTS)
MONEY = R.duck(R.MONEY_TEXT)
PURCHASES = R.duck(R.PURCHASES)
INVENTORY = R.duck(R.INVENTORY)

NULLS = "(" + ", ".join(f"'{t}'" for t in NULL_TOKENS) + ")"
CSV_NULLS = "(" + ", ".join(f"'{t}'" for t in CSV_NA_TOKENS) + ")"


def strip(x):
    return f"trim({x}, E' \\t\\n\\r')"


def clean(x):
    return f"CASE WHEN {strip(x)} NOT IN {NULLS} THEN {strip(x)} END"


def point(x):
    """Digits with one decimal point: the last separator is the mark."""
    return f"CASE WHEN regexp_matches({x}, ',[^.]*$') THEN replace(replace({x}, '.', ''), ',', '.') ELSE replace({x}, ',', '') END"


def number(x):
    return f"TRY_CAST({point(x)} AS DOUBLE)"


def brackets(x):
    return f"regexp_replace({x}, '^\\(([^)]+)\\)$', '-\\1')"


def numeric(x, paren=True):
    bare = f"regexp_replace({brackets(strip(x)) if paren else x}, '^[$()]+|[$()]+$', '', 'g')"
    return number(f"regexp_replace({bare}, '[^0-9,.\\-]', '', 'g')")


def money_steps(x, name, paren=True, thousands=False):
    """Select items that end in ``name``, each building on the one before."""
    start = brackets(strip(x)) if paren else strip(x)
    value = number(f"{name}_d")
    if thousands:
        value = f"CASE WHEN regexp_full_match({name}_d, '-?\\d{{1,3}}(,\\d{{3}})+') THEN TRY_CAST(replace({name}_d, ',', '') AS DOUBLE) ELSE {value} END"
    return f"""regexp_replace({start}, '^\\s*([0-9.,]+)\\s*-\\s*$', '-\\1') AS {name}_a,
      {strip(f"regexp_replace({name}_a, '(?i)\\b[cd]r\\b', '', 'g')")} AS {name}_b,
      CASE WHEN regexp_matches({name}_a, '(?i)\\bcr\\b') THEN '-' || {name}_b ELSE {name}_b END AS {name}_c,
      regexp_replace({name}_c, '[^0-9,.\\-]', '', 'g') AS {name}_d,
      {value} AS {name}"""


def plain(x):
    return f"CASE WHEN regexp_full_match({x}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN TRY_CAST({x} AS DOUBLE) END"


def number_text(x):
    return f"CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def moment(x):
    """The date shapes the derived data has."""
    t = strip(x)
    return f"""CASE
      WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime({t}, '%Y-%m-%d')
      WHEN regexp_full_match({t}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime({t}, '%m/%d/%Y')
      WHEN regexp_full_match({t}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN try_strptime({t}, '%m-%d-%Y')
      WHEN regexp_full_match({t}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}') THEN try_strptime({t}, '%m/%d/%y')
      WHEN regexp_full_match({t}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{2}}') THEN try_strptime({t}, '%m-%d-%y')
      WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}} \\d{{1,2}}:\\d{{2}}:\\d{{2}}') THEN try_strptime({t}, '%Y-%m-%d %H:%M:%S')
    END"""


def day(x):
    return f"NULLIF({moment(x)}, TIMESTAMP '1970-01-01 00:00:00')"


def expiry_steps(x):
    """Select items that end in ``expiry`` and ``bare``."""
    items = []
    for i, pattern in enumerate(EXPIRY_PATTERNS):
        found = f"regexp_extract({x}, '(?i){pattern}', 1)"
        items.append(f"CAST({moment(found)} AS DATE) AS day{i}")
        items.append(f"CASE WHEN year(day{i}) BETWEEN 2020 AND 2045 THEN day{i} END AS ok{i}")
    whens = " ".join(f"WHEN ok{i} IS NOT NULL THEN regexp_replace({x}, '(?i){p}', '', 'g')" for i, p in enumerate(EXPIRY_PATTERNS))
    items.append(f"CASE {whens} ELSE {x} END AS cut")
    left = "cut"
    for p in EXPIRY_RESIDUE:
        left = f"regexp_replace({left}, '(?i){p}', '', 'g')"
    items.append(f"trim(regexp_replace({left}, '\\s+', ' ', 'g'), ' ,-#:()') AS tidied")
    items.append("COALESCE(ok0, ok1, ok2, ok3) AS expiry")
    items.append(f"CASE WHEN {x} IS NULL OR {strip(x)} = '' OR tidied = '' THEN {x} ELSE tidied END AS bare")
    return ", ".join(items)


def basic(x):
    spaces = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
    dropped = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g')"
    return f"trim(regexp_replace({dropped}, '{spaces}', ' ', 'g'))"


def improved(x):
    t = f"lower(COALESCE({x}, ''))"
    for p in ["\\([^)]*\\)", "\\[[^\\]]*\\]", "\\{[^\\}]*\\}", "#exp[0-9-]*", "exp[0-9-]*", "#[a-z0-9-]+"]:
        t = f"regexp_replace({t}, '{p}', '', 'g')"
    return basic(t)


def listed(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def canonical(x, forms=True):
    t = f"lower({strip(x)})"
    first = f"WHEN {t} IN {listed(PIECE_FORMS)} THEN 'pcs' " if forms else ""
    exact = " ".join(f"WHEN {t} IN {listed(w)} THEN '{u}'" for u, w in UNIT_ALIASES.items())
    loose = " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{u}'" for p, u in UNIT_PATTERNS)
    return f"CASE {first}{exact} {loose} END"


def unit_word(x):
    found = f"regexp_extract({x}, '(?i)(?:^|[^A-Za-z])({'|'.join(DESCRIPTION_UNITS)})(?:$|[^A-Za-z])', 1)"
    return f"NULLIF({found}, '')"


# ------------------------------------------------------------ the cleaning chain as CTEs

CELLS = ["date", "receipt", "so", "item_code", "description", "qty", "discount", "sales", "cost", "profit", "payment", "cashier_id"]
_missing = ", ".join(f"CASE WHEN {c} NOT IN {CSV_NULLS} THEN {c} END AS {c}" for c in CELLS)
_typed = ", ".join(f"{numeric(c)} AS {c}" for c in ("qty", "discount", "sales", "cost", "profit"))

CHAIN = f"""
raw AS ({RAW}),
cells AS (SELECT file, chunk, row_index, concat_ws(',', {', '.join(CELLS)}) AS raw_text, {_missing} FROM raw),
found AS (SELECT *, {expiry_steps('description')} FROM cells),
typed AS (
  SELECT file, chunk, row_index,
    CASE WHEN contains(lower(raw_text), 'grand total') THEN 'grand total' WHEN contains(lower(raw_text), 'total:') THEN 'total:'
         WHEN contains(lower(raw_text), 'subtotal') THEN 'subtotal' END AS summary,
    COALESCE({', '.join(CELLS)}) IS NULL AS row_is_empty,
    {improved('description')} AS match_name, {day('date')} AS date, expiry AS expiration_date,
    {', '.join(f'{clean(c)} AS {c}' for c in ('receipt', 'so', 'payment', 'cashier_id'))},
    upper({clean('item_code')}) AS item_code, {clean('bare')} AS description, {_typed},
    {plain('qty')} AS plain_qty, {canonical(unit_word('bare'))} AS unit_found
  FROM found),
vals AS (
  SELECT * REPLACE (COALESCE(profit, sales - cost) AS profit),
    COALESCE(unit_found, CASE WHEN plain_qty IS NOT NULL THEN 'pcs' END) AS unit
  FROM typed),
labelled AS (
  SELECT *, COALESCE(sales, 0) = 0 AND COALESCE(cost, 0) = 0 AND COALESCE(profit, 0) = 0 AS no_money,
    CASE
      WHEN summary IS NOT NULL THEN 'summary/total row matched ''' || summary || ''''
      WHEN row_is_empty THEN 'completely empty row'
      WHEN NOT no_money AND (item_code IS NULL OR lower(item_code) IN ('', 'nan', 'none', 'null')
                             OR description IS NULL OR lower(description) IN ('', 'nan', 'none', 'null'))
        THEN 'financial data present but missing supporting fields'
      WHEN item_code IS NULL AND description IS NULL AND qty IS NULL AND sales IS NULL AND cost IS NULL THEN 'all important fields empty'
      WHEN COALESCE(qty, 0) = 0 AND no_money AND ((item_code IS NOT NULL AND NOT regexp_full_match(item_code, '\\d+')) OR description IS NULL)
        THEN 'placeholder/non-item row (e.g., header like "Account : ...")'
      WHEN no_money AND (COALESCE(regexp_matches(lower(description), '{ADJUSTMENT_TEXT}'), FALSE)
                         OR COALESCE(lower(item_code) IN {listed(ADJUSTMENT_CODES)}, FALSE))
        THEN 'non-item adjustment (e.g., Sales Discount/VOID/rounding)'
    END AS error_reason,
    CASE WHEN summary IS NOT NULL OR row_is_empty THEN 'pre-map'
         WHEN error_reason IS NOT NULL THEN 'remove_incomplete_rows' END AS error_stage
  FROM vals),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file, error_reason IS NULL, date, receipt, so, item_code, qty, sales, cost
                               ORDER BY row_index) AS nth
  FROM labelled),
final AS (
  SELECT * REPLACE (
      CASE WHEN error_reason IS NULL AND nth > 1 THEN 'duplicates' ELSE error_stage END AS error_stage,
      CASE WHEN error_reason IS NULL AND nth > 1 THEN 'duplicate row' ELSE error_reason END AS error_reason)
  FROM ranked),
filled AS (
  SELECT * REPLACE (
      last_value(receipt IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_index) AS receipt,
      last_value(so IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_index) AS so)
  FROM final WHERE error_reason IS NULL),
lines AS (
  SELECT *,
    sha256(concat_ws('|', COALESCE(CASE WHEN CAST(date AS TIME) = TIME '00:00:00' THEN strftime(date, '%Y-%m-%d')
                                        ELSE strftime(date, '%Y-%m-%dT%H:%M:%S') END, ''),
      COALESCE(receipt, ''), COALESCE(so, ''), COALESCE(item_code, ''),
      {', '.join(f"COALESCE({number_text(c)}, '')" for c in ('qty', 'sales', 'cost'))})) AS row_hash,
    CASE WHEN regexp_matches(lower(COALESCE(description, '')), '{ADJUSTMENT_WORDS}') THEN 'ADJUSTMENT'
         WHEN qty < 0 OR regexp_matches(lower(COALESCE(description, '')), '{RETURN_WORDS}') THEN 'RETURN' ELSE 'SALE' END AS txn_type
  FROM filled),
staged AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY row_hash ORDER BY file, chunk, row_index) = 1)
"""

BARCODES = f"""
entries AS (SELECT * FROM ({CATALOGUE})),
coded AS (SELECT upper(trim(barcode)) AS barcode, category, tab, position FROM entries WHERE barcode IS NOT NULL),
barcodes AS (SELECT barcode, trim(arg_max(category, position) FILTER (WHERE category IS NOT NULL)) AS category,
                    trim(arg_max(tab, position) FILTER (WHERE tab IS NOT NULL)) AS tab FROM coded GROUP BY barcode),
names AS (SELECT {improved('product_name')} AS name, trim(arg_max(category, position)) AS category,
                 trim(arg_max(tab, position)) AS tab, min(position) AS position
          FROM entries WHERE category IS NOT NULL AND tab IS NOT NULL GROUP BY 1)
"""


def lcs(a, b):
    """Length of the longest common subsequence, one row of the table per character of ``a``."""
    chars = f"list_transform(string_split({a}, ''), lambda ch: [unicode(ch)])"
    codes = f"list_transform(string_split({b}, ''), lambda ch: unicode(ch))"
    width = f"length({b})"
    start = f"[list_transform(range({width} + 1), lambda i: 0)]"
    best = "greatest(acc[j + 1], CASE WHEN j > 0 AND codes[j] = x[1] THEN acc[j] + 1 ELSE 0 END)"
    row = f"list_transform(range({width} + 1), lambda j: {best.replace('codes', f'({codes})')})"
    running = f"list_transform(range({width} + 1), lambda m: list_max(list_slice({row}, 1, m + 1)))"
    return f"list_max(list_reduce(list_concat({start}, {chars}), lambda acc, x: {running}))"


PROBES = f"probes AS (SELECT DISTINCT {improved('name')} AS name FROM ({R.duck(R.PROBES)}) WHERE {improved('name')} <> '')"


def scored(left, right):
    """Pairs of a probe name and a catalogue name with their similarity, above the threshold."""
    return f"""
    pairs AS (SELECT a.name, b.name AS match, b.position FROM {left} a, {right} b),
    scored AS (SELECT *, 2.0 * {lcs('name', 'match')} / (length(name) + length(match)) AS score FROM pairs
               WHERE 2.0 * least(length(name), length(match)) > 0.7 * (length(name) + length(match))),
    alike AS (SELECT *, CAST(score AS DOUBLE) AS s FROM scored WHERE score > 0.7)
    """


KEYS = "keys AS (SELECT item_code, match_name AS name, count(*) AS lines FROM typed GROUP BY 1, 2)"
PRODUCT_MATCH = f"""
exact AS (SELECT k.*, b.category AS bc, b.tab AS bt, n.category AS nc, n.tab AS nt, n.name IS NOT NULL AS named
          FROM keys k LEFT JOIN barcodes b ON b.barcode = upper(trim(k.item_code)) LEFT JOIN names n ON n.name = k.name),
open AS (SELECT DISTINCT name FROM exact WHERE (COALESCE(bc, nc) IS NULL OR COALESCE(bt, nt) IS NULL) AND NOT named AND name <> ''),
{scored('open', 'names')},
best AS (SELECT name, arg_max(match, (s, -position)) AS match FROM alike GROUP BY name),
opened AS (SELECT e.*, CASE WHEN (COALESCE(bc, nc) IS NULL OR COALESCE(bt, nt) IS NULL) AND NOT named THEN e.name END AS open_name FROM exact e),
matched AS (
  SELECT o.item_code, o.name, o.lines, COALESCE(bc, nc, n.category) AS category, COALESCE(bt, nt, n.tab) AS tab,
         CASE WHEN bc IS NOT NULL OR bt IS NOT NULL THEN 'barcode' WHEN named THEN 'name'
              WHEN b.match IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method
  FROM opened o LEFT JOIN best b ON b.name = o.open_name LEFT JOIN names n ON n.name = b.match)
"""

TOP_PRODUCTS = f"""
rows_named AS (SELECT *, {improved('product_name')} AS match FROM entries),
firsts AS (SELECT match AS name, min(position) AS position FROM rows_named WHERE match <> '' GROUP BY 1)
"""

ORACLE["money_parse"] = f"""
SELECT line, amount, {money_steps('amount', 'value')}, {money_steps('amount', 'no_brackets', paren=False)},
       {money_steps('amount', 'thousands', thousands=True)} FROM ({MONEY})"""
ORACLE["money_parse"] = f"SELECT line, amount, value, no_brackets, thousands FROM ({ORACLE['money_parse']})"
ORACLE["numeric_clean"] = f"""
SELECT line, {numeric('amount')} AS value, {numeric('amount', paren=False)} AS no_brackets,
       TRY_CAST(regexp_replace(amount, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS strict, {plain('amount')} AS plain FROM ({MONEY})"""
ORACLE["date_clean"] = f"""
SELECT row_index, date AS date_text, CAST(m AS DATE) AS day, strftime(m, '%H:%M:%S') AS time
FROM (SELECT *, {day('date')} AS m FROM ({RAW}))"""


def _expiry_normalize():
    shown = {s: R.date_text("o_orderdate", s) for s in ("iso", "us", "us-dash", "short")}
    m = moment("expiry_text")
    return f"""
    SELECT o_orderkey, CASE WHEN year(m) BETWEEN 2020 AND 2045 THEN m END AS in_range,
           CASE WHEN year(m) BETWEEN 1998 AND 2045 THEN m END AS from_1998,
           COALESCE(strftime(m, '%Y-%m-%d'), expiry_text) AS lenient
    FROM (SELECT *, CAST({m} AS DATE) AS m FROM (
      SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN {shown['iso']} WHEN 1 THEN {shown['us']}
        WHEN 2 THEN {shown['us-dash']} WHEN 3 THEN {shown['short']} ELSE 'soon' END AS expiry_text FROM orders))"""


ORACLE["expiry_normalize"] = _expiry_normalize()
ORACLE["expiry_extract"] = f"""
SELECT row_index, description AS raw_description, expiry, bare
FROM (SELECT row_index, description, {expiry_steps('description')} FROM ({RAW}))"""
ORACLE["text_clean"] = f"""
SELECT row_index, {', '.join(f'{clean(c)} AS {c}' for c in ('receipt', 'so', 'payment', 'cashier_id'))},
  upper({clean('item_code')}) AS item_code, lower({clean('payment')}) AS lowered,
  NULLIF(upper({strip('item_code')}), '') AS barcode, NULLIF({strip('description')}, '') AS description FROM ({RAW})"""
ORACLE["name_normalize"] = f"""
SELECT {basic("lower(COALESCE(t, ''))")} AS basic, {improved('t')} AS improved FROM (
  SELECT concat_ws(' ', p_name, '(New)', p_type, '#EXP2024-11-01', p_brand) AS t FROM part UNION ALL SELECT text FROM documents)"""
UNIT = R.duck(Q.UNIT_TEXT)
ORACLE["unit_canonical"] = f"""
SELECT p_partkey, {canonical('unit_text')} AS unit, {canonical('unit_text', forms=False)} AS strict_unit,
       {strip('unit_text')} NOT IN ('', 'nan', 'None', 'NULL') AS is_given FROM ({UNIT})"""
ORACLE["unit_scale"] = f"""
SELECT p_partkey, COALESCE(CASE u WHEN 'g' THEN 'kg' WHEN 'ml' THEN 'l' ELSE u END, CASE WHEN n IS NOT NULL THEN 'pcs' END) AS unit,
       CASE WHEN u IN ('g', 'ml') THEN n / 1000.0 ELSE {numeric('qty_text')} END AS qty
FROM (SELECT *, {canonical('unit_text')} AS u, {plain('qty_text')} AS n FROM ({UNIT}))"""
ORACLE["unit_infer"] = f"""
SELECT row_index, lower(w) AS word, {canonical('w')} AS unit FROM (SELECT row_index, {unit_word('description')} AS w FROM ({RAW}))"""
ORACLE["profit_fill"] = f"""
SELECT row_index, round(COALESCE({numeric('profit')}, {numeric('sales')} - {numeric('cost')}), 4) AS profit FROM ({RAW})"""
ORACLE["txn_type"] = f"""
SELECT row_index, CASE WHEN regexp_matches(lower(COALESCE(description, '')), '{ADJUSTMENT_WORDS}') THEN 'ADJUSTMENT'
  WHEN {numeric('qty')} < 0 OR regexp_matches(lower(COALESCE(description, '')), '{RETURN_WORDS}') THEN 'RETURN'
  ELSE 'SALE' END AS txn_type FROM ({RAW})"""
ORACLE["row_key"] = f"""
WITH {CHAIN}
SELECT row_index, sha256(concat_ws('|', COALESCE(CASE WHEN CAST(date AS TIME) = TIME '00:00:00' THEN strftime(date, '%Y-%m-%d')
    ELSE strftime(date, '%Y-%m-%dT%H:%M:%S') END, ''), COALESCE(receipt, ''), COALESCE(so, ''), COALESCE(item_code, ''),
    {', '.join(f"COALESCE({number_text(c)}, '')" for c in ('qty', 'sales', 'cost'))})) AS row_hash
FROM typed"""
ORACLE["contains_search"] = "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%'"

RECOVERY = R.duck(Q.RECOVERY)
ORACLE["sales_recovery"] = f"""
WITH base AS (SELECT file, row_index, receipt, payment, {plain('sales')} AS plain_sales, {numeric('sales')} AS sales_value,
    {money_steps('sales', 'lit0')}, {money_steps('net_sales', 'lit1')}, {money_steps('ext_a', 'oth0')}, {money_steps('ext_b', 'oth1')},
    {money_steps('payment', 'pay')} FROM ({RECOVERY})),
nonzero AS (SELECT file, {', '.join(f'count(*) FILTER (WHERE abs({c}) > 1e-9) AS z_{c}' for c in ('plain_sales', 'lit0', 'lit1', 'oth0', 'oth1', 'pay'))},
    count(oth0) AS n0, count(oth1) AS n1 FROM base GROUP BY file),
varies AS (SELECT file, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END) AS share
    FROM (SELECT file, receipt, count(DISTINCT payment) AS n FROM base GROUP BY ALL) GROUP BY file),
source AS (SELECT file, CASE WHEN z_plain_sales > 0 THEN 'sales' WHEN z_lit0 > 0 OR z_lit1 > 0 THEN 'literal'
    WHEN (CASE WHEN n1 > n0 THEN z_oth1 ELSE z_oth0 END) > 0 THEN 'other'
    WHEN z_pay > 0 AND share >= 0.30 THEN 'payment' ELSE 'none' END AS sales_source, z_lit0, n0, n1
    FROM nonzero JOIN varies USING (file))
SELECT row_index, file, sales_source, CASE sales_source WHEN 'literal' THEN CASE WHEN z_lit0 > 0 THEN lit0 ELSE lit1 END
    WHEN 'other' THEN CASE WHEN n1 > n0 THEN oth1 ELSE oth0 END WHEN 'payment' THEN pay ELSE sales_value END AS sales
FROM base JOIN source USING (file)"""
ORACLE["payment_variety"] = f"""
SELECT file, count(*) AS receipts, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END), 6) AS varying_share
FROM (SELECT file, receipt, count(DISTINCT payment) AS n FROM ({RECOVERY}) GROUP BY ALL) GROUP BY file"""
_five = ", ".join(f"CASE WHEN {c} NOT IN {CSV_NULLS} THEN {c} END" for c in ("item_code", "description", "qty", "sales", "cost"))
ORACLE["quality_gate"] = f"""
SELECT file, count(*) AS rows, count(*) FILTER (WHERE e) AS empty_rows, avg(CASE WHEN e THEN 1.0 ELSE 0.0 END) > 0.95 AS gate_fired
FROM (SELECT file || '-' || chunk AS file, COALESCE({_five}) IS NULL OR (chunk % 2 = 1 AND row_index % 25 <> 0) AS e FROM ({RAW})) GROUP BY 1"""
ORACLE["empty_columns"] = f"""
WITH r AS (SELECT file || '-' || chunk AS file, CASE WHEN chunk % 3 = 0 THEN 'NULL' ELSE payment END AS unit, discount FROM ({RAW}))
SELECT file, 'unit' AS "column", bool_and(trim(unit) IN ('', 'nan', 'None', 'NULL')) AS is_empty FROM r GROUP BY 1
UNION ALL SELECT file, 'discount', bool_and(trim(discount) IN ('', 'nan', 'None', 'NULL')) FROM r GROUP BY 1"""

ORACLE["reject_label"] = f"WITH {CHAIN} SELECT row_index, error_stage, error_reason FROM labelled"
ORACLE["reject_summary"] = f"""
WITH {CHAIN} SELECT file, error_stage AS stage, error_reason AS reason, count(*) AS count FROM labelled
WHERE error_reason IS NOT NULL GROUP BY ALL"""
ORACLE["error_breakdown"] = f"""
WITH {CHAIN},
counts AS (SELECT error_stage, error_reason, count(*) AS n FROM labelled WHERE error_reason IS NOT NULL GROUP BY ALL),
stages AS (SELECT error_stage, '{{' || string_agg(to_json(error_reason) || ':' || n, ',' ORDER BY error_reason) || '}}' AS j
           FROM counts GROUP BY 1)
SELECT '{{' || string_agg(to_json(error_stage) || ':' || j, ',' ORDER BY error_stage) || '}}' AS by_reason FROM stages"""
ORACLE["cleaning_summary"] = f"""
WITH {CHAIN} SELECT file, count(*) AS rows_before, count(error_reason) AS rows_removed, count(*) - count(error_reason) AS rows_after
FROM labelled GROUP BY 1"""
ORACLE["typing_profile"] = f"WITH {CHAIN} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS before, count({numeric(c) if c != 'date' else day(c)}) AS after FROM cells"
    for c in ("qty", "discount", "sales", "cost", "profit", "date"))
ORACLE["dedup_first"] = f"WITH {CHAIN} SELECT row_index, error_stage, error_reason, item_code, round(sales, 2) AS sales FROM final"
ORACLE["fill_down"] = f"""
SELECT row_index, last_value({clean('receipt')} IGNORE NULLS) OVER w AS receipt, last_value({clean('so')} IGNORE NULLS) OVER w AS so
FROM ({RAW}) WINDOW w AS (PARTITION BY file ORDER BY row_index)"""

HALVES = f"""lines AS ({STAGED}), stored AS (SELECT * FROM lines WHERE run_id = 'run-a' OR unit = 'box'),
batch AS (SELECT * FROM lines WHERE run_id = 'run-b')"""
ORACLE["skip_loaded"] = f"WITH {HALVES} SELECT row_hash, item_code, date FROM batch ANTI JOIN stored USING (row_hash)"
ORACLE["dup_log"] = f"""
WITH {HALVES} SELECT 'run-b' AS run_id, 'STAGING' AS error_stage, 'DUPLICATE_ROW' AS error_reason, date, receipt, so, item_code
FROM batch SEMI JOIN stored USING (row_hash)"""
ORACLE["batch_duplicates"] = f"""
WITH {HALVES}, twice AS (SELECT * FROM batch UNION ALL SELECT * FROM batch WHERE payment = 'Cash'),
marked AS (SELECT *, row_hash IN (SELECT row_hash FROM stored) OR row_number() OVER (PARTITION BY row_hash) > 1 AS is_duplicate FROM twice)
SELECT payment, is_duplicate, count(*) AS lines, count(DISTINCT row_hash) AS keys FROM marked GROUP BY ALL"""
ORACLE["union_runs"] = f"""
SELECT row_hash, run_id, CASE WHEN run_id = 'run-b' THEN category END AS category FROM ({STAGED})"""

ORACLE["catalog_last_wins"] = f"WITH {BARCODES} SELECT * FROM barcodes"
ORACLE["name_lookup"] = f"WITH {BARCODES} SELECT name, category, tab, position FROM names"
ORACLE["barcode_match"] = f"""
WITH {CHAIN}, {BARCODES} SELECT row_index, item_code, b.category AS barcode_category, b.tab AS barcode_tab
FROM typed LEFT JOIN barcodes b ON b.barcode = item_code"""
ORACLE["name_match"] = f"""
WITH {CHAIN}, {BARCODES} SELECT row_index, match_name AS name, n.category AS name_category, n.tab AS name_tab
FROM typed LEFT JOIN names n ON n.name = match_name"""
ORACLE["fuzzy_match"] = f"""
WITH {BARCODES}, {PROBES}, {scored('probes', 'names')}
SELECT name, arg_max(match, (s, -position)) AS match, round(max(s), 6) AS score FROM alike GROUP BY name"""
ORACLE["product_match"] = f"WITH {CHAIN}, {BARCODES}, {KEYS}, {PRODUCT_MATCH} SELECT * FROM matched"
ORACLE["match_stats"] = f"""
WITH {CHAIN}, {BARCODES}, {KEYS}, {PRODUCT_MATCH}
SELECT method, count(DISTINCT name) AS names, CAST(sum(lines) AS BIGINT) AS lines, (SELECT count(*) FROM names) AS catalogue_names,
       round(CAST(count(DISTINCT name) AS DOUBLE) / (SELECT count(*) FROM names), 4) AS coverage FROM matched GROUP BY method"""
ORACLE["token_blocking"] = f"""
WITH {BARCODES}, {PROBES},
pw AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS w FROM probes),
nw AS (SELECT DISTINCT name AS candidate, unnest(string_split(name, ' ')) AS w FROM names),
shared AS (SELECT DISTINCT name, candidate FROM pw JOIN nw USING (w) WHERE length(w) >= 3)
SELECT name, candidate FROM shared UNION ALL SELECT name, NULL FROM probes WHERE name NOT IN (SELECT name FROM shared)"""
ORACLE["similar_top5"] = f"""
WITH {BARCODES}, {PROBES}, {TOP_PRODUCTS}, {scored('probes', 'firsts')},
ranked AS (SELECT a.name, r.product_name, a.s, r.category, r.tab, r.position,
             row_number() OVER (PARTITION BY a.name ORDER BY a.s DESC, r.position) AS rank
           FROM alike a JOIN rows_named r ON r.match = a.match)
SELECT name, rank, product_name, round(s, 6) AS score, category, tab, position FROM ranked WHERE rank <= 5"""
_expand = f"""
{BARCODES}, {TOP_PRODUCTS}, wanted AS (SELECT DISTINCT item_code, description, {improved('description')} AS pname FROM ({PRODUCTS})
  WHERE COALESCE(category, '') = '' AND item_code <> '' AND description <> ''),
wnames AS (SELECT DISTINCT pname AS name FROM wanted WHERE pname <> ''), {scored('wnames', 'firsts')},
ranked AS (SELECT a.name, r.category, r.tab, row_number() OVER (PARTITION BY a.name ORDER BY a.s DESC, r.position) AS rank
           FROM alike a JOIN rows_named r ON r.match = a.match),
added AS (SELECT w.description AS product_name, r.tab, r.category, w.item_code AS barcode, 'AUTO-' || w.item_code AS sku_number
          FROM wanted w JOIN ranked r ON r.name = w.pname AND r.rank = 1)"""
ORACLE["catalog_expand"] = f"WITH {_expand} SELECT * FROM added"
ORACLE["catalog_append"] = f"""
WITH {_expand} SELECT * FROM added UNION ALL SELECT product_name, tab, category, barcode, sku_number FROM entries"""

_rollup = ", ".join(f"max(NULLIF({c}, '')) AS {c}" for c in ("description", "unit", "category", "tab"))
ROLLUP = f"SELECT item_code, {_rollup}, min(date) AS first_seen_date, max(date) AS last_seen_date FROM ({STAGED}) WHERE item_code IS NOT NULL"
ORACLE["product_rollup"] = f"{ROLLUP} AND run_id = 'run-a' GROUP BY item_code"
ORACLE["product_merge"] = f"""
WITH n AS ({ROLLUP} GROUP BY item_code), o AS ({SOME_PRODUCTS})
SELECT COALESCE(n.item_code, o.item_code) AS item_code, COALESCE(n.description, o.description) AS description,
  COALESCE(n.unit, o.unit) AS unit, COALESCE(n.category, o.category) AS category, COALESCE(n.tab, o.tab) AS tab,
  least(o.first_seen_date, n.first_seen_date) AS first_seen_date, greatest(o.last_seen_date, n.last_seen_date) AS last_seen_date
FROM o FULL JOIN n ON n.item_code = o.item_code"""
ORACLE["product_keys"] = f"""
WITH n AS ({ROLLUP} GROUP BY item_code), o AS ({SOME_PRODUCTS}), fresh AS (SELECT count(*) AS c FROM n ANTI JOIN o USING (item_code))
SELECT count(*) + (SELECT c FROM fresh) AS products, count(*) + (SELECT c FROM fresh) AS keys, min(product_key) AS first_key,
       max(product_key) + (SELECT c FROM fresh) AS last_key FROM o"""
ORACLE["category_fill"] = f"""
WITH {BARCODES}, keys AS (SELECT item_code, {improved('description')} AS name, 1 AS lines FROM ({PRODUCTS})
  WHERE COALESCE(category, '') = '' OR COALESCE(tab, '') = ''), {PRODUCT_MATCH}
SELECT p.item_code, CASE WHEN COALESCE(p.category, '') = '' OR COALESCE(p.tab, '') = '' THEN COALESCE(m.category, p.category) ELSE p.category END AS category,
  CASE WHEN COALESCE(p.category, '') = '' OR COALESCE(p.tab, '') = '' THEN COALESCE(m.tab, p.tab) ELSE p.tab END AS tab
FROM ({PRODUCTS}) p LEFT JOIN matched m ON m.item_code = p.item_code"""
ORACLE["category_settled"] = f"""
SELECT filled.*, item_code[-1] NOT IN ('0', '2', '4', '6', '8')
  AND (COALESCE(p.category, '') = '' OR COALESCE(p.tab, '') = '') AS matched_now
FROM ({ORACLE["category_fill"]}) filled JOIN ({PRODUCTS}) p USING (item_code)"""
ORACLE["catalog_files"] = f"""
SELECT product_name, tab, category, barcode, sku_number, row_number() OVER (ORDER BY position) - 1 AS position,
  row_number() OVER (ORDER BY position) <= 100 AS in_backup FROM ({CATALOGUE})"""
ORACLE["uncategorised"] = f"""
SELECT DISTINCT item_code, description FROM ({PRODUCTS}) WHERE COALESCE(category, '') = '' AND item_code <> '' AND description <> ''"""
ORACLE["key_lookup"] = f"SELECT row_hash, receipt, qty, sales FROM ({STAGED}) WHERE item_code = '00000123'"

def days(last="day"):
    return f"""days AS (SELECT CAST(d AS DATE) AS date_key FROM (SELECT unnest(generate_series(
      date_trunc('year', min(l_shipdate)), date_trunc('{last}', max(l_shipdate)), INTERVAL 1 DAY)) AS d FROM lineitem))"""


DAYS = days()
ORACLE["dim_date"] = f"""
WITH {DAYS} SELECT date_key, day(date_key) AS day, week(date_key) AS week, month(date_key) AS month, quarter(date_key) AS quarter,
  year(date_key) AS year, dayofweek(date_key) AS dow, dayofweek(date_key) IN (0, 6) AS is_weekend FROM days"""
_fact = """
  s.run_id, d.date_key, p.product_key, s.receipt AS receipt_number, s.so AS sales_order_number, s.qty AS quantity_sold, s.unit,
  CASE WHEN s.qty <> 0 THEN s.sales / s.qty END AS unit_price,
  COALESCE(s.discount, 0) / NULLIF(s.sales + COALESCE(s.discount, 0), 0) AS discount_rate, s.sales AS sales_amount,
  s.sales + COALESCE(s.discount, 0) AS gross_amount, s.cost AS cost_amount, s.profit AS profit_amount, s.payment, s.cashier_id,
  COALESCE(s.txn_type, 'SALE') AS txn_type, s.expiration_date, s.row_hash, year(d.date_key) AS year, month(d.date_key) AS month"""
def star(products, calendar):
    return f"""p AS ({products}), {calendar}, s AS ({STAGED}),
    facts AS (SELECT {_fact} FROM s JOIN p ON p.item_code = s.item_code JOIN days d ON d.date_key = s.date)"""


STAR = star(PRODUCTS, DAYS)
ORACLE["fact_sales"] = f"WITH {STAR} SELECT * FROM facts WHERE run_id = 'run-a'"
ORACLE["fact_unmatched"] = f"""
WITH {star(SOME_PRODUCTS, days('month'))} SELECT row_hash, item_code, date, 'FACT' AS error_stage, 'NO_DIM_MATCH' AS error_reason FROM s ANTI JOIN facts USING (row_hash)"""
ORACLE["run_audit"] = f"""
WITH {HALVES}, {STAR}, new AS (SELECT * FROM batch ANTI JOIN stored USING (row_hash)),
c AS (SELECT (SELECT count(*) FROM batch) AS rows_cleaned, (SELECT count(*) FROM new) AS rows_staged,
  (SELECT count(*) FROM new SEMI JOIN facts USING (row_hash)) AS rows_out, (SELECT count(*) FROM lines WHERE sales IS NULL) AS rows_rejected)
SELECT *, greatest(0, rows_cleaned - rows_staged) + rows_rejected AS rows_removed FROM c"""
ORACLE["run_rows"] = f"SELECT run_id, count(*) AS rows FROM ({STAGED}) GROUP BY 1"
_columns = ["file", "chunk", "row_index", *CELLS]
ORACLE["column_profile"] = f"WITH r AS MATERIALIZED ({RAW}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE CAST({c} AS VARCHAR) NOT IN ('', 'nan')) AS non_null FROM r" for c in _columns)
ORACLE["structure_profile"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, (SELECT string_agg(v, '|' ORDER BY s_suppkey) FROM "
    f"(SELECT s_suppkey, CAST({c} AS VARCHAR) AS v FROM supplier ORDER BY s_suppkey LIMIT 3)) AS samples"
    for c, t in (("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")))

ORACLE["head_rows"] = f"SELECT row_index, date, item_code, sales FROM ({RAW}) ORDER BY row_index LIMIT 10"

ORACLE["kpi"] = f"""
WITH p AS ({PURCHASES}), i AS ({INVENTORY})
SELECT (SELECT CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) FROM p) AS total_revenue,
  (SELECT count(*) FROM p WHERE status = 'completed') AS total_sales,
  (SELECT CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM p) AS average_order_value, CAST(3.2 AS DOUBLE) AS conversion_rate,
  (SELECT count(*) FROM i WHERE stock <= min_stock) AS low_stock_items, (SELECT count(*) FROM i WHERE stock = 0) AS out_of_stock_items,
  (SELECT count(*) FROM i) AS total_products"""
ORACLE["daily_sales"] = f"""
SELECT CAST(date AS DATE) AS date, count(*) AS sales, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM ({PURCHASES}) GROUP BY 1"""


def _trend(source, by=""):
    comma = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
    WITH w AS (SELECT {comma}CAST(date_trunc('week', date) AS DATE) AS week, sum(CAST(price AS DECIMAL(18,2))) AS total FROM ({source}) GROUP BY ALL)
    SELECT {comma}week, CAST(total AS DOUBLE) AS sales,
      CAST(sum(total) OVER t AS DOUBLE) / count(*) OVER t AS trend FROM w
    WINDOW t AS ({part}ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""


LINE_SALES = """SELECT l_partkey AS product, l_shipdate AS date, l_extendedprice AS price, CAST(l_quantity AS BIGINT) AS units,
  p_name AS name, p_type AS category FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"""
ORACLE["weekly_trend"] = _trend(PURCHASES)
ORACLE["weekly_category_revenue"] = _trend(LINE_SALES, "category")
ORACLE["mom_change"] = f"""
WITH m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  CAST(count(*) FILTER (WHERE status = 'completed') AS DOUBLE) AS orders FROM ({PURCHASES}) GROUP BY 1),
  v AS (SELECT *, revenue / NULLIF(orders, 0) AS order_value FROM m)
SELECT month, revenue, orders, order_value,
  (revenue - lag(revenue) OVER w) * 100 / lag(revenue) OVER w AS revenue_change,
  (orders - lag(orders) OVER w) * 100 / lag(orders) OVER w AS orders_change,
  (order_value - lag(order_value) OVER w) * 100 / lag(order_value) OVER w AS order_value_change
FROM v WINDOW w AS (ORDER BY month)"""
ORACLE["purchases_export"] = ORACLE["last_30_days"] = f"""
WITH p AS ({PURCHASES}) SELECT id, price, status FROM p WHERE date >= (SELECT max(date) FROM p) - INTERVAL 30 DAY"""
EVENTS = "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS product, event_type, ts AS date FROM events"
TRAFFIC = f"""SELECT product, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS sales
FROM ({EVENTS}) WHERE event_type IN ('view', 'purchase') GROUP BY 1"""
ORACLE["traffic_conversion"] = f"SELECT *, round(sales * 100.0 / NULLIF(views, 0), 1) AS conversion_rate FROM ({TRAFFIC})"
TIERS = f"""SELECT product, views, round(pr, 6) AS percent_rank,
  CASE WHEN pr >= 2.0 / 3 THEN 'high' WHEN pr >= 1.0 / 3 THEN 'medium' ELSE 'low' END AS tier
FROM (SELECT product, views, percent_rank() OVER (ORDER BY views) AS pr FROM ({TRAFFIC}))"""
ORACLE["traffic_tier"] = TIERS
ORACLE["tier_counts"] = f"SELECT tier, count(*) AS products FROM ({TIERS}) GROUP BY 1"
ORACLE["stock_alerts"] = f"""
SELECT product, CASE WHEN stock = 0 THEN 'critical' WHEN stock <= min_stock THEN 'warning' ELSE 'info' END AS type,
  CASE WHEN stock = 0 THEN 'Out of Stock Alert' WHEN stock <= min_stock THEN 'Low Stock Warning' ELSE 'Restock Recommended' END AS title,
  CASE WHEN stock = 0 THEN name || ' is completely out of stock'
       WHEN stock <= min_stock THEN name || ' - Only ' || stock || ' units remaining (Min: ' || min_stock || ')'
       ELSE name || ' approaching minimum threshold' END AS description
FROM ({INVENTORY}) WHERE stock <= CAST(min_stock AS DOUBLE) * 1.2"""
ORACLE["demand_alerts"] = f"""
WITH s AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week FROM ({LINE_SALES})), n AS (SELECT max(week) AS newest FROM s),
u AS (SELECT product, name, sum(units) FILTER (WHERE week = newest) AS now, sum(units) FILTER (WHERE week = newest - 7) AS before
      FROM s, n WHERE week >= newest - 7 GROUP BY ALL),
r AS (SELECT product, name, CAST(round((now - before) * 100.0 / before) AS BIGINT) AS pct FROM u)
SELECT product, 'success' AS type, 'High Demand Product' AS title, name || ' sales increased by ' || pct || '% this week' AS description
FROM r WHERE pct >= 20"""
ORACLE["traffic_alerts"] = f"""
WITH v AS (SELECT product, CAST(date AS DATE) AS d FROM ({EVENTS}) WHERE event_type = 'view'),
b AS (SELECT max(d) AS newest, min(d) AS first FROM v),
c AS (SELECT product, count(*) FILTER (WHERE d = newest) AS now, count(*) FILTER (WHERE d < newest) AS before,
      greatest(max(newest) - max(first), 1) AS days FROM v, b GROUP BY product)
SELECT product, 'warning' AS type, 'Unusual Traffic Pattern' AS title, 'Traffic increased on product page of item ' || product AS description
FROM c WHERE before > 0 AND now * days > 2.0 * before"""

ORACLE["report_scan"] = f"WITH {CHAIN} SELECT file, {', '.join(CELLS)} FROM cells"
ORACLE["report_files"] = f"""
SELECT file, 'OK' AS status, count(*) + 3 AS lines FROM ({RAW}) GROUP BY 1
UNION ALL SELECT DISTINCT 'bad-' || file, 'HEADER_NOT_FOUND', 1 FROM ({RAW})
UNION ALL SELECT DISTINCT 'binary-' || file, 'NOT_TEXT', 1 FROM ({RAW})
UNION ALL SELECT 'torn-' || min(file), 'UNREADABLE', 0 FROM ({RAW}) HAVING count(*) > 0"""
ORACLE["file_rows"] = f"SELECT file, count(*) AS rows FROM ({RAW}) GROUP BY 1"
ORACLE["clean_report"] = f"""
WITH {CHAIN} SELECT file, CAST(date AS DATE) AS date, receipt, so, item_code, description, expiration_date, unit,
  {', '.join(f'round({c}, 4) AS {c}' for c in ('qty', 'discount', 'sales', 'cost', 'profit'))}, payment, cashier_id, txn_type, row_hash FROM lines"""
ORACLE["clean_rejects"] = f"""
WITH {CHAIN} SELECT file, error_stage, error_reason, count(*) AS count FROM final WHERE error_reason IS NOT NULL GROUP BY ALL"""
_loaded = f"""{CHAIN}, {DAYS}, loaded AS (SELECT row_hash, date_key, receipt AS receipt_number, txn_type, round(sales, 2) AS sales_amount
  FROM staged JOIN days ON date_key = CAST(date AS DATE) WHERE item_code IS NOT NULL)"""
ORACLE["cleaned_sink"] = f"""
WITH {CHAIN} SELECT file, CAST(date AS DATE) AS date, receipt, item_code, description, round(qty, 4) AS qty, round(sales, 4) AS sales, row_hash FROM lines"""
ORACLE["reject_sink"] = ORACLE["clean_rejects"]
ORACLE["load_report"] = f"WITH {_loaded} SELECT * FROM loaded"
ORACLE["stream_ingest"] = ORACLE["load_report"]
ORACLE["run_history"] = f"""
WITH {_loaded}, c AS (SELECT (SELECT count(*) FROM raw) AS rows_in, (SELECT count(*) FROM lines) AS rows_cleaned,
  (SELECT count(*) FROM loaded) AS rows_out, (SELECT count(*) FROM lines) - (SELECT count(*) FROM staged) AS dups)
SELECT 'SUCCEEDED' AS status, rows_in, rows_cleaned, rows_out, dups + rows_in - rows_cleaned AS rows_removed FROM c
UNION ALL SELECT 'SUCCEEDED', rows_in, rows_cleaned, 0, rows_in FROM c"""
ORACLE["project_target"] = """
SELECT o_orderdate AS date, o_orderkey AS receipt, o_custkey AS so, o_totalprice AS sales, NULL AS unit, NULL AS txn_type FROM orders"""
ORACLE["lenient_scan"] = f"""
WITH {CHAIN} SELECT file, date, receipt, so, item_code, description, qty, NULL AS unit, sales FROM cells"""
