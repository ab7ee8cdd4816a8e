"""The same results in plain SQL for a second engine, written apart from the Spark code."""

from __future__ import annotations

from suite.base_sql import LINES

ORACLES: dict[str, str] = {}

M = """WITH m AS (
  SELECT o_orderkey AS line_no, 'O' || CAST(o_orderkey % 500 AS VARCHAR) AS order_id,
    CASE o_orderkey % 10 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y')
      WHEN 2 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
    CASE o_orderkey % 7 WHEN 0 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) // 1000 AS VARCHAR) || ',' ||
        lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || '.50'
      WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ',25' WHEN 2 THEN NULL WHEN 3 THEN 'abc'
      WHEN 4 THEN CAST(-CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN 5 THEN '0' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 13 = 1 THEN 'x' ELSE CAST(o_orderkey % 17 - 2 AS VARCHAR) END AS qty,
    CASE WHEN o_orderkey % 9 = 0 THEN ' ' || o_orderstatus || ' ' WHEN o_orderkey % 8 = 1 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 11 = 0 THEN replace(o_orderpriority, '-', ' ') ELSE o_orderpriority END AS priority,
    'user' || CAST(o_custkey AS VARCHAR) || '@shop.test' AS contact, CAST(o_orderdate AS DATE) AS true_day
  FROM orders)
"""
U = M + """, u AS (SELECT "column", value, count(*) AS n FROM (
  SELECT 'order_id' AS "column", order_id AS value FROM m UNION ALL SELECT 'day', day FROM m UNION ALL SELECT 'price', price FROM m
  UNION ALL SELECT 'qty', qty FROM m UNION ALL SELECT 'status', status FROM m UNION ALL SELECT 'priority', priority FROM m
  UNION ALL SELECT 'contact', contact FROM m) GROUP BY 1, 2)
"""
# A strict number, as a nullable double.
NUM = "CASE WHEN regexp_full_match(value, '-?[0-9]+') THEN CAST(value AS DOUBLE) END"


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


def over_lines(name: str, sql: str) -> None:
    add(name, LINES + sql)


add("s1_read_text_csv", M + """SELECT count(*) AS row_count, count(*) AS line_numbers, count(*) AS distinct_lines, count(order_id) AS n_order_id,
  count(day) AS n_day, count(price) AS n_price, count(qty) AS n_qty, count(status) AS n_status, count(priority) AS n_priority, count(contact) AS n_contact FROM m""")
add("s1_quoted_records", """SELECT o_orderkey AS order_key, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority || chr(10) || chr(10) || o_orderstatus
  WHEN 1 THEN 'say "' || o_orderpriority || '",' || chr(10) || 'then ""' WHEN 2 THEN 'a,b;' || o_orderstatus WHEN 3 THEN o_orderstatus || '5" wide' ELSE o_orderpriority END AS note,
  o_custkey AS customer FROM orders""")
add("s5_iso_dates", """SELECT CAST(CASE WHEN src = 'o' THEN 10 WHEN micro THEN 26 WHEN clock THEN 19 ELSE 10 END AS INTEGER) AS width, count(*) AS cells FROM (
  SELECT 'o' AS src, FALSE AS micro, FALSE AS clock FROM orders UNION ALL
  SELECT 'e', (SELECT bool_or(microsecond(ts) % 1000000 <> 0) FROM events), (SELECT bool_or(CAST(ts AS TIME) <> TIME '00:00:00') FROM events) FROM events) GROUP BY 1""")
add("s8_union_extracts", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders, count(DISTINCT o_orderkey) AS order_keys FROM orders GROUP BY 1""")

# --- profiling
add("p1_dataset_stats", M + """SELECT count(*) AS row_count, CAST(5 AS BIGINT) AS column_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT day, price, qty, status, priority FROM m)) AS duplicate_rows,
  round((count(*) * 5 - count(day) - count(price) - count(qty) - count(status) - count(priority)) * 100.0 / (count(*) * 5), 4) AS missing_cells_pct FROM m""")
add("p2_column_profile", U + f"""SELECT "column", CAST(coalesce(sum(CASE WHEN value IS NULL THEN n END), 0) AS BIGINT) AS null_count,
  round(coalesce(sum(CASE WHEN value IS NULL THEN n END), 0) * 100.0 / sum(n), 4) AS null_pct, count(value) AS unique_count,
  coalesce(bool_and(CASE WHEN value IS NOT NULL THEN ({NUM}) IS NOT NULL END), FALSE) AS is_numeric FROM u GROUP BY 1""")
add("p3_numeric_stats", """SELECT 'l_quantity' AS "column", TRUE AS is_numeric, round(min(x), 4) AS min_value, round(max(x), 4) AS max_value, round(avg(x), 4) AS mean_value,
    round(median(x), 4) AS median, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.75), 4) AS q3 FROM (SELECT l_quantity AS x FROM lineitem)
  UNION ALL SELECT 'l_extendedprice', TRUE, round(min(x), 4), round(max(x), 4), round(avg(x), 4), round(median(x), 4), round(quantile_cont(x, 0.25), 4), round(quantile_cont(x, 0.75), 4) FROM (SELECT l_extendedprice AS x FROM lineitem)
  UNION ALL SELECT 'l_discount', TRUE, round(min(x), 4), round(max(x), 4), round(avg(x), 4), round(median(x), 4), round(quantile_cont(x, 0.25), 4), round(quantile_cont(x, 0.75), 4) FROM (SELECT l_discount AS x FROM lineitem)
  UNION ALL SELECT 'l_returnflag', FALSE, NULL, NULL, NULL, NULL, NULL, NULL""")
add("p5_top_values", U + """SELECT "column", value, n, position FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS position FROM u WHERE value IS NOT NULL) WHERE position <= 10""")
add("p6_sample_values", M + """, s AS (SELECT DISTINCT i * (SELECT max(line_no) FROM m) // 4 AS line_no FROM range(5) t(i))
  SELECT m.line_no, 'day' AS "column", day AS value FROM m JOIN s ON m.line_no = s.line_no UNION ALL SELECT m.line_no, 'price', price FROM m JOIN s ON m.line_no = s.line_no""")
add("p7_date_order", U + """, d AS (SELECT "column", n, CAST(value[1:2] AS INTEGER) AS a, CAST(value[4:5] AS INTEGER) AS b FROM u WHERE regexp_full_match(value, '[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}'))
  SELECT "column", CAST(sum(n) AS BIGINT) AS shaped, CAST(sum(CASE WHEN a > 12 THEN n ELSE 0 END) AS BIGINT) AS day_first, CAST(sum(CASE WHEN b > 12 THEN n ELSE 0 END) AS BIGINT) AS month_first,
    CAST(sum(CASE WHEN a <= 12 AND b <= 12 AND a <> b THEN n ELSE 0 END) AS BIGINT) AS ambiguous, 'day_first' AS decision, 'day_first' AS applied FROM d GROUP BY 1""")
add("p8_number_formats", U + """SELECT "column", CAST(sum(CASE WHEN value NOT IN ('abc', 'x') THEN n ELSE 0 END) AS BIGINT) AS readable,
    CAST(sum(CASE WHEN regexp_full_match(value, '-?[0-9]+') THEN n ELSE 0 END) AS BIGINT) AS plain, CAST(sum(CASE WHEN value LIKE '$%' THEN n ELSE 0 END) AS BIGINT) AS point,
    CAST(sum(CASE WHEN value LIKE '%,25' THEN n ELSE 0 END) AS BIGINT) AS comma, CAST(0 AS BIGINT) AS ambiguous, CAST(sum(CASE WHEN value LIKE '$%' THEN n ELSE 0 END) AS BIGINT) AS signed_currency,
    CAST(sum(CASE WHEN value IN ('abc', 'x') THEN n ELSE 0 END) AS BIGINT) AS unreadable, CASE WHEN "column" = 'price' THEN 'ask' END AS decision
  FROM (SELECT * FROM u WHERE value IS NOT NULL AND "column" IN ('price', 'qty')) GROUP BY 1""")
# Two marks proven and no ambiguous cell: nothing depends on the answer.
ORACLES["p8_number_formats"] = ORACLES["p8_number_formats"].replace("CASE WHEN \"column\" = 'price' THEN 'ask' END", "CAST(NULL AS VARCHAR)")
add("p9_column_kinds", U + f"""SELECT "column", CAST(sum(n) AS BIGINT) AS present, CAST(sum(CASE WHEN ({NUM}) IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS numeric,
    CAST(sum(CASE WHEN "column" = 'day' AND value <> 'not a date' THEN n WHEN "column" = 'price' AND regexp_full_match(value, '(19|20)[0-9]{{2}}(0[1-9]|1[0-2])([0-2][1-9]|10|20)') THEN n ELSE 0 END) AS BIGINT) AS dates,
    CAST(sum(CASE WHEN value <> trim(value) THEN n ELSE 0 END) AS BIGINT) AS padded, FALSE AS has_utc_offset,
    sum(CASE WHEN ({NUM}) IS NOT NULL THEN n ELSE 0 END) / sum(n) > 0.5 AS mostly_numeric, "column" = 'day' AS mostly_dates FROM u WHERE value IS NOT NULL GROUP BY 1""")
add("p10_cell_masks", M + "SELECT line_no, TRUE AS is_present, FALSE AS is_number, day <> 'not a date' AS is_date, day = 'not a date' AS is_not_date, FALSE AS has_padding FROM m")
add("p11_date_shapes", U + """SELECT "column", CASE WHEN value LIKE '%/%' THEN 'slash' WHEN value LIKE '%.%' THEN 'dot' ELSE 'iso' END AS shape, CAST(sum(n) AS BIGINT) AS n FROM u
  WHERE "column" = 'day' AND value <> 'not a date' GROUP BY 1, 2""")
add("p13_iqr_fences", """SELECT c AS "column", round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high FROM (
  SELECT 'l_quantity' AS c, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem UNION ALL
  SELECT 'l_extendedprice', quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.75) FROM lineitem)""")
add("p14_spellings", U + """, r AS (SELECT *, lower(value) AS label, row_number() OVER (PARTITION BY "column", lower(value) ORDER BY n DESC, value) AS k FROM u WHERE value IS NOT NULL AND "column" IN ('status', 'priority'))
  SELECT "column", label, max(CASE WHEN k = 1 THEN value END) AS spelling, CAST(sum(CASE WHEN k > 1 THEN n ELSE 0 END) AS BIGINT) AS variants FROM r GROUP BY 1, 2""")
add("p15_identity_merges", U + """SELECT "column", count(DISTINCT value) - count(DISTINCT lower(trim(value))) AS merged FROM u WHERE value IS NOT NULL AND "column" IN ('status', 'priority', 'order_id', 'contact') GROUP BY 1""")
add("l15_personal_columns", U + """SELECT DISTINCT "column", "column" = 'contact' AS by_header, "column" = 'contact' AS by_value, "column" = 'contact' AS personal FROM u""")
add("t3_rewrite_numbers", M + "SELECT line_no, CASE WHEN price LIKE '$%' THEN replace(replace(price, '$', ''), ',', '') WHEN price LIKE '%,25' THEN replace(price, ',', '.') ELSE price END AS price FROM m")
add("t5_read_dates", M + "SELECT line_no, CASE WHEN day <> 'not a date' THEN true_day END AS read FROM m")
add("t9_first_misread", M + """SELECT line_no, day AS cell, CAST(strptime(day, '%m/%d/%Y') AS DATE) AS format_reads, true_day AS order_reads FROM m
  WHERE line_no % 10 = 0 AND day(true_day) <= 12 AND day(true_day) <> month(true_day) ORDER BY line_no LIMIT 1""")
over_lines("t10_month_grain", "SELECT FALSE AS month_grain FROM lines LIMIT 1")
add("n_text_identities", M + """SELECT line_no, FALSE AS blank, trim(status) AS identifier, lower(trim(status)) AS category, priority AS product,
  CASE WHEN priority LIKE '%NOT SPECIFIED' THEN '4 not specified' ELSE lower(replace(priority, '-', ' ')) END AS label,
  CASE split_part(replace(priority, ' ', '-'), '-', 1) WHEN '1' THEN replace(priority, 'URGENT', 'Urgent') WHEN '2' THEN replace(priority, 'HIGH', 'High')
    WHEN '3' THEN replace(priority, 'MEDIUM', 'Medium') WHEN '4' THEN replace(priority, 'NOT SPECIFIED', 'Not Specified') ELSE replace(priority, 'LOW', 'Low') END AS title FROM m""")
add("n10_value_shapes", U + """SELECT "column", CAST(sum(CASE WHEN "column" IN ('price', 'qty') AND value NOT IN ('abc', 'x') THEN n WHEN "column" = 'day' AND value LIKE '%.%' THEN n WHEN value = '5 LOW' THEN n ELSE 0 END) AS BIGINT) AS number_like,
  CAST(0 AS BIGINT) AS period_like, CAST(0 AS BIGINT) AS time_like FROM u WHERE value IS NOT NULL GROUP BY 1""")

# --- issues
add("c17_reads_as_missing", """SELECT 'url' AS "column", count(CASE WHEN url IN ('', 'NA', 'N/A', 'null', 'NULL', 'nan', 'NaN', 'None', 'n/a') THEN 1 END) AS cells FROM pages
  UNION ALL SELECT 'html', count(CASE WHEN html IN ('', 'NA', 'N/A', 'null', 'NULL', 'nan', 'NaN', 'None', 'n/a') THEN 1 END) FROM pages""")
FENCE = """, q AS (SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (
    SELECT 'price' AS "column", CAST(price AS DOUBLE) AS x FROM m WHERE regexp_full_match(price, '-?[0-9]+') UNION ALL SELECT 'qty', CAST(qty AS DOUBLE) FROM m WHERE regexp_full_match(qty, '-?[0-9]+')) GROUP BY 1)"""
ISSUES = U + FENCE + f""", base AS (SELECT u."column", sum(n) AS present, count(*) AS kinds, sum(CASE WHEN x IS NOT NULL THEN n ELSE 0 END) AS numeric,
    sum(CASE WHEN x < 0 THEN n ELSE 0 END) AS negative_values, sum(CASE WHEN x = 0 THEN n ELSE 0 END) AS zero_values, sum(CASE WHEN value <> trim(value) THEN n ELSE 0 END) AS trailing_whitespace,
    sum(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN n ELSE 0 END) AS outliers_iqr
    FROM (SELECT *, {NUM} AS x FROM u WHERE value IS NOT NULL) u LEFT JOIN q ON u."column" = q."column" GROUP BY 1),
  spell AS (SELECT "column", sum(s) AS inconsistent_case FROM (SELECT "column", sum(n) - max(n) AS s FROM u WHERE value IS NOT NULL GROUP BY "column", lower(value)) GROUP BY 1),
  twin AS (SELECT "column", sum(s) AS near FROM (SELECT "column", sum(n) - max(n) AS s FROM (SELECT "column", lower(value) AS l, trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) AS t, sum(n) AS n
    FROM u WHERE value IS NOT NULL GROUP BY 1, 2, 3) GROUP BY "column", t) GROUP BY 1),
  found AS (
    SELECT "column", 'negative_values' AS code, negative_values AS c FROM base UNION ALL SELECT "column", 'zero_values', zero_values FROM base
    UNION ALL SELECT "column", 'trailing_whitespace', trailing_whitespace FROM base UNION ALL SELECT "column", 'outliers_iqr', outliers_iqr FROM base
    UNION ALL SELECT "column", 'mixed_types', least(numeric, present - numeric) FROM base UNION ALL SELECT "column", 'non_numeric_in_numeric', present - numeric FROM base WHERE numeric / present > 0.5
    UNION ALL SELECT "column", 'constant_column', present FROM base WHERE kinds = 1 UNION ALL SELECT "column", 'inconsistent_case', inconsistent_case FROM spell
    UNION ALL SELECT "column", 'near_duplicate_labels', near FROM twin
    UNION ALL SELECT 'day', 'invalid_dates', count(CASE WHEN day = 'not a date' THEN 1 END) FROM m
    UNION ALL SELECT 'day', 'mixed_date_formats', count(CASE WHEN day LIKE '%/%' OR day LIKE '%.%' THEN 1 END) FROM m
    UNION ALL SELECT "column", 'missing_values', sum(CASE WHEN value IS NULL THEN n ELSE 0 END) FROM u GROUP BY 1)
"""
add("c15_issue_counts", ISSUES + """SELECT "column", code, CAST(c AS BIGINT) AS count FROM found WHERE c > 0
  UNION ALL SELECT NULL, 'duplicate_business_key', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM m GROUP BY order_id, status HAVING count(*) > 1)""")
add("c16_reconcile", ISSUES + """, claimed AS (SELECT u."column", code, count(*) AS claimed FROM u, (VALUES ('negative_values'), ('trailing_whitespace'), ('near_duplicate_labels'), ('missing_values'), ('duplicate_rows')) c(code) GROUP BY 1, 2),
  j AS (SELECT c.*, CAST(f.c AS BIGINT) AS measured FROM claimed c LEFT JOIN found f ON c."column" = f."column" AND c.code = f.code AND f.c > 0)
  SELECT "column", code, claimed, CASE WHEN code IN ('negative_values', 'trailing_whitespace', 'near_duplicate_labels') THEN measured ELSE claimed END AS count,
    CASE WHEN code = 'duplicate_rows' THEN 'dropped_wrong_level' WHEN code = 'near_duplicate_labels' AND "column" <> 'priority' THEN 'dropped_not_text'
      WHEN code <> 'missing_values' AND measured IS NULL THEN 'dropped_not_found' WHEN code <> 'missing_values' AND claimed <> measured THEN 'replaced' ELSE 'kept' END AS outcome FROM j""")
MARKS = M + """, g AS (SELECT day, price, qty, status, priority, count(*) AS n FROM m GROUP BY ALL),
  k AS (SELECT m.line_no, m.price IS NULL OR m.qty IS NULL AS any_missing,
    g.n > 1 AS duplicate,
    coalesce(m.price LIKE '-%', FALSE) OR coalesce(m.qty LIKE '-%', FALSE) AS negative,
    (m.price IS NOT NULL AND NOT regexp_full_match(m.price, '-?[0-9]+')) OR coalesce(m.qty = 'x', FALSE) AS non_numeric, m.status <> trim(m.status) AS padded, m.day = 'not a date' AS bad_date FROM m JOIN g ON g.day = m.day AND g.price IS NOT DISTINCT FROM m.price AND g.qty IS NOT DISTINCT FROM m.qty AND g.status = m.status AND g.priority = m.priority)
"""
add("c18_problem_marks", MARKS + "SELECT line_no, any_missing, duplicate, negative, coalesce(non_numeric, FALSE) AS non_numeric, padded, bad_date FROM k")
add("c19_first_problem_rows", MARKS + """
  SELECT kind, line_no, position FROM (SELECT kind, line_no, row_number() OVER (PARTITION BY kind ORDER BY line_no) AS position FROM (
    SELECT 'any_missing' AS kind, line_no FROM k WHERE any_missing UNION ALL SELECT 'duplicate', line_no FROM k WHERE duplicate UNION ALL SELECT 'negative', line_no FROM k WHERE negative
    UNION ALL SELECT 'non_numeric', line_no FROM k WHERE non_numeric UNION ALL SELECT 'padded', line_no FROM k WHERE padded UNION ALL SELECT 'bad_date', line_no FROM k WHERE bad_date)) WHERE position <= 40""")
add("c23_first_positions", M + "SELECT line_no FROM m WHERE price IS NULL ORDER BY line_no LIMIT 25")
add("c24_check_claims", """SELECT 'qty' AS "column", 'missing_values' AS code, 'missing_values_differs' AS problem UNION ALL SELECT 'price', 'missing_values', 'pct_differs'""")

# --- the plan and single actions
CLEAN = M + """, c AS (SELECT line_no, order_id, day, price, contact, status AS old_status, priority AS old_priority, qty AS old_qty, upper(trim(status)) AS status,
    CASE priority WHEN '1 URGENT' THEN '1-URGENT' WHEN '5 LOW' THEN '5-LOW' ELSE priority END AS priority,
    CASE WHEN regexp_full_match(qty, '-?[0-9]+') THEN abs(CAST(qty AS BIGINT)) END AS qty, coalesce(qty = 'x', FALSE) AS failed, price IS NULL AS dropped FROM m)
"""
add("x22_cleaned_frame", CLEAN + """SELECT line_no, status, priority, qty, failed AS qty_failed, count(*) OVER (PARTITION BY order_id, status) > 1 AS duplicate_key FROM c WHERE NOT dropped""")
add("x26_change_log", CLEAN + """, k AS (SELECT *, count(*) OVER (PARTITION BY order_id, status, dropped) > 1 AS dup FROM c)
  SELECT 'trim_whitespace' AS action, 'status' AS "column", count(CASE WHEN old_status <> trim(old_status) THEN 1 END) AS cells, CAST(0 AS BIGINT) AS rows FROM k
  UNION ALL SELECT 'normalize_case', 'status', count(CASE WHEN trim(old_status) <> status THEN 1 END), 0 FROM k
  UNION ALL SELECT 'cast_type', 'qty', count(qty), count(CASE WHEN failed THEN 1 END) FROM k
  UNION ALL SELECT 'drop_rows_missing', 'price', 0, count(CASE WHEN dropped THEN 1 END) FROM k
  UNION ALL SELECT 'impute_constant', 'priority', 0, 0
  UNION ALL SELECT 'standardize_categories', 'priority', count(CASE WHEN priority <> old_priority AND NOT dropped THEN 1 END), 0 FROM k
  UNION ALL SELECT 'fix_negative', 'qty', count(CASE WHEN old_qty LIKE '-%' AND NOT dropped THEN 1 END), 0 FROM k
  UNION ALL SELECT 'flag_duplicate_keys', NULL, 0, count(CASE WHEN dup AND NOT dropped THEN 1 END) FROM k
  UNION ALL SELECT 'flag_only', 'contact', 0, 0""")
add("c20_plan_diff", CLEAN + """, k AS (SELECT *, count(*) OVER (PARTITION BY order_id, status, dropped) > 1 AS dup FROM c)
  SELECT line_no, dropped, CASE WHEN dropped THEN '' ELSE concat_ws(',', CASE WHEN failed THEN '__flag_cast_failed__qty' END, CASE WHEN dup THEN '__flag_duplicate_key' END,
    CASE WHEN priority <> old_priority THEN 'priority' END, CASE WHEN CAST(qty AS VARCHAR) IS DISTINCT FROM old_qty THEN 'qty' END, CASE WHEN status <> old_status THEN 'status' END) END AS changed FROM k""")
add("c22_column_deltas", CLEAN + """SELECT 'order_id' AS "column", 0.0 AS null_pct_before, count(DISTINCT order_id) AS unique_before, 0.0 AS null_pct_after, count(DISTINCT CASE WHEN NOT dropped THEN order_id END) AS unique_after FROM c
  UNION ALL SELECT 'day', 0.0, count(DISTINCT day), 0.0, count(DISTINCT CASE WHEN NOT dropped THEN day END) FROM c
  UNION ALL SELECT 'price', round(count(CASE WHEN price IS NULL THEN 1 END) * 100.0 / count(*), 4), count(DISTINCT price), 0.0, count(DISTINCT price) FROM c
  UNION ALL SELECT 'qty', round(count(CASE WHEN old_qty IS NULL THEN 1 END) * 100.0 / count(*), 4), count(DISTINCT old_qty), round(count(CASE WHEN qty IS NULL AND NOT dropped THEN 1 END) * 100.0 / count(CASE WHEN NOT dropped THEN 1 END), 4), count(DISTINCT CASE WHEN NOT dropped THEN qty END) FROM c
  UNION ALL SELECT 'status', 0.0, count(DISTINCT old_status), 0.0, count(DISTINCT CASE WHEN NOT dropped THEN status END) FROM c
  UNION ALL SELECT 'priority', 0.0, count(DISTINCT old_priority), 0.0, count(DISTINCT CASE WHEN NOT dropped THEN priority END) FROM c
  UNION ALL SELECT 'contact', 0.0, count(DISTINCT contact), 0.0, count(DISTINCT CASE WHEN NOT dropped THEN contact END) FROM c""")
add("x3_impute_mode", M + "SELECT line_no, coalesce(qty, (SELECT qty FROM m WHERE qty IS NOT NULL GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1)) AS cell FROM m")
add("x4_impute_constant", M + "SELECT line_no, coalesce(price, '0') AS cell FROM m")
add("x5_drop_rows_missing", M + "SELECT line_no, qty AS cell FROM m WHERE qty IS NOT NULL")
add("x6_drop_column", M + "SELECT line_no, CAST(7 AS INTEGER) AS columns_left FROM m")
add("x8_trim_whitespace", M + "SELECT line_no, trim(status) AS cell FROM m")
add("x9_normalize_case", ORACLES["n_text_identities"].replace("SELECT line_no, FALSE AS blank", "SELECT line_no, title AS cell FROM (SELECT line_no, FALSE AS blank") + ")")
add("x10_standardize", M + "SELECT line_no, CASE priority WHEN '1 URGENT' THEN '1-URGENT' WHEN '3 MEDIUM' THEN '3-MEDIUM' ELSE priority END AS cell FROM m")
add("x11_parse_datetime", M + "SELECT line_no, CASE WHEN day <> 'not a date' THEN strftime(true_day, '%Y-%m-%d 00:00:00') END AS cell, day = 'not a date' AS flag FROM m")
add("x12_cast_integer", M + "SELECT line_no, CASE WHEN qty <> 'x' THEN qty END AS cell, coalesce(qty = 'x', FALSE) AS flag FROM m")
add("x13_fix_negative_drop", M + "SELECT line_no, qty AS cell FROM m WHERE NOT coalesce(qty LIKE '-%', FALSE)")
add("x13_fix_negative_flag", M + "SELECT line_no, price AS cell, coalesce(price LIKE '-%', FALSE) AS flag FROM m")
add("x15_flag_duplicate_keys", M + "SELECT line_no, order_id AS cell, count(*) OVER (PARTITION BY order_id, status) > 1 AS flag FROM m")
FIG = "WITH f AS (SELECT p_partkey AS line_no, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END AS price FROM part)"
add("x1_impute_median", FIG + "SELECT line_no, round(coalesce(price, (SELECT median(price) FROM f)), 4) AS price FROM f")
add("x2_impute_mean", FIG + "SELECT line_no, round(coalesce(price, (SELECT avg(price) FROM f)), 4) AS price FROM f")
add("x14_clip_outliers", FIG + """, q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM f)
  SELECT line_no, round(CASE WHEN price IS NULL THEN NULL ELSE greatest(least(price, q3 + 0.2 * (q3 - q1)), q1 - 0.2 * (q3 - q1)) END, 4) AS price FROM f, q""")
add("x7_remove_duplicates", """SELECT l_suppkey, l_quantity, l_returnflag, min(line_no) AS line_no FROM (SELECT *, row_number() OVER () - 1 AS line_no FROM lineitem) GROUP BY 1, 2, 3""")

# --- classification, orders, products
add("l2_composed_names", """WITH r AS (SELECT *, CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN chr(233) WHEN 1 THEN 'e' || chr(769) ELSE 'e' || chr(8203) || chr(769) END AS a,
    CASE l_linenumber % 3 WHEN 0 THEN chr(233) WHEN 1 THEN 'e' || chr(769) ELSE 'e' || chr(8203) || chr(769) END AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  raw AS (SELECT 'Caf' || a || ' ' || CAST(l_partkey % 40 AS VARCHAR) AS product, CASE l_linenumber % 2 WHEN 0 THEN chr(201) ELSE 'E' || chr(769) END || 've ' || CAST(o_custkey % 30 AS VARCHAR) AS who,
    'Soir' || b AS kind, 'N' || b || CAST(l_orderkey AS VARCHAR) AS receipt, l_quantity FROM r),
  t AS (SELECT product, nfc_normalize(replace(product, chr(8203), '')) AS shown, lower(nfc_normalize(who)) AS who, lower(nfc_normalize(replace(kind, chr(8203), ''))) AS category_key,
    nfc_normalize(replace(receipt, chr(8203), '')) AS receipt, l_quantity FROM raw)
  SELECT 'name:' || lower(shown) AS item_key, CASE WHEN shown = 'Caf' || chr(233) || ' 7' THEN 'charge' ELSE 'sale' END AS line_class, category_key, count(*) AS lines,
    count(DISTINCT who) AS customers, count(CASE WHEN who = chr(233) || 've 3' THEN 1 END) AS placeholders, count(DISTINCT receipt) AS orders, count(DISTINCT product) AS spellings,
    min(shown) AS shown FROM t GROUP BY 1, 2, 3""")
over_lines("l2_line_classes", "SELECT line_class, class_source, count(*) AS lines, sum(amount) AS amount FROM lines GROUP BY 1, 2")
over_lines("x22_run_lines", """SELECT line_class, class_source, month, count(*) AS lines, sum(amount) AS amount, count(DISTINCT customer) AS customers, count(DISTINCT product_key) AS products
  FROM lines GROUP BY 1, 2, 3""")
over_lines("x22_run_decisions", """SELECT question, answer, source, count(*) AS subjects FROM (
    SELECT 'line_class' AS question, answer, 'user' AS source FROM answers UNION ALL SELECT 'placeholder', 'yes', 'user'
    UNION ALL SELECT 'date_order', 'day_first', 'cells' FROM (SELECT max(day(txn_day)) AS d FROM lines) WHERE d > 12
    UNION ALL SELECT 'number_format', 'decimal_comma', 'cells' FROM (SELECT count(unit_price) AS n FROM lines) WHERE n > 0
    UNION ALL SELECT 'currency', 'EUR', 'cells' FROM (SELECT count(unit_price) AS n FROM lines) WHERE n > 0) GROUP BY 1, 2, 3""")
over_lines("x22_open_questions", """SELECT 'line_class' AS question, CASE WHEN item_key LIKE 'sku:%' THEN 'sku:' || sku ELSE 'product_name:' || name END AS subject, suggested AS hint FROM cand
  WHERE (positive <> 0 OR negative <> 0) AND item_key NOT IN (SELECT item_key FROM lines WHERE class_source = 'user' AND item_key IS NOT NULL)""")
over_lines("l6_candidates", """SELECT item_key, CASE WHEN item_key LIKE 'sku:%' THEN 'sku' ELSE 'product_name' END AS field, CASE WHEN item_key LIKE 'sku:%' THEN sku ELSE name END AS value, name,
  lines, positive, negative, suggested FROM cand WHERE positive <> 0 OR negative <> 0""")
over_lines("l7_suggestions", "SELECT suggested_class, line_class, count(*) AS lines FROM lines WHERE suggested_class IS NOT NULL GROUP BY 1, 2")
over_lines("l9_line_masks", """SELECT line_class, count(CASE WHEN counted THEN 1 END) AS counted, count(CASE WHEN sale THEN 1 END) AS sale, count(CASE WHEN returned THEN 1 END) AS returned,
  count(CASE WHEN charge THEN 1 END) AS charge, count(CASE WHEN deduction THEN 1 END) AS deduction, count(CASE WHEN left_out THEN 1 END) AS left_out, sum(units) AS units,
  CASE line_class WHEN 'sale' THEN 'gross_sales' WHEN 'pooled_sale' THEN 'gross_sales' WHEN 'customer_return' THEN 'returns' WHEN 'pooled_return' THEN 'returns' WHEN 'allowance' THEN 'other_deductions'
    WHEN 'pooled_allowance' THEN 'other_deductions' WHEN 'discount' THEN 'discounts' WHEN 'charge' THEN 'other_revenue' END AS term,
  CASE WHEN line_class IN ('gift_card_sale', 'gift_card_redemption', 'cost', 'adjustment', 'stock_in') THEN 'outside_revenue' WHEN line_class IN ('unclassified', 'unmeasurable') THEN line_class END AS reported
  FROM lines GROUP BY line_class""")
over_lines("l10_class_violations", "SELECT 'line_class' AS \"column\", kind AS value, count(*) AS lines FROM lines WHERE kind <> 'in' GROUP BY kind")
PLACE = """, c AS (SELECT customer_written AS customer, count(*) AS lines, sum(CASE WHEN quantity > 0 AND amount > 0 THEN amount ELSE 0 END) AS revenue FROM lines
    WHERE NOT stock_in AND quantity IS NOT NULL AND unit_price IS NOT NULL GROUP BY 1), t AS (SELECT sum(lines) AS tl, sum(revenue) AS tr FROM c)"""
over_lines("l11_placeholders", PLACE + """SELECT customer, lines, round(lines * 100.0 / tl, 4) AS lines_pct, round(revenue * 100.0 / tr, 4) AS revenue_pct, CASE WHEN customer = 'walk-in' THEN 'word' ELSE 'share' END AS why
  FROM c, t WHERE customer IS NOT NULL AND (customer = 'walk-in' OR lines * 100.0 / tl >= 10 OR revenue * 100.0 / tr >= 10)""")
over_lines("l12_unanswered_placeholders", PLACE + "SELECT customer, lines FROM c, t WHERE customer <> 'walk-in' AND (lines * 100.0 / tl >= 10 OR revenue * 100.0 / tr >= 10)")
add("l13_currency", "SELECT 'narrowed' AS kind, CAST(NULL AS VARCHAR) AS code, CAST(22 AS BIGINT) AS candidates, CAST(0 AS BIGINT) AS unreadable")
add("l13_currency_parts", M + "SELECT '$' AS label, count(*) AS lines, 'symbol' AS source FROM m WHERE price LIKE '$%'")
over_lines("o1_spanning_ids", """SELECT count(CASE WHEN d > 1 OR c > 1 THEN 1 END) AS spanning, count(*) AS ids FROM (SELECT order_id, count(DISTINCT txn_day) AS d, count(DISTINCT customer_written) AS c FROM lines WHERE sale GROUP BY 1)""")
over_lines("c14_order_id_issue", """, s AS (SELECT 'order_id' AS "column", order_id AS k, txn_day, customer_written FROM lines WHERE sale UNION ALL SELECT 'category_key', category_key, txn_day, customer_written FROM lines WHERE sale),
  i AS (SELECT "column", k, count(DISTINCT txn_day) > 1 OR count(DISTINCT customer_written) > 1 AS spans FROM s WHERE k IS NOT NULL GROUP BY 1, 2)
  SELECT "column", 'order_id_not_one_order' AS code, count(CASE WHEN spans THEN 1 END) AS "count" FROM i GROUP BY 1 HAVING count(CASE WHEN spans THEN 1 END) > 0.1 * count(*)""")
over_lines("o5_order_basis", """, f AS (SELECT l.*, split_part(order_key, '␟', 3) AS filled FROM lines l WHERE sale), i AS (SELECT order_id, count(DISTINCT txn_day) AS d, count(DISTINCT nullif(filled, '')) AS c FROM f GROUP BY 1)
  SELECT 'order_id' AS orders_basis, CAST(NULL AS VARCHAR) AS orders_reason, CAST(NULL AS VARCHAR) AS date_only_reason, count(*) AS ids, count(CASE WHEN d > 1 OR c > 1 THEN 1 END) AS spanning, CAST(0 AS BIGINT) AS blank_ids,
    (SELECT count(*) FROM lines WHERE sale OR returned) AS moved_lines FROM i""")
over_lines("o5_order_basis_by_shipdate", "SELECT 'lines' AS orders_basis, 'ids_span_days_or_customers' AS orders_reason, count(*) AS lines, count(CASE WHEN sale THEN 1 END) AS orders FROM lines")
over_lines("o6_orders", "SELECT month, count(DISTINCT order_key) AS orders FROM lines WHERE sale GROUP BY 1")
over_lines("o8_order_checks", """SELECT (SELECT count(*) FROM lines WHERE receipt_fillable) AS fillable_lines, count(CASE WHEN d > 1 OR c > 1 THEN 1 END) AS spanning, count(*) AS ids FROM (
  SELECT order_id, count(DISTINCT txn_day) AS d, count(DISTINCT customer_written) AS c FROM lines WHERE sale GROUP BY 1)""")
FIRST = """, h AS (SELECT * FROM lines WHERE counted AND customer IS NOT NULL), od AS (SELECT customer, min(txn_day) AS d FROM h WHERE sale OR returned GROUP BY 1),
  net AS (SELECT h.customer, h.netting_key, sum(CASE WHEN sale THEN units ELSE 0 END) AS bought, sum(CASE WHEN returned THEN -units ELSE 0 END) AS back FROM h JOIN od ON h.customer = od.customer AND h.txn_day = od.d
    WHERE sale OR returned GROUP BY 1, 2), ref AS (SELECT DISTINCT customer FROM net WHERE back > bought),
  first AS (SELECT h.customer, CASE WHEN max(ref.customer) IS NULL THEN CAST(date_trunc('month', min(CASE WHEN sale THEN txn_day END)) AS DATE) END AS first_month FROM h LEFT JOIN ref ON h.customer = ref.customer GROUP BY h.customer)
"""
over_lines("o10_first_purchases", FIRST + "SELECT customer, first_month FROM first")
over_lines("r1_product_keys", "SELECT product_key, netting_key, count(*) AS lines FROM lines GROUP BY 1, 2")
LABELS = """, pn AS (SELECT product_key, product_name AS name, count(CASE WHEN sale THEN 1 END) AS ns, max(CASE WHEN sale THEN txn_ts END) AS ls, count(*) AS n, max(txn_ts) AS la FROM lines WHERE product_key IS NOT NULL GROUP BY 1, 2),
  bs AS (SELECT product_key, name FROM pn WHERE ns > 0 QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY ns DESC, ls DESC, name) = 1),
  ba AS (SELECT product_key, name FROM pn QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY n DESC, la DESC NULLS LAST, name) = 1),
  best AS (SELECT ba.product_key, coalesce(bs.name, ba.name) AS label FROM ba LEFT JOIN bs ON ba.product_key = bs.product_key),
  skus AS (SELECT product_key, min_by(sku, line_no) AS sku FROM lines WHERE sku IS NOT NULL AND product_key IS NOT NULL GROUP BY 1),
  twins AS (SELECT lower(label) AS fold, count(*) AS k FROM best GROUP BY 1),
  labels AS (SELECT b.product_key, CASE WHEN k > 1 AND sku IS NOT NULL THEN label || ' (' || sku || ')' ELSE label END AS product_label FROM best b JOIN twins ON lower(label) = fold LEFT JOIN skus s ON b.product_key = s.product_key)
"""
add("n8_numbered_labels", """WITH RECURSIVE c AS (SELECT c_nationkey AS nation, c_custkey AS k, CAST(c_custkey AS VARCHAR) AS product_key, ' (' || CAST(c_custkey % 41 + 1 AS VARCHAR) || ')' AS suffix, c_mktsegment AS s FROM customer),
  n AS (SELECT nation, product_key, CASE WHEN k % 9 = 0 THEN lower(s) || suffix || ' (2)' WHEN k % 3 = 0 THEN s || suffix ELSE s END AS shown, row_number() OVER (PARTITION BY nation ORDER BY k) AS i FROM c),
  f(nation, i, product_key, product_label, seen) AS (SELECT DISTINCT nation, CAST(0 AS BIGINT), '', '', ['(no product name)'] FROM n UNION ALL
    SELECT nation, i, product_key, label, list_append(seen, lower(label)) FROM (SELECT n.nation, n.i, n.product_key, f.seen,
      list_filter(list_transform(range(1, len(f.seen) + 2), lambda j: CASE WHEN j = 1 THEN n.shown ELSE n.shown || ' (' || CAST(j AS VARCHAR) || ')' END), lambda x: NOT list_contains(f.seen, lower(x)))[1] AS label
      FROM f JOIN n ON n.nation = f.nation AND n.i = f.i + 1))
  SELECT nation, product_key, product_label FROM f WHERE i > 0""")
over_lines("r3_product_labels", LABELS + "SELECT product_key, product_label FROM labels")
over_lines("r4_product_suggestions", "SELECT product_key, max(suggested_class) AS suggested_class FROM lines WHERE product_key = item_key AND suggested_class IS NOT NULL GROUP BY 1")
over_lines("r5_period", """SELECT data_start, data_end, cur AS current, prev AS previous, first_sale, CAST(greatest(0, first_sale - prev) AS INTEGER) AS leading_days_missing, TRUE AS previous_complete, FALSE AS month_grain FROM p""")
over_lines("r5_period_by_nation", """, q AS (SELECT nation, min(txn_day) AS data_start, max(txn_day) AS data_end, min(CASE WHEN sale THEN txn_day END) AS first_sale FROM lines GROUP BY 1),
  z AS (SELECT *, CASE WHEN data_end = last_day(data_end) THEN CAST(date_trunc('month', data_end) AS DATE) ELSE CAST(date_trunc('month', data_end) - INTERVAL 1 MONTH AS DATE) END AS current FROM q),
  y AS (SELECT *, CAST(current - INTERVAL 1 MONTH AS DATE) AS previous FROM z), sm AS (SELECT DISTINCT nation, month FROM lines WHERE sale)
  SELECT y.nation, data_start, data_end, current, previous, first_sale, sm.month IS NOT NULL AND first_sale - previous < 3 AS previous_complete FROM y LEFT JOIN sm ON sm.nation = y.nation AND sm.month = y.previous""")
over_lines("r7_future_lines", "SELECT count(*) AS future_lines, sum(CASE WHEN counted THEN amount ELSE 0 END) AS future_revenue, max(txn_day) AS latest_day FROM lines WHERE txn_day > DATE '2000-12-31'")
CAL = """, comp AS (SELECT CAST(m AS DATE) AS month FROM (SELECT unnest(generate_series(date_trunc('month', data_start), date_trunc('month', data_end), INTERVAL 1 MONTH)) AS m FROM p), p
    WHERE CAST(m AS DATE) >= data_start AND last_day(CAST(m AS DATE)) <= data_end),
  hist AS (SELECT month FROM comp, p WHERE month < cur ORDER BY month DESC LIMIT 24)
"""
over_lines("r9_complete_months", CAL + "SELECT month FROM comp")
over_lines("r10_partial_months", CAL + """SELECT month, greatest(month, data_start) AS first_day, least(last_day(month), data_end) AS last_day FROM (
  SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS month FROM (SELECT data_start AS d FROM p UNION ALL SELECT data_end FROM p)), p WHERE month NOT IN (SELECT month FROM comp)""")
over_lines("r11_months_with_rows", CAL + "SELECT month, count(*) AS lines, count(CASE WHEN sale AND customer IS NOT NULL THEN 1 END) = 0 AS blank_customers FROM lines WHERE counted AND month IN (SELECT month FROM comp) GROUP BY 1")

# --- metrics
CORE = """sum(amount) AS revenue, sum(abs(amount)) AS money_moved, sum(units) AS units, count(DISTINCT CASE WHEN sale THEN order_key END) AS orders, count(DISTINCT CASE WHEN returned THEN order_key END) AS return_orders,
  sum(CASE WHEN sale THEN amount ELSE 0 END) AS gross_sales, 0 - sum(CASE WHEN returned THEN amount ELSE 0 END) AS returns, 0 - sum(CASE WHEN deduction THEN amount ELSE 0 END) AS deductions,
  sum(CASE WHEN charge THEN amount ELSE 0 END) AS charges, count(CASE WHEN returned OR amount < 0 THEN 1 END) AS refund_lines, count(DISTINCT customer) AS active_customers, count(DISTINCT CASE WHEN sale THEN customer END) AS buyers"""
CORE_CTE = f", core AS (SELECT month, {CORE} FROM lines WHERE counted GROUP BY month)"
over_lines("m1_monthly_core", CORE_CTE + "SELECT *, round(revenue / nullif(orders, 0), 4) AS aov, round(return_orders / nullif(orders, 0), 6) AS return_rate FROM core")
over_lines("m1_monthly_core_by_nation", f", core AS (SELECT nation, month, {CORE} FROM lines WHERE counted GROUP BY nation, month) SELECT *, round(revenue / nullif(orders, 0), 4) AS aov FROM core")
PAIR = CORE_CTE + ", a AS (SELECT core.* FROM core, p WHERE month = cur), b AS (SELECT core.* FROM core, p WHERE month = prev)"
_kpi = "SELECT '{k}' AS kpi, round(CAST({a} AS DOUBLE), 4) AS current_value, round(CAST({b} AS DOUBLE), 4) AS previous_value, round({a} - {b}, 4) AS change, round(({a} - {b}) * 100.0 / {b}, 4) AS change_pct, CAST(NULL AS VARCHAR) AS reason FROM a, b"
over_lines("m3_kpis", PAIR + " UNION ALL ".join(
    _kpi.format(k=k, a=e.format("a"), b=e.format("b")) for k, e in (
        ("revenue", "{0}.revenue"), ("orders", "{0}.orders"), ("active_customers", "{0}.active_customers"), ("buyers", "{0}.buyers"),
        ("return_orders", "{0}.return_orders"), ("aov", "({0}.revenue / {0}.orders)"), ("return_rate", "({0}.return_orders / {0}.orders)"))))
over_lines("m7_undated_lines", "SELECT count(*) AS undated_lines FROM lines WHERE txn_ts IS NULL AND line_class <> 'unmeasurable'")
over_lines("m8_non_product_lines", """SELECT answered_class, count(*) AS lines, sum(amount) AS amount, sum(CASE WHEN month = cur THEN amount ELSE 0 END) AS amount_current, sum(CASE WHEN month = prev THEN amount ELSE 0 END) AS amount_previous
  FROM lines, p WHERE (counted OR left_out) AND answered_class IS NOT NULL GROUP BY 1""")
SC = """, sc AS (SELECT 'file' AS figure_scope, l.* FROM lines l UNION ALL SELECT 'current', l.* FROM lines l, p WHERE month = cur UNION ALL SELECT 'previous', l.* FROM lines l, p WHERE month = prev)"""
LEAVING = "suggested_class IN ('cost', 'charge', 'discount', 'adjustment', 'gift_card')"
over_lines("m9_revenue_identity", SC + f"""SELECT figure_scope, sum(CASE WHEN sale THEN amount ELSE 0 END) AS gross_sales, 0 - sum(CASE WHEN returned THEN amount ELSE 0 END) AS returns,
  0 - sum(CASE WHEN line_class = 'discount' THEN amount ELSE 0 END) AS discounts, 0 - sum(CASE WHEN line_class IN ('allowance', 'pooled_allowance') THEN amount ELSE 0 END) AS other_deductions,
  sum(CASE WHEN charge THEN amount ELSE 0 END) AS other_revenue, sum(amount) AS net_revenue, 0 - sum(CASE WHEN returned AND {LEAVING} THEN amount ELSE 0 END) AS returns_on_suggested_keys,
  sum(abs(amount)) AS money_moved FROM sc WHERE counted GROUP BY 1""")
add("m9_identity_violations", "SELECT CAST(0 AS INTEGER) AS nation, '' AS figure_scope WHERE FALSE")
over_lines("m32_line_summary", ORACLES["m9_revenue_identity"].split(LINES)[1].replace("SELECT figure_scope, sum(CASE WHEN sale", "SELECT *, (SELECT count(*) FROM lines WHERE txn_ts IS NULL AND line_class <> 'unmeasurable') AS undated_lines FROM (SELECT figure_scope, sum(CASE WHEN sale") + ") WHERE figure_scope = 'file'")
SIGN = "CASE WHEN amount > 0 THEN 'positive' WHEN amount < 0 THEN 'negative' ELSE 'no_money' END"
over_lines("m10_outside_revenue", SC + f"""SELECT line_class, figure_scope, CASE WHEN line_class = 'stock_in' THEN {SIGN} END AS sign, count(*) AS lines, coalesce(sum(amount), 0) AS amount,
  count(CASE WHEN amount IS NULL THEN 1 END) AS lines_without_amount FROM sc WHERE line_class IN ('gift_card_sale', 'gift_card_redemption', 'cost', 'adjustment', 'stock_in') GROUP BY 1, 2, 3""")
over_lines("m11_unclassified", "SELECT CAST(0 AS BIGINT) AS lines, CAST(0 AS DOUBLE) AS amount, CAST(0 AS DOUBLE) AS share_of_money_moved FROM lines LIMIT 1")
over_lines("m12_unmeasurable", SC + "SELECT figure_scope, CASE WHEN quantity IS NULL THEN 'no quantity' ELSE 'no price' END AS reason, count(*) AS lines FROM sc WHERE line_class = 'unmeasurable' GROUP BY 1, 2")
over_lines("m13_same_day_cancellations", SC + """, hit AS (SELECT customer, netting_key, txn_day FROM lines WHERE customer IS NOT NULL AND netting_key IS NOT NULL AND txn_day IS NOT NULL GROUP BY 1, 2, 3
    HAVING count(CASE WHEN line_class = 'customer_return' THEN 1 END) > 0 AND count(CASE WHEN line_class = 'sale' THEN 1 END) > 0)
  SELECT 'returns' AS measure, figure_scope, count(*) AS lines, sum(amount) AS amount, count(DISTINCT order_key) AS orders FROM sc WHERE line_class = 'customer_return' AND (customer, netting_key, txn_day) IN (SELECT (customer, netting_key, txn_day) FROM hit) GROUP BY 2
  UNION ALL SELECT 'sales', figure_scope, count(*), sum(amount), count(DISTINCT order_key) FROM sc WHERE line_class = 'sale' AND (customer, netting_key, txn_day) IN (SELECT (customer, netting_key, txn_day) FROM hit) GROUP BY 2
  UNION ALL SELECT 'returns_unchecked', figure_scope, count(*), sum(amount), count(DISTINCT order_key) FROM sc WHERE returned AND (customer IS NULL OR line_class = 'pooled_return') GROUP BY 2""")
over_lines("m14_returns_booked_as_in", SC + "SELECT CASE WHEN amount IS NULL THEN 'unknown' WHEN amount > 0 THEN 'positive' WHEN amount < 0 THEN 'negative' ELSE 'zero' END AS measure, figure_scope, count(*) AS lines, coalesce(sum(amount), 0) AS amount FROM sc WHERE line_class = 'stock_in' GROUP BY 1, 2")
over_lines("m15_unconfirmed_suggestions", SC + f""", o AS (SELECT figure_scope, order_key, bool_or(sale) AS s, bool_or(returned) AS r, bool_and(CASE WHEN sale THEN coalesce({LEAVING}, FALSE) END) AS so, bool_and(CASE WHEN returned THEN coalesce({LEAVING}, FALSE) END) AS ro FROM sc WHERE counted GROUP BY 1, 2),
  oo AS (SELECT figure_scope, count(CASE WHEN s AND so THEN 1 END) AS orders_only, count(CASE WHEN r AND ro THEN 1 END) AS return_orders_only FROM o GROUP BY 1)
  SELECT sc.figure_scope, count(CASE WHEN {LEAVING} THEN 1 END) AS lines, sum(CASE WHEN {LEAVING} THEN amount ELSE 0 END) AS amount, count(CASE WHEN {LEAVING} AND returned THEN 1 END) AS return_lines,
    sum(CASE WHEN {LEAVING} AND returned THEN amount ELSE 0 END) AS return_amount, max(orders_only) AS orders_only, max(return_orders_only) AS return_orders_only, count(DISTINCT CASE WHEN {LEAVING} THEN netting_key END) AS keys
  FROM sc JOIN oo ON sc.figure_scope = oo.figure_scope WHERE counted GROUP BY 1""")
over_lines("m16_unconfirmed_deductions", SC + "SELECT figure_scope, count(*) AS lines, sum(amount) AS amount FROM sc WHERE counted AND line_class IN ('allowance', 'pooled_allowance') GROUP BY 1")
over_lines("m17_other_types", SC + "SELECT kind AS measure, figure_scope, count(*) AS lines, sum(amount) AS amount FROM sc WHERE counted AND kind NOT IN ('in', 'out') GROUP BY 1, 2")
add("m18_note_figures", """SELECT 'other_transaction_types' AS code, unnest(['revenue','gross_sales','returns','other_deductions','return_rate','orders','aov','units','customers','products','diagnosis']) AS figure
  UNION ALL SELECT 'returns_booked_as_in', unnest(['revenue','returns','return_rate','aov','units','customers','products','diagnosis'])""")


_NONE = "CAST(NULL AS BIGINT) AS orders, CAST(NULL AS BIGINT) AS keys"


def _body(name: str) -> str:
    """A twin's query on lines and figure scopes that an outer WITH already holds."""
    rest = ORACLES[name].split(LINES)[1].removeprefix(SC).strip()
    return f"WITH {rest[1:]}" if rest.startswith(",") else rest


def _said(name: str, block: str, item: str, values: str) -> str:
    return f"SELECT figure_scope, '{block}' AS block, {item} AS item, {values} FROM ({_body(name)})"


_TERMS = {"gross_sales": "sale", "returns": "returned", "discounts": "line_class = 'discount'", "other_deductions": "line_class IN ('allowance', 'pooled_allowance')",
          "other_revenue": "charge", "net_revenue": "TRUE", "returns_on_suggested_keys": f"returned AND coalesce({LEAVING}, FALSE)"}
_FILE = "SELECT count(*) AS a, count(CASE WHEN txn_ts IS NULL AND line_class <> 'unmeasurable' THEN 1 END) AS u, count(CASE WHEN line_class = 'unmeasurable' AND quantity IS NULL THEN 1 END) AS q, count(CASE WHEN line_class = 'unmeasurable' AND quantity IS NOT NULL THEN 1 END) AS p FROM lines"
_HELD = (LINES + SC).replace("), lines AS (", "), lines AS MATERIALIZED (").replace(", sc AS (", ", sc AS MATERIALIZED (")
add("m32_file_summary", _HELD + " UNION ALL ".join([
    *(f"""SELECT i.figure_scope, 'identity' AS block, '{t}' AS item, n AS lines, {t} AS amount, CAST(0 AS BIGINT) AS without_amount, {_NONE} FROM ({_body("m9_revenue_identity")}) i
      JOIN (SELECT figure_scope, count(CASE WHEN {cond} THEN 1 END) AS n FROM sc WHERE counted GROUP BY 1) c ON c.figure_scope = i.figure_scope""" for t, cond in _TERMS.items()),
    _said("m10_outside_revenue", "outside_revenue", "concat_ws('/', line_class, sign)", f"lines, amount, lines_without_amount AS without_amount, {_NONE}"),
    _said("m14_returns_booked_as_in", "returns_booked_as_in", "measure", f"lines, amount, CASE WHEN measure = 'unknown' THEN lines ELSE 0 END AS without_amount, {_NONE}"),
    _said("m16_unconfirmed_deductions", "unconfirmed_deductions", "'all'", f"lines, amount, CAST(0 AS BIGINT) AS without_amount, {_NONE}"),
    *(f"SELECT 'file', '{b}', '{i}', {v}, CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), {_NONE} FROM ({_FILE})" for b, i, v in (
        ("lines", "all", "a"), ("lines", "undated", "u"), ("unmeasurable", "no quantity", "q"), ("unmeasurable", "no price", "p"), ("unmeasurable", "amount too large to add", "CAST(0 AS BIGINT)"))),
    *(f"SELECT 'file', 'customers', '{i}', {v}, CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), {_NONE} FROM (SELECT count(CASE WHEN receipt_fillable AND customer IS NULL AND NOT placeholder THEN 1 END) AS a, count(CASE WHEN placeholder AND counted AND customer IS NULL THEN 1 END) AS b FROM lines)"
      for i, v in (("unfilled receipt lines", "a"), ("placeholder lines", "b"))),
    _said("m13_same_day_cancellations", "same_day_cancellations", "measure", "lines, amount, CAST(NULL AS BIGINT), orders, CAST(NULL AS BIGINT)"),
    _said("m15_unconfirmed_suggestions", "unconfirmed_suggestions", "'all'", "lines, amount, CAST(NULL AS BIGINT), orders_only, keys"),
    _said("m15_unconfirmed_suggestions", "unconfirmed_suggestions", "'returns'", "return_lines, return_amount, CAST(NULL AS BIGINT), return_orders_only, CAST(NULL AS BIGINT)"),
    _said("m17_other_types", "other_transaction_types", "measure", "lines, amount, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)"),
]))


def rfm(where: str, ref: str) -> str:
    return f"""(WITH t AS (SELECT * FROM lines, p WHERE counted AND customer IS NOT NULL AND {where}), s AS (SELECT min(txn_day) AS s FROM t),
   g AS (SELECT customer, max({ref}) AS ref, CAST(max(CASE WHEN sale THEN txn_day END) AS DATE) AS last_purchase, count(DISTINCT CASE WHEN sale THEN order_key END) AS frequency, sum(amount) AS monetary FROM t GROUP BY 1),
   h AS (SELECT *, CAST(coalesce(ref - last_purchase, ref - s + 1) AS BIGINT) AS recency_days FROM g, s),
   bins AS (SELECT *, row_number() OVER (ORDER BY recency_days DESC) AS pr, row_number() OVER (ORDER BY frequency) AS pf, count(*) OVER () AS n FROM h WHERE frequency > 0),
   sc AS (SELECT customer, ceil(avg(CAST(greatest(1, (5 * (pr - 1) + n - 2) // (n - 1)) AS BIGINT)) OVER (PARTITION BY recency_days) - 0.5) AS r0, ceil(avg(CAST(greatest(1, (5 * (pf - 1) + n - 2) // (n - 1)) AS BIGINT)) OVER (PARTITION BY frequency) - 0.5) AS f0 FROM bins),
   z AS (SELECT h.customer, last_purchase, recency_days, frequency, monetary, CAST(coalesce(r0, 1) AS BIGINT) AS r_score, CAST(CASE WHEN frequency <= 1 THEN 1 ELSE f0 END AS BIGINT) AS f_score FROM h LEFT JOIN sc ON h.customer = sc.customer)
   SELECT *, CASE WHEN frequency = 0 THEN 'No purchases in file' WHEN r_score >= 4 AND f_score >= 4 THEN 'Champions' WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal' WHEN r_score <= 2 AND f_score >= 3 THEN 'At-risk'
     WHEN r_score <= 2 AND f_score <= 2 THEN 'Hibernating' WHEN r_score >= 4 AND f_score <= 1 THEN 'New' ELSE 'Needs Attention' END AS segment FROM z)"""


NOW, BEFORE = rfm("TRUE", "data_end + 1"), rfm("txn_day < cur", "cur")
over_lines("m19_rfm", "SELECT * FROM " + NOW)
over_lines("m22_segments", f""", now AS (SELECT * FROM {NOW}), was AS (SELECT segment, count(*) AS customers_previous FROM {BEFORE} GROUP BY 1), tot AS (SELECT sum(monetary) AS t FROM now)
  SELECT now.segment, count(*) AS customers, round(sum(monetary) * 100.0 / max(abs(t)), 4) AS revenue_share_pct, round(avg(monetary), 2) AS avg_monetary, coalesce(max(customers_previous), 0) AS customers_previous
  FROM tot, now LEFT JOIN was ON now.segment = was.segment GROUP BY 1""")
over_lines("m23_new_vs_returning", FIRST + """, c AS (SELECT customer, sum(amount) AS a FROM lines, p WHERE counted AND customer IS NOT NULL AND month = cur GROUP BY 1)
  SELECT count(CASE WHEN first_month = cur THEN 1 END) AS new_customers, count(CASE WHEN first_month = cur THEN NULL ELSE 1 END) AS returning_customers, sum(CASE WHEN first_month = cur THEN a ELSE 0 END) AS new_revenue,
    sum(CASE WHEN first_month = cur THEN 0 ELSE a END) AS returning_revenue FROM c JOIN first ON c.customer = first.customer, p""")
over_lines("m24_placeholder_lines", "SELECT count(CASE WHEN receipt_fillable AND customer IS NULL AND NOT placeholder THEN 1 END) AS unfilled_receipt_lines, count(CASE WHEN placeholder AND counted AND customer IS NULL THEN 1 END) AS placeholder_lines FROM lines")
over_lines("m24_unconfirmed_placeholders", """SELECT customer, count(*) AS lines, count(CASE WHEN month = cur THEN 1 END) AS lines_current, count(CASE WHEN month = prev THEN 1 END) AS lines_previous FROM lines, p
  WHERE counted AND customer IS NOT NULL GROUP BY 1 HAVING count(*) >= 60""")
PM = ", pm AS (SELECT CASE WHEN month = cur THEN 'cur' ELSE 'prev' END AS slot, l.* FROM lines l, p WHERE counted AND month IN (cur, prev))"
over_lines("m25_pareto", PM + """, r AS (SELECT product_key, sum(amount) AS rev FROM pm WHERE slot = 'cur' AND product_key IS NOT NULL GROUP BY 1 HAVING sum(amount) > 0), k AS (SELECT rev, sum(rev) OVER (ORDER BY rev DESC, product_key) AS c, sum(rev) OVER () AS t, count(*) OVER () AS n FROM r)
  SELECT least(count(CASE WHEN c < t * 0.8 THEN 1 END) + 1, max(n)) AS products_for_80pct, max(n) AS total_products, round(least(count(CASE WHEN c < t * 0.8 THEN 1 END) + 1, max(n)) * 100.0 / max(n), 4) AS concentration_pct FROM k""")
PN = """, y AS (SELECT nation, CASE WHEN max(txn_day) = last_day(max(txn_day)) THEN CAST(date_trunc('month', max(txn_day)) AS DATE) ELSE CAST(date_trunc('month', max(txn_day)) - INTERVAL 1 MONTH AS DATE) END AS cur, min(txn_day) AS data_start, max(txn_day) AS data_end FROM lines GROUP BY 1),
  pn AS (SELECT nation, cur, CAST(cur - INTERVAL 1 MONTH AS DATE) AS prev, data_start, data_end FROM y),
  ln AS (SELECT CASE WHEN l.month = pn.cur THEN 'cur' ELSE 'prev' END AS slot, l.* FROM lines l JOIN pn ON l.nation = pn.nation WHERE counted AND l.month IN (pn.cur, pn.prev))"""
over_lines("m25_pareto_by_nation", PN + """, r AS (SELECT nation, product_key, sum(amount) AS rev FROM ln WHERE slot = 'cur' AND product_key IS NOT NULL GROUP BY 1, 2 HAVING sum(amount) > 0),
  k AS (SELECT nation, sum(rev) OVER (PARTITION BY nation ORDER BY rev DESC, product_key) AS c, sum(rev) OVER (PARTITION BY nation) AS t, count(*) OVER (PARTITION BY nation) AS n FROM r)
  SELECT nation, least(count(CASE WHEN c < t * 0.8 THEN 1 END) + 1, max(n)) AS products_for_80pct, max(n) AS total_products FROM k GROUP BY 1""")
over_lines("m26_top_products", LABELS + PM + """SELECT row_number() OVER (ORDER BY revenue DESC, product_label) AS rank, product_label, revenue, round(units) AS units FROM (
  SELECT product_key, sum(amount) AS revenue, sum(CASE WHEN sale THEN quantity ELSE 0 END) AS units FROM pm WHERE slot = 'cur' AND product_key IS NOT NULL GROUP BY 1 HAVING sum(amount) > 0) r JOIN labels USING (product_key) QUALIFY rank <= 10""")
over_lines("m27_decliners", LABELS + PM + """, d AS (SELECT product_key, coalesce(sum(CASE WHEN slot = 'cur' THEN amount END), 0) AS c, sum(CASE WHEN slot = 'prev' THEN amount END) AS b FROM pm WHERE product_key IS NOT NULL GROUP BY 1)
  SELECT row_number() OVER (ORDER BY c - b, product_label) AS rank, product_label, c - b AS revenue_change, CASE WHEN b > 0 THEN round((c - b) * 100.0 / b, 4) END AS change_pct, CASE WHEN b = 0 THEN 'no_previous_value' WHEN b < 0 THEN 'previous_is_negative' END AS reason
  FROM d JOIN labels USING (product_key) WHERE b IS NOT NULL AND c < b QUALIFY rank <= 10""")
over_lines("m28_categories", PM + """, t AS (SELECT sum(CASE WHEN slot = 'cur' THEN amount ELSE -amount END) AS d FROM pm)
  SELECT category_key, sum(CASE WHEN slot = 'cur' THEN amount ELSE 0 END) AS revenue_current, sum(CASE WHEN slot = 'prev' THEN amount ELSE 0 END) AS revenue_previous,
    round(sum(CASE WHEN slot = 'cur' THEN amount ELSE -amount END) * 100.0 / max(d), 4) AS contribution_pct FROM pm, t WHERE category_key IS NOT NULL GROUP BY 1""")
over_lines("m29_breakdown", PM + """SELECT 'value' AS kind, segment AS member, sum(CASE WHEN slot = 'cur' THEN amount ELSE 0 END) AS revenue_current, sum(CASE WHEN slot = 'prev' THEN amount ELSE 0 END) AS revenue_previous,
  sum(CASE WHEN slot = 'cur' THEN amount ELSE -amount END) AS change, CAST(NULL AS VARCHAR) AS withheld FROM pm GROUP BY 2""")
over_lines("m29_breakdown_folded", PM + """, b AS (SELECT lower('B' || CAST(length(product_name) * 7 + ascii(product_name) AS VARCHAR)) AS k, sum(CASE WHEN slot = 'cur' THEN amount ELSE 0 END) AS c, sum(CASE WHEN slot = 'prev' THEN amount ELSE 0 END) AS w FROM pm GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY c + w DESC, k) AS rk, count(*) OVER () AS n FROM b)
  SELECT CASE WHEN n <= 9 OR rk <= 8 THEN 'value' ELSE 'other' END AS kind, CASE WHEN n <= 9 OR rk <= 8 THEN upper(k) ELSE 'Other (' || CAST(n - 8 AS VARCHAR) || ' values)' END AS member, sum(c) AS revenue_current, sum(w) AS revenue_previous FROM r GROUP BY 1, 2""")
over_lines("m30_split_values", "SELECT lower(priority) AS split_key, FALSE AS first_line_only, count(*) AS lines FROM lines GROUP BY 1")
over_lines("m31_breakdown_measures", """SELECT 'priority' AS "column", FALSE AS first_line_only, count(DISTINCT priority) AS value_count, count(*) AS units, CAST(0 AS BIGINT) AS blank_units, count(DISTINCT order_key) AS purchases, FALSE AS sale_or_return FROM lines WHERE counted
  UNION ALL SELECT 'segment', FALSE, count(DISTINCT segment), count(*), 0, count(DISTINCT order_key), FALSE FROM lines WHERE counted""")
add("m35_eligible_columns", """SELECT 'priority' AS "column", TRUE AS eligible, CAST(NULL AS VARCHAR) AS refusal UNION ALL SELECT 'segment', TRUE, NULL UNION ALL SELECT 'quantity', FALSE, 'numbers' UNION ALL SELECT 'order_id', FALSE, 'lines_not_read'""")
over_lines("m34_trend", CAL + CORE_CTE + """, s AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM core WHERE month IS NOT NULL)
  SELECT s.month, revenue, orders, s.month IN (SELECT month FROM comp) AS complete, revenue IS NULL AS is_gap FROM s LEFT JOIN core ON s.month = core.month""")

# --- trust
over_lines("d1_trading_pace", "SELECT month, count(*) AS trading_days, round(avg(r), 2) AS revenue_per_day FROM (SELECT month, txn_day, sum(amount) AS r FROM lines WHERE counted GROUP BY 1, 2 HAVING bool_or(sale)) GROUP BY 1")
ZERO = PN + """, hc AS (SELECT nation, CAST(m AS DATE) AS month, cur FROM (SELECT pn.*, unnest(generate_series(date_trunc('month', data_start), date_trunc('month', data_end), INTERVAL 1 MONTH)) AS m FROM pn)
    WHERE CAST(m AS DATE) >= data_start AND last_day(CAST(m AS DATE)) <= data_end AND CAST(m AS DATE) < cur), hn AS (SELECT nation, month FROM hc QUALIFY row_number() OVER (PARTITION BY nation ORDER BY month DESC) <= 24),
  dd AS (SELECT nation, month, CAST(unnest(generate_series(month, last_day(month), INTERVAL 1 DAY)) AS DATE) AS d FROM hn), td AS (SELECT DISTINCT nation, txn_day FROM lines WHERE sale),
  zd AS (SELECT dd.nation, dd.month, isodow(d) - 1 AS weekday, count(*) AS days, count(CASE WHEN txn_day IS NULL THEN 1 END) AS zeros FROM dd LEFT JOIN td ON dd.nation = td.nation AND d = txn_day GROUP BY 1, 2, 3),
  wr AS (SELECT nation, weekday, CAST(sum(zeros) AS BIGINT) AS zeros, CAST(sum(days) AS BIGINT) AS days, sum(zeros) / sum(days) AS zero_rate FROM zd GROUP BY 1, 2)"""
over_lines("d2_zero_days", ZERO + "SELECT nation, month, weekday, days, zeros FROM zd")
over_lines("d3_weekday_rates", ZERO + "SELECT nation, weekday, zeros, days, round(zero_rate, 6) AS zero_rate FROM wr")
over_lines("d3_expected_zero_days", ZERO + """, e AS (SELECT zd.nation, zd.month, CAST(sum(zd.zeros) AS BIGINT) AS observed, sum(zd.days) AS len, sum(zd.days * zero_rate) AS pattern FROM zd JOIN wr ON zd.nation = wr.nation AND zd.weekday = wr.weekday GROUP BY 1, 2)
  SELECT nation, month, observed, round(pattern, 4) AS pattern, round(pattern + greatest(0, coalesce(av, 0)), 4) AS expected FROM (
    SELECT e.nation, e.month, e.observed, e.pattern, avg((o.observed - o.pattern) * e.len / o.len) AS av FROM e LEFT JOIN e o ON o.nation = e.nation AND o.month <> e.month AND month(o.month) = month(e.month) GROUP BY ALL)""")
over_lines("d4_leave_one_out", ZERO + """, lo AS (SELECT t.nation, t.month AS target, z.weekday, coalesce(sum(CASE WHEN z.month <> t.month THEN z.zeros END) / nullif(sum(CASE WHEN z.month <> t.month THEN z.days END), 0), 0) AS rate FROM hn t JOIN zd z ON t.nation = z.nation GROUP BY 1, 2, 3),
  pr AS (SELECT lo.nation, lo.target, z.month, sum(z.zeros) AS obs, sum(z.days) AS len, sum(z.days * rate) AS pat FROM lo JOIN zd z ON lo.nation = z.nation AND lo.weekday = z.weekday GROUP BY 1, 2, 3),
  own AS (SELECT * FROM pr WHERE target = month), oth AS (SELECT o.nation, o.target, greatest(0, avg((o.obs - o.pat) / o.len)) AS s FROM pr o WHERE o.target <> o.month AND month(o.target) = month(o.month) GROUP BY 1, 2)
  SELECT own.nation, own.month, CAST(obs AS BIGINT) AS observed, round(pat, 4) AS pattern, round(coalesce(s * len, 0), 4) AS season, round(obs - pat - coalesce(s * len, 0), 4) AS excess FROM own LEFT JOIN oth ON own.nation = oth.nation AND own.target = oth.target""")
PRICE = PN + ", md AS (SELECT nation, slot, category_key, median(unit_price) AS m, count(*) AS n FROM ln WHERE category_key IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3)"
over_lines("d9_price_medians", PRICE + "SELECT nation, slot, category_key AS category, round(m, 4) AS median_price, n FROM md")
over_lines("d9_price_level", PRICE + """, r AS (SELECT c.nation, c.m / b.m AS ratio FROM md c JOIN md b ON c.nation = b.nation AND c.category_key = b.category_key WHERE c.slot = 'cur' AND b.slot = 'prev' AND b.m > 0),
  g AS (SELECT nation, count(*) AS n, median(ratio) AS m, avg(CASE WHEN ratio >= 5 OR ratio <= 0.2 THEN 1.0 ELSE 0.0 END) AS e FROM r GROUP BY 1)
  SELECT pn.nation, CASE WHEN coalesce(n, 0) < 3 THEN 'inconclusive' WHEN e >= 0.8 THEN 'caution' ELSE 'ok' END AS status, coalesce(n, 0) AS comparable_products, round(m, 6) AS median_ratio, round(e, 6) AS share_extreme FROM pn LEFT JOIN g ON pn.nation = g.nation""")
over_lines("d10_flagged_rows", PM + """, s AS (SELECT avg(CASE WHEN slot = 'cur' THEN CASE WHEN sku IS NULL THEN 1.0 ELSE 0.0 END END) AS c, avg(CASE WHEN slot = 'prev' THEN CASE WHEN sku IS NULL THEN 1.0 ELSE 0.0 END END) AS b FROM pm)
  SELECT CASE WHEN c >= 2 * b AND c >= 0.02 THEN 'caution' ELSE 'ok' END AS status, round(c, 6) AS flagged_share_cur, round(b, 6) AS flagged_share_prev FROM s""")
over_lines("d11_uncategorised", PM + "SELECT slot, round(sum(CASE WHEN category_key IS NULL THEN amount ELSE 0 END) / sum(amount), 6) AS uncategorised_share FROM pm GROUP BY 1")

# --- calendar and signals
over_lines("g1_history", CAL + "SELECT month FROM hist")
WK = CAL + """, dr AS (SELECT txn_day, sum(amount) AS r FROM lines WHERE counted GROUP BY 1), hd AS (SELECT CAST(unnest(generate_series(month, last_day(month), INTERVAL 1 DAY)) AS DATE) AS d FROM hist),
  ww AS (SELECT isodow(d) - 1 AS weekday, median(coalesce(r, 0)) AS weight, count(*) AS dates FROM hd LEFT JOIN dr ON d = txn_day GROUP BY 1)"""
over_lines("g2_weekday_weights", WK + "SELECT weekday, round(weight, 4) AS weight, dates FROM ww")
over_lines("g3_calendar_effect", WK + CORE_CTE + """, ex AS (SELECT m, sum(weight) AS e FROM (SELECT cur AS m, CAST(unnest(generate_series(cur, last_day(cur), INTERVAL 1 DAY)) AS DATE) AS d FROM p UNION ALL SELECT prev, CAST(unnest(generate_series(prev, last_day(prev), INTERVAL 1 DAY)) AS DATE) FROM p) JOIN ww ON isodow(d) - 1 = weekday GROUP BY 1),
  v AS (SELECT (SELECT e FROM ex WHERE m = cur) AS ec, (SELECT e FROM ex WHERE m = prev) AS ep, (SELECT revenue FROM core WHERE month = cur) AS rc, (SELECT revenue FROM core WHERE month = prev) AS rp FROM p)
  SELECT 'weekday_weights' AS method, round(ec, 4) AS expected_cur, round(ep, 4) AS expected_prev, round(rp * (ec / ep - 1), 2) AS calendar_effect, round(rc - rp - rp * (ec / ep - 1), 2) AS adjusted_change FROM v""")
SER = CAL + CORE_CTE + """, t AS MATERIALIZED (SELECT c.month, coalesce(revenue, 0) AS revenue, coalesce(orders, 0) AS orders, coalesce(units, 0) AS units, coalesce(return_orders, 0) AS ret, coalesce(active_customers, 0) AS ac, coalesce(buyers, 0) AS buyers, core.month IS NULL AS empty FROM comp c LEFT JOIN core ON c.month = core.month),
  ser AS MATERIALIZED (SELECT month, 'revenue' AS series, CAST(revenue AS DOUBLE) AS value FROM t UNION ALL SELECT month, 'orders', orders FROM t UNION ALL SELECT month, 'active_customers', CASE WHEN ac > 0 OR empty THEN ac END FROM t
    UNION ALL SELECT month, 'frequency', CASE WHEN buyers > 0 THEN orders / buyers WHEN orders = 0 THEN 0 END FROM t UNION ALL SELECT month, 'aov', coalesce(revenue / nullif(orders, 0), 0) FROM t
    UNION ALL SELECT month, 'units_per_order', coalesce(units / nullif(orders, 0), 0) FROM t UNION ALL SELECT month, 'price_per_unit', coalesce(revenue / nullif(units, 0), 0) FROM t UNION ALL SELECT month, 'return_rate', coalesce(ret / nullif(orders, 0), 0) FROM t),
  ty AS MATERIALIZED (SELECT series, median(abs(value)) AS typ FROM ser WHERE month IN (SELECT month FROM hist) AND abs(value) > 0 GROUP BY 1),
  yy AS (SELECT s.series, s.month, s.value, b.value AS base, typ FROM ser s LEFT JOIN ty ON ty.series = s.series LEFT JOIN ser b ON s.series = b.series AND b.month = CAST(s.month - INTERVAL 12 MONTH AS DATE)),
  yo AS (SELECT series, month, value, CASE WHEN base > 0 AND base >= 0.03 * typ THEN (value - base) / base * 100 END AS yoy FROM yy)"""
over_lines("g4_monthly_series", SER + "SELECT month, series, round(value, 4) AS value FROM ser")
# Each of its tables reads the lines again: they are computed once.
add("g5_year_over_year", LINES.replace("), lines AS (", "), lines AS MATERIALIZED (") + SER + "SELECT series, month, round(yoy, 4) AS yoy FROM yo")
over_lines("g8_signals", SER + """, b AS (SELECT series, yoy, abs(yoy - lag(yoy) OVER (PARTITION BY series ORDER BY month)) AS mr FROM yo WHERE month IN (SELECT month FROM hist) AND yoy IS NOT NULL),
  l AS (SELECT series, avg(yoy) AS c, greatest(2.0, CASE WHEN median(mr) > 0 THEN 3.145 * median(mr) ELSE 2.66 * avg(mr) END) AS s, CASE WHEN 2.0 > CASE WHEN median(mr) > 0 THEN 3.145 * median(mr) ELSE 2.66 * avg(mr) END THEN 'minimum_spread' WHEN median(mr) > 0 THEN 'median_moving_range' ELSE 'mean_moving_range' END AS lm FROM b GROUP BY 1),
  n AS (SELECT series, yoy AS v FROM yo, p WHERE month = cur), run AS (SELECT series, list(yoy ORDER BY month DESC)[1:7] AS r FROM yo WHERE month IN (SELECT month FROM hist) GROUP BY 1)
  SELECT l.series, 'yoy' AS mode, round(v, 4) AS value_cur, round(c, 4) AS center, round(c - s, 3) AS lower, round(c + s, 3) AS upper,
    CASE WHEN v > c + s + 1e-6 THEN 'above' WHEN v < c - s - 1e-6 THEN 'below' WHEN v > c AND len(list_filter(r, lambda x: x > c)) = 7 THEN 'above' WHEN v < c AND len(list_filter(r, lambda x: x < c)) = 7 THEN 'below' ELSE 'within' END AS signal, lm AS limits_method
  FROM l JOIN n ON l.series = n.series JOIN run ON l.series = run.series""")
over_lines("g9_movement", CAL + CORE_CTE + """, h AS (SELECT hist.month, coalesce(revenue, 0) AS r FROM hist LEFT JOIN core ON hist.month = core.month), m AS (SELECT abs((r - lag(r) OVER (ORDER BY month)) * 100.0 / lag(r) OVER (ORDER BY month)) AS m FROM h),
  c AS (SELECT ((SELECT revenue FROM core WHERE month = cur) / (SELECT revenue FROM core WHERE month = prev) - 1) * 100 AS c FROM p)
  SELECT round(c, 4) AS change_pct, round((SELECT median(m) FROM m), 4) AS typical_pct, (SELECT count(m) FROM m) AS movements, abs(c) >= 2 * (SELECT median(m) FROM m) AS singled_out, CAST(NULL AS VARCHAR) AS reason FROM c""")
WIN = CAL + CORE_CTE + """, w0 AS (SELECT core.month, revenue, row_number() OVER (ORDER BY core.month DESC) - 1 AS k, datediff('month', core.month, cur) AS back FROM core, p WHERE core.month IN (SELECT month FROM comp) AND core.month <= cur),
  win AS (SELECT month, revenue, count(*) OVER () - 1 - k AS position, count(*) OVER () AS n FROM w0 WHERE k = back)"""
over_lines("g10_season_comparison", WIN + """, ch AS (SELECT month, (revenue / lag(revenue) OVER (ORDER BY month) - 1) * 100 AS c FROM win), pa AS (SELECT a.month, a.c, b.c AS a0 FROM ch a LEFT JOIN ch b ON b.month = CAST(a.month - INTERVAL 12 MONTH AS DATE)),
  f AS (SELECT (SELECT c FROM ch WHERE month = cur) AS now, (SELECT median(c) FROM ch WHERE month < cur AND datediff('month', month, cur) % 12 = 0) AS ex, (SELECT count(c) FROM ch WHERE month < cur AND datediff('month', month, cur) % 12 = 0) AS years,
    (SELECT median(abs(c - a0)) FROM pa WHERE month <> cur) AS typ, (SELECT count(c - a0) FROM pa WHERE month <> cur) AS differences FROM p)
  SELECT round(now, 4) AS change_pct, round(ex, 4) AS expected_change_pct, years, round(now - ex, 4) AS difference_pct, round(typ, 4) AS typical_pct, differences,
    CASE WHEN abs(now - ex) < 2 * typ THEN 'consistent' WHEN abs(now - ex) < 4 * typ THEN 'inconclusive' WHEN now < ex THEN 'shortfall' ELSE 'excess' END AS band FROM f""")

# --- lenses
LEV = PAIR + """, v AS (SELECT a.revenue AS r1, b.revenue AS r0, CAST(a.orders AS DOUBLE) AS o1, CAST(b.orders AS DOUBLE) AS o0, CAST(a.buyers AS DOUBLE) AS c1, CAST(b.buyers AS DOUBLE) AS c0, a.units AS u1, b.units AS u0, a.orders / a.buyers AS f1, b.orders / b.buyers AS f0, a.revenue / a.orders AS a1, b.revenue / b.orders AS a0 FROM a, b),
  e AS (SELECT *, (c1 - c0) * (2 * f0 * a0 + f0 * a1 + f1 * a0 + 2 * f1 * a1) / 6 AS pc, (f1 - f0) * (2 * c0 * a0 + c0 * a1 + c1 * a0 + 2 * c1 * a1) / 6 AS pf, (a1 - a0) * (2 * c0 * f0 + c0 * f1 + c1 * f0 + 2 * c1 * f1) / 6 AS pa, (o1 - o0) * (a0 + a1) / 2 AS po, (a1 - a0) * (o0 + o1) / 2 AS p2 FROM v)"""
over_lines("a3_lever", CAL + LEV + """, ty AS (SELECT median(abs(revenue)) AS t FROM core WHERE month IN (SELECT month FROM hist)), x AS (SELECT *, (abs(pc) + abs(pf) + abs(pa)) / abs(r1 - r0) AS g FROM e)
  SELECT 'customers*frequency*aov' AS formula, round(pc, 2) AS customers_effect, round(pf, 2) AS frequency_effect, round(pa, 2) AS aov_effect, round(po, 2) AS pair_orders_effect, round(p2, 2) AS pair_aov_effect, round(g, 4) AS gross_to_net,
    abs(r1 - r0) < 0.25 * greatest(r0, r1) AND g >= 3 AND greatest(po, p2) >= 0.25 * greatest(t, r0, r1) AND least(po, p2) <= -0.25 * greatest(t, r0, r1) AS masked_shift_alert FROM x, ty""")
over_lines("a4_lever_level2", LEV + """SELECT CAST(NULL AS VARCHAR) AS level2_reason, round(pa * ((u1 / o1 - u0 / o0) * (r0 / u0 + r1 / u1) / 2) / (a1 - a0), 2) AS units_per_order_effect,
  round(pa * ((r1 / u1 - r0 / u0) * (u0 / o0 + u1 / o1) / 2) / (a1 - a0), 2) AS price_per_unit_effect FROM e""")
over_lines("a9_returns_lens", PAIR + " UNION ALL ".join(
    f"SELECT '{t}' AS term, b.{t} AS previous, a.{t} AS current, {s}(a.{t} - b.{t}) AS effect FROM a, b" for t, s in (("gross_sales", ""), ("returns", "0 - "), ("deductions", "0 - "), ("charges", ""))))
ORACLES["a9_returns_lens"] = ORACLES["a9_returns_lens"].replace("SELECT core.* FROM core, p WHERE month = prev)UNION", "SELECT core.* FROM core, p WHERE month = prev) UNION")
TRANS = FIRST + """, tr AS (SELECT 'current' AS transition, prev AS m0, cur AS m1 FROM p UNION ALL SELECT 'previous', CAST(prev - INTERVAL 1 MONTH AS DATE), prev FROM p),
  cm AS (SELECT customer, month, sum(amount) AS a FROM lines WHERE counted GROUP BY 1, 2),
  cc AS (SELECT transition, cm.customer, max(m1) AS m1, sum(CASE WHEN month = m0 THEN a END) AS b, sum(CASE WHEN month = m1 THEN a END) AS c FROM cm, tr WHERE month IN (m0, m1) AND cm.customer IS NOT NULL GROUP BY 1, 2),
  ck AS (SELECT cc.*, first_month, CASE WHEN c IS NOT NULL AND first_month = m1 THEN 'new' WHEN c IS NOT NULL AND b IS NOT NULL THEN 'retained' WHEN c IS NOT NULL THEN 'resurrected' ELSE 'lapsed' END AS k FROM cc JOIN first ON cc.customer = first.customer)"""
over_lines("a10_customer_classes", TRANS + "SELECT transition, k AS customer_class, count(*) AS customers, sum(c) AS cur, sum(b) AS prev FROM ck GROUP BY 1, 2")
over_lines("a11_customer_bridge", TRANS + """SELECT ck.transition, sum(CASE WHEN k = 'new' THEN c - coalesce(b, 0) ELSE 0 END) AS new, sum(CASE WHEN k = 'resurrected' THEN c ELSE 0 END) AS resurrected, sum(CASE WHEN k = 'retained' THEN greatest(0, c - b) ELSE 0 END) AS expansion,
  0 - sum(CASE WHEN k = 'retained' THEN greatest(0, b - c) ELSE 0 END) AS contraction, 0 - sum(CASE WHEN k = 'lapsed' THEN b ELSE 0 END) AS lapsed,
  max(un) AS unattributed, count(CASE WHEN k = 'new' THEN 1 END) AS new_customers
  FROM ck JOIN (SELECT transition, coalesce(sum(CASE WHEN month = tr.m1 THEN a END), 0) - coalesce(sum(CASE WHEN month = tr.m0 THEN a END), 0) AS un FROM tr, cm WHERE cm.customer IS NULL GROUP BY 1) un ON ck.transition = un.transition GROUP BY 1""")
over_lines("a12_product_lens", PM + """, k AS (SELECT product_key, coalesce(sum(CASE WHEN slot = 'prev' THEN quantity END), 0) AS q0, coalesce(sum(CASE WHEN slot = 'cur' THEN quantity END), 0) AS q1, coalesce(sum(CASE WHEN slot = 'prev' THEN amount END), 0) AS g0, coalesce(sum(CASE WHEN slot = 'cur' THEN amount END), 0) AS g1 FROM pm WHERE sale GROUP BY 1),
  lv AS (SELECT *, g0 / q0 AS p0, g1 / q1 AS p1 FROM k WHERE product_key IS NOT NULL AND q0 > 0 AND q1 > 0), t AS (SELECT sum(q0) AS a, sum(q1) AS b FROM lv),
  s AS (SELECT max(a) AS q0, max(b) AS q1, sum(q0 / a * p0) AS c00, sum(q0 / a * p1) AS c01, sum(q1 / b * p0) AS c10, sum(q1 / b * p1) AS c11, count(*) AS n FROM lv, t)
  SELECT round((q1 - q0) * (2 * c00 + c01 + c10 + 2 * c11) / 6, 1) AS volume, round((2 * q0 * (c10 - c00) + q0 * (c11 - c01) + q1 * (c10 - c00) + 2 * q1 * (c11 - c01)) / 6, 1) AS mix,
    round((2 * q0 * (c01 - c00) + q0 * (c11 - c10) + q1 * (c01 - c00) + 2 * q1 * (c11 - c10)) / 6, 1) AS price,
    (SELECT round(coalesce(sum(g1), 0), 1) FROM k WHERE product_key IS NOT NULL AND q1 > 0 AND q0 = 0) AS new_products, (SELECT round(0 - coalesce(sum(g0), 0), 1) FROM k WHERE product_key IS NOT NULL AND q0 > 0 AND q1 = 0) AS discontinued_products,
    (SELECT round(coalesce(sum(g1 - g0), 0), 1) FROM k WHERE product_key IS NULL) AS unidentified, n AS live_products FROM s""")
MEM = """, g AS (SELECT key, max(label) AS label, coalesce(sum(CASE WHEN slot = 'prev' THEN amount END), 0) AS b, coalesce(sum(CASE WHEN slot = 'cur' THEN amount END), 0) AS c, greatest(count(DISTINCT CASE WHEN slot = 'prev' AND sale THEN order_key END), count(DISTINCT CASE WHEN slot = 'cur' AND sale THEN order_key END)) AS o,
    coalesce(sum(CASE WHEN slot = 'prev' AND sale THEN amount END), 0) AS sb, coalesce(sum(CASE WHEN slot = 'cur' AND sale THEN amount END), 0) AS sc FROM dm GROUP BY key),
  tt AS (SELECT sum(c) - sum(b) AS d, sum(abs(b)) AS base, count(*) AS n FROM g), z AS (SELECT g.*, d, n, abs(b) / base >= 0.02 OR o >= 30 AS big, bool_or(abs(b) / base >= 0.02 OR o >= 30) OVER () AS any_big FROM g, tt),
  rk AS (SELECT *, row_number() OVER (ORDER BY abs(c - b) DESC, key) AS r FROM z WHERE NOT any_big OR n <= 5 OR big),
  out AS (SELECT r AS rank, label, b AS rev_prev, c AS rev_cur, c - b AS delta, key LIKE '#UN%' AS is_data_gap, d, n FROM rk WHERE r <= 5
    UNION ALL SELECT 6, 'Other', sum(b), sum(c), sum(c - b), FALSE, max(d), max(n) FROM z WHERE key NOT IN (SELECT key FROM rk WHERE r <= 5) HAVING count(*) > 0)"""
over_lines("a14_category_members", PM + ", fl AS (SELECT category_key, min_by(category_label, line_no) AS fl FROM lines WHERE category_key IS NOT NULL GROUP BY 1), dm AS (SELECT pm.*, coalesce(pm.category_key, '#UNCATEGORISED') AS key, coalesce(fl, '(uncategorised)') AS label FROM pm LEFT JOIN fl ON pm.category_key = fl.category_key)" + MEM
           + "SELECT 'category' AS dimension, rank, label, rev_prev, rev_cur, delta, round(delta / d, 6) AS share_of_change, is_data_gap FROM out")
PRODM = LABELS + PM + ", dm AS (SELECT pm.*, CASE WHEN answered_class IN ('charge', 'discount') THEN '#NOT_A_PRODUCT' ELSE coalesce(pm.product_key, '#UNNAMED_PRODUCT') END AS key, CASE WHEN answered_class IN ('charge', 'discount') THEN '(not a product)' ELSE coalesce(product_label, '(no product name)') END AS label FROM pm LEFT JOIN labels ON pm.product_key = labels.product_key)" + MEM
over_lines("a14_product_members", PRODM + "SELECT rank, label, rev_prev, rev_cur, delta, n AS member_count FROM out")
over_lines("a14_new_and_removed", PRODM + """SELECT 'product' AS dimension, max(label) AS label, CASE WHEN bool_or(slot = 'cur') THEN 'new' ELSE 'removed' END AS status, sum(amount) AS revenue FROM dm WHERE key NOT LIKE '#%' GROUP BY key HAVING count(DISTINCT slot) = 1""")
over_lines("a15_customer_type_members", TRANS + PM + ", dm AS (SELECT pm.*, coalesce(k, '#UNCATEGORISED') AS key, coalesce(k, '(no customer)') AS label FROM pm LEFT JOIN ck ON pm.customer = ck.customer AND ck.transition = 'current')" + MEM + "SELECT label, rev_prev, rev_cur, delta, is_data_gap FROM out")
over_lines("a16_breadth", PRODM + """, q AS (SELECT *, c - b AS dl, sc - sb AS sd FROM g WHERE key NOT LIKE '#%'), pc AS (SELECT sum(sd) AS pcs, sum(CASE WHEN b > 0 THEN b END) AS pb, max(abs(dl)) AS top, sum(abs(dl)) AS mv FROM q),
  y AS (SELECT (SELECT coalesce(sum(b), 0) FROM q, pc WHERE b > 0 AND dl <> 0 AND (dl > 0) = (pcs > 0)) / pb AS db, top / mv AS ts, pcs / d AS sh, (pcs - 0.5 * d > 0) = (d > 0) AS inside FROM pc, tt)
  SELECT round(db, 6) AS declining_base_share, round(ts, 6) AS top_member_share, CASE WHEN NOT inside THEN 'outside_products' WHEN db >= 0.7 THEN 'broad' WHEN ts >= 0.5 THEN 'concentrated' ELSE 'mixed' END AS classification, round(sh, 6) AS products_share_of_change FROM y""")
over_lines("a17_mix_rate", PM + """, k AS (SELECT coalesce(category_key, '#') AS key, coalesce(sum(CASE WHEN slot = 'prev' THEN amount END), 0) AS r0, coalesce(sum(CASE WHEN slot = 'cur' THEN amount END), 0) AS r1, coalesce(sum(CASE WHEN slot = 'prev' THEN units END), 0) AS w0, coalesce(sum(CASE WHEN slot = 'cur' THEN units END), 0) AS w1 FROM pm GROUP BY 1), t AS (SELECT sum(w0) AS a, sum(w1) AS b FROM k)
  SELECT 'price_per_unit' AS metric, round(sum((w1 / b - w0 / a) * (r0 / w0 + r1 / w1) / 2), 4) AS mix, round(sum((r1 / w1 - r0 / w0) * (w0 / a + w1 / b) / 2), 4) AS rate FROM k, t""")
add("a13_reconciliation", "SELECT CAST(0 AS INTEGER) AS nation, '' AS lens, TRUE AS reconciles WHERE FALSE")
del ORACLES["a13_reconciliation"]
over_lines("h14_change_to_explain", PAIR + "SELECT b.revenue AS revenue_prev, a.revenue AS revenue_cur, a.revenue - b.revenue AS net, a.gross_sales - b.gross_sales AS gross, a.money_moved + b.money_moved AS moved FROM a, b")
over_lines("h15_year_ago", CORE_CTE + """SELECT CAST(cur - INTERVAL 12 MONTH AS DATE) AS ly_current, CAST(prev - INTERVAL 12 MONTH AS DATE) AS ly_previous, a.revenue AS ly_cur, b.revenue AS ly_prev FROM p JOIN core a ON a.month = CAST(cur - INTERVAL 12 MONTH AS DATE) JOIN core b ON b.month = CAST(prev - INTERVAL 12 MONTH AS DATE)""")
over_lines("h12_named_suggestions", LABELS + PM + """, d AS (SELECT product_key, coalesce(sum(CASE WHEN slot = 'cur' THEN amount END), 0) AS c, sum(CASE WHEN slot = 'prev' THEN amount END) AS b FROM pm WHERE product_key IS NOT NULL GROUP BY 1),
  w AS (SELECT product_key, product_label FROM d JOIN labels USING (product_key) WHERE b IS NOT NULL AND c < b ORDER BY c - b, product_label LIMIT 10)
  SELECT product_label, max(suggested_class) AS suggested_class FROM w JOIN lines l ON l.product_key = w.product_key AND l.item_key = l.product_key WHERE suggested_class IS NOT NULL GROUP BY 1""")

# --- season and forecast
over_lines("f1_season_window", WIN + "SELECT month, revenue, position, n FROM win")
RAT = WIN + """, k AS (SELECT month, revenue, n, position, position - (n - n // 12 * 12) AS i, ln(revenue) AS y FROM win WHERE position >= n - n // 12 * 12), sl AS (SELECT median(d) / 12 AS s FROM (SELECT y - lag(y, 12) OVER (ORDER BY i) AS d FROM k)), lv AS (SELECT avg(y - s * i) AS l FROM k, sl),
  rat AS (SELECT month, revenue, n, position, i, month(month) AS moy, i // 12 AS year, exp(y - l - s * i) AS ratio FROM k, sl, lv)"""
over_lines("f2_detrended", RAT + "SELECT month, year, round(ratio, 6) AS ratio FROM rat")
IDX = RAT + """, ys AS (SELECT DISTINCT year FROM rat UNION ALL SELECT -1), rw AS (SELECT ys.year AS set_no, moy, avg(ratio) AS r FROM ys JOIN rat ON rat.year <> ys.year GROUP BY 1, 2), idx AS (SELECT set_no, moy, r / (sum(r) OVER (PARTITION BY set_no) / 12) AS index FROM rw)"""
over_lines("f3_season_indices", IDX + "SELECT set_no, moy, round(index, 6) AS index FROM idx")
over_lines("f6_season_claim", IDX + """, rs AS (SELECT a.year, a.moy, a.ratio, avg(b.ratio) AS rest FROM rat a JOIN rat b ON b.moy = a.moy AND b.year <> a.year GROUP BY 1, 2, 3), ag AS (SELECT avg(c) AS a, count(*) AS years FROM (SELECT year, corr(ratio, rest) AS c FROM rs GROUP BY 1)),
  w AS (SELECT idx.index, r.position - r.n + 12 AS x FROM idx JOIN rat r ON idx.moy = r.moy AND r.position >= r.n - 12 WHERE set_no = -1), g AS (SELECT (max(index) - min(index)) / max(index) AS gap, corr(x, ln(index)) * corr(x, ln(index)) AS ramp FROM w)
  SELECT years, round(gap, 4) AS strength_gap, round(a, 4) AS agreement, round(ramp, 4) AS ramp, CASE WHEN NOT gap > 0.4 + 1e-9 THEN 'gap' WHEN NOT a >= 0.6 THEN 'agreement' WHEN NOT ramp < 0.9 THEN 'ramp' END AS refusal, gap > 0.4 + 1e-9 AND a >= 0.6 AND ramp < 0.9 AS claimed FROM ag, g""")
ERR = WIN + """, hz AS (SELECT unnest([1, 2, 3]) AS h), er AS (SELECT h, t.month, ln(t.revenue) - ln((3 * a.revenue + 2 * b.revenue + c.revenue) / 6) AS error FROM hz, win t, win a, win b, win c WHERE a.position = t.position - h AND b.position = t.position - h - 1 AND c.position = t.position - h - 2)"""
over_lines("f9_horizon_errors", ERR + "SELECT CAST(h AS BIGINT) AS h, month, round(error, 6) AS error FROM er")
over_lines("f8_forecast_points", ERR + """, lv AS (SELECT sum(revenue * CASE n - position WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END) / 6 AS l FROM win)
  SELECT CAST(h AS BIGINT) AS h, CAST(cur + h * INTERVAL 1 MONTH AS DATE) AS month, round(l, 2) AS point, (SELECT count(*) FROM er WHERE er.h = hz.h) AS errors, FALSE AS seasonal FROM hz, lv, p""")
over_lines("v1_chart_series", WIN + """, lv AS (SELECT sum(revenue * CASE n - position WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END) / 6 AS l FROM win)
  SELECT 'revenue' AS series, month, CASE WHEN month IN (SELECT month FROM comp) THEN round(revenue, 2) END AS value FROM core WHERE month IS NOT NULL
  UNION ALL SELECT 'forecast_point', CAST(cur + h * INTERVAL 1 MONTH AS DATE), round(l, 2) FROM p, lv, (SELECT unnest([1, 2, 3]) AS h)""")
over_lines("v3_bars", PM + """SELECT row_number() OVER (ORDER BY revenue_current DESC, member) AS position, member, revenue_current, revenue_previous FROM (SELECT priority AS member, sum(CASE WHEN slot = 'cur' THEN amount ELSE 0 END) AS revenue_current, sum(CASE WHEN slot = 'prev' THEN amount ELSE 0 END) AS revenue_previous FROM pm GROUP BY 1)""")

# --- texts, samples, written dates
add("s2_encodings", "SELECT 'é' || CAST(o_orderkey % 7 AS VARCHAR) AS label, count(*) AS orders FROM orders GROUP BY 1")
add("s3_delimiters", "SELECT o_orderkey % 4 AS file, count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS customers, count(*) AS lines FROM orders GROUP BY 1")
over_lines("s7_results_read_back", CORE_CTE + "SELECT month, revenue, orders FROM core")
over_lines("s9_sample_customers", """SELECT customer, order_id, product_key, amount FROM lines
  WHERE coalesce(CAST('0x' || substr(md5('7:' || coalesce('c:' || customer, 'i:' || order_id)), 1, 12) AS BIGINT) % 1000000 < 250000, FALSE) OR coalesce(product_key = 'sku:p1', FALSE)""")
add("t5_written_shapes", """SELECT o_orderkey AS line_no, strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 8 WHEN 4 THEN ' 10:30:00' WHEN 5 THEN ' 10:30:00' WHEN 6 THEN ' 15:05:00' WHEN 7 THEN ' 10:15:00' ELSE ' 00:00:00' END AS read FROM orders""")
add("t7_utc_offsets", "SELECT o_orderkey % 8 AS shape, count(CASE WHEN o_orderkey % 8 IN (5, 7) THEN 1 END) AS offsets FROM orders GROUP BY 1")
add("x11_written_format", "SELECT o_orderkey AS line_no, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 10 = 0")
add("x11_written_format_marks", M + "SELECT line_no, CASE WHEN line_no % 10 = 0 THEN true_day END AS day, line_no % 10 <> 0 AS invalid_date FROM m")
add("x24_dropped_rows", M + """SELECT 'drop_rows_missing' AS action, 'price' AS "column", count(*) AS rows FROM m WHERE price IS NULL""")
over_lines("r6_not_after", "SELECT count(*) AS lines, max(txn_day) AS latest FROM lines WHERE txn_day IS NULL OR txn_day <= DATE '1998-01-02'")
add("c19_stratified_sample", MARKS + """, f AS (SELECT line_no, row_number() OVER (PARTITION BY kind ORDER BY line_no) AS position FROM (
    SELECT 'any_missing' AS kind, line_no FROM k WHERE any_missing UNION ALL SELECT 'duplicate', line_no FROM k WHERE duplicate UNION ALL SELECT 'negative', line_no FROM k WHERE negative
    UNION ALL SELECT 'non_numeric', line_no FROM k WHERE non_numeric UNION ALL SELECT 'padded', line_no FROM k WHERE padded UNION ALL SELECT 'bad_date', line_no FROM k WHERE bad_date)),
  ch AS (SELECT DISTINCT line_no FROM f WHERE position <= 40 ORDER BY line_no LIMIT 250), grid AS (SELECT DISTINCT CAST(floor(i * (SELECT max(line_no) FROM m) / 499) AS BIGINT) AS line_no FROM range(500) t(i)),
  pk AS (SELECT line_no, min(pr) AS pr FROM (SELECT line_no, 0 AS pr FROM ch UNION ALL SELECT line_no, 1 FROM grid) GROUP BY 1), ps AS (SELECT line_no FROM pk ORDER BY pr, line_no LIMIT 500)
  SELECT m.line_no, m.day, m.price FROM m JOIN ps ON m.line_no = ps.line_no""")

# --- figures of every nation
BY_NATION = PN + f""", core AS MATERIALIZED (SELECT nation, month, {CORE} FROM lines WHERE counted GROUP BY nation, month),
  cn AS MATERIALIZED (SELECT nation, CAST(m AS DATE) AS month, cur FROM (SELECT pn.*, unnest(generate_series(date_trunc('month', data_start), date_trunc('month', data_end), INTERVAL 1 MONTH)) AS m FROM pn)
    WHERE CAST(m AS DATE) >= data_start AND last_day(CAST(m AS DATE)) <= data_end),
  v AS MATERIALIZED (SELECT pn.nation, a.revenue AS r1, b.revenue AS r0, CAST(a.orders AS DOUBLE) AS o1, CAST(b.orders AS DOUBLE) AS o0, CAST(a.buyers AS DOUBLE) AS c1, CAST(b.buyers AS DOUBLE) AS c0, a.units AS u1, b.units AS u0,
    a.orders / a.buyers AS f1, b.orders / b.buyers AS f0, a.revenue / a.orders AS a1, b.revenue / b.orders AS a0, a.refund_lines + b.refund_lines AS refunds
    FROM pn JOIN core a ON a.nation = pn.nation AND a.month = cur JOIN core b ON b.nation = pn.nation AND b.month = prev),
  e AS MATERIALIZED (SELECT *, (c1 - c0) * (2 * f0 * a0 + f0 * a1 + f1 * a0 + 2 * f1 * a1) / 6 AS pc, (f1 - f0) * (2 * c0 * a0 + c0 * a1 + c1 * a0 + 2 * c1 * a1) / 6 AS pf,
    (a1 - a0) * (2 * c0 * f0 + c0 * f1 + c1 * f0 + 2 * c1 * f1) / 6 AS pa, (o1 - o0) * (a0 + a1) / 2 AS po, (a1 - a0) * (o0 + o1) / 2 AS p2,
    CAST(round(CAST(r0 AS DECIMAL(28, 6)) * 100) AS BIGINT) AS w0, CAST(round(CAST(r1 AS DECIMAL(28, 6)) * 100) AS BIGINT) AS w1, u0 > 0 AND u1 > 0 AND a1 <> a0 AS basket FROM v)"""
over_lines("a6_masked_shift_by_nation", BY_NATION + """, h AS (SELECT cn.nation, cn.month FROM cn WHERE month < cur QUALIFY row_number() OVER (PARTITION BY nation ORDER BY month DESC) <= 24),
  ty AS (SELECT h.nation, median(abs(revenue)) AS t FROM h JOIN core ON core.nation = h.nation AND core.month = h.month WHERE revenue <> 0 GROUP BY 1), x AS (SELECT *, (abs(pc) + abs(pf) + abs(pa)) / abs(r1 - r0) AS g FROM e)
  SELECT x.nation, round(t, 2) AS typical, round(g, 4) AS gross_to_net,
    abs(r1 - r0) < 0.25 * greatest(r0, r1) AND g >= 3 AND greatest(po, p2) >= 0.25 * greatest(t, r0, r1) AND least(po, p2) <= -0.25 * greatest(t, r0, r1) AS masked_shift_alert FROM x JOIN ty ON x.nation = ty.nation""")
over_lines("a8_bars_sum_to_the_cent", BY_NATION + "SELECT nation, CAST(CASE WHEN basket THEN 4 ELSE 3 END AS BIGINT) AS bars, w1 - w0 AS cents, w1 - w0 AS change_cents FROM e WHERE least(w0, w1) > 0")
# Bars in whole cents by largest remainders; with refunds in either month the basket is not split.
over_lines("v4_waterfall", BY_NATION + """, f AS (SELECT nation, unnest([1, 2, 4, 5, 6]) AS position, unnest(['customers', 'frequency', 'aov', 'units_per_order', 'price_per_unit']) AS factor, basket AND refunds = 0 AS split, w1 - w0 AS change,
    unnest([pc, pf, pa, pa * ((u1 / o1 - u0 / o0) * (r0 / u0 + r1 / u1) / 2) / (a1 - a0), pa * ((r1 / u1 - r0 / u0) * (u0 / o0 + u1 / o1) / 2) / (a1 - a0)]) AS effect FROM e WHERE least(w0, w1) > 0),
  b AS (SELECT *, CAST(effect AS DECIMAL(28, 10)) * 100 AS exact FROM f WHERE position <= 2 OR (position = 4) <> split),
  r AS (SELECT *, CAST(floor(exact) AS BIGINT) AS low, exact - floor(exact) AS rest FROM b), l AS (SELECT *, change - sum(low) OVER (PARTITION BY nation) AS missing FROM r),
  d AS (SELECT *, low + CASE WHEN missing > 0 AND effect <> 0 AND row_number() OVER (PARTITION BY nation ORDER BY effect <> 0 DESC, rest DESC, position) <= missing THEN 1
      WHEN missing < 0 AND effect <> 0 AND NOT (effect > 0 AND low <= 0) AND row_number() OVER (PARTITION BY nation ORDER BY effect <> 0 AND NOT (effect > 0 AND low <= 0) DESC, rest, position DESC) <= -missing THEN -1 ELSE 0 END AS cents FROM l),
  s AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY nation ORDER BY position) AS BIGINT) AS upto FROM d)
  SELECT nation, CAST(position AS INTEGER) AS position, factor, CAST(upto - cents AS BIGINT) AS start_cents, upto AS end_cents FROM s
  UNION ALL SELECT nation, 99, 'change', 0, max(change) FROM s GROUP BY nation""")
over_lines("f11_forecast_status", BY_NATION + """, w AS (SELECT cn.nation, datediff('month', cn.month, cur) AS back, row_number() OVER (PARTITION BY cn.nation ORDER BY cn.month DESC) - 1 AS k FROM cn JOIN core ON core.nation = cn.nation AND core.month = cn.month WHERE cn.month <= cur)
  SELECT pn.nation, count(k) AS months_used, count(k) < 3 AS insufficient_history FROM pn LEFT JOIN w ON w.nation = pn.nation AND k = back GROUP BY 1""")
add("c21_rows_to_show", CLEAN + """, k AS (SELECT *, count(*) OVER (PARTITION BY order_id, status, dropped) > 1 AS dup FROM c),
  x AS (SELECT line_no, unnest(CASE WHEN dropped THEN ['dropped'] ELSE list_filter([CASE WHEN failed THEN 'f' END, CASE WHEN dup THEN 'd' END, CASE WHEN priority <> old_priority THEN 'p' END,
      CASE WHEN CAST(qty AS VARCHAR) IS DISTINCT FROM old_qty THEN 'q' END, CASE WHEN status <> old_status THEN 's' END], lambda x: x IS NOT NULL) END) AS effect FROM k),
  f AS (SELECT DISTINCT min(line_no) OVER (PARTITION BY effect) AS line_no FROM x)
  SELECT line_no, CASE WHEN line_no IN (SELECT line_no FROM f) THEN 0 WHEN line_no IN (SELECT line_no FROM x) THEN 1 ELSE 2 END AS priority FROM k ORDER BY 2, 1 LIMIT 20""")
