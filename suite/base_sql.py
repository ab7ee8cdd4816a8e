"""The ledger and its sales lines in plain SQL, independent of the Spark code."""

LINES = r"""
WITH raw AS (
  SELECT l.line_no, c.c_nationkey AS nation, 'INV' || CAST(l.l_orderkey AS VARCHAR) AS order_id,
    CASE WHEN l.l_orderkey % 307 <> 0 THEN o.o_orderdate + CASE WHEN l.l_orderkey % 53 = 0 AND l.l_linenumber >= 4 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END END AS txn_ts,
    CASE WHEN l.l_partkey % 23 <> 7 THEN 'P' || CAST(l.l_partkey AS VARCHAR) END AS sku,
    CASE l.l_partkey % 101 WHEN 9 THEN 'Postage' WHEN 10 THEN 'Gift card' WHEN 11 THEN 'Discount' WHEN 12 THEN 'Manual'
      WHEN 13 THEN 'Bank charge' WHEN 14 THEN 'Bad debt'
      ELSE CASE WHEN l.l_partkey % 43 = 0 THEN upper(p.p_name) ELSE p.p_name END END AS product_name,
    CASE WHEN l.l_partkey % 29 <> 0 THEN CASE WHEN l.l_partkey % 31 = 0 AND l.l_linenumber = 2 THEN lower(p.p_type) ELSE p.p_type END END AS category,
    CASE WHEN l.l_orderkey % 37 = 0 OR (l.l_orderkey % 5 = 0 AND l.l_linenumber > 2) THEN NULL
      WHEN l.l_orderkey % 11 = 3 THEN 'Walk-in' ELSE c.c_name END AS customer_raw,
    CASE WHEN l.l_orderkey % 223 <> 5 THEN CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 THEN -l.l_quantity ELSE l.l_quantity END END AS quantity,
    CASE WHEN l.l_orderkey % 211 <> 3 THEN CASE WHEN l.l_partkey % 97 = 5 THEN 0.0 ELSE floor(l.l_extendedprice / l.l_quantity) END END AS unit_price,
    CASE WHEN l.l_suppkey % 50 = 1 THEN 'in' WHEN l.l_suppkey % 50 = 2 THEN 'exchange' ELSE 'out' END AS kind,
    o.o_orderpriority AS priority, c.c_mktsegment AS segment
  FROM (SELECT *, row_number() OVER () - 1 AS line_no FROM lineitem) l
  JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN (SELECT c_custkey, max(c_name) AS c_name, max(c_nationkey) AS c_nationkey, max(c_mktsegment) AS c_mktsegment FROM customer GROUP BY 1) c ON o.o_custkey = c.c_custkey
  JOIN (SELECT p_partkey, max(p_name) AS p_name, max(p_type) AS p_type FROM part GROUP BY 1) p ON l.l_partkey = p.p_partkey
), typed AS (
  SELECT *, CAST(txn_ts AS DATE) AS txn_day, CAST(date_trunc('month', txn_ts) AS DATE) AS month, quantity * unit_price AS amount,
    kind = 'in' AS stock_in, lower(product_name) AS name_id, lower(sku) AS sku_id,
    CASE WHEN sku IS NOT NULL THEN 'sku:' || lower(sku) ELSE 'name:' || lower(product_name) END AS item_key,
    lower(customer_raw) AS customer_written, lower(category) AS category_key,
    CASE lower(product_name) WHEN 'postage' THEN 'charge' WHEN 'gift card' THEN 'gift_card' WHEN 'discount' THEN 'discount'
      WHEN 'manual' THEN 'pooled' WHEN 'bank charge' THEN 'cost' WHEN 'bad debt' THEN 'adjustment' END AS word
  FROM raw
), answers(item_key, answer) AS (
  VALUES ('sku:p9','charge'),('sku:p110','charge'),('sku:p10','gift_card'),('sku:p11','discount'),('sku:p12','pooled'),
         ('sku:p13','cost'),('sku:p14','adjustment'),('sku:p115','product')
), cand AS (
  SELECT item_key, max(word) AS suggested, max(product_name) AS name, max(sku) AS sku,
    count(CASE WHEN NOT stock_in AND amount IS NOT NULL THEN 1 END) AS lines,
    coalesce(sum(CASE WHEN NOT stock_in AND amount > 0 THEN amount END), 0) AS positive,
    coalesce(sum(CASE WHEN NOT stock_in AND amount < 0 THEN amount END), 0) AS negative
  FROM typed WHERE word IS NOT NULL GROUP BY item_key
), sugg AS (SELECT item_key, suggested FROM cand WHERE positive <> 0 OR negative <> 0
), names AS (
  SELECT name_id, min(sku_id) AS one_sku FROM typed
  WHERE txn_ts IS NOT NULL AND NOT stock_in AND quantity > 0 AND amount > 0 AND sku_id IS NOT NULL
  GROUP BY name_id HAVING count(DISTINCT sku_id) = 1
), looked AS (
  SELECT t.*, n.one_sku, coalesce(a.answer, an.answer) AS item, coalesce(s.suggested, sn.suggested) AS sugg_any, an.answer AS sku_answer
  FROM typed t
  LEFT JOIN names n ON t.sku_id IS NULL AND t.name_id = n.name_id
  LEFT JOIN answers a ON t.item_key = a.item_key LEFT JOIN answers an ON 'sku:' || n.one_sku = an.item_key
  LEFT JOIN sugg s ON t.item_key = s.item_key LEFT JOIN sugg sn ON 'sku:' || n.one_sku = sn.item_key
), classed AS (
  SELECT *, CASE WHEN stock_in THEN 'stock_in' WHEN amount IS NULL THEN 'unmeasurable'
      WHEN item IN ('charge','discount','cost','adjustment') THEN item
      WHEN item = 'gift_card' THEN CASE WHEN amount >= 0 THEN 'gift_card_sale' ELSE 'gift_card_redemption' END
      WHEN amount = 0 THEN CASE WHEN item = 'pooled' THEN 'pooled_no_money' ELSE 'no_money' END
      WHEN quantity > 0 AND amount > 0 THEN CASE WHEN item = 'pooled' THEN 'pooled_sale' ELSE 'sale' END
      WHEN quantity < 0 AND amount < 0 THEN CASE WHEN item = 'pooled' THEN 'pooled_return' ELSE 'customer_return' END
      ELSE CASE WHEN item = 'pooled' THEN 'pooled_allowance' ELSE 'allowance' END END AS line_class,
    CASE WHEN item IS NULL THEN sugg_any END AS suggested_class, CASE WHEN item <> 'product' THEN item END AS answered_class,
    CASE WHEN item IS NOT NULL AND NOT stock_in AND amount IS NOT NULL THEN 'user' ELSE 'rule' END AS class_source,
    customer_written = 'walk-in' AS placeholder0, CASE WHEN customer_written <> 'walk-in' THEN customer_written END AS named
  FROM looked
), masked AS (
  SELECT *, coalesce(placeholder0, FALSE) AS placeholder,
    txn_ts IS NOT NULL AND line_class IN ('sale','pooled_sale','customer_return','pooled_return','allowance','pooled_allowance','discount','charge','no_money','pooled_no_money') AS counted,
    txn_ts IS NOT NULL AND line_class IN ('sale','pooled_sale') AS sale,
    txn_ts IS NOT NULL AND line_class IN ('customer_return','pooled_return') AS returned,
    txn_ts IS NOT NULL AND line_class = 'charge' AS charge,
    txn_ts IS NOT NULL AND line_class IN ('allowance','pooled_allowance','discount','no_money','pooled_no_money') AS deduction,
    txn_ts IS NOT NULL AND line_class IN ('gift_card_sale','gift_card_redemption','cost','adjustment') AS left_out
  FROM classed
), fills AS (
  SELECT order_id, txn_day,
    CASE WHEN count(CASE WHEN (sale OR returned) AND named IS NOT NULL THEN 1 END) > 0
      THEN CASE WHEN count(DISTINCT CASE WHEN sale OR returned THEN named END) = 1 THEN max(CASE WHEN sale OR returned THEN named END) END
      ELSE CASE WHEN count(DISTINCT CASE WHEN line_class <> 'stock_in' AND NOT left_out THEN named END) = 1
        THEN max(CASE WHEN line_class <> 'stock_in' AND NOT left_out THEN named END) END END AS fill
  FROM masked WHERE txn_day IS NOT NULL GROUP BY order_id, txn_day
), has_sale AS (SELECT order_id, max(CASE WHEN sale THEN 1 ELSE 0 END) AS hs FROM masked WHERE txn_day IS NOT NULL GROUP BY order_id
), receipt0 AS (
  SELECT m.order_id, max(h.hs) AS hs, min(m.txn_day) AS d
  FROM masked m JOIN has_sale h ON m.order_id = h.order_id WHERE m.txn_day IS NOT NULL AND (m.sale OR (h.hs = 0 AND m.counted))
  GROUP BY m.order_id HAVING count(DISTINCT m.txn_day) = 1 AND count(DISTINCT m.named) <= 1
), receipt AS (
  SELECT r.order_id, r.d FROM receipt0 r WHERE NOT EXISTS (
      SELECT 1 FROM masked m WHERE r.hs = 1 AND m.order_id = r.order_id AND (m.sale OR m.returned) AND m.txn_day < r.d)
    AND r.order_id NOT IN (SELECT m.order_id FROM masked m JOIN has_sale h ON m.order_id = h.order_id
      WHERE h.hs = 1 AND (m.sale OR m.returned) GROUP BY m.order_id HAVING count(DISTINCT m.named) > 1)
), lines AS (
  SELECT m.line_no, m.nation, m.txn_ts, m.txn_day, m.month, m.quantity, m.unit_price, m.amount, m.line_class, m.class_source,
    m.suggested_class, m.answered_class, m.counted, m.sale, m.returned, m.charge, m.deduction, m.left_out, m.stock_in, m.kind,
    CASE WHEN m.sale OR m.returned THEN m.quantity ELSE 0 END AS units, m.item_key, m.sku, m.product_name, m.name_id, m.sku_id,
    CASE WHEN m.sku_id IS NULL AND m.one_sku IS NOT NULL THEN 'sku:' || m.one_sku ELSE m.item_key END AS netting_key,
    CASE WHEN m.answered_class IS NULL THEN CASE WHEN m.sku_id IS NULL AND m.one_sku IS NOT NULL AND coalesce(m.sku_answer, 'product') = 'product'
      THEN 'sku:' || m.one_sku ELSE m.item_key END END AS product_key,
    m.order_id, m.order_id || '␟' || CAST(m.txn_day AS VARCHAR) || '␟' || coalesce(m.named, f.fill, '') AS order_key,
    CASE WHEN r.d = m.txn_day THEN coalesce(m.named, f.fill) ELSE m.named END AS customer, m.named AS customer_named,
    coalesce(m.counted AND m.named IS NULL AND f.fill IS NOT NULL AND r.d = m.txn_day, FALSE) AS receipt_fillable,
    m.placeholder, m.customer_written, m.category_key, m.category AS category_label, m.priority, m.segment
  FROM masked m LEFT JOIN fills f ON m.order_id = f.order_id AND m.txn_day = f.txn_day LEFT JOIN receipt r ON m.order_id = r.order_id
), period AS (
  SELECT CASE WHEN max(txn_day) = last_day(max(txn_day)) THEN CAST(date_trunc('month', max(txn_day)) AS DATE)
      ELSE CAST(date_trunc('month', max(txn_day)) - INTERVAL 1 MONTH AS DATE) END AS cur,
    min(txn_day) AS data_start, max(txn_day) AS data_end, min(CASE WHEN sale THEN txn_day END) AS first_sale FROM lines
), p AS (SELECT cur, CAST(cur - INTERVAL 1 MONTH AS DATE) AS prev, data_start, data_end, first_sale FROM period)
"""
