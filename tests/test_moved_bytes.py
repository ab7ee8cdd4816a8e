"""What moves and is written: few and short rows, with the same results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.shop import FIELDS, clean_rows, frame, lines
from tillscope.operators import metrics, orders, periods, products
from tillscope.plans.analysis import Analysis
from tillscope.plans.sales_lines import Answers, Mapping, build_sales_lines
from tillscope.session import materialize

ORDER = {"order_id": "Invoice"}


def noted(monkeypatch, *modules):
    """The tables that modules write, by label."""
    seen = {}

    def note(df, label, partition_by=None):
        seen.setdefault(label, []).append(out := materialize(df, label, partition_by))
        return out

    for module in modules:
        monkeypatch.setattr(module, "materialize", note)
    return seen


def test_only_days_both_sold_and_returned_are_reduced_to_orders(spark, monkeypatch):
    rows = clean_rows(dt.date(2024, 1, 1), dt.date(2024, 2, 29))
    back = [dict(rows[0], Date="2024-02-05", Qty="-1", Cust=who, Product=product, Invoice=f"R{who}") for who, product in (("Ann", "Mug"), ("Bo", "Hat"))]
    df = lines(spark, [*rows, *back], Answers(order_id_is_receipt=True), ORDER)
    seen = noted(monkeypatch, metrics)
    got = {(r.measure, r.figure_scope): (r.lines, r.amount, r.orders) for r in metrics.same_day_cancellations(df, periods.periods(df)).collect()}
    assert {k[0]: v for k, v in got.items() if k[0] != "returns_unchecked"} == {"returns": (1, -10.0, 1), "sales": (1, 10.0, 1)}
    assert seen["customer-product-days"][0].count() == 2


@pytest.mark.parametrize("scope", [[], ["shop"]])
def test_receipts_move_once_for_counts_and_fills(spark, scope):
    names = "shop string, order_id string, txn_day date, customer string, sale boolean, returned boolean, counted boolean, left_out boolean, line_class string"
    days = [dt.date(2024, 1, d) for d in (5, 6)]
    sold, back, gone, cost = (True, False, True, False, "sale"), (False, True, True, False, "customer_return"), (False, False, False, False, "unmeasurable"), (False, False, False, True, "cost")
    rows = [
        ("a", "1", days[0], "ann", *sold), ("a", "1", days[0], None, *sold), ("a", "1", days[1], "ann", *back), ("a", "1", days[0], "ann", *sold),
        ("a", "2", days[0], None, *sold), ("a", "2", days[0], "bo", *gone), ("a", "2", days[0], "cy", *cost),
        ("a", "3", days[0], "ann", *sold), ("a", "3", days[0], "bo", *sold), ("a", "3", days[0], "bo", *sold), ("a", "3", days[1], None, *sold),
        ("a", "4", days[0], "ann", *gone), (None, "4", days[1], None, *sold), ("b", "1", days[0], "dee", *back), ("b", "1", days[0], "eve", *sold),
        ("b", "5", None, "ann", *sold), ("b", None, days[0], None, *sold), ("b", "6", days[0], "ann", *back), ("b", "6", days[1], "ann", *back),
    ]
    df = spark.createDataFrame(rows, names)
    plain = orders.receipt_lines(df, scope)
    dealt = orders.receipt_lines(df, scope, dealt=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))
    filled = orders.with_fills(dealt, scope)
    assert filled._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    fills = orders.receipt_fills(plain, scope)
    keys = [*scope, "order_id", "txn_day"]
    assert sorted(map(str, filled.select(*keys, "fill").distinct().collect())) == sorted(map(str, fills.select(*keys, "fill").collect()))
    read, told = orders.order_id_facts(plain, fills, scope), orders.order_id_facts(filled, None, scope, write=True)
    columns = [*scope, "order_id", "n_sale", "receipt_day", "spans", "top"]
    assert sorted(map(str, read.select(columns).collect())) == sorted(map(str, told.select(columns).collect()))
    if scope:
        got = {(r.shop, r.order_id): (r.n_sale, r.receipt_day, r.spans, r.spans_raw, r.top) for r in read.collect()}
        assert got == {
            ("a", "1"): (3, days[0], False, False, "ann"), ("a", "2"): (1, days[0], False, False, "bo"),
            ("a", "3"): (4, None, True, True, "bo"), ("a", "4"): (0, None, False, False, None), (None, "4"): (1, days[1], False, False, None),
            ("b", "1"): (1, None, False, False, "eve"), ("b", "6"): (0, None, False, False, None)}


def test_only_days_that_lines_ask_for_are_written(spark, monkeypatch):
    rows = clean_rows(dt.date(2024, 1, 1), dt.date(2024, 1, 20))
    rows[1] = dict(rows[1], Cust=None)
    seen = noted(monkeypatch, orders)
    got = build_sales_lines(frame(spark, rows), Mapping({**FIELDS, **ORDER}), [], Answers(order_id_is_receipt=True)).collect()
    assert [r.fill for r in seen["receipt-days"][0].collect()] == ["ann"]
    assert sum(r.receipt_fillable for r in got) == 1 and {r.customer for r in got} == {"ann", "bo", "cy"}
    assert set(seen["order-facts"][0].columns) == {"order_id", "n_sale", "receipt_day", "spans", "filled0", "__several"}


def test_keys_that_cells_tell_are_not_written(spark, monkeypatch):
    from tillscope.plans import sales_lines

    seen = noted(monkeypatch, sales_lines)
    cells = ["P1", " p1 ", None, "", "Ä9", "P​1"]
    rows = [dict(Date="2024-01-05", Qty="1", Price="2", Product="Mug", Cust="Ann", Invoice=None, Type=None, SKU=c) for c in cells]
    got = {r.line_no: r.item_key for r in lines(spark, rows, extra={"sku": "SKU"}).collect()}
    assert [got[i] for i in range(6)] == ["sku:p1", "sku:p1", "name:mug", "name:mug", "sku:ä9", "sku:p1"]
    assert "item_key" not in seen["sales-lines"][0].columns
    assert {r.line_no: r["__key"] for r in seen["sales-lines"][0].collect()} == {0: None, 1: "sku:p1", 2: "name:mug", 3: "name:mug", 4: None, 5: "sku:p1"}


def test_only_products_of_several_names_are_counted_by_name(spark, monkeypatch):
    columns = "product_key string, line_no long, sku_label_text string, product_label_text string, sale boolean, txn_ts timestamp_ntz"
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", 1, "A1", "Mug", True, at(1)), ("a", 2, "a1", "Mug", True, at(2)), ("a", 3, None, "Zzz", False, at(3)),
            ("b", 4, None, "Tea", True, at(1)), ("b", 5, None, "TEA", True, at(2)), ("b", 6, "B", "Chai", False, at(9)), ("b", 7, "B", "Chai", False, at(9)), ("b", 8, "B", "Chai", False, at(9)),
            ("c", 9, None, "Hat", False, None), ("c", 10, None, "Cap", False, at(1)), ("c", 11, None, None, True, at(1)), ("d", 12, "D", None, True, at(1)),
            ("e", 13, "E", "Mug", True, at(4)), (None, 14, "F", "Mug", True, at(4))]
    seen = noted(monkeypatch, products)
    got = {r.product_key: r.product_label for r in products.product_labels(spark.createDataFrame(rows, columns)).collect()}
    assert got == {"a": "Mug (A1)", "b": "TEA", "c": "Cap", "d": "D", "e": "Mug (E)"}
    assert {r.product_key for r in seen["commonest-names"][0].collect()} == {"b", "c"}
    # No label is shared: none is written to be numbered.
    assert "labels" not in seen and "label-texts" not in seen


def test_first_days_alone_are_netted(spark, monkeypatch):
    rows = clean_rows(dt.date(2024, 1, 1), dt.date(2024, 3, 20))
    of = lambda day, who, qty, product="Mug": dict(rows[0], Date=day, Qty=qty, Cust=who, Product=product, Invoice=f"{day}{who}{qty}")
    extra = [of("2024-01-09", "Dee", "-1"), of("2024-02-09", "Dee", "3"), of("2024-02-01", "Eve", "2"), of("2024-02-01", "Eve", "-2"), of("2024-03-01", "Eve", "-1"),
             of("2024-02-03", "Fay", "2"), of("2024-02-03", "Fay", "-1", "Tea"), of("2024-01-05", "Ann", "-9")]
    df = lines(spark, [*rows, *extra], extra=ORDER)
    seen = noted(monkeypatch, orders)
    got = {r.customer: r.first_month and r.first_month.month for r in orders.first_purchases(df).collect()}
    assert got == {"ann": 1, "bo": 1, "cy": 1, "dee": None, "eve": 2, "fay": None}
    assert {r.customer for r in seen["first-returns"][0].collect()} == {"dee", "eve", "fay"}


def test_tables_that_several_figures_share_are_written_once(spark, monkeypatch):
    from tillscope.operators import lenses, members
    from tillscope.plans import analysis

    a = Analysis(lines(spark, clean_rows(dt.date(2023, 10, 1), dt.date(2024, 2, 29)), extra=ORDER))
    seen = noted(monkeypatch, analysis, lenses, members)
    assert a.facts.first().top_member is not None
    assert [len(seen[x]) for x in ("month-customers", "trading-days", "product-sums")] == [1, 1, 1] and "product-totals" not in seen
    wide = a.product_totals.filter(F.col("key") == a.facts.first().top_member.lower().join(["name:", ""])).first()
    assert wide.label == a.facts.first().top_member


def test_the_ledger_of_text_keeps_an_invoices_lines_together(spark, sf):
    from suite import registry
    from tillscope.sources.ledger import ledger

    out = registry._text_run(spark, sf)
    assert out.lines.count() == ledger(spark, sf).count()
    at = out.lines.groupBy("order_id").agg((F.max("line_no") - F.min("line_no") + 1 - F.count("*")).alias("gaps"))
    assert at.filter("gaps > 0").isEmpty()
