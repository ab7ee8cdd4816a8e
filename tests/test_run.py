"""A run from written text to classed lines: what it decides, what it refuses, what it leaves open."""

import pytest

from tillscope.plans import run
from tillscope.plans.cleaning import CleaningPlan, Step
from tillscope.plans.run import NothingLeft, Run, RunRefused, run_files, run_lines
from tillscope.plans.sales_lines import Mapping, MissingField

FIELDS = {"transaction_date": "Date", "quantity": "Qty", "unit_price": "Price", "product_name": "Product", "customer": "Cust", "order_id": "No"}
SCHEMA = "line_no bigint, Date string, Qty string, Price string, Product string, Cust string, No string"
ROWS = [("13/01/2024", "1", "€1.234,50", "Mug", "Ann", "1"), ("05/02/2024", "2", "€2,00", "Tea", "Bo", "2"), ("06/02/2024", "-1", "€2,00", "Tea", "Bo", "3"), ("07/02/2024", "1", "€9,00", "Postage", "Cy", "4")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def refused(spark, rows, decisions=(), plan=None, error=RunRefused):
    with pytest.raises(error) as caught:
        run_lines(frame(spark, rows), Run(Mapping(FIELDS), plan or CleaningPlan(), tuple(decisions)))
    return getattr(caught.value, "problems", None)


def swapped(column, value, rows=ROWS):
    return [tuple(value if i == column else x for i, x in enumerate(r)) for r in rows]


def test_cells_prove_how_they_are_written(spark):
    out = run_lines(frame(spark), Run(Mapping(FIELDS), decisions=(("line_class", "product_name:postage", "charge"), ("placeholder", "cy", "yes"))))
    decided = {(r.question, r.subject): (r.answer, r.source) for r in out.decisions.collect()}
    assert decided == {("date_order", "Date"): ("day_first", "cells"), ("number_format", "Price"): ("decimal_comma", "cells"), ("currency", ""): ("EUR", "cells"),
                       ("line_class", "product_name:postage"): ("charge", "user"), ("placeholder", "cy"): ("yes", "user")}
    lines = {r.line_no: r for r in out.lines.collect()}
    assert [(str(lines[i].txn_day), lines[i].amount, lines[i].line_class) for i in range(4)] == [
        ("2024-01-13", 1234.5, "sale"), ("2024-02-05", 4.0, "sale"), ("2024-02-06", -2.0, "customer_return"), ("2024-02-07", 9.0, "charge")]
    assert lines[3].customer is None and lines[3].placeholder
    assert "line_class" not in {r.question for r in out.open_questions.collect()}


def test_unanswered_and_contradicted_dates(spark):
    both = [("05/06/2024", *r[1:]) for r in ROWS]
    assert refused(spark, both) == [("date_order", "Date", "unanswered")]
    assert refused(spark, ROWS, [("date_order", "Date", "month_first")]) == [("date_order", "Date", "contradicted by the cells")]
    out = run_lines(frame(spark, both), Run(Mapping(FIELDS), decisions=(("date_order", "Date", "month_first"),)))
    assert {str(r.txn_day) for r in out.lines.collect()} == {"2024-05-06"}
    assert refused(spark, [ROWS[0], ("01/13/2024", *ROWS[1][1:])]) == [("date_order", "Date", "unanswered")]


def test_unanswered_and_contradicted_numbers(spark):
    assert refused(spark, swapped(2, "1.234")) == [("number_format", "Price", "unanswered")]
    assert refused(spark, ROWS, [("number_format", "Price", "decimal_point")]) == [("number_format", "Price", "contradicted by the cells")]
    for answer, price in (("decimal_point", 1.234), ("decimal_comma", 1234.0)):
        out = run_lines(frame(spark, swapped(2, "1.234")), Run(Mapping(FIELDS), decisions=(("number_format", "Price", answer),)))
        assert {r.unit_price for r in out.lines.collect()} == {price}


def test_currencies(spark):
    mixed = [(*ROWS[0][:2], "$1.234,50", *ROWS[0][3:]), *ROWS[1:]]
    assert refused(spark, mixed) == [("currency", "", "more than one currency")]
    assert refused(spark, ROWS, [("currency", "", "USD")]) == [("currency", "", "contradicted by the cells")]
    dollars = [tuple(c.replace("€", "$") for c in r) for r in ROWS]
    assert refused(spark, dollars, [("currency", "", "EUR")]) == [("currency", "", "contradicted by the cells")]
    for told, answer in (((), None), ((("currency", "", "CAD"),), "CAD")):
        out = run_lines(frame(spark, dollars), Run(Mapping(FIELDS), decisions=told))
        assert {r.answer for r in out.decisions.filter("question = 'currency'").collect()} == ({answer} if answer else set())


def test_decisions_nobody_asks(spark):
    assert refused(spark, ROWS, [("colour", "", "red"), ("placeholder", "Ann", "perhaps"), ("line_class", "sku:1", "gift")]) == [
        ("colour", "", "unknown question"), ("placeholder", "Ann", "unknown answer 'perhaps'"), ("line_class", "sku:1", "unknown answer 'gift'")]


def test_missing_fields_and_nothing_left(spark):
    with pytest.raises(MissingField):
        run_lines(frame(spark), Run(Mapping({k: v for k, v in FIELDS.items() if k != "quantity"})))
    with pytest.raises(MissingField):
        run_lines(frame(spark).drop("Price"), Run(Mapping(FIELDS)))
    refused(spark, swapped(4, None), plan=CleaningPlan(columns=(Step("drop_rows_missing", "Cust"),)), error=NothingLeft)


def test_proof_comes_from_rows_that_the_plan_drops(spark):
    rows = [("13/01/2024", "1", "€1,00", "Mug", None, "1"), ("05/06/2024", "2", "€2,00", "Tea", "Bo", "2")]
    out = run_lines(frame(spark, rows), Run(Mapping(FIELDS), CleaningPlan(columns=(Step("drop_rows_missing", "Cust"),))))
    assert [str(r.txn_day) for r in out.lines.collect()] == ["2024-06-05"]
    assert [(r.action, r.rows) for r in out.log.collect()] == [("drop_rows_missing", 1)]


def test_open_questions_and_warnings(spark):
    rows = [(f"{d:02d}/01/2024", "1", "€2,00", "Tea", "Walk-in" if d % 2 else "Bo", str(d // 8)) for d in range(1, 29)] + [("29/01/2024", "1", "€3,00", "Postage", " NA ", "x")]
    out = run_lines(frame(spark, rows), Run(Mapping(FIELDS), CleaningPlan(columns=(Step("trim_whitespace", "Cust"),))))
    asked = {(r.question, r.subject) for r in out.open_questions.collect()}
    assert {("placeholder", "walk-in"), ("line_class", "product_name:Postage"), ("order_id_is_receipt", "No")} <= asked
    assert [(r.warning, r.subject, r.cells) for r in out.warnings.collect()] == [("text_reads_as_missing", "Cust", 1)]
    told = (("placeholder", "Walk-in", "no"), ("line_class", "product_name:Postage", "product"), ("order_id_is_receipt", "", "yes"))
    after = run_lines(frame(spark, rows), Run(Mapping(FIELDS), CleaningPlan(columns=(Step("trim_whitespace", "Cust"),)), told))
    assert not {("placeholder", "walk-in"), ("line_class", "product_name:Postage"), ("order_id_is_receipt", "No")} & {(r.question, r.subject) for r in after.open_questions.collect()}


def test_from_files_with_their_encoding(spark, tmp_path):
    text = "Date;Qty;Price;Product;Cust;No\n" + "\n".join(";".join(r).replace("Mug", "Caf\xe9") for r in swapped(2, "2,50")) + "\n"
    (tmp_path / "f.csv").write_bytes(text.encode("latin-1"))
    out = run_files(spark, str(tmp_path / "f.csv"), Run(Mapping(FIELDS)))
    assert {r.product_label_text for r in out.lines.collect()} >= {"Caf\xe9"}
    assert [r.warning for r in out.warnings.collect()] == ["encoding_fallback"]


def test_currency_is_told_from_distinct_cells(spark, monkeypatch):
    """Money cells are looked through once each; only a column that names currencies is read beside its lines."""
    seen, finding = [], run.currency_finding
    monkeypatch.setattr(run, "currency_finding", lambda df, *a: seen.append(df) or finding(df, *a))
    rows = [*ROWS, *ROWS, *ROWS]
    found = {r.question: r.answer for r in run.decide(frame(spark, rows), Run(Mapping(FIELDS))).collect()}
    assert found["currency"] == "EUR" and seen[0].count() == len({r[2] for r in ROWS})
    named = frame(spark, rows).selectExpr("*", "if(line_no < 5, 'EUR', 'USD') as Currency")
    problems = {r.question: r.problem for r in run.decide(named, Run(Mapping(FIELDS))).collect()}
    assert problems["currency"] == "more than one currency" and seen[1].count() == len(rows)
