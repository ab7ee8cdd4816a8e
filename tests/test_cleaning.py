import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillscope.operators import currency, issues, profile
from tillscope.plans.cleaning import CleaningPlan, Step, apply_action, dropped_rows_report, preview, run_plan

ROWS = [(0, "S1", " Mug ", "2", "10", "2024-01-05"), (1, "S2", "Tea", "-1", None, "13/01/2024"), (2, "S1", " Mug ", "2", "10", "2024-01-05"),
        (3, "S3", None, "3", "1000", "2024-01-07"), (4, "S4", "Cup", "x", "12", "soon")]


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(ROWS, "line_no bigint, sku string, name string, qty string, price string, day string")


def column(df, name):
    return [r[0] for r in df.orderBy("line_no").select(name).collect()]


def log_of(log):
    return {(r.action, r.column): (r.cells, r.rows) for r in log.collect()}


def test_each_action(dirty):
    out, log = apply_action(dirty, "impute_median", "price")
    assert column(out, "price") == ["10", "11.0", "10", "1000", "12"] and log_of(log)[("impute_median", "price")] == (1, 0)
    out, _ = apply_action(dirty, "impute_mode", "name")
    assert column(out, "name")[3] == " Mug "
    out, log = apply_action(dirty, "drop_rows_missing", "name")
    assert out.count() == 4 and log_of(log)[("drop_rows_missing", "name")] == (0, 1)
    out, log = apply_action(dirty, "remove_exact_duplicates")
    assert sorted(column(out, "line_no")) == [0, 1, 3, 4] and log_of(log)[("remove_exact_duplicates", None)] == (0, 1)
    out, log = apply_action(dirty, "trim_whitespace", "name")
    assert column(out, "name") == ["Mug", "Tea", "Mug", None, "Cup"] and log_of(log)[("trim_whitespace", "name")] == (2, 0)
    out, log = apply_action(dirty, "cast_type", "qty", {"target": "integer"})
    assert column(out, "qty") == [2, -1, 2, 3, None] and column(out, "__flag_cast_failed__qty") == [False, False, False, False, True]
    out, log = apply_action(dirty, "parse_datetime", "day", {"dayfirst": True})
    assert [d and d.date() for d in column(out, "day")] == [dt.date(2024, 1, 5), dt.date(2024, 1, 13), dt.date(2024, 1, 5), dt.date(2024, 1, 7), None]
    out, _ = apply_action(dirty, "fix_negative", "qty", {"strategy": "abs"})
    assert column(out, "qty")[1] == "1.0"
    out, log = apply_action(dirty, "flag_duplicate_keys", None, {"keys": ["sku", "day"]})
    assert column(out, "__flag_duplicate_key") == [True, False, True, False, False] and log_of(log)[("flag_duplicate_keys", None)] == (0, 2)
    out, _ = apply_action(dirty, "clip_outliers_iqr", "price", {"k": 1.5})
    assert float(column(out, "price")[3]) < 1000
    with pytest.raises(ValueError):
        apply_action(dirty, "drop_column", "nope")


def test_first_copy_stays_and_a_hot_row_costs_one_group(spark):
    df = spark.range(9000).select(F.col("id").alias("line_no"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a"))
    out, log = apply_action(df, "remove_exact_duplicates")
    assert out.count() == 6001 and out.filter("a = 'hot'").first().line_no == 0
    assert log.first().rows == 2999


def test_plan_order_is_fixed_and_the_log_is_one_pass(dirty):
    plan = CleaningPlan(columns=(Step("impute_median", "price"), Step("drop_rows_missing", "name"), Step("trim_whitespace", "name"),
                                 Step("drop_column", "sku"), Step("fix_negative", "qty")))
    out, log = run_plan(dirty, plan)
    assert [r.action for r in log.orderBy("position").collect()] == ["drop_column", "trim_whitespace", "drop_rows_missing", "impute_median", "fix_negative"]
    # The dropped row's 1000 no longer pulls the median.
    assert column(out, "price") == ["10", "10.0", "10", "12"]
    assert "sku" not in out.columns and column(out, "__flag_negative__qty") == [False, True, False, False]
    assert [tuple(r) for r in dropped_rows_report(log).collect()] == [("drop_rows_missing", "name", 1)]


def test_flags_nothing_set_leave_no_column(dirty):
    out, _ = apply_action(dirty, "fix_negative", "price")
    assert not [c for c in out.columns if c.startswith("__flag_")]


def test_number_question_refuses_or_rewrites(spark):
    df = spark.createDataFrame([(0, "1,000"), (1, "2,500"), (2, "7")], "line_no bigint, p string")
    with pytest.raises(profile.AnswerNeeded):
        profile.rewrite_numbers(df, ["p"])
    out, log = profile.rewrite_numbers(df, ["p"], {"p": "decimal_comma"})
    assert column(out, "p") == ["1.000", "2.500", "7"] and log.first().rewritten == 2
    proven = spark.createDataFrame([(0, "1,000"), (1, "2,500.75")], "line_no bigint, p string")
    assert column(profile.rewrite_numbers(proven, ["p"])[0], "p") == ["1000", "2500.75"]
    with pytest.raises(profile.AnswerNeeded):
        profile.rewrite_numbers(proven, ["p"], {"p": "decimal_comma"})


def test_date_order_evidence(spark):
    df = spark.createDataFrame([("01/02/2024",), ("01/03/2024",), ("01/04/2024",), ("x",)], "d string")
    e = profile.date_order_evidence(profile.value_counts(df)).first()
    assert (e.shaped, e.ambiguous, e.decision, e.hint) == (3, 3, "ask", "day_first")
    df = spark.createDataFrame([("25/12/2024",), ("01/02/2024",)], "d string")
    assert profile.date_order_evidence(profile.value_counts(df)).first().decision == "day_first"


def test_issue_counts_on_small_columns(spark):
    df = spark.createDataFrame([("Cafe", "1", "Coca-Cola"), ("Cafe", "2", "coca cola"), ("cafe", "-3", "Coca-Cola"), (" Bar", "0", "Pepsi"), (None, "x", "Pepsi")],
                               "a string, b string, c string")
    got = {(r.column, r.code): r["count"] for r in issues.issue_counts(profile.value_counts(df)).collect()}
    assert got[("a", "inconsistent_case")] == 1 and got[("a", "trailing_whitespace")] == 1 and got[("a", "missing_values")] == 1
    assert got[("b", "negative_values")] == 1 and got[("b", "zero_values")] == 1 and got[("b", "non_numeric_in_numeric")] == 1 and got[("b", "mixed_types")] == 1
    assert got[("c", "near_duplicate_labels")] == 1 and ("c", "inconsistent_case") not in got


def test_currency(spark):
    def find(rows, cols, money):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line_no bigint, " + ", ".join(f"`{c}` string" for c in cols))
        return currency.currency_finding(df, money)[0].first()

    assert find([("£5",), ("£6",)], ["price"], ["price"]).code == "GBP"
    assert find([("$5",), ("6",)], ["price"], ["price"]).kind == "narrowed"
    assert find([("$5",)], ["Price (AUD)"], ["Price (AUD)"]).code == "AUD"
    assert find([("£5",), ("€5",)], ["price"], ["price"]).kind == "mixed"
    assert find([("5", "EUR"), ("6", "EUR")], ["price", "Currency"], ["price"]).code == "EUR"
    mixed = find([("5", "EUR"), ("6", "USD")], ["price", "Currency"], ["price"])
    assert mixed.kind == "mixed"
    assert find([("5",)], ["price"], ["price"]).kind == "none"


def test_preview(dirty):
    plan = CleaningPlan(columns=(Step("trim_whitespace", "name"), Step("drop_rows_missing", "name")))
    out = preview(dirty, plan, ["sku", "name", "qty", "price", "day"], ["qty", "price"], ["day"])
    assert {r.line_no: (r.dropped, r.changed) for r in out["rows"].collect()}[3] == (True, [])
    assert out["size"].first().asDict() == {"sample_rows": 5, "rows_after": 4}
