import itertools
import random

import pytest
from pyspark.sql import functions as F

from tillscope.functions import dates as D
from tillscope.functions import numbers as N
from tillscope.functions import text as T
from tillscope.operators.classify import class_word
from tillscope.operators.customers import is_placeholder_word


def values(spark, cells, *columns):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string")
    return [tuple(r[1:]) for r in df.select("i", *columns).orderBy("i").collect()]


def test_blank_cells(spark):
    cells = [None, "", "   ", " ", "​", "⁠­", "x", "؀", "0", "\x1c"]
    got = [r[0] for r in values(spark, cells, T.is_blank(F.col("t")))]
    assert got == [True, True, True, True, True, True, False, False, False, True]


def test_long_texts_do_not_exhaust_the_pattern_engine(spark):
    cells = ["word " * 60000, " " * 300000, "​" * 200000, "x" * 300000, "ü " * 100000, "a" + " " * 90000 + "b"]
    got = values(spark, cells, T.is_blank(F.col("t")), F.length(T.product_text(F.col("t"))), F.length(T.identifier_text(F.col("t"))),
                 class_word(F.col("t")), N.human_number(F.col("t")).isNull(), D.read_date(F.col("t")).isNull())
    assert [g[0] for g in got] == [False, True, True, False, False, False] and [g[1] for g in got] == [299999, None, None, 300000, 199999, 3]
    assert all(g[4] and g[5] for g in got)


def test_identity_keeps_what_a_reader_can_tell_apart(spark):
    cells = ["INV1", "INV1​", " INV1 ", " inv1", "IN‎V1", "a  b"]
    got = [r[0] for r in values(spark, cells, T.identifier_text(F.col("t")))]
    assert got == ["INV1", "INV1", "INV1", "inv1", "INV1", "a  b"]
    assert [r[0] for r in values(spark, cells, T.category_text(F.col("t")))][-1] == "a b"


def test_product_text_and_fold(spark):
    cells = ["  Red   mug​", "Maßband", "MASSBAND", "⠀", None]
    got = values(spark, cells, T.product_text(F.col("t")), T.text_identity(F.col("t")))
    assert got == [("Red mug", "red mug"), ("Maßband", "massband"), ("MASSBAND", "massband"), (None, None), (None, None)]


def test_composed_and_decomposed_names_meet(spark):
    df = spark.createDataFrame([(1, "café"), (2, "café"), (3, "plain"), (4, None)], "i int, t string")
    got = {r.i: r.t for r in T.compose_columns(df, ["t"]).collect()}
    assert got == {1: "café", 2: "café", 3: "plain", 4: None}


def test_title_case_capitalises_after_every_non_letter(spark):
    assert [r[0] for r in values(spark, ["o'neil-smith", "ABC def 3rd"], T.title_case(F.col("t")))] == ["O'Neil-Smith", "Abc Def 3Rd"]


def test_strict_numbers(spark):
    cells = ["12", " 1.5 ", "-3e2", ".5", "5.", "1.0d", "1f", "inf", "nan", "1,000", "", None, "1e999"]
    got = [r[0] for r in values(spark, cells, N.strict_number(F.col("t")))]
    assert got == [12.0, 1.5, -300.0, 0.5, 5.0, None, None, None, None, None, None, None, None]


@pytest.mark.parametrize("cell, shape, point, comma", [
    ("1,234.50", "point", "1234.50", None), ("1.234,50", "comma", None, "1234.50"), ("1,000", "ambiguous", "1000", "1.000"),
    ("1.000", "ambiguous", "1.000", "1000"), ("0,500", "comma", None, "0.500"), ("-5", "plain", "-5", "-5"), ("5-", "plain", "-5", "-5"),
    ("€ 1 234", "plain", "1234", "1234"), ("-$5", "plain", "-5", "-5"), ("$-5", "plain", "-5", "-5"), ("1'000'000.25", "point", "1000000.25", None),
    (".5", "point", "0.5", None), ("+2.500", "ambiguous", "2.500", "2500"), ("-5-", None, None, None), ("1,23,4", None, None, None),
    ("5.", None, None, None), ("abc", None, None, None), ("1 2345", None, None, None),
])
def test_human_numbers(spark, cell, shape, point, comma):
    read = N.human_number(F.col("t"))
    got = values(spark, [cell], read["shape"], read["point_text"], read["comma_text"])[0]
    assert got == (shape, point, comma)


@pytest.mark.parametrize("cell, plain, day_first", [
    ("2024-01-05", "2024-01-05 00:00:00", "2024-01-05 00:00:00"), ("2024-01-05T10:30:00+02:00", "2024-01-05 10:30:00", "2024-01-05 10:30:00"),
    ("01/02/2024", "2024-01-02 00:00:00", "2024-02-01 00:00:00"), ("13/01/2024", "2024-01-13 00:00:00", "2024-01-13 00:00:00"),
    ("5 Jan 2024", "2024-01-05 00:00:00", "2024-01-05 00:00:00"), ("January 5, 2024 3:05 PM", "2024-01-05 15:05:00", "2024-01-05 15:05:00"),
    ("20240330T101500+1100", "2024-03-30 10:15:00", "2024-03-30 10:15:00"), ("now", None, None), ("10:30", None, None), ("1970-01-01", None, None),
    ("31/02/2024", None, None), ("2024-13-45", None, None), ("2150-01-01", None, None), ("05.01.2024 10.30", None, "2024-01-05 10:30:00"),
])
def test_dates(spark, cell, plain, day_first):
    got = values(spark, [cell], D.read_date(F.col("t")).cast("string"), D.read_date(F.col("t"), F.lit("day_first")).cast("string"))[0]
    if cell.endswith("10.30"):
        assert got[1] == day_first
    else:
        assert got == (plain, day_first)


def test_class_words_at_an_end_only(spark):
    cells = ["postage", "dotcom postage", "postage stamps box", "coffee", "fees", "bank charges", "gift_0001_20", "p & p", "manual", "phí ship", "red mug", "sampler"]
    got = [r[0] for r in values(spark, cells, class_word(F.col("t")))]
    assert got == ["charge", "charge", "charge", None, "cost", "cost", None, "charge", "pooled", "charge", None, None] or got[6] in (None, "gift_card")
    assert got[:6] == ["charge", "charge", "charge", None, "cost", "cost"] and got[7:] == ["charge", "pooled", "charge", None, None]


def test_placeholder_words(spark):
    cells = ["walk-in", "guest 2", "cashmere ltd", "0", "-1", "n/a", "-", "customer", "customer 12", "unknown"]
    got = [r[0] for r in values(spark, cells, is_placeholder_word(F.col("t")))]
    assert got == [True, True, False, True, True, True, True, True, False, True]


def test_shapley_closed_forms_equal_all_orderings(spark):
    rng = random.Random(7)
    for _ in range(5):
        a = [rng.uniform(-5, 9) for _ in range(3)]
        b = [rng.uniform(-5, 9) for _ in range(3)]
        for size in (2, 3):
            want = [0.0] * size
            orders = list(itertools.permutations(range(size)))
            for order in orders:
                now = list(a[:size])
                for i in order:
                    before = 1.0
                    for v in now:
                        before *= v
                    now[i] = b[i]
                    after = 1.0
                    for v in now:
                        after *= v
                    want[i] += (after - before) / len(orders)
            args = [F.lit(x) for pair in zip(a[:size], b[:size]) for x in pair]
            parts = (N.shapley2 if size == 2 else N.shapley3)(*args)
            got = spark.range(1).select(*parts).first()
            assert all(abs(x - y) < 1e-9 for x, y in zip(got, want))


def test_percentage_guards(spark):
    df = spark.createDataFrame([(110.0, 100.0), (5.0, 0.0), (5.0, -2.0), (1e12, 1e-9)], "c double, p double")
    got = [tuple(r) for r in df.select(N.pct_change(F.col("c"), F.col("p")), N.pct_change_reason(F.col("c"), F.col("p"))).collect()]
    assert got[0][0] == pytest.approx(10.0) and got[0][1] is None
    assert [g[1] for g in got[1:]] == ["no_previous_value", "previous_is_negative", "previous_is_residue"]


@pytest.mark.parametrize("cell", ["2024-01-05", "2024/02/30", "1970-01-01", "01/02/2024", "13/01/2024", "13-13-2024", "31.12.1999", "00/01/2024", "01/02-1900", "01/01/1900", "01/02/1970"])
def test_days_alone_are_read_as_with_a_time(spark, cell):
    for order in (None, F.lit("day_first"), F.lit("month_first"), F.lit(None).cast("string")):
        alone, timed = values(spark, [cell], D.read_date(F.col("t"), order), D.read_date(F.concat("t", F.lit(" 00:00")), order))[0]
        assert alone == timed


def test_days_alone_spare_the_tokens(spark, monkeypatch):
    """A cell that is a day alone is read in generated code; its tokens are never taken."""
    monkeypatch.setattr(D, "tokens", lambda text: F.split(F.raise_error(F.concat(F.lit("taken apart: "), text)).cast("string"), " "))
    read = D.read_date(F.col("t"), F.lit("day_first")).cast("string")
    assert values(spark, ["05/01/2024", "2024-01-05", "31/02/2024"], read) == [("2024-01-05 00:00:00",), ("2024-01-05 00:00:00",), (None,)]
    with pytest.raises(Exception, match="taken apart"):
        values(spark, ["5 Jan 2024"], read)


@pytest.mark.parametrize("cell, point, comma", [
    ("12", "12", "12"), ("007", "007", "007"), ("12.50", "12.50", "12.50"), ("€12,00", "12.00", "12.00"), ("$5.5", "5.5", "5.5"), ("1,000", "1000", "1.000"),
    ("5.", "5.", "5."), ("12,5\n", "12.5", "12.5"), ("€", "€", "€"),
])
def test_numbers_as_decided(spark, cell, point, comma):
    got = values(spark, [cell], *[N.number_as_decided(F.col("t"), F.lit(d)) for d in ("decimal_point", "decimal_comma")])[0]
    assert got == (point, comma)
