"""What used to stop at a fixed number, or lose rows: quantiles, dominant values, names, labels, scopes without a value, written dates."""

import random

import pytest
from pyspark.sql import functions as F

from tillscope.functions import dates as D
from tillscope.operators import customers, forecast, metrics, periods, products
from tillscope.session import shared_folder


def test_t_quantiles_go_on_past_the_table(spark):
    got = {r.df: r.t for r in spark.createDataFrame([(d,) for d in (300, 400, 500, 1_000, 100_000)], "df int").withColumn("t", forecast.t_series(F.col("df"))).collect()}
    for df in (300, 400, 500, 1_000):
        assert got[df] == pytest.approx(forecast.t_quantile(df), rel=1e-9)
    assert got[100_000] < got[1_000]


def brute_dominant(values):
    order = sorted((v for v in values if v > 0), reverse=True)
    out = []
    for a, b in zip(order, order[1:], strict=False):
        if a < 4 * b:
            break
        out.append(a)
    return out


def test_dominant_values_from_their_powers(spark):
    rng = random.Random(3)
    for case in ([1.0, 4.0, 16.0, 3.0], [5.0, 5.0, 1.0], [4.0**k for k in range(30)], [0.0, -2.0, 8.0, 1.0], [rng.choice([1, 4, 15, 16, 64, 300, 1200]) * 1.0 for _ in range(9)], [7.0]):
        df = spark.createDataFrame([("s", f"c{i}", v) for i, v in enumerate(case)], "s string, customer string, v double")
        got = [case[int(r.customer[1:])] for r in customers._dominant(df, ["s"], "v").collect()]
        assert sorted(got, reverse=True) == brute_dominant(case)


def test_placeholder_words_for_not_available(spark):
    cells = ["n/a", "n.a.", "na", "#n/a", "n a", "#na", "n/a/", "nan", "ana", "n//a", "n.a", "na#", "north"]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string").orderBy("i").select(customers.is_placeholder_word(F.col("t"))).collect()]
    assert got == [True, True, True, True, True, True, False, False, False, False, True, False, False]


def test_type_names_stay_apart(spark):
    long = "x" * 37
    rows = [("a", long + "-one", 1), ("b", long + "-two", 2), ("c", "(other values)", 3), ("d", "plain", 4), ("e", "PLAIN", 5), ("f", "rest", 6)]
    got = {r.value: r.name for r in metrics._names_apart(spark.createDataFrame(rows, "value string, spelling string, rank int"), []).collect()}
    assert len(got) == 5 and len({n.lower() for n in got.values()}) == 5 and all(len(n) <= 40 for n in got.values())
    assert got["a"] == long + "..." and got["b"] == "x" * 33 + "... (2)" and got["c"] == "(other values) (2)" and got["e"] == "PLAIN (2)"


def test_labels_are_unique_whatever_collides(spark):
    shown = ["MUG", "MUG (2)", "MUG", "MUG (2) (2)", "mug", "MUG (3)", products.GAP_LABEL]
    df = spark.createDataFrame([(f"p{i}", s, i) for i, s in enumerate(shown)], "product_key string, shown string, first_line int")
    got = [r.shown for r in products._numbered(df, []).orderBy("first_line").collect()]
    assert len({g.lower() for g in got}) == len(got) and got[:2] == ["MUG", "MUG (2)"] and products.GAP_LABEL not in got


def brute_labels(shown):
    seen, out = {products.GAP_LABEL}, []
    for label in shown:
        number, tried = 1, label
        while tried.lower() in seen:
            number += 1
            tried = f"{label} ({number})"
        seen.add(tried.lower())
        out.append(tried)
    return out


def test_labels_take_the_lowest_free_number(spark):
    rng = random.Random(8)
    words = ["MUG", "mug", "MUG (2)", "Mug (3)", "MUG (4)", "MUG (7)", "MUG (2) (2)", "MUG (2) (3)", "MUG (2) (2) (2)", "MUG (1)", "MUG (1) (2)", "CUP", "CUP (2)", "CUP (02)", products.GAP_LABEL, products.GAP_LABEL + " (2)"]
    rows = []
    for case in range(60):
        some = rng.sample(words, rng.randint(1, len(words)))
        rows += [(case if case else None, f"p{rng.random()}", rng.choice(some), i) for i in range(rng.randint(1, 25))]
    df = spark.createDataFrame(rows, "shop int, product_key string, shown string, first_line int")
    got = {}
    for r in products._numbered(df, ["shop"]).orderBy("first_line").collect():
        got.setdefault(r.shop, []).append(r.shown)
    for shop in {r[0] for r in rows}:
        assert got[shop] == brute_labels([r[2] for r in rows if r[0] == shop])


def test_a_hundred_thousand_products_of_one_name(spark):
    df = spark.range(100_000).select(F.concat(F.lit("p"), "id").alias("product_key"), F.when(F.col("id") % 1_000 == 999, F.concat(F.lit("mug ("), F.col("id") + 1, F.lit(")")))
                                     .otherwise("MUG").alias("shown"), F.col("id").alias("first_line"))
    rows = products._numbered(df, []).orderBy("first_line").select("shown").collect()
    want, own, taken = [], 0, set()
    for i in range(100_000):
        named = i + 1 if i % 1_000 == 999 else None
        if named is None:
            own += 1
            while own in taken:
                own += 1
            want.append("MUG" if own == 1 else f"MUG ({own})")
        elif named > own:
            taken.add(named)
            want.append(f"mug ({named})")
        else:
            want.append(f"mug ({named}) (2)")
    assert [r.shown for r in rows] == want


def test_a_scope_without_a_value_is_a_scope(spark):
    months = [("2024-01-01", 1.0), ("2023-12-01", 2.0), ("2023-11-01", 3.0)]
    table = spark.createDataFrame([(s, m, a) for s in (None, "x") for m, a in months], "s string, month string, amount double").withColumn("month", F.to_date("month"))
    period = spark.createDataFrame([(s, "2024-01-01", "2023-12-01") for s in (None, "x")], "s string, current string, previous string").select("s", F.to_date("current").alias("current"), F.to_date("previous").alias("previous"))
    got = periods.compared(table, period, ["s"]).collect()
    assert sorted((r.s or "", r.slot, r.amount) for r in got) == [("", "cur", 1.0), ("", "prev", 2.0), ("x", "cur", 1.0), ("x", "prev", 2.0)]


@pytest.mark.parametrize("cell, day_first", [
    ("6-Jan-24", "2024-01-06 00:00:00"), ("5 Jan 24", "2024-01-05 00:00:00"), ("Sat Jan 06 2024", "2024-01-06 00:00:00"), ("Saturday, 6 January 2024", "2024-01-06 00:00:00"),
    ("10.30.00 05/01/26", "2026-01-05 10:30:00"), ("10.05.30 05-01-2026", "2026-01-05 10:05:30"), ("09.15.00 05.01.26", None), ("Sat Jan 06 01:00:00 +0000 2024", "2024-01-06 01:00:00"),
    ("March 3rd, 2024", "2024-03-03 00:00:00"), ("Jan 2024", "2024-01-01 00:00:00"), ("05-01-2026.10:30:00", "2026-01-05 10:30:00"), ("1/6/2024 9:15:02 AM -05:00", "2024-06-01 09:15:02"),
    ("01/02/03/2024", None), ("05/01/2024 b", None), ("12:30 05/01", None), ("2024-1-5 25:00", None), ("13/13/2024", None),
])
def test_more_written_dates(spark, cell, day_first):
    df = spark.createDataFrame([(cell,)], "t string")
    assert df.select(D.read_date(F.col("t"), F.lit("day_first")).cast("string")).first()[0] == day_first


def test_written_formats():
    assert D.spark_format("%d/%m/%Y %H:%M") == "d/M/yyyy H:m" and D.spark_format("yyyy-MM-dd") == "yyyy-MM-dd"
    assert D.spark_format("%Y-%m-%dT%H:%M:%S%z") == "yyyy-M-d'T'H:m:s"
    with pytest.raises(ValueError, match="%Q"):
        D.spark_format("%Q")


def test_shared_folder_off_local_masters():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf({"spark.master": "local-cluster[2,1,1024]"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert shared_folder(Session()) == "hdfs:///shared"
