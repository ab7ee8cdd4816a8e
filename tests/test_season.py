import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tillscope.operators import forecast, signals


def month(i):
    return dt.date(2018 + i // 12, i % 12 + 1, 1)


def world(spark, values, rows=None):
    core = spark.createDataFrame([(month(i), float(v), abs(float(v))) for i, v in enumerate(values)], "month date, revenue double, money_moved double")
    complete = core.select("month")
    last = month(len(values) - 1)
    period = spark.createDataFrame([(last, month(len(values) - 2))], "current date, previous date")
    window = signals.season_window(core, complete, period)
    ratios = forecast.detrended(window)
    indices = forecast.season_indices(ratios)
    return core, period, window, ratios, indices, forecast.season_claim(ratios, indices)


def seasonal(years, noise=0.0):
    shape = [1.6, 1.1, 0.7, 1.0, 0.6, 1.3, 0.8, 0.9, 1.2, 0.7, 1.1, 1.9]
    return [1000 * 1.01 ** i * shape[i % 12] * (1 + noise * math.sin(i * 1.7)) for i in range(12 * years)]


def test_a_season_is_claimed_and_carries_the_forecast(spark):
    core, period, window, ratios, indices, claim = world(spark, seasonal(4))
    c = claim.first()
    assert c.claimed and c.years == 4 and c.note is None
    found = forecast.forecast(window, indices, claim, period, forecast.t_table(spark)).orderBy("h").collect()
    shape = seasonal(5)
    assert [r.point for r in found] == pytest.approx(shape[48:51], rel=0.06) and all(r.low < r.point < r.high and r.seasonal for r in found)


@pytest.mark.parametrize("values, refusal", [
    ([1000.0 + i % 5 for i in range(36)], "gap"), ([1000.0 * (1 + (i * 7919 % 13) / 6) for i in range(36)], None), ([100.0 * 1.2 ** (i % 12) for i in range(36)], "ramp"),
])
def test_refusals(spark, values, refusal):
    claim = world(spark, values)[5].first()
    assert not claim.claimed and (refusal is None or claim.refusal == refusal)


def test_window_stops_at_a_month_without_rows(spark):
    core, period, *_ = world(spark, [100.0] * 30)
    kept = core.filter(F.col("month") != F.lit(month(20)))
    window = signals.season_window(kept, core.select("month"), period)
    assert window.count() == 9 and window.agg(F.min("month")).first()[0] == month(21)
    assert forecast.detrended(window).count() == 0


def test_short_histories(spark):
    for n, rows in ((2, 0), (3, 3)):
        _, period, window, _, indices, claim = world(spark, [100.0, 120.0, 90.0][:n])
        assert forecast.forecast(window, indices, claim, period, forecast.t_table(spark)).count() == rows
    got = forecast.forecast(window, indices, claim, period, forecast.t_table(spark)).orderBy("h").first()
    level = (100 + 240 + 270) / 6
    spread = math.sqrt(sum((v - 310 / 3) ** 2 for v in (100, 120, 90)) / 2)
    assert got.point == pytest.approx(level) and got.high - got.point == pytest.approx(spread * forecast.t_quantile(2))


def test_t_quantiles():
    # Published table values for the 90th percentile.
    for df, want in ((1, 3.0777), (2, 1.8856), (5, 1.4759), (10, 1.3722), (30, 1.3104), (120, 1.2886)):
        assert forecast.t_quantile(df) == pytest.approx(want, abs=6e-5)


def test_control_limits_rules(spark):
    flat = [100, 102, 99, 101, 100, 103, 98, 101, 100, 102, 99, 101]

    def run(values):
        core, period, *_ = world(spark, values)
        series = core.select("month", F.lit("revenue").alias("series"), F.col("revenue").alias("value"))
        n = len(values)
        history = core.filter(F.col("month") < F.lit(month(n - 1))).select("month")
        return signals.signals(series, history, core.select("month"), period, core.select("month")).first()

    assert run(flat + [160]).signal == "above" and run(flat + [160]).rule == 1
    assert run(flat + [100]).signal == "within"
    assert run([90, 91, 92, 90, 91, 93] + [104, 105, 104, 105, 104, 106, 105] + [104]).rule in (1, 2)
    assert run(flat[:6] + [100]).insufficient_reason == "too_few_points"
    assert run([50.0] * 12 + [50.0]).limits_method == "minimum_spread"
    assert run([50.0] * 12 + [60.0]).signal == "above"
