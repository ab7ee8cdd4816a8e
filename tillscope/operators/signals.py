"""Calendar effect, monthly series, control limits, size of a movement, comparison with the season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.functions.numbers import RESIDUE, is_negligible, pct_change, pct_change_reason
from tillscope.operators.periods import month_days, with_period
from tillscope.operators.ranking import join_same

# --- fixed values -------------------------------------------------------------------------------
CALENDAR_MIN_WEEKS = 8
XMR_MEAN, XMR_MEDIAN, XMR_MIN_POINTS, XMR_RUN = 2.66, 3.145, 8, 8
MIN_SPREAD_SHARE, MIN_SPREAD_RATE, MIN_SPREAD_YOY = 0.01, 0.01, 2.0
XMR_TOLERANCE, XMR_FLOOR = 1e-9, 1e-6
YOY_LAG, YOY_MIN_BASE, YOY_MIN_MONTHS = 12, 0.03, 21
MOVEMENT_FACTOR, SEASON_BEYOND, MIN_MOVEMENTS = 2.0, 4.0, 7
SERIES = ("revenue", "orders", "active_customers", "frequency", "aov", "units_per_order", "price_per_unit", "return_rate")
CUSTOMER_SERIES = ("active_customers", "frequency")
# -------------------------------------------------------------------------------------------------


def daily_revenue(lines: DataFrame, scope: list[str]) -> DataFrame:
    return lines.filter("counted").groupBy(*scope, F.col("txn_day").alias("day")).agg(F.sum("amount").alias("revenue"))


def weekday_weights(lines: DataFrame, history: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Median revenue per calendar date of each weekday over the history, days without revenue included."""
    scope = scope or []
    calendar = month_days(history, scope)
    daily = join_same(calendar, daily_revenue(lines, scope), [*scope, "day"], "left")
    return daily.groupBy(*scope, "weekday").agg(
        F.median(F.coalesce("revenue", F.lit(0.0))).alias("weight"), F.count("*").alias("dates"))


def calendar_effect(lines: DataFrame, core: DataFrame, history: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """How much of the change the mix of weekdays explains; day counts with under eight weeks of history."""
    scope = scope or []
    weights = weekday_weights(lines, history, scope)
    days = weights.groupBy(*scope).agg(F.sum("dates").alias("history_days"))
    pair = period.select(*scope, F.explode(F.array("current", "previous")).alias("month"))
    expected = join_same(month_days(pair, scope), weights, [*scope, "weekday"], "left").groupBy(*scope, "month").agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("weighted"), F.count("*").cast("double").alias("n"))
    known = join_same(expected, core.select(*scope, "month", "revenue"), [*scope, "month"], "left")
    wide = with_period(with_period(known, period.select(*scope, "current", "previous", "month_grain"), scope), days, scope)
    enough = F.coalesce(F.col("history_days") >= CALENDAR_MIN_WEEKS * 7, F.lit(False))
    at = lambda m, c: F.max(F.when(F.col("month") == F.col(m), c))
    value = F.when(enough, F.col("weighted")).otherwise(F.col("n"))
    sides = wide.groupBy(*scope, "month_grain", "history_days").agg(
        at("current", value).alias("expected_cur"), at("previous", value).alias("expected_prev"),
        F.coalesce(at("current", F.col("revenue")), F.lit(0.0)).alias("__rc"), F.coalesce(at("previous", F.col("revenue")), F.lit(0.0)).alias("__rp"))
    ratio = F.coalesce(F.try_divide("expected_cur", "expected_prev"), F.lit(1.0))
    effect = F.when(F.col("month_grain"), 0.0).otherwise(F.col("__rp") * (ratio - 1))
    method = F.when(F.col("month_grain"), "not_applicable").when(enough, "weekday_weights").otherwise("day_count")
    only = lambda c: F.when(~F.col("month_grain"), F.col(c)).alias(c)
    return sides.select(*scope, method.alias("method"), only("expected_cur"), only("expected_prev"), effect.alias("calendar_effect"),
                        (F.col("__rc") - F.col("__rp") - effect).alias("adjusted_change"))


def monthly_series(core: DataFrame, complete: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``(month, series, value)`` for every complete month; months without rows hold zeros.

    Customer figures are null, not zero, in a month whose lines name nobody.
    """
    scope = scope or []
    table = join_same(complete, core, [*scope, "month"], "left")
    for c in ("revenue", "orders", "units", "return_orders", "active_customers", "buyers", "lines"):
        table = table.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    values = {
        "revenue": F.col("revenue"), "orders": F.col("orders"),
        "active_customers": F.when((F.col("active_customers") > 0) | (F.col("lines") == 0), F.col("active_customers")),
        "frequency": F.when(F.col("buyers") > 0, F.col("orders") / F.col("buyers")).when(F.col("orders") == 0, 0.0),
        "aov": per("revenue", "orders"), "units_per_order": per("units", "orders"),
        "price_per_unit": per("revenue", "units"), "return_rate": per("return_orders", "orders"),
    }
    wide = table.select(*scope, "month", *[v.cast("double").alias(f"s_{k}") for k, v in values.items()])
    tidy = wide.unpivot([*scope, "month"], [f"s_{k}" for k in values], "series", "value")
    return tidy.withColumn("series", F.substring("series", 3, 100))


def typical_magnitude(df: DataFrame, group: list[str], value: str, name: str = "typical") -> DataFrame:
    """Median size of the values that are not residue of the largest (at most a few dozen months per group)."""
    top = df.groupBy(*group).agg(F.max(F.abs(value)).alias("__top"))
    sized = join_same(df, top, group).filter(F.abs(F.col(value)) > RESIDUE * F.col("__top"))
    return sized.groupBy(*group).agg(F.median(F.abs(value)).alias(name))


def year_over_year(series: DataFrame, history: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Percentage change on the same month a year earlier, where that month is a usable base."""
    scope = scope or []
    group = [*scope, "series"]
    before = series.select(*group, F.add_months("month", YOY_LAG).alias("month"), F.col("value").alias("base"))
    in_history = join_same(series, history, [*scope, "month"], "left_semi").filter("value is not null")
    typical = typical_magnitude(in_history, group, "value")
    scale = series.groupBy(*group).agg(F.max(F.abs("value")).alias("__scale"))
    wide = join_same(join_same(join_same(series, before, [*group, "month"], "left"), typical, group, "left"), scale, group, "left")
    base = F.col("base")
    usable = (base > 0) & (base >= YOY_MIN_BASE * F.col("typical")) & ~is_negligible(base, F.col("__scale"))
    return wide.select(*group, "month", "value", F.when(F.coalesce(usable, F.lit(False)), (F.col("value") - base) / base * 100).alias("yoy"))


def signals(series: DataFrame, history: DataFrame, complete: DataFrame, period: DataFrame, with_rows: DataFrame,
            scope: list[str] | None = None) -> DataFrame:
    """Control limits per series, and whether the current month is above, below or within them.

    The year-over-year form is used when 21 complete months give eight usable history points and a
    value now; else the level. Everything here is at most a few dozen rows per scope and series.
    """
    scope = scope or []
    group = [*scope, "series"]
    yoy = year_over_year(series, history, scope)
    ready = complete.groupBy(*scope).agg((F.count("*") >= YOY_MIN_MONTHS).alias("__ready"))
    past = history.withColumn("__past", F.lit(True))
    wide = join_same(with_period(with_period(yoy, ready, scope), period.select(*scope, "current"), scope), past, [*scope, "month"], "left")
    wide = wide.withColumns({"__past": F.coalesce("__past", F.lit(False)), "__now": F.col("month") == F.col("current")}).filter("__past or __now")
    modes = wide.groupBy(*group).agg(
        (F.bool_and("__ready") & (F.count_if(F.col("__past") & F.col("yoy").isNotNull()) >= XMR_MIN_POINTS)).alias("__usable"),
        F.max(F.when(F.col("__now"), F.col("yoy"))).alias("__yoy_now"))
    rows_ago = with_rows.select(*scope, F.add_months("month", YOY_LAG).alias("current"), F.lit(True).alias("__rows_ago"))
    ago = series.select(*group, F.add_months("month", YOY_LAG).alias("__m"), F.col("value").alias("__ago"))
    chosen = join_same(wide, modes, group).withColumn("mode", F.when(F.col("__usable") & F.col("__yoy_now").isNotNull(), "yoy").otherwise("level"))
    chosen = chosen.withColumn("v", F.when(F.col("mode") == "yoy", F.col("yoy")).otherwise(F.col("value")))
    order = W.partitionBy(*group).orderBy("month")
    base = chosen.filter(F.col("__past") & F.col("v").isNotNull()).withColumn("__mr", F.abs(F.col("v") - F.lag("v").over(order)))
    limits = base.groupBy(*group).agg(
        F.count("*").alias("points"), F.avg("v").alias("center"), F.median("__mr").alias("__median"), F.avg("__mr").alias("__mean"))
    now = chosen.filter("__now").select(*group, "mode", "__usable", F.col("v").alias("value_cur"), "current")
    joined = join_same(join_same(now, limits, group, "left"), rows_ago, [*scope, "current"], "left")
    joined = join_same(joined, ago.withColumnRenamed("__m", "current"), [*group, "current"], "left")
    measured = F.when(F.col("__median") > 0, XMR_MEDIAN * F.col("__median")).otherwise(F.coalesce(XMR_MEAN * F.col("__mean"), F.lit(0.0)))
    minimum = F.when(F.col("mode") == "yoy", MIN_SPREAD_YOY).when(F.col("series") == "return_rate", MIN_SPREAD_RATE).otherwise(MIN_SPREAD_SHARE * F.abs("center"))
    joined = joined.withColumns({"__measured": measured, "__minimum": minimum}).withColumns({
        "spread": F.greatest("__measured", "__minimum"),
        "limits_method": F.when(F.col("__minimum") > F.col("__measured"), "minimum_spread").when(F.col("__median") > 0, "median_moving_range").otherwise("mean_moving_range"),
        "margin": F.greatest(XMR_TOLERANCE * F.abs("center"), F.lit(XMR_FLOOR))})
    # A run of eight: the last seven history months and the current one, all on one side.
    last = W.partitionBy(*group).orderBy(F.desc("month"))
    recent = join_same(chosen.filter("__past").withColumn("__n", F.row_number().over(last)).filter(F.col("__n") < XMR_RUN),
                       joined.select(*group, "center", "margin"), group)
    run = recent.groupBy(*group).agg(
        F.count("v").alias("__run"), F.bool_and(F.col("v") > F.col("center") + F.col("margin")).alias("__all_above"),
        F.bool_and(F.col("v") < F.col("center") - F.col("margin")).alias("__all_below"))
    joined = join_same(joined, run, group, "left")
    v, c, s, m = F.col("value_cur"), F.col("center"), F.col("spread"), F.col("margin")
    insufficient = (
        F.when(F.col("series").isin(*CUSTOMER_SERIES) & v.isNull(), "no_current_value")
        .when(F.coalesce(F.col("points"), F.lit(0)) < XMR_MIN_POINTS, "too_few_points").when(v.isNull(), "no_current_value")
        .when(s <= 0, "no_measurable_spread"))
    full = F.coalesce(F.col("__run") == XMR_RUN - 1, F.lit(False))
    rule = (
        F.when((v > c + s + m) | (v < c - s - m), 1)
        .when(full & ((F.col("__all_above") & (v > c + m)) | (F.col("__all_below") & (v < c - m))), 2))
    signal = (
        F.when(insufficient.isNotNull(), "insufficient_history").when(v > c + s + m, "above").when(v < c - s - m, "below")
        .when(full & F.col("__all_above") & (v > c + m), "above").when(full & F.col("__all_below") & (v < c - m), "below").otherwise("within"))
    fallback = F.when(F.col("__usable") & (F.col("mode") == "level"), F.when(
        F.col("series").isin(*CUSTOMER_SERIES) & F.col("__ago").isNull(), "no_year_ago_value"
    ).when(F.col("__rows_ago"), "unusable_year_ago_base").otherwise("no_year_ago_value"))
    ok = insufficient.isNull()
    only = lambda x: F.when(ok, x)
    return joined.select(
        *group, "mode", only(v).alias("value_cur"), only(c).alias("center"), only(c - s).alias("lower"), only(c + s).alias("upper"),
        signal.alias("signal"), only(rule).alias("rule"), only(F.col("limits_method")).alias("limits_method"),
        F.when(ok | (insufficient == "no_measurable_spread"), fallback).alias("mode_fallback"), insufficient.alias("insufficient_reason"))


def movement(core: DataFrame, history: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Is this month's change large next to the median month-to-month change of the history?"""
    scope = scope or []
    past = join_same(history, core.select(*scope, "month", "revenue"), [*scope, "month"], "left").withColumn("revenue", F.coalesce("revenue", F.lit(0.0)))
    order = W.partitionBy(*scope).orderBy("month")
    steps = past.withColumns({"__before": F.lag("revenue").over(order), "__bm": F.lag("month").over(order)}).filter(F.col("__bm") == F.add_months("month", -1))
    moves = steps.select(*scope, F.abs(pct_change(F.col("revenue"), F.col("__before"))).alias("m")).filter("m is not null")
    typical = moves.groupBy(*scope).agg(F.count("*").alias("movements"), F.median("m").alias("__typical"))
    sides = _two_months(core, period, scope)
    wide = with_period(sides, typical, scope).withColumn("movements", F.coalesce("movements", F.lit(0)))
    args = (F.col("rev_cur"), F.col("rev_prev"), F.col("moved"))
    change, reason = pct_change(*args), pct_change_reason(*args)
    enough = F.col("movements") >= MIN_MOVEMENTS
    typ = F.when(reason.isNull() & enough, F.col("__typical"))
    return wide.select(
        *scope, change.alias("change_pct"), typ.alias("typical_pct"), "movements",
        F.when(reason.isNull() & enough, F.abs(change) >= MOVEMENT_FACTOR * typ).alias("singled_out"),
        F.when(reason.isNotNull(), reason).when(~enough, "too_few_movements").alias("reason"))


def _two_months(core: DataFrame, period: DataFrame, scope: list[str]) -> DataFrame:
    wide = with_period(core.select(*scope, "month", "revenue", "money_moved"), period.select(*scope, "current", "previous"), scope)
    at = lambda m, c: F.coalesce(F.sum(F.when(F.col("month") == F.col(m), F.col(c))), F.lit(0.0))
    return wide.groupBy(*scope).agg(
        at("current", "revenue").alias("rev_cur"), at("previous", "revenue").alias("rev_prev"),
        (at("current", "money_moved") + at("previous", "money_moved")).alias("moved"))


def season_window(core: DataFrame, complete: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The unbroken run of complete months with rows that ends at the current month, numbered from 0."""
    scope = scope or []
    held = join_same(complete, core.select(*scope, "month", "revenue"), [*scope, "month"])
    held = with_period(held, period.select(*scope, "current"), scope).filter(F.col("month") <= F.col("current"))
    back = F.months_between(F.trunc("current", "MM"), F.trunc("month", "MM")).cast("int")
    order = W.partitionBy(*scope).orderBy(F.desc("month"))
    run = held.withColumn("__back", back).withColumn("__n", F.row_number().over(order) - 1).filter(F.col("__back") == F.col("__n"))
    size = W.partitionBy(*scope)
    return run.withColumn("n", F.count("*").over(size)).select(
        *scope, "month", "revenue", (F.col("n") - 1 - F.col("__n")).alias("position"), "n")


def season_comparison(window: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """This month's change against the same calendar month's change in earlier years, in bands."""
    scope = scope or []
    order = W.partitionBy(*scope).orderBy("month")
    changes = window.withColumn("c", pct_change(F.col("revenue"), F.lag("revenue").over(order)))
    ago = changes.select(*scope, F.add_months("month", 12).alias("month"), F.col("c").alias("a"))
    wide = with_period(join_same(changes, ago, [*scope, "month"], "left"), period.select(*scope, "current"), scope)
    gap = lambda x, y: F.when(is_negligible(x - y, x, y, F.lit(100.0)), 0.0).otherwise(x - y)
    now = F.col("month") == F.col("current")
    years_back = F.months_between("current", "month")
    earlier = (years_back > 0) & (years_back % 12 == 0) & (years_back / 12 <= F.floor(F.col("n") / 12))
    facts = wide.groupBy(*scope).agg(
        F.max(F.when(now, F.col("c"))).alias("now"), F.max(F.when(now, F.col("a"))).alias("ago"),
        F.median(F.when(earlier, F.col("c"))).alias("expected_change_pct"), F.count(F.when(earlier, F.col("c"))).alias("years"),
        F.median(F.when(~now, F.abs(gap(F.col("c"), F.col("a"))))).alias("typical_pct"),
        F.count(F.when(~now, F.col("c") + F.col("a"))).alias("differences"))
    facts = facts.filter(F.col("now").isNotNull() & F.col("ago").isNotNull() & (F.col("differences") >= MIN_MOVEMENTS))
    raw = gap(F.col("now"), F.col("expected_change_pct"))
    typical = F.col("typical_pct")

    def snapped(g: Column) -> Column:
        out = g
        for factor in (MOVEMENT_FACTOR, SEASON_BEYOND):
            bound = typical * factor
            near = (bound != 0) & is_negligible(F.abs(g) - bound, g, bound, F.lit(100.0))
            out = F.when(near, F.signum(g) * bound).otherwise(out)
        return out

    facts = facts.withColumn("__g", raw).withColumn("difference_pct", snapped(F.col("__g")))
    facts = facts.filter((typical != 0) | (F.col("difference_pct") == 0))
    d = F.col("difference_pct")
    band = (
        F.when((F.abs(d) < MOVEMENT_FACTOR * typical) | (d == 0), "consistent").when(F.abs(d) < SEASON_BEYOND * typical, "inconclusive")
        .when(d < 0, "shortfall").otherwise("excess"))
    return facts.select(*scope, F.col("now").alias("change_pct"), "expected_change_pct", "years", "difference_pct", "typical_pct", "differences", band.alias("band"))
