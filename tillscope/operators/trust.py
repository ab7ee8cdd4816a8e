"""Trust checks: days without sales, uniform price shifts, flagged rows, uncategorised revenue."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.functions.numbers import is_negligible
from tillscope.operators.periods import compared, complete_months, month_days, with_period
from tillscope.operators.ranking import join_same, percentiles
from tillscope.session import materialize

# --- fixed values -------------------------------------------------------------------------------
D1_HISTORY = 36
D1_CAUTION_DAYS, D1_CAUTION_DAYS_SHORT, D1_FULL_YEAR = 1.0, 3.0, 12
D1_SPREAD_K, D1_BLOCK_SHARE, MAD_SCALE = 2.5, 0.5, 1.4826
D2_MIN_PRODUCTS, D2_MIN_ROWS, D2_CLUSTER_SHARE, D2_CLUSTER_WIDTH = 20, 3, 0.8, 0.02
D2_NEUTRAL_LOW, D2_NEUTRAL_HIGH = 0.9, 1.1
D2_SMALL_PRODUCTS, D2_SMALL_SHARE, D2_SMALL_HIGH, D2_SMALL_LOW = 3, 0.8, 5.0, 0.2
D3_RATIO, D3_MIN_SHARE = 2.0, 0.02
# -------------------------------------------------------------------------------------------------


def trading_days(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Days with a sale line, and the day's net revenue."""
    return lines.filter("counted").groupBy(*(scope or []), "month", F.col("txn_day").alias("day")).agg(
        F.bool_or("sale").alias("traded"), F.sum("amount").alias("revenue")).filter("traded").drop("traded")


def trading_pace(days: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per month: trading days and revenue per trading day."""
    return days.groupBy(*(scope or []), "month").agg(
        F.count("*").alias("trading_days"), F.sum("revenue").alias("revenue"), F.avg("revenue").alias("revenue_per_day"))


def zero_days(months: DataFrame, days: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``(month, weekday)``: calendar days and days without a sale of the given months."""
    scope = scope or []
    calendar = month_days(months, scope)
    seen = join_same(calendar, days.select(*scope, "day").withColumn("__sold", F.lit(1)), [*scope, "day"], "left")
    return seen.groupBy(*scope, "month", "weekday").agg(
        F.count("*").alias("days"), F.count_if(F.col("__sold").isNull()).alias("zeros"))


def weekday_zero_rates(zeros: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Share of each weekday's dates with no sale over the months given."""
    return zeros.groupBy(*(scope or []), "weekday").agg(
        F.sum("zeros").alias("zeros"), F.sum("days").alias("days")).withColumn("zero_rate", F.try_divide("zeros", "days"))


def expected_zero_days(zeros: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per month: zero days, what the weekday rates expect, and what the same month of other years adds."""
    scope = scope or []
    rates = weekday_zero_rates(zeros, scope).select(*scope, "weekday", "zero_rate")
    priced = join_same(zeros, rates, [*scope, "weekday"]).groupBy(*scope, "month").agg(
        F.sum("zeros").alias("observed"), F.sum("days").alias("length"), F.sum(F.col("days") * F.col("zero_rate")).alias("pattern"))
    other = priced.select(*scope, F.month("month").alias("moy"), F.col("month").alias("__m"),
                          (F.col("observed") - F.col("pattern")).alias("__beyond"), F.col("length").alias("__len"))
    pairs = join_same(priced.withColumn("moy", F.month("month")), other, [*scope, "moy"], "left")
    beyond = F.avg(F.when(F.col("__m") != F.col("month"), F.col("__beyond") * F.col("length") / F.col("__len")))
    return pairs.groupBy(*scope, "month", "observed", "length", "pattern").agg(beyond.alias("__b")).select(
        *scope, "month", "observed", "length", "pattern",
        (F.col("pattern") + F.greatest(F.lit(0.0), F.coalesce("__b", F.lit(0.0)))).alias("expected"))


def leave_one_out_excess(zeros: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Each month's zero days beyond what the other months expect of it.

    The weekday totals minus the month's own row give its rates; the same calendar month of the other
    years is priced with those rates. Both are joins over at most a few dozen months per scope.
    """
    scope = scope or []
    by_day = W.partitionBy(*scope, "weekday")
    left = zeros.withColumns({
        "__z": F.sum("zeros").over(by_day) - F.col("zeros"), "__d": F.sum("days").over(by_day) - F.col("days"),
    }).withColumn("__rate", F.coalesce(F.try_divide("__z", "__d"), F.lit(0.0)))
    own = left.groupBy(*scope, "month").agg(
        F.sum("zeros").alias("observed"), F.sum("days").alias("length"), F.sum(F.col("days") * F.col("__rate")).alias("pattern"))
    rates = left.select(*scope, F.col("month").alias("__target"), F.month("month").alias("moy"), "weekday", "__rate")
    priced = join_same(zeros.withColumn("moy", F.month("month")), rates, [*scope, "moy", "weekday"]).filter(F.col("month") != F.col("__target"))
    others = priced.groupBy(*scope, "__target", "month").agg(
        (F.sum("zeros") - F.sum(F.col("days") * F.col("__rate"))).alias("__beyond"), F.sum("days").alias("__len"))
    scaled = others.groupBy(*scope, F.col("__target").alias("month")).agg(F.avg(F.col("__beyond") / F.col("__len")).alias("__share"))
    wide = join_same(own, scaled, [*scope, "month"], "left")
    season = F.greatest(F.lit(0.0), F.coalesce(F.col("__share") * F.col("length"), F.lit(0.0)))
    return wide.select(*scope, "month", "observed", "pattern", season.alias("season"),
                       (F.col("observed") - F.col("pattern") - season).alias("excess"))


# --- the learning of a shop's own pattern (at most 38 months per scope) --------------------------

_JUDGED = (
    "learned_months int, learned array<date>, excluded array<date>, weekday_months array<date>, caution_floor double, "
    "blocked boolean, zero_cur int, pattern_cur double, expected_cur double, excess_cur double, unexplained_cur double, "
    "bar_cur double, flagged_cur boolean, zero_prev int, pattern_prev double, expected_prev double, excess_prev double, "
    "unexplained_prev double, bar_prev double, flagged_prev boolean"
)


@dataclass(frozen=True)
class _Table:
    """Zero days and days per weekday of a scope's months (months × 7), and each month's place in the year.

    Sets of months are masks. Whatever is said of a month is said without it: the sums over a set lose the month's own row,
    for all months at once.
    """

    zeros: np.ndarray
    days: np.ndarray
    place: np.ndarray

    @property
    def seen(self) -> np.ndarray:
        return self.zeros.sum(axis=1)

    @property
    def length(self) -> np.ndarray:
        return self.days.sum(axis=1)

    def forecast(self, learned: np.ndarray, weekly: np.ndarray, season: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weekday rates, pattern and expectation of every month, from the other months of the two sets."""
        own = weekly[:, None]
        held = weekly @ self.days - own * self.days
        rates = np.divide(weekly @ self.zeros - own * self.zeros, held, out=np.zeros_like(self.days), where=held > 0)
        pattern = (self.days * rates).sum(axis=1)
        twins = (self.place[:, None] == self.place) & learned & ~np.eye(len(learned), dtype=bool) & season
        beyond = (self.seen - rates @ self.days.T) / self.length * self.length[:, None]
        count = twins.sum(axis=1)
        extra = np.where(twins, beyond, 0.0).sum(axis=1) / np.maximum(count, 1)
        return rates, pattern, pattern + np.maximum(extra, 0.0)

    def excess(self, learned: np.ndarray, weekly: np.ndarray, season: bool) -> np.ndarray:
        """How far the learned months lie above what the others of them let expect; a single one lies nowhere."""
        if learned.sum() < 2:
            return np.zeros(1)
        return (self.seen - self.forecast(learned, weekly, season)[2])[learned]

    def bars(self, learned: np.ndarray, weekly: np.ndarray, season: bool = True) -> np.ndarray:
        """What a month has to exceed: a few robust deviations of the learned months, or of chance alone."""
        excess = self.excess(learned, weekly, season)
        centre = np.median(excess)
        rates, pattern, expected = self.forecast(learned, weekly, season)
        chance = np.minimum(1.0, rates + ((expected - pattern) / self.length)[:, None])
        deviation = np.sqrt((self.days * chance * (1 - chance)).sum(axis=1))
        return np.maximum(centre + D1_SPREAD_K * MAD_SCALE * np.median(np.abs(excess - centre)), D1_SPREAD_K * deviation)

    def settled(self, months: np.ndarray, season: bool) -> np.ndarray:
        """The set without the months that stand out, the furthest first, until none does."""
        months = months.copy()
        while months.sum() > 1:
            above = np.where(months, self.seen - self.forecast(months, months, season)[2], -np.inf)
            worst = int(np.argmax(above))
            others = months & (np.arange(len(months)) != worst)
            if above[worst] < D1_CAUTION_DAYS_SHORT or above[worst] <= self.bars(others, others, season)[worst]:
                break
            months = others
        return months


def _judge(rows: pd.DataFrame) -> dict | None:
    rows = rows.sort_values("month").reset_index(drop=True)
    grid = lambda c: np.array(rows[c].tolist(), dtype=float)
    table = _Table(grid("zeros"), grid("days"), pd.to_datetime(rows["month"]).dt.month.to_numpy())
    role = rows["role"].to_numpy()
    candidates = role == "candidate"
    if not all((role == r).any() for r in ("candidate", "current", "previous")):
        return None
    learned = table.settled(candidates, season=True)
    weekly = table.settled(learned, season=False)
    floor = D1_CAUTION_DAYS if learned.sum() >= D1_FULL_YEAR else D1_CAUTION_DAYS_SHORT
    listed = lambda mask: rows["month"][mask].tolist()
    out = {
        "learned_months": int(learned.sum()), "learned": listed(learned), "excluded": listed(candidates & ~learned),
        "weekday_months": listed(weekly), "caution_floor": floor,
    }
    _, pattern, expected = table.forecast(learned, weekly)
    figures = pd.DataFrame({
        "zero": table.seen, "pattern": pattern, "expected": expected, "excess": np.maximum(0.0, table.seen - pattern),
        "unexplained": np.maximum(0.0, table.seen - expected), "bar": table.bars(learned, weekly)})
    for tag, name in (("cur", "current"), ("prev", "previous")):
        at = figures.iloc[int(np.argmax(role == name))]
        out |= {f"{k}_{tag}": float(v) for k, v in at.items()}
        out |= {f"zero_{tag}": int(at["zero"]), f"flagged_{tag}": bool(at["unexplained"] >= floor and at["unexplained"] > at["bar"])}
    out["blocked"] = bool(out["unexplained_cur"] >= D1_BLOCK_SHARE * table.length[int(np.argmax(role == "current"))])
    return out


def coverage_check(lines: DataFrame, period: DataFrame, scope: list[str] | None = None, days: DataFrame | None = None) -> DataFrame:
    """D1 per scope: zero days against the shop's own learned pattern, the judgement and the revenue gap.

    The months × weekdays table (at most 38 × 7 per scope) is the only thing that reaches Python. ``days`` are the trading days, if
    they are known.
    """
    scope = scope or []
    days = trading_days(lines, scope) if days is None else days
    with_rows = lines.filter("counted").select(*scope, "month").distinct().withColumn("__rows", F.lit(True))
    pair = period.select(*scope, "current", "previous")
    past = with_period(complete_months(period, scope), pair, scope).filter(F.col("month") < F.col("current"))
    order = W.partitionBy(*scope).orderBy(F.desc("month"))
    window = past.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= D1_HISTORY)
    window = join_same(window, with_rows, [*scope, "month"]).filter(F.col("month") != F.col("previous"))
    roles = (
        window.select(*scope, "month", F.lit("candidate").alias("role"))
        .unionByName(pair.select(*scope, F.col("current").alias("month"), F.lit("current").alias("role")))
        .unionByName(pair.select(*scope, F.col("previous").alias("month"), F.lit("previous").alias("role")))
    )
    zeros = zero_days(roles.drop("role").distinct(), days, scope).groupBy(*scope, "month").agg(
        F.sort_array(F.collect_list(F.struct("weekday", "zeros", "days"))).alias("w"))
    table = join_same(roles, zeros, [*scope, "month"]).select(
        *scope, "month", "role", F.transform("w", lambda x: x.zeros).alias("zeros"), F.transform("w", lambda x: x.days).alias("days"))

    def judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = _judge(rows)
        if found is None:
            return pd.DataFrame()
        return pd.DataFrame([{**dict(zip(scope, key)), **found}])

    fields = ", ".join([f"{c} {dict(lines.dtypes)[c]}" for c in scope] + [_JUDGED])
    judged = table.withColumn("__all", F.lit("all")).groupBy(*(scope or ["__all"])).applyInPandas(judge, fields)
    pace = trading_pace(days, scope).select(*scope, "month", "revenue_per_day")
    at = lambda c: F.max(F.when(F.col("month") == F.col(c), F.col("revenue_per_day")))
    paces = with_period(pace, pair, scope).groupBy(*scope).agg(at("current").alias("__pc"), at("previous").alias("__pp"))
    wide = join_same(join_same(period, judged, scope, "left"), paces, scope, "left")
    status = (
        F.when(~F.col("previous_complete"), "blocked").when(F.col("month_grain"), "not_applicable")
        .when(F.col("learned_months").isNull(), "inconclusive").when(F.col("blocked"), "blocked")
        .when(F.col("flagged_cur") | F.col("flagged_prev"), "caution").otherwise("ok"))
    about = (
        F.when(~F.col("previous_complete"), "coverage").when(F.col("blocked") | F.col("flagged_cur"), "current")
        .when(F.col("flagged_prev"), "previous"))
    beyond = lambda t: F.coalesce((F.col(f"excess_{t}") >= F.col("caution_floor")) & (F.col(f"excess_{t}") > F.col(f"bar_{t}")), F.lit(False))
    return wide.select(
        *scope, F.lit("D1").alias("check"), status.alias("status"), about.alias("about_month"),
        *[c.split()[0] for c in _JUDGED.split(", ")],
        (F.col("excess_cur") * F.coalesce("__pc", F.lit(0.0))).alias("revenue_gap_cur"),
        (F.col("excess_prev") * F.coalesce("__pp", F.lit(0.0))).alias("revenue_gap_prev"),
        beyond("cur").alias("beyond_pattern_cur"), beyond("prev").alias("beyond_pattern_prev"))


def excess_in_month(months: DataFrame, judged: DataFrame, lines: DataFrame, scope: list[str] | None = None, days: DataFrame | None = None) -> DataFrame:
    """Zero days of any month beyond the learned weekday pattern, the month itself left out of it."""
    scope = scope or []
    days = trading_days(lines, scope) if days is None else days
    learned = judged.select(*scope, F.explode("weekday_months").alias("month"))
    taught = zero_days(learned, days, scope)
    asked = zero_days(months, days, scope).select(*scope, F.col("month").alias("__target"), "weekday", F.col("days").alias("__d"), F.col("zeros").alias("__z"))
    pairs = join_same(taught.filter("days > 0"), asked, [*scope, "weekday"]).filter(F.col("month") != F.col("__target"))
    rates = pairs.groupBy(*scope, "__target", "weekday", "__d", "__z").agg((F.sum("zeros") / F.sum("days")).alias("rate"))
    return rates.groupBy(*scope, F.col("__target").alias("month")).agg(
        F.greatest(F.lit(0.0), F.sum("__z") - F.sum(F.col("rate") * F.col("__d"))).alias("excess_zero_days"))


# --- prices, flags, categories -------------------------------------------------------------------


def price_medians(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Median price per product and compared month with at least three lines.

    Prices are counted first (a product's lines combine to its distinct prices), and the price list of a product is ranked in
    buckets, however long it is.
    """
    scope = scope or []
    ours = compared(lines.filter(F.col("counted") & F.col("product_key").isNotNull()), period, scope)
    keys = [*scope, "slot", "product_key"]
    counts = materialize(ours.groupBy(*keys, "unit_price").agg(F.count("*").alias("n")), "prices")
    enough = counts.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") >= D2_MIN_ROWS)
    medians = percentiles(counts.filter("unit_price is not null"), keys, "unit_price", "n", {"median_price": 0.5})
    return join_same(enough, medians, keys, "left").select(*keys, "median_price", "n")


def price_level_check(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """D2 per scope: did the whole catalogue's prices move by one factor?"""
    scope = scope or []
    medians = price_medians(lines, period, scope)
    side = lambda s: F.max(F.when(F.col("slot") == s, F.col("median_price")))
    ratios = medians.groupBy(*scope, "product_key").agg(side("cur").alias("c"), side("prev").alias("p")).filter("p > 0 and c is not null").select(
        *scope, (F.col("c") / F.col("p")).alias("ratio"))
    counts = materialize(ratios.groupBy(*scope, "ratio").agg(F.count("*").alias("n")), "price-ratios")
    middle = percentiles(counts, scope, "ratio", "n", {"median_ratio": 0.5})
    near = F.abs(F.col("ratio") - F.col("median_ratio")) <= D2_CLUSTER_WIDTH * F.col("median_ratio")
    extreme = (F.col("ratio") >= D2_SMALL_HIGH) | (F.col("ratio") <= D2_SMALL_LOW)
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")
    found = join_same(counts, middle, scope).groupBy(*scope, "median_ratio").agg(
        F.sum("n").alias("comparable_products"), share(near).alias("share_in_cluster"), share(extreme).alias("share_extreme"))
    wide = join_same(period.select(*scope), found, scope, "left").fillna(0, ["comparable_products"]) if scope else _one_row(period, found)
    n, m = F.col("comparable_products"), F.col("median_ratio")
    status = (
        F.when(n >= D2_MIN_PRODUCTS, F.when((F.col("share_in_cluster") >= D2_CLUSTER_SHARE) & ((m < D2_NEUTRAL_LOW) | (m > D2_NEUTRAL_HIGH)), "caution").otherwise("ok"))
        .when(n >= D2_SMALL_PRODUCTS, F.when(F.col("share_extreme") >= D2_SMALL_SHARE, "caution").otherwise("ok"))
        .otherwise("inconclusive"))
    rule = F.when(n >= D2_MIN_PRODUCTS, "cluster").when(n >= D2_SMALL_PRODUCTS, "small_catalogue")
    return wide.select(*scope, F.lit("D2").alias("check"), status.alias("status"), "comparable_products", "median_ratio",
                       "share_in_cluster", "share_extreme", rule.alias("rule"))


def _one_row(period: DataFrame, found: DataFrame) -> DataFrame:
    base = period.select(F.lit(1).alias("__one"))
    joined = base.join(found.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")
    return joined.fillna(0, ["comparable_products"])


def flag_check(lines: DataFrame, period: DataFrame, flags: list[str], scope: list[str] | None = None) -> DataFrame:
    """D3 per scope: are flagged rows concentrated in the current month?"""
    scope = scope or []
    flagged = F.lit(False)
    for name in flags:
        flagged = flagged | F.coalesce(F.lower(F.trim(F.col(f"`{name}`").cast("string"))).isin("true", "1"), F.lit(False))
    small = compared(lines.filter("counted"), period, scope).groupBy(*scope).agg(*[
        F.coalesce(F.avg(F.when(F.col("slot") == s, flagged.cast("double"))), F.lit(0.0)).alias(f"flagged_share_{s}") for s in ("cur", "prev")])
    caution = F.lit(bool(flags)) & (F.col("flagged_share_cur") >= D3_RATIO * F.col("flagged_share_prev")) & (F.col("flagged_share_cur") >= D3_MIN_SHARE)
    return small.select(*scope, F.lit("D3").alias("check"), F.when(caution, "caution").otherwise("ok").alias("status"),
                        "flagged_share_cur", "flagged_share_prev")


def uncategorised_share(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Share of each compared month's revenue with no category; null when the month nets to nothing."""
    scope = scope or []
    sums = compared(lines.filter("counted"), period, scope).groupBy(*scope, "slot").agg(
        F.sum("amount").alias("t"), F.sum(F.abs("amount")).alias("m"),
        F.coalesce(F.sum(F.when(F.col("category_key").isNull(), F.col("amount"))), F.lit(0.0)).alias("u"))
    return sums.select(*scope, "slot", F.when(~is_negligible(F.col("t"), F.col("m"), F.col("t")), F.try_divide("u", "t")).alias("uncategorised_share"))


def verdict(checks: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """trusted, caution or blocked from ``(check, status)`` rows."""
    has = lambda *s: F.bool_or(F.col("status").isin(*s))
    return checks.groupBy(*(scope or [])).agg(
        F.when(has("blocked"), "blocked").when(has("caution", "inconclusive"), "caution").otherwise("trusted").alias("verdict"))
