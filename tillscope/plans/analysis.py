"""From sales lines to every result table: metrics, trust, signals, lenses, hypotheses, forecast.

Line-grain data is reduced first to month × order, month × customer, month × product and day; what
follows reads those small tables. The ones several results share are written once.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.operators import (
    customers, forecast, hypotheses, lenses, members, metrics, movements, orders, periods, products, report, signals, trust,
)
from tillscope.operators.periods import with_period
from tillscope.operators.ranking import join_same
from tillscope.session import materialize


@dataclass
class Analysis:
    """Lazily built result tables over one table of sales lines; each shared one is computed once."""

    lines: DataFrame
    scope: list[str] = field(default_factory=list)
    cutoff: dt.date | None = None
    now: dt.datetime | None = None
    flags: list[str] = field(default_factory=list)
    has_customers: bool = True

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        return materialize(df, label)

    def together(self, *names: str) -> None:
        """Compute shared tables that do not need one another at the same time: each is a small job that leaves most cores idle."""
        with ThreadPoolExecutor(max_workers=len(names)) as pool:
            for done in [pool.submit(getattr, self, name) for name in names]:
                done.result()

    # --- shared small tables ---------------------------------------------------------------------

    @cached_property
    def period(self) -> DataFrame:
        return self._kept(periods.periods(self.lines, self.scope, self.cutoff, self.now), "period")

    @cached_property
    def core(self) -> DataFrame:
        return self._kept(metrics.monthly_core(self.lines, self.scope, self.people), "core")

    @cached_property
    def people(self) -> DataFrame:
        """Revenue per month and customer."""
        return self._kept(metrics.monthly_customers(self.lines, self.scope), "month-customers")

    @cached_property
    def days(self) -> DataFrame:
        return self._kept(trust.trading_days(self.lines, self.scope), "trading-days")

    @cached_property
    def complete(self) -> DataFrame:
        return periods.complete_months(self.period, self.scope)

    @cached_property
    def history(self) -> DataFrame:
        return periods.history(self.period, self.scope)

    @cached_property
    def rows(self) -> DataFrame:
        """Complete months with rows, and whether their sales name nobody."""
        seen = self.lines.filter("counted").groupBy(*self.scope, "month").agg(
            F.count("*").alias("lines"),
            (F.bool_or("sale") & ~F.bool_or(F.col("sale") & F.col("customer").isNotNull())).alias("blank_customers"))
        return self._kept(join_same(seen, self.complete, [*self.scope, "month"], "left_semi"), "month-rows")

    @cached_property
    def classes(self) -> DataFrame:
        return self._kept(metrics.class_amounts(self.lines, self.scope), "class-amounts")

    @cached_property
    def labels(self) -> DataFrame:
        # Told at each reading from the written names of the products.
        return products.product_labels(self.lines, self.scope)

    @cached_property
    def product_months(self) -> DataFrame:
        return self._kept(movements.product_months(self.lines, self.period, self.scope), "product-months")

    @cached_property
    def totals(self) -> DataFrame:
        return lenses.period_totals(self.core, self.period, self.scope)

    @cached_property
    def coverage(self) -> DataFrame:
        return self._kept(trust.coverage_check(self.lines, self.period, self.scope, self.days), "coverage")

    @cached_property
    def levers(self) -> DataFrame:
        typical = lenses.typical_month(self.core, self.history, self.scope)
        return self._kept(lenses.lever(self.totals, typical, self.scope, self.has_customers), "levers")

    @cached_property
    def first_purchases(self) -> DataFrame:
        return self._kept(orders.first_purchases(self.lines, self.scope), "first-purchases")

    @cached_property
    def _customer_lens(self) -> tuple[DataFrame, DataFrame]:
        bridge, classes = lenses.customer_lens(self.lines, self.period, self.rows, self.scope, self.first_purchases, self.people)
        return self._kept(bridge, "bridge"), classes

    @cached_property
    def bridge(self) -> DataFrame:
        return self._customer_lens[0]

    @cached_property
    def customer_classes(self) -> DataFrame:
        return self._customer_lens[1]

    @cached_property
    def product_lens(self) -> DataFrame:
        return self._kept(lenses.product_lens(self.product_months, self.scope), "product-lens")

    @cached_property
    def product_sums(self) -> DataFrame:
        return self._kept(members.product_sums(self.lines, self.period, self.scope), "product-sums")

    @cached_property
    def product_totals(self) -> DataFrame:
        return self._kept(members.product_totals(self.product_sums, self.labels, self.scope), "product-totals")

    @cached_property
    def breadth(self) -> DataFrame:
        return members.breadth(self.product_sums, self.totals, self.labels, self.scope)

    @cached_property
    def calendar(self) -> DataFrame:
        return signals.calendar_effect(self.lines, self.core, self.history, self.period, self.scope)

    @cached_property
    def movement(self) -> DataFrame:
        return signals.movement(self.core, self.history, self.period, self.scope)

    @cached_property
    def series(self) -> DataFrame:
        return self._kept(signals.monthly_series(self.core, self.complete, self.scope), "series")

    @cached_property
    def signals(self) -> DataFrame:
        return signals.signals(self.series, self.history, self.complete, self.period, self.rows, self.scope)

    @cached_property
    def window(self) -> DataFrame:
        return self._kept(signals.season_window(self.core, self.complete, self.period, self.scope), "season-window")

    @cached_property
    def ratios(self) -> DataFrame:
        return self._kept(forecast.detrended(self.window, self.scope), "ratios")

    @cached_property
    def indices(self) -> DataFrame:
        return self._kept(forecast.season_indices(self.ratios, self.scope), "indices")

    @cached_property
    def claim(self) -> DataFrame:
        return self._kept(forecast.season_claim(self.ratios, self.indices, self.scope), "season-claim")

    @cached_property
    def forecast(self) -> DataFrame:
        table = forecast.t_table(self.lines.sparkSession)
        return forecast.forecast(self.window, self.indices, self.claim, self.period, table, self.scope)

    @cached_property
    def stockouts(self) -> DataFrame:
        return self._kept(lenses.stockouts(self.lines, self.period, self.scope), "stockouts")

    @cached_property
    def tree(self) -> DataFrame:
        return lenses.tree(self.levers, self.bridge, self.product_lens, self.totals, self.scope)

    @cached_property
    def price_check(self) -> DataFrame:
        return self._kept(trust.price_level_check(self.lines, self.period, self.scope), "price-check")

    @cached_property
    def flag_check(self) -> DataFrame:
        return self._kept(trust.flag_check(self.lines, self.period, self.flags, self.scope), "flag-check")

    @cached_property
    def checks(self) -> DataFrame:
        rows = lambda df: df.select(*self.scope, "check", "status")
        return rows(self.coverage).unionByName(rows(self.price_check)).unionByName(rows(self.flag_check))

    @cached_property
    def verdict(self) -> DataFrame:
        return trust.verdict(self.checks, self.scope)

    # --- hypotheses ------------------------------------------------------------------------------

    @cached_property
    def facts(self) -> DataFrame:
        """One row per scope with everything the hypotheses read."""
        return self._kept(diagnosis_facts(self), "facts")

    @cached_property
    def specs(self) -> DataFrame:
        return hypotheses.catalogue(self.lines.sparkSession)

    @cached_property
    def hypotheses(self) -> DataFrame:
        found = hypotheses.evidence(self.facts, self.scope)
        return self._kept(hypotheses.evaluate(found, self.facts, self.specs, self.scope), "hypotheses")

    @cached_property
    def candidates(self) -> DataFrame:
        return hypotheses.headline_candidates(self.hypotheses, self.facts, self.scope)

    @cached_property
    def headline(self) -> DataFrame:
        return self._kept(hypotheses.headline(self.candidates, self.facts, self.scope), "headline")

    @cached_property
    def actions(self) -> DataFrame:
        return hypotheses.actions(self.hypotheses, self.headline, self.facts, self.scope)

    # --- the stage results as tables -------------------------------------------------------------

    def metric_tables(self) -> dict[str, DataFrame]:
        s, p = self.scope, self.period
        now, before = customers.rfm(self.lines, p, s), customers.rfm(self.lines, p, s, "previous")
        return {
            "period": p, "kpis": metrics.kpis(self.core, p, s), "revenue_by_month": self.core,
            "trend": metrics.monthly_trend(self.core, self.complete, s), "identity": metrics.revenue_identity(self.classes, p, s),
            "outside_revenue": metrics.outside_revenue(self.classes, p, s), "non_product": metrics.non_product_lines(self.lines, p, s),
            "segments": customers.segment_summary(now, before, p, s), "new_vs_returning": customers.new_vs_returning(self.lines, p, s, self.first_purchases),
            "pareto": movements.pareto(self.product_months, s), "top_products": movements.top_products(self.product_months, self.labels, s),
            "decliners": movements.decliners(self.product_months, self.labels, p, s), "categories": movements.category_changes(self.lines, p, s),
        }

    def diagnosis_tables(self) -> dict[str, DataFrame]:
        return {
            "coverage": self.coverage, "checks": self.checks, "verdict": self.verdict, "calendar": self.calendar, "signals": self.signals,
            "tree": self.tree, "breadth": self.breadth, "hypotheses": self.hypotheses, "headline": self.headline,
            "checklist": hypotheses.checklist(self.hypotheses, self.headline, self.scope),
        }

    def forecast_tables(self) -> dict[str, DataFrame]:
        trend = metrics.monthly_trend(self.core, self.complete, self.scope)
        return {"forecast": self.forecast, "claim": self.claim, "actions": self.actions,
                "chart": report.chart_series(trend, self.forecast, self.scope)}


def diagnosis_facts(a: Analysis) -> DataFrame:
    """Join the small results into one row per scope, under the names the hypotheses read."""
    a.together("period", "core", "labels", "first_purchases")
    a.together("rows", "product_months", "coverage", "price_check", "flag_check", "levers", "stockouts", "window")
    a.together("bridge", "product_lens", "product_sums", "ratios")
    s, p = a.scope, a.period
    wide = p.select(*s, "current", "previous", "data_start", "previous_complete", "month_grain")

    def add(df: DataFrame, *columns: str) -> None:
        nonlocal wide
        wide = with_period(wide, df.select(*s, *columns) if columns else df, s)

    cover = a.coverage
    add(cover.select(*s, "learned_months", "beyond_pattern_cur", "beyond_pattern_prev", "revenue_gap_cur", "revenue_gap_prev",
                     "excess_cur", "excess_prev", F.col("status").alias("d1_status")))
    add(a.price_check.select(*s, F.col("status").alias("d2_status")))
    add(a.flag_check.select(*s, F.col("status").alias("d3_status")))
    add(a.verdict.select(*s, F.col("verdict").alias("trust_verdict")))
    add(a.calendar.select(*s, F.col("method").alias("calendar_method"), "calendar_effect"))
    lever = a.levers.select(
        *s, "revenue_prev", "revenue_cur", "returns_prev", "returns_cur", "deductions_prev", "deductions_cur", "charges_prev", "charges_cur",
        "refund_lines_prev", "refund_lines_cur", "formula", "frequency_effect", "units_per_order_effect", "price_per_unit_effect",
        "price_per_unit_prev", "price_per_unit_cur", "level1_gross", "masked_shift_alert", "typical",
        F.col("net_change").alias("net"), (F.col("gross_sales_cur") - F.col("gross_sales_prev")).alias("gross"),
        (F.col("money_moved_cur") + F.col("money_moved_prev")).alias("moved"))
    add(lever)
    past = join_same(a.history, a.core.select(*s, "month", "revenue"), [*s, "month"])
    add(past.groupBy(*s).agg(F.max(F.abs("revenue")).alias("history_scale")))
    ly = report.year_ago(a.core, p, a.rows, s)
    add(ly, "ly_current", "ly_previous", "ly_cur", "ly_prev")
    asked = ly.select(*s, F.explode(F.array("ly_current", "ly_previous")).alias("month"))
    excess = trust.excess_in_month(asked, cover, a.lines, s, a.days)
    for month, name in (("ly_current", "ly_excess_cur"), ("ly_previous", "ly_excess_prev")):
        hit = join_same(excess.withColumnRenamed("month", month), ly.select(*s, month), [*s, month])
        add(hit.select(*s, F.col("excess_zero_days").alias(name)))
    terms = ("new", "lapsed", "resurrected")
    at = lambda tr, t: F.max(F.when(F.col("transition") == tr, F.col(t)))
    add(a.bridge.groupBy(*s).agg(*[at(tr, t).alias(f"{t}_{tag}") for t in terms for tr, tag in (("current", "now"), ("previous", "before"))]))
    blanks = with_period(a.rows.filter("blank_customers"), p.select(*s, "current", "previous"), s).groupBy(*s).agg(
        F.bool_or(F.col("month").isin(F.col("current"), F.col("previous"))).alias("__b1"),
        F.bool_or((F.col("month") <= F.col("current")) & (F.col("month") >= F.add_months("previous", -1))).alias("__b2"),
        F.bool_or(F.col("month") <= F.col("current")).alias("__b3"))
    add(blanks)
    add(a.product_lens.select(*s, "volume", "mix", "price", "new_products", "discontinued_products", "unidentified"))
    both = a.product_sums.filter(~F.col("is_gap") & (F.col("orders_prev") > 0) & (F.col("orders_cur") > 0))
    add(both.groupBy(*s).agg(F.count("*").alias("common_products")))
    add(a.breadth.select(*s, "classification", "products_share_of_change", "top_member", "top_member_delta"))
    add(a.stockouts.groupBy(*s).agg(F.sum("contribution").alias("stockout_contribution")))
    add(a.lines.groupBy(*s).agg(F.bool_or("charge").alias("has_charges")))
    add(a.movement.select(*s, "singled_out", F.col("change_pct").alias("movement_change_pct")))
    add(a.claim.select(*s, F.col("claimed").alias("season_claimed")))
    add(signals.season_comparison(a.window, p, s).select(*s, F.col("band").alias("season_band")))
    months_in = F.months_between(F.trunc("current", "MM"), F.trunc("data_start", "MM"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return wide.withColumns({
        "left_censored": months_in < lenses.LEFT_CENSOR_MONTHS, "has_customers": F.lit(a.has_customers),
        "blank_compared": no("__b1"), "blank_transition": no("__b2"), "blank_history": no("__b3"),
        "season_claimed": no("season_claimed"), "has_charges": no("has_charges"),
        "common_products": F.coalesce("common_products", F.lit(0)), "stockout_contribution": F.coalesce("stockout_contribution", F.lit(0.0)),
        "beyond_pattern_cur": no("beyond_pattern_cur"), "beyond_pattern_prev": no("beyond_pattern_prev"),
    }).drop("__b1", "__b2", "__b3")
