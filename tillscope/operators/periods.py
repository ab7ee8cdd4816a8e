"""Which months are compared, which are complete, and how the months are labelled."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.operators.profile import month_grain
from tillscope.operators.ranking import join_same

# Fixed values.
PREVIOUS_MIN_MISSING_DAYS = 3
FURTHEST_AHEAD_HOURS = 14


def upload_cutoff(uploaded_at: dt.datetime) -> dt.date:
    """The last day a line may be dated: the upload's day on the clock furthest ahead of UTC."""
    utc = uploaded_at if uploaded_at.tzinfo is None else uploaded_at.astimezone(dt.timezone.utc)
    return (utc + dt.timedelta(hours=FURTHEST_AHEAD_HOURS)).date()


def not_after(lines: DataFrame, cutoff: dt.date | None) -> DataFrame:
    return lines if cutoff is None else lines.filter(F.col("txn_day").isNull() | (F.col("txn_day") <= F.lit(cutoff)))


def future_lines(lines: DataFrame, cutoff: dt.date, scope: list[str] | None = None) -> DataFrame:
    """Lines dated after the upload, of any class, and the revenue of the counted ones."""
    late = F.coalesce(F.col("txn_day") > F.lit(cutoff), F.lit(False))
    return lines.groupBy(*(scope or [])).agg(
        F.count_if(late).alias("future_lines"),
        F.coalesce(F.sum(F.when(late & F.col("counted"), F.col("amount"))), F.lit(0.0)).alias("future_revenue"),
        F.max(F.when(late, F.col("txn_day"))).alias("latest_day"))


def periods(lines: DataFrame, scope: list[str] | None = None, cutoff: dt.date | None = None,
            now: dt.datetime | None = None) -> DataFrame:
    """One row per scope: data range, current and previous month, and whether the previous is complete.

    The current month is the last one the data's last day has finished. A file that records months
    compares its last month with sales once the clock has passed it everywhere.
    """
    scope = scope or []
    seen = not_after(lines, cutoff)
    base = seen.groupBy(*scope).agg(
        F.min("txn_day").alias("data_start"), F.max("txn_day").alias("data_end"),
        F.min(F.when(F.col("sale"), F.col("txn_day"))).alias("first_sale"),
        F.max(F.when(F.col("sale"), F.col("month"))).alias("__last_sold"),
        F.min(F.when(F.col("counted"), F.col("txn_day"))).alias("counted_start"),
        F.max(F.when(F.col("counted"), F.col("txn_day"))).alias("counted_end"),
    )
    grain = month_grain(seen.filter("counted"), "txn_ts", scope)
    wide = join_same(base, grain, scope, "left").withColumn("month_grain", F.coalesce("month_grain", F.lit(False)))
    clock = F.trunc(F.lit((now or dt.datetime.now(dt.timezone.utc)).replace(tzinfo=None) - dt.timedelta(hours=12)).cast("date"), "MM")
    end = F.col("data_end")
    by_day = F.when(end == F.last_day(end), F.trunc(end, "MM")).otherwise(F.add_months(F.trunc(end, "MM"), -1))
    sold = F.col("__last_sold")
    by_month = F.when(sold < clock, sold).otherwise(F.add_months(sold, -1))
    current = F.when(F.col("month_grain") & sold.isNotNull(), by_month).otherwise(by_day)
    wide = wide.withColumn("current", current).withColumn("previous", F.add_months("current", -1))
    sold_months = seen.filter("sale").groupBy(*scope, "month").agg(F.lit(True).alias("previous_has_sales"))
    wide = join_same(wide, sold_months.withColumnRenamed("month", "previous"), [*scope, "previous"], "left")
    days = F.dayofmonth(F.last_day("previous"))
    late = F.greatest(F.lit(0), F.datediff("first_sale", "previous"))
    has = F.coalesce(F.col("previous_has_sales"), F.lit(False))
    leading = F.when(F.col("first_sale").isNull(), days).when(F.col("month_grain") & has, 0).otherwise(F.least(days, late))
    return wide.withColumns({"previous_has_sales": has, "leading_days_missing": leading}).withColumn(
        "previous_complete", has & (F.col("leading_days_missing") < PREVIOUS_MIN_MISSING_DAYS)
    ).select(*scope, "data_start", "data_end", "current", "previous", "first_sale", "counted_start", "counted_end",
             "leading_days_missing", "previous_has_sales", "previous_complete", "month_grain")


def slots(period: DataFrame, scope: list[str]) -> DataFrame:
    """``(scope, month, slot)``: the two compared months of each scope."""
    pair = F.explode(F.array(
        F.struct(F.col("current").alias("month"), F.lit("cur").alias("slot")),
        F.struct(F.col("previous").alias("month"), F.lit("prev").alias("slot")))).alias("__slot")
    return period.select(*scope, pair).select(*scope, F.col("__slot.month").alias("month"), F.col("__slot.slot").alias("slot"))


def compared(table: DataFrame, period: DataFrame, scope: list[str]) -> DataFrame:
    """The rows of the two compared months, labelled; an equi-join on the month, so month partitions prune. Null scopes are scopes."""
    pair = slots(period, scope).filter("month is not null")
    renamed = pair.select(*(F.col(c).alias(f"__s_{c}") for c in scope), F.col("month").alias("__s_month"), "slot")
    on = table["month"] == renamed["__s_month"]
    for c in scope:
        on = on & table[c].eqNullSafe(renamed[f"__s_{c}"])
    return table.join(renamed if scope else F.broadcast(renamed), on).drop("__s_month", *(f"__s_{c}" for c in scope))


def figure_scopes(table: DataFrame, period: DataFrame, scope: list[str]) -> DataFrame:
    """Each row of a monthly table under ``file`` and, in a compared month, ``current`` / ``previous``."""
    wide = with_period(table, period.select(*scope, "current", "previous"), scope)
    label = F.when(F.col("month") == F.col("current"), "current").when(F.col("month") == F.col("previous"), "previous")
    return wide.withColumn("figure_scope", F.explode(F.array_compact(F.array(F.lit("file"), label)))).drop("current", "previous")


def with_period(table: DataFrame, period: DataFrame, scope: list[str]) -> DataFrame:
    """Attach each scope's period row (a single row without scope columns)."""
    return join_same(table, period, scope, "left")


def complete_months(period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Calendar months covered from their first day to their last."""
    scope = scope or []
    start = F.when(F.col("month_grain"), F.coalesce("counted_start", "data_start")).otherwise(F.col("data_start"))
    end = F.when(F.col("month_grain"), F.coalesce("counted_end", "data_end")).otherwise(F.col("data_end"))
    months = F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))).alias("month")
    return (
        period.filter("data_start is not null").select(*scope, "data_start", "data_end", "month_grain", months)
        .filter(F.col("month_grain") | ((F.col("month") >= F.col("data_start")) & (F.last_day("month") <= F.col("data_end"))))
        .select(*scope, "month")
    )


def partial_months(period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """First or last months the data covers only in part, with the days covered."""
    scope = scope or []
    months = F.explode(F.array_distinct(F.array(F.trunc("data_start", "MM"), F.trunc("data_end", "MM")))).alias("month")
    ends = period.filter("data_start is not null").select(*scope, "data_start", "data_end", months)
    partial = join_same(ends, complete_months(period, scope), [*scope, "month"], "left_anti")
    return partial.select(*scope, "month", F.greatest("data_start", "month").alias("first_day"),
                          F.least("data_end", F.last_day("month")).alias("last_day"))


def months_with_rows(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Months with counted lines, whether every one of them is nameless, and their money moved."""
    scope = scope or []
    return lines.filter("counted").groupBy(*scope, "month").agg(
        F.count("*").alias("lines"), (F.count("customer") == 0).alias("blank_customers"),
        F.sum("amount").alias("revenue"), F.sum(F.abs("amount")).alias("money_moved"))


def history(period: DataFrame, scope: list[str] | None = None, limit: int = 24) -> DataFrame:
    """The last complete months before the current one, ``limit`` at most."""
    scope = scope or []
    past = with_period(complete_months(period, scope), period.select(*scope, "current"), scope).filter(F.col("month") < F.col("current"))
    order = W.partitionBy(*scope).orderBy(F.desc("month"))
    return past.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit).select(*scope, "month")


def month_days(months: DataFrame, scope: list[str]) -> DataFrame:
    """Every calendar day of the given months, with its weekday (Monday is 0)."""
    days = F.explode(F.sequence("month", F.last_day("month"))).alias("day")
    return months.select(*scope, "month", days).withColumn("weekday", F.weekday("day"))


def month_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")
