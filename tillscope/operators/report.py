"""Tables a report draws: chart series, ordered bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def chart_series(trend: DataFrame, points: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The revenue line (null at gaps and part months) and the forecast's point, low and high as one tidy table."""
    scope = scope or []
    revenue = trend.select(*scope, F.lit("revenue").alias("series"), "month", F.when(F.col("complete"), F.col("revenue")).alias("value"))
    ahead = points.select(*scope, "month", "point", "low", "high").unpivot([*scope, "month"], ["point", "low", "high"], "series", "value")
    return revenue.unionByName(ahead.select(*scope, F.concat(F.lit("forecast_"), "series").alias("series"), "month", "value"))


def bars(breakdown: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Members in drawing order: values by this month's revenue, then Other, then blank."""
    scope = scope or []
    last = F.when(F.col("kind") == "value", 0).when(F.col("kind") == "other", 1).otherwise(2)
    order = W.partitionBy(*scope, "column").orderBy(last, F.desc("revenue_current"), "member")
    return breakdown.filter("withheld is null").withColumn("position", F.row_number().over(order)).select(
        *scope, "column", "position", "member", "revenue_current", "revenue_previous")


def year_ago(core: DataFrame, period: DataFrame, with_rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The same two months a year earlier, where both hold rows."""
    from tillscope.operators.ranking import join_same

    scope = scope or []
    pair = period.select(*scope, F.add_months("current", -12).alias("ly_current"), F.add_months("previous", -12).alias("ly_previous"))
    held = join_same(core.select(*scope, "month", "revenue"), with_rows.select(*scope, "month"), [*scope, "month"], "left_semi")
    now = held.withColumnsRenamed({"month": "ly_current", "revenue": "ly_cur"})
    before = held.withColumnsRenamed({"month": "ly_previous", "revenue": "ly_prev"})
    return join_same(join_same(pair, now, [*scope, "ly_current"]), before, [*scope, "ly_previous"])
