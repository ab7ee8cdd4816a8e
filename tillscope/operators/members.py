"""Where the change sits: members of a dimension, breadth, products whose class is only suggested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.functions.numbers import is_negligible
from tillscope.operators.periods import compared, with_period
from tillscope.operators.ranking import join_same
from tillscope.session import materialize

# --- fixed values -------------------------------------------------------------------------------
MIN_SHARE, MIN_ORDERS, LISTED = 0.02, 30, 5
BROAD, CONCENTRATED, MAJORITY = 0.7, 0.5, 0.5
UNCATEGORISED, UNNAMED, NOT_A_PRODUCT = "#UNCATEGORISED", "#UNNAMED_PRODUCT", "#NOT_A_PRODUCT"
# -------------------------------------------------------------------------------------------------


def _totals(lines: DataFrame, period: DataFrame, scope: list[str]) -> DataFrame:
    """Revenue, sale-line revenue and orders per key and compared month; ``lines`` has a ``key`` column."""
    per_order = compared(lines.filter("counted"), period, scope).groupBy(*scope, "slot", "key", "order_key").agg(
        F.sum("amount").alias("rev"), F.sum(F.when(F.col("sale"), F.col("amount")).otherwise(0.0)).alias("sales"), F.bool_or("sale").alias("sale"))
    cells = per_order.groupBy(*scope, "slot", "key").agg(
        F.sum("rev").alias("rev"), F.sum("sales").alias("sales"), F.count_if("sale").alias("orders"))
    at = lambda s, c: F.sum(F.when(F.col("slot") == s, F.col(c)))
    return cells.groupBy(*scope, "key").agg(*[
        at(s, c).alias(f"{c}_{s}") for c in ("rev", "sales", "orders") for s in ("prev", "cur")])


def category_totals(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or []
    totals = _totals(lines.withColumn("key", F.coalesce("category_key", F.lit(UNCATEGORISED))), period, scope)
    labels = lines.filter("category_key is not null").groupBy(*scope, F.col("category_key").alias("key")).agg(F.min_by("category_label", "line_no").alias("label"))
    named = join_same(totals, labels, [*scope, "key"], "left")
    return named.withColumns({"dimension": F.lit("category"), "label": F.coalesce("label", F.lit("(uncategorised)")), "is_gap": F.col("key") == UNCATEGORISED})


def product_sums(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Unnamed lines and lines classed as charges or discounts are buckets of their own."""
    scope = scope or []
    key = F.when(F.col("answered_class").isin("charge", "discount"), NOT_A_PRODUCT).otherwise(F.coalesce("product_key", F.lit(UNNAMED)))
    return _totals(lines.withColumn("key", key), period, scope).withColumn("is_gap", F.col("key").isin(UNNAMED, NOT_A_PRODUCT))


def product_totals(sums: DataFrame, labels: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``product_sums`` with their labels."""
    scope = scope or []
    named = join_same(sums, labels.select(*scope, F.col("product_key").alias("key"), F.col("product_label").alias("label")), [*scope, "key"], "left")
    label = F.when(F.col("key") == UNNAMED, "(no product name)").when(F.col("key") == NOT_A_PRODUCT, "(not a product)").otherwise(F.col("label"))
    return named.withColumns({"dimension": F.lit("product"), "label": label})


def customer_type_totals(lines: DataFrame, period: DataFrame, classes: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Revenue by how the bridge classed each customer in the compared transition."""
    scope = scope or []
    kinds = classes.filter(F.col("transition") == "current").select(*scope, F.col("customer").alias("__who"), "customer_class")
    pair = compared(lines.filter("counted"), period, scope).drop("slot")
    spread = F.concat(F.lit("\u0000"), F.pmod(F.col("line_no"), F.lit(4096)).cast("string"))
    typed = join_same(pair.withColumn("__who", F.coalesce("customer", spread)), kinds, [*scope, "__who"], "left")
    totals = _totals(typed.withColumn("key", F.coalesce("customer_class", F.lit(UNCATEGORISED))), period, scope)
    return totals.withColumns({
        "dimension": F.lit("customer_type"), "is_gap": F.col("key") == UNCATEGORISED,
        "label": F.when(F.col("key") == UNCATEGORISED, "(no customer)").otherwise(F.col("key"))})


def _scale(period_totals: DataFrame, scope: list[str]) -> DataFrame:
    return period_totals.select(
        *scope, (F.col("revenue_cur") - F.col("revenue_prev")).alias("delta_total"),
        (F.col("money_moved_cur") + F.col("money_moved_prev")).alias("moved"))


def members(totals: DataFrame, period_totals: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """At most five members by size of change, the rest folded into Other; small ones are never named alone.

    Only large members (2 % of the base or thirty orders) are listed, unless there are at most five
    members or none is large.
    """
    scope = scope or []
    group = [*scope, "dimension"]
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    base = totals.select(*group, "key", "label", "is_gap", z("rev_prev").alias("rev_prev"), z("rev_cur").alias("rev_cur"),
                         F.greatest(F.coalesce("orders_prev", F.lit(0)), F.coalesce("orders_cur", F.lit(0))).alias("orders"))
    base = materialize(base.withColumn("delta", F.col("rev_cur") - F.col("rev_prev")), "members")
    facts = base.groupBy(*group).agg(F.sum(F.abs("rev_prev")).alias("__base"), F.count("*").alias("member_count"))
    sized = join_same(base, facts, group)
    large = F.coalesce(F.try_divide(F.abs("rev_prev"), F.col("__base")) >= MIN_SHARE, F.lit(False)) | (F.col("orders") >= MIN_ORDERS)
    any_large = join_same(base, facts, group).groupBy(*group).agg(F.bool_or(large).alias("any_large"))
    sized = join_same(sized.withColumn("large", large), any_large, group)
    eligible = ~F.col("any_large") | (F.col("member_count") <= LISTED) | F.col("large")
    order = W.partitionBy(*group).orderBy(F.desc(F.abs("delta")), "key")
    named = sized.filter(eligible).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LISTED)
    rest = join_same(sized, named.select(*group, "key"), [*group, "key"], "left_anti").groupBy(*group, "member_count", "any_large").agg(
        F.sum("rev_prev").alias("rev_prev"), F.sum("rev_cur").alias("rev_cur")).withColumn("delta", F.col("rev_cur") - F.col("rev_prev"))
    listed = named.select(*group, "rank", "label", "rev_prev", "rev_cur", "delta", (F.col("is_gap") & (F.col("key") != NOT_A_PRODUCT)).alias("is_data_gap"),
                          (F.col("key") == NOT_A_PRODUCT).alias("is_not_a_product"), "member_count", (~F.col("any_large")).alias("size_filter_waived"))
    other = rest.select(*group, F.lit(LISTED + 1).alias("rank"), F.lit("Other").alias("label"), "rev_prev", "rev_cur", "delta",
                        F.lit(False).alias("is_data_gap"), F.lit(False).alias("is_not_a_product"), "member_count", (~F.col("any_large")).alias("size_filter_waived"))
    wide = with_period(listed.unionByName(other), _scale(period_totals, scope), scope)
    nothing = is_negligible(F.col("delta_total"), F.col("delta_total"), F.col("delta"), F.col("moved"))
    return wide.withColumn("share_of_change", F.when(nothing, 0.0).otherwise(F.try_divide("delta", "delta_total"))).drop("delta_total", "moved")


def new_and_removed(totals: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Members only one of the two months knows."""
    scope = scope or []
    seen, held = F.col("rev_cur").isNotNull(), F.col("rev_prev").isNotNull()
    return totals.filter(~F.col("is_gap") & (seen != held)).select(
        *scope, "dimension", "label", F.when(seen, "new").otherwise("removed").alias("status"), F.coalesce("rev_cur", "rev_prev").alias("revenue"))


def breadth(products: DataFrame, period_totals: DataFrame, labels: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Is the change broad, concentrated in one product, mixed, or outside the products?

    ``products`` are ``product_sums``; a label is looked up for each scope's top member alone.
    """
    scope = scope or []
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    real = products.filter(~F.col("is_gap")).select(
        *scope, "key", z("rev_prev").alias("base"), (z("rev_cur") - z("rev_prev")).alias("delta"), (z("sales_cur") - z("sales_prev")).alias("sales_delta"))
    summed = real.groupBy(*scope).agg(
        F.sum("sales_delta").alias("products_change"), F.sum(F.when(F.col("base") > 0, F.col("base")).otherwise(0.0)).alias("positive_base"),
        F.sum(F.when((F.col("base") > 0) & (F.col("delta") > 0), F.col("base")).otherwise(0.0)).alias("rising"),
        F.sum(F.when((F.col("base") > 0) & (F.col("delta") < 0), F.col("base")).otherwise(0.0)).alias("falling"),
        F.max(F.abs("delta")).alias("top"), F.sum(F.abs("delta")).alias("movement"), F.max(F.abs("base")).alias("largest"),
        F.min_by(F.struct("key", "delta"), F.struct(-F.abs("delta"), F.col("key"))).alias("top_member"))
    summed = materialize(summed.withColumn("key", F.col("top_member.key")), "breadth-sums")
    named = labels.select(*scope, F.col("product_key").alias("key"), F.col("product_label").alias("label"))
    named = materialize(join_same(named, F.broadcast(summed.select(*scope, "key")), [*scope, "key"], "left_semi"), "top-labels")
    wide = with_period(_scale(period_totals, scope), join_same(summed, named, [*scope, "key"], "left"), scope)
    d, part = F.col("delta_total"), F.coalesce("products_change", F.lit(0.0))
    flat = is_negligible(d, F.coalesce("largest", F.lit(0.0)), d, F.col("moved"))
    excess = part - MAJORITY * d
    inside = ~flat & (d != 0) & ((excess > 0) == (d > 0)) & ~is_negligible(excess, d, F.coalesce("largest", F.lit(0.0)), F.col("moved"))
    moving = F.when(flat, 0.0).when(part > 0, F.col("rising")).otherwise(F.col("falling"))
    declining = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(moving, F.col("positive_base")), F.lit(0.0))))
    top = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide("top", "movement"), F.lit(0.0))))
    kind = (
        F.when(flat, "mixed").when(~inside, "outside_products").when(declining >= BROAD, "broad").when(top >= CONCENTRATED, "concentrated").otherwise("mixed"))
    return wide.select(
        *scope, declining.alias("declining_base_share"), top.alias("top_member_share"), kind.alias("classification"),
        F.when(~flat, F.try_divide(part, d)).alias("products_share_of_change"),
        F.col("label").alias("top_member"), F.col("top_member.delta").alias("top_member_delta"))
