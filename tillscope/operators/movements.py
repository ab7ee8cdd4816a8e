"""Products, categories and breakdown columns: current month against the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.functions import text as T
from tillscope.functions.numbers import is_negligible, pct_change, pct_change_reason
from tillscope.operators.periods import compared, with_period
from tillscope.operators.ranking import join_same, share_reached
from tillscope.session import materialize

# Fixed values.
TOP, DECLINERS, PARETO_SHARE = 10, 10, 0.8
ALL_SHOWN, TOP_SHOWN, MAX_BREAKDOWNS = 9, 8, 2
BLANK_LABEL = "(blank)"
MAX_BLANK_PCT, MIN_VALUES, MAX_VALUES_PER_UNIT = 10.0, 2, 0.5
SPLIT_TYPES = ("categorical_nominal", "categorical_ordinal", "boolean", "text")


def product_months(lines: DataFrame, period: DataFrame, scope: list[str]) -> DataFrame:
    """Per product and compared month: revenue, sold units, money moved, sale-line figures."""
    ours = compared(lines.filter("counted"), period, scope)
    return ours.groupBy(*scope, "slot", "product_key").agg(
        F.sum("amount").alias("revenue"), F.sum(F.when(F.col("sale"), F.col("quantity")).otherwise(0.0)).alias("sold"),
        F.sum(F.abs("amount")).alias("moved"), F.sum(F.when(F.col("sale"), F.col("amount")).otherwise(0.0)).alias("gross"),
        F.count_if("sale").alias("sale_lines"))


def pareto(products: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Fewest products that make 80 % of the current month's positive revenue."""
    scope = scope or []
    ours = products.filter((F.col("slot") == "cur") & F.col("product_key").isNotNull() & (F.col("revenue") > 0))
    values = ours.groupBy(*scope, "revenue").agg(F.count("*").alias("n"))
    found = share_reached(values, scope, "revenue", "n", PARETO_SHARE)
    return found.select(
        *scope, F.col("needed").alias("products_for_80pct"), F.col("members").alias("total_products"),
        (F.col("needed") / F.col("members") * 100).alias("concentration_pct"))


def top_products(products: DataFrame, labels: DataFrame, scope: list[str] | None = None, k: int = TOP) -> DataFrame:
    """The current month's best sellers by revenue, ties by label."""
    scope = scope or []
    ours = products.filter((F.col("slot") == "cur") & F.col("product_key").isNotNull() & (F.col("revenue") > 0))
    named = join_same(ours, labels, [*scope, "product_key"], "left")
    order = W.partitionBy(*scope).orderBy(F.desc("revenue"), "product_label")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        *scope, "rank", "product_key", "product_label", "revenue", F.round("sold").alias("units"))


def decliners(products: DataFrame, labels: DataFrame, period: DataFrame, scope: list[str] | None = None, k: int = DECLINERS) -> DataFrame:
    """The biggest falls among the previous month's products; none when that month is incomplete."""
    scope = scope or []
    side = lambda s, c: F.sum(F.when(F.col("slot") == s, F.col(c)))
    pair = products.filter(F.col("product_key").isNotNull()).groupBy(*scope, "product_key").agg(
        F.coalesce(side("cur", "revenue"), F.lit(0.0)).alias("cur"), side("prev", "revenue").alias("prev"), F.sum("moved").alias("moved"))
    change = F.col("cur") - F.col("prev")
    fell = pair.filter(F.col("prev").isNotNull() & (change < 0) & ~is_negligible(change, F.col("moved")))
    fell = with_period(fell, period.select(*scope, "previous_complete"), scope).filter("previous_complete")
    named = join_same(fell, labels, [*scope, "product_key"], "left").withColumn("revenue_change", change)
    order = W.partitionBy(*scope).orderBy("revenue_change", "product_label")
    args = (F.col("cur"), F.col("prev"), F.col("moved"))
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        *scope, "rank", "product_key", "product_label", "revenue_change", pct_change(*args).alias("change_pct"),
        pct_change_reason(*args).alias("reason"))


def suggested_products(named: DataFrame, suggestions: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Products a table names whose class is only suggested."""
    scope = scope or []
    return join_same(named.select(*scope, "product_key", "product_label").distinct(), suggestions, [*scope, "product_key"])


def category_changes(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per category the two months and its share of the total change (uncategorised lines are in the total)."""
    scope = scope or []
    labels = lines.filter(F.col("category_key").isNotNull()).groupBy(*scope, "category_key").agg(
        F.min_by("category_label", "line_no").alias("category"))
    pair = compared(lines.filter("counted"), period, scope).groupBy(*scope, "slot", "category_key").agg(
        F.sum("amount").alias("revenue"), F.sum(F.abs("amount")).alias("moved"))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("slot") == s, F.col("revenue"))), F.lit(0.0))
    table = pair.groupBy(*scope, "category_key").agg(side("cur").alias("revenue_current"), side("prev").alias("revenue_previous"), F.sum("moved").alias("moved"))
    total = table.groupBy(*scope).agg(
        F.sum("revenue_current").alias("__c"), F.sum("revenue_previous").alias("__p"), F.sum("moved").alias("__m"))
    wide = with_period(with_period(table.filter(F.col("category_key").isNotNull()), total, scope), period.select(*scope, "previous_complete"), scope)
    change = F.col("__c") - F.col("__p")
    reason = F.when(~F.col("previous_complete"), "previous_incomplete").when(
        is_negligible(change, F.col("__c"), F.col("__p"), F.col("__m")), "total_change_is_nothing")
    share = F.when(reason.isNull(), F.try_divide(F.col("revenue_current") - F.col("revenue_previous"), change) * 100)
    return join_same(wide, labels, [*scope, "category_key"], "left").select(
        *scope, "category_key", "category", "revenue_current", "revenue_previous", share.alias("contribution_pct"), reason.alias("reason"))


# --- breakdown columns ---------------------------------------------------------------------------


def split_values(lines: DataFrame, column: str, scope: list[str] | None = None, fill: bool = False) -> DataFrame:
    """Add ``split_key`` and ``split_label``: the column's value per line, or per order where it is
    written on each order's first counted line only and ``fill`` says it holds for the whole order.
    Also ``first_line_only`` per scope.
    """
    scope = scope or []
    raw = F.col(f"`{column}`").cast("string")
    read = lines.withColumns({
        "split_label": F.when(~T.is_blank(raw), T.category_text(raw))})
    read = T.compose_columns(read, ["split_label"]).withColumn("split_key", F.lower("split_label"))
    held = F.col("split_key").isNotNull()
    per_order = read.filter(F.col("counted") & (F.col("orders_basis") == "order_id")).groupBy(*scope, "order_key").agg(
        F.min("line_no").alias("__first"), F.min(F.when(held, F.col("line_no"))).alias("__held0"),
        F.max(F.when(held, F.col("line_no"))).alias("__held1"), F.count_if(~held).alias("__blank"),
        F.min_by("split_key", F.when(held, F.col("line_no"))).alias("__key"), F.min_by("split_label", F.when(held, F.col("line_no"))).alias("__label"))
    first = (F.col("__held0") == F.col("__first")) & (F.col("__held1") == F.col("__first"))
    decided = per_order.groupBy(*scope).agg(
        (F.coalesce(F.bool_and(F.when(F.col("__held0").isNotNull(), first)), F.lit(True))
         & F.coalesce(F.bool_or(F.col("__held0").isNotNull() & (F.col("__blank") > 0)), F.lit(False))).alias("first_line_only"))
    out = with_period(read, decided, scope).withColumn("first_line_only", F.coalesce("first_line_only", F.lit(False)))
    if not fill:
        return out
    values = per_order.filter(F.col("__key").isNotNull()).select(*scope, "order_key", "__key", "__label")
    joined = join_same(out, values, [*scope, "order_key"], "left")
    takes = F.col("first_line_only") & F.col("counted") & F.col("split_key").isNull()
    return joined.withColumns({
        "split_key": F.when(takes, F.col("__key")).otherwise(F.col("split_key")),
        "split_label": F.when(takes, F.col("__label")).otherwise(F.col("split_label")),
    }).drop("__key", "__label")


def breakdown(lines: DataFrame, period: DataFrame, column: str, scope: list[str] | None = None, fill: bool = False) -> DataFrame:
    """The two months' revenue per value of a column: at most nine values, else the top eight and Other, blanks last.

    ``withheld`` says why a scope's split must not be shown.
    """
    scope = scope or []
    split = split_values(lines, column, scope, fill)
    # The label is the key's first spelling in the whole file, not only in the two months.
    labels = split.filter(F.col("split_key").isNotNull()).groupBy(*scope, "split_key").agg(F.min_by("split_label", "line_no").alias("label"))
    ours = compared(split.filter("counted"), period, scope)
    side = lambda s: F.coalesce(F.sum(F.when(F.col("slot") == s, F.col("amount"))), F.lit(0.0))
    values = ours.groupBy(*scope, "split_key").agg(side("cur").alias("cur"), side("prev").alias("prev"))
    values = materialize(join_same(values, labels, [*scope, "split_key"], "left"), "breakdown-values")
    named = F.col("split_key").isNotNull()
    facts = values.groupBy(*scope).agg(
        F.count("split_key").alias("__values"),
        F.coalesce(F.bool_or(F.lower("label") == BLANK_LABEL), F.lit(False)).alias("__blank_like"),
        F.coalesce(F.bool_or(F.lower("label").rlike(r"^other \(\d+ values?\)$")), F.lit(False)).alias("__other_like"))
    order = W.partitionBy(*scope).orderBy(named.desc(), F.desc(F.col("cur") + F.col("prev")), "split_key")
    # Only the first nine named values ever show; ranks beyond them are not needed, just their sums.
    top = values.filter(named).withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= ALL_SHOWN).select(*scope, "split_key", "__rank")
    wide = with_period(join_same(values, top, [*scope, "split_key"], "left"), facts, scope)
    limit = F.when(F.col("__values") <= ALL_SHOWN, ALL_SHOWN).otherwise(TOP_SHOWN)
    kind = F.when(~named, "blank").when(F.col("__rank") <= limit, "value").otherwise("other")
    folded = wide.withColumn("kind", kind)
    member = F.when(F.col("kind") == "value", F.col("label")).when(F.col("kind") == "blank", F.lit(BLANK_LABEL))
    withheld = (
        F.when(F.col("__blank_like"), "value_like_blank_label").when(F.col("__values") < MIN_VALUES, "fewer_than_two_values")
        .when((F.col("__values") > ALL_SHOWN) & F.col("__other_like"), "value_like_other_label"))
    shown = folded.withColumn("withheld", withheld).groupBy(*scope, "kind", member.alias("member"), "withheld").agg(
        F.sum("cur").alias("revenue_current"), F.sum("prev").alias("revenue_previous"), F.count("*").alias("__n"))
    name = F.when(F.col("kind") == "other", F.concat(F.lit("Other ("), F.col("__n").cast("string"), F.when(F.col("__n") == 1, F.lit(" value)")).otherwise(F.lit(" values)")))).otherwise(F.col("member"))
    done = with_period(shown, period.select(*scope, "previous_complete"), scope)
    return done.select(
        *scope, F.lit(column).alias("column"), "kind", name.alias("member"), "revenue_current", "revenue_previous",
        F.when(F.col("previous_complete"), F.col("revenue_current") - F.col("revenue_previous")).alias("change"), "withheld")


def breakdown_measures(lines: DataFrame, column: str, scope: list[str] | None = None) -> DataFrame:
    """What decides whether a column can split sales: blanks, values and purchases, sale-or-return values."""
    scope = scope or []
    split = split_values(lines, column, scope, fill=True).filter("counted")
    by_value = split.groupBy(*scope, "split_key").agg(
        F.count("*").alias("lines"), F.bool_or("sale").alias("s"), F.bool_or("returned").alias("r"))
    both = by_value.groupBy(*scope).agg(
        F.count("split_key").alias("value_count"), F.sum("lines").alias("__lines"),
        F.coalesce(F.sum(F.when(F.col("split_key").isNull(), F.col("lines"))), F.lit(0)).alias("__blank_lines"),
        (F.bool_or("s") & F.bool_or("r") & ~F.bool_or(F.col("s") & F.col("r"))).alias("sale_or_return"))
    per_order = split.groupBy(*scope, "order_key").agg(F.bool_and(F.col("split_key").isNull()).alias("blank"), F.bool_or("first_line_only").alias("f"))
    orders = per_order.groupBy(*scope).agg(F.count("*").alias("__orders"), F.count_if("blank").alias("__blank_orders"), F.bool_or("f").alias("first_line_only"))
    wide = with_period(both, orders, scope)
    by_order = F.col("first_line_only")
    return wide.select(
        *scope, F.lit(column).alias("column"), "first_line_only", "value_count",
        F.when(by_order, F.col("__orders")).otherwise(F.col("__lines")).alias("units"),
        F.when(by_order, F.col("__blank_orders")).otherwise(F.col("__blank_lines")).alias("blank_units"),
        F.col("__orders").alias("purchases"), "sale_or_return")


def breakdown_refusal(whole_order: Column | bool = False) -> Column:
    """Why a measured column cannot split sales, null when it can."""
    whole = F.lit(whole_order) if isinstance(whole_order, bool) else whole_order
    return (
        F.when(F.col("units").isNull(), "lines_not_read").when(F.col("first_line_only") & ~whole, "first_line_only")
        .when(F.col("blank_units") * 100 > MAX_BLANK_PCT * F.col("units"), "too_many_blanks")
        .when(F.col("value_count") < MIN_VALUES, "too_few_values")
        .when((F.col("value_count") > ALL_SHOWN) & (F.col("value_count") > MAX_VALUES_PER_UNIT * F.col("purchases")), "nearly_every_purchase_its_own")
        .when(F.col("sale_or_return"), "sale_or_return_values"))


def column_refusal() -> Column:
    """Why a profiled column cannot split sales; read over profile, kinds and the caller's semantic type."""
    return (
        F.when(F.col("personal"), "personal").when(F.trim("column") == "", "no_header").when(F.col("column").rlike(r"^Unnamed: \d+$"), "no_header")
        .when(~F.col("semantic_type").isin(*SPLIT_TYPES), "not_categories").when(F.col("unique_count") < MIN_VALUES, "too_few_values")
        .when(F.col("null_pct") > MAX_BLANK_PCT, "too_many_blanks").when(F.col("is_numeric") | F.col("any_number_like"), "numbers")
        .when(F.col("any_period_like") | (F.col("dates") > 0), "dates"))


def eligible_columns(profile: DataFrame, kinds: DataFrame, personal: DataFrame, types: DataFrame, measures: DataFrame,
                     whole_order: list[str] | None = None) -> DataFrame:
    """Every unmapped column with why it cannot split sales, and whether the whole-order question would open it."""
    joined = (
        types.join(profile, "column").join(kinds, "column", "left").join(personal, "column", "left")
        .join(measures, "column", "left").fillna(False, ["any_number_like", "any_period_like", "personal"]).fillna(0, ["dates"])
    )
    answered = F.col("column").isin(*(whole_order or [""]))
    by_profile, by_lines, if_whole = column_refusal(), breakdown_refusal(answered), breakdown_refusal(True)
    refusal = F.coalesce(by_profile, by_lines)
    return joined.select("column", refusal.alias("refusal"), refusal.isNull().alias("eligible"),
                         F.coalesce(F.col("first_line_only") & by_profile.isNull() & if_whole.isNull(), F.lit(False)).alias("asks_whole_order"))


def check_chosen(eligible: DataFrame, chosen: list[str]) -> DataFrame:
    """Problems with the columns chosen to split sales: at most two, each once, each eligible."""
    picked = eligible.sparkSession.createDataFrame([(c,) for c in chosen], "column string").groupBy("column").agg(F.count("*").alias("times"))
    problem = (
        F.when(F.lit(len(chosen) > MAX_BREAKDOWNS), "more_than_two").when(F.col("times") > 1, "chosen_twice")
        .when(~F.coalesce(F.col("eligible"), F.lit(False)), "not_eligible"))
    return picked.join(eligible, "column", "left").withColumn("problem", problem).filter("problem is not null").select("column", "problem")
