"""Monthly figures, the revenue identity, and what every kind of line did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.functions import text as T
from tillscope.functions.numbers import is_negligible, pct_change, pct_change_reason
from tillscope.operators.classify import LEAVING, TERM_OF, term_of
from tillscope.operators.periods import compared, figure_scopes, with_period
from tillscope.operators.ranking import join_same, sent
from tillscope.session import materialize

# Which figures each note about the lines touches, and the report's limits.
EVERY_FIGURE = ("revenue", "gross_sales", "returns", "other_deductions", "return_rate", "orders", "aov", "units",
                "customers", "products", "diagnosis")
NOTE_FIGURES = {
    "same_day_cancellations": ("gross_sales", "returns", "return_rate", "orders", "aov", "customers", "products", "diagnosis"),
    "returns_booked_as_in": ("revenue", "returns", "return_rate", "aov", "units", "customers", "products", "diagnosis"),
    "unconfirmed_suggestions": EVERY_FIGURE,
    "unconfirmed_deductions": ("revenue", "other_deductions", "returns", "return_rate", "aov", "customers", "products", "diagnosis"),
    "discounts_in_prices": ("gross_sales", "discounts"),
    "other_transaction_types": EVERY_FIGURE,
}
OTHER_TYPES_NAMED = 5
OTHER_TYPE_NAME_CHARS = 40
OTHER_TYPES_REST = "(other values)"


def zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def monthly_orders(lines: DataFrame, scope: list[str]) -> DataFrame:
    """One row per month and order: the only step that shuffles lines by order, so it carries no sums."""
    return lines.filter("counted").groupBy(*scope, "month", "order_key").agg(F.bool_or("sale").alias("sale"), F.bool_or("returned").alias("returned"))


def monthly_customers(lines: DataFrame, scope: list[str]) -> DataFrame:
    """One row per month and customer (null: nobody named)."""
    return lines.filter("counted").groupBy(*scope, "month", "customer").agg(
        F.sum("amount").alias("amount"), F.bool_or("sale").alias("sale"))


def monthly_core(lines: DataFrame, scope: list[str] | None = None, people: DataFrame | None = None) -> DataFrame:
    """Per month: net revenue, orders, return orders, active customers, buyers, units, per-order figures.

    ``people``, as ``monthly_customers`` tells them, spare reading the lines for them.
    """
    scope = scope or []
    of = lambda c: zero(F.sum(F.when(F.col(c), F.col("amount"))))
    sums = lines.filter("counted").groupBy(*scope, "month").agg(
        F.sum("amount").alias("revenue"), F.sum(F.abs("amount")).alias("money_moved"), F.sum("units").alias("units"),
        of("sale").alias("gross_sales"), (0.0 - of("returned")).alias("returns"), (0.0 - of("deduction")).alias("deductions"), of("charge").alias("charges"),
        F.count_if(F.col("returned") | (F.col("amount") < 0)).alias("refund_lines"), F.count("*").alias("lines"))
    orders = monthly_orders(lines, scope).groupBy(*scope, "month").agg(
        F.count_if("sale").alias("orders"), F.count_if("returned").alias("return_orders"))
    people = monthly_customers(lines, scope) if people is None else people
    people = people.groupBy(*scope, "month").agg(
        F.count("customer").alias("active_customers"), F.count(F.when(F.col("sale"), F.col("customer"))).alias("buyers"))
    figures = join_same(join_same(sums, orders, [*scope, "month"], "left"), people, [*scope, "month"], "left")
    per = lambda c: F.try_divide(F.col(c), F.col("orders"))
    return figures.withColumns({
        "aov": per("revenue"), "return_rate": per("return_orders"),
        "per_order_reason": F.when(F.col("orders") == 0, "no_orders")})


def kpis(core: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One row per figure: current, previous, change and percentage, or the reason there is none."""
    scope = scope or []
    names = ("revenue", "orders", "active_customers", "buyers", "aov", "return_orders", "return_rate")
    pair = compared(core, period, scope).select(
        *scope, "slot", "money_moved", *[F.col(c).cast("double").alias(c) for c in names])
    tidy = pair.unpivot([*scope, "slot", "money_moved"], list(names), "kpi", "value")
    side = lambda s, c="value": F.max(F.when(F.col("slot") == s, F.col(c)))
    wide = tidy.groupBy(*scope, "kpi").agg(
        side("cur").alias("current_value"), side("prev").alias("previous_value"), F.sum("money_moved").alias("__moved"))
    counts = F.col("kpi").isin("orders", "active_customers", "buyers", "return_orders", "revenue")
    cur = F.when(counts, zero(F.col("current_value"))).otherwise(F.col("current_value"))
    prev = F.when(counts, zero(F.col("previous_value"))).otherwise(F.col("previous_value"))
    wide = with_period(wide, period.select(*scope, "previous_complete"), scope).withColumns({"current_value": cur, "previous_value": prev})
    moved = F.when(F.col("kpi") == "revenue", F.col("__moved")).otherwise(F.lit(0.0))
    c, p = F.col("current_value"), F.col("previous_value")
    reason = F.when(~F.col("previous_complete"), "previous_incomplete").otherwise(pct_change_reason(c, p, moved))
    return wide.select(
        *scope, "kpi", "current_value", "previous_value",
        F.when(F.col("previous_complete"), c - p).alias("change"),
        F.when(F.col("previous_complete"), pct_change(c, p, moved)).alias("change_pct"), reason.alias("reason"))


def monthly_trend(core: DataFrame, complete: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Every month from the first to the last, months without rows as gaps, complete or not, gaps numbered in runs."""
    scope = scope or []
    span = core.groupBy(*scope).agg(F.min("month").alias("m0"), F.max("month").alias("m1"))
    calendar = span.select(*scope, F.explode(F.sequence("m0", "m1", F.expr("interval 1 month"))).alias("month"))
    trend = join_same(calendar, core.select(*scope, "month", "revenue", "orders"), [*scope, "month"], "left")
    trend = join_same(trend, complete.withColumn("complete", F.lit(True)), [*scope, "month"], "left")
    order = W.partitionBy(*scope).orderBy("month")
    gap = F.col("revenue").isNull()
    return trend.withColumns({"complete": F.coalesce("complete", F.lit(False)), "is_gap": gap}).withColumn(
        "gap_run", F.when(gap, F.count_if(~F.col("is_gap")).over(order)))


# --- the revenue identity ------------------------------------------------------------------------


def class_amounts(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``(month, line_class, sign)`` with lines and money: the small table the identity is read from."""
    scope = scope or []
    amount = F.col("amount")
    sign = F.when(amount > 0, "positive").when(amount < 0, "negative").otherwise("no_money")
    flagged = F.coalesce(F.col("suggested_class").isin(*LEAVING), F.lit(False))
    return lines.groupBy(*scope, "month", "line_class", sign.alias("sign"), flagged.alias("leaving"),
                         F.col("amount").isNull().alias("no_amount")).agg(
        F.count("*").alias("lines"), zero(F.sum("amount")).alias("amount"), zero(F.sum(F.abs("amount"))).alias("moved"))


def revenue_identity(classes: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Gross − returns − discounts − other deductions + other revenue = net, per file and compared month."""
    scope = scope or []
    terms = figure_scopes(classes.filter(F.col("month").isNotNull() & F.col("line_class").isin(*_counted())), period, scope)
    term = term_of(F.col("line_class"))
    total = lambda cond: zero(F.sum(F.when(cond, F.col("amount"))))
    back = F.col("line_class").isin("customer_return", "pooled_return")
    return terms.groupBy(*scope, "figure_scope").agg(
        total(term == "gross_sales").alias("gross_sales"), (0.0 - total(term == "returns")).alias("returns"),
        (0.0 - total(term == "discounts")).alias("discounts"), (0.0 - total(term == "other_deductions")).alias("other_deductions"),
        total(term == "other_revenue").alias("other_revenue"), zero(F.sum("amount")).alias("net_revenue"),
        (0.0 - total(back & F.col("leaving"))).alias("returns_on_suggested_keys"), zero(F.sum("moved")).alias("money_moved"))


def _counted() -> tuple[str, ...]:
    from tillscope.operators.classify import COUNTED

    return COUNTED


def identity_violations(identity: DataFrame) -> DataFrame:
    """Rows of the identity that do not add up; empty on every ledger."""
    parts = F.col("gross_sales") - F.col("returns") - F.col("discounts") - F.col("other_deductions") + F.col("other_revenue")
    return identity.filter(~is_negligible(parts - F.col("net_revenue"), F.col("money_moved"), F.col("net_revenue")))


def undated_lines(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Lines in no month; unmeasurable ones are reported as such instead."""
    return lines.groupBy(*(scope or [])).agg(
        F.count_if(F.col("txn_ts").isNull() & (F.col("line_class") != "unmeasurable")).alias("undated_lines"))


def non_product_lines(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per class the user gave: lines, money, and money of the compared months."""
    scope = scope or []
    ours = lines.filter((F.col("counted") | F.col("left_out")) & F.col("answered_class").isNotNull())
    small = ours.groupBy(*scope, "month", "answered_class").agg(F.count("*").alias("lines"), F.sum("amount").alias("amount"))
    wide = with_period(small, period.select(*scope, "current", "previous"), scope)
    return wide.groupBy(*scope, "answered_class").agg(
        F.sum("lines").alias("lines"), F.sum("amount").alias("amount"),
        zero(F.sum(F.when(F.col("month") == F.col("current"), F.col("amount")))).alias("amount_current"),
        zero(F.sum(F.when(F.col("month") == F.col("previous"), F.col("amount")))).alias("amount_previous"))


def outside_revenue(classes: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Lines no figure counts, per class and figure scope; stock received also by sign."""
    scope = scope or []
    outside = ("gift_card_sale", "gift_card_redemption", "cost", "adjustment", "stock_in")
    labelled = figure_scopes(classes.filter(F.col("line_class").isin(*outside)), period, scope)
    sign = F.when(F.col("line_class") == "stock_in", F.col("sign"))
    return labelled.groupBy(*scope, "line_class", "figure_scope", sign.alias("sign")).agg(
        F.sum("lines").alias("lines"), F.sum("amount").alias("amount"),
        F.sum(F.when(F.col("no_amount"), F.col("lines")).otherwise(0)).alias("lines_without_amount"))


def unclassified(classes: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or []
    mine = F.col("line_class") == "unclassified"
    counted = F.col("line_class").isin(*_counted()) & F.col("month").isNotNull()
    found = classes.groupBy(*scope).agg(
        F.coalesce(F.sum(F.when(mine, F.col("lines"))), F.lit(0)).alias("lines"),
        zero(F.sum(F.when(mine, F.col("amount")))).alias("amount"), zero(F.sum(F.when(counted, F.col("moved")))).alias("__moved"))
    return found.withColumn("share_of_money_moved", F.try_divide(F.abs("amount"), F.col("__moved"))).drop("__moved")


def unmeasurable(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or []
    reason = F.when(F.col("quantity").isNull(), "no quantity").when(F.col("unit_price").isNull(), "no price").otherwise("amount too large to add")
    small = lines.filter(F.col("line_class") == "unmeasurable").groupBy(*scope, "month", reason.alias("reason")).agg(F.count("*").alias("lines"))
    return figure_scopes(small, period, scope).groupBy(*scope, "figure_scope", "reason").agg(F.sum("lines").alias("lines"))


# --- notes about the lines -----------------------------------------------------------------------


def same_day_cancellations(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Return lines whose customer bought the same product that day, and those sale lines.

    Lines first move as a hash of customer, product and day alone; only those whose hash is both sold and taken back are
    reduced to one row each way before they meet, so nothing joins line to line.
    """
    scope = scope or []
    key = [*scope, "customer", "netting_key", "txn_day"]
    known = F.col("txn_ts").isNotNull() & F.col("customer").isNotNull() & F.col("netting_key").isNotNull()
    back, sold = F.col("line_class") == "customer_return", F.col("line_class") == "sale"
    ours = lines.filter(known & (back | sold)).withColumn("__hash", F.xxhash64(*key))
    # Two keys of one hash only let more lines through; they are told apart below.
    both = ours.groupBy("__hash").agg(F.bool_or(back).alias("r"), F.bool_or(sold).alias("s")).filter("r and s").select("__hash")
    near = ours.join(sent(materialize(both, "returned-and-sold")), "__hash", "left_semi")
    orders = materialize(near.groupBy(*key, "month", "order_key").agg(
        F.count_if(back).alias("return_lines"), zero(F.sum(F.when(back, F.col("amount")))).alias("return_amount"),
        F.count_if(sold).alias("sale_lines"), zero(F.sum(F.when(sold, F.col("amount")))).alias("sale_amount")), "customer-product-days")
    hits = orders.groupBy(*key).agg(F.sum("return_lines").alias("r"), F.sum("sale_lines").alias("s")).filter("r > 0 and s > 0")
    hit = join_same(orders, hits.drop("r", "s"), key, "left_semi")
    per_order = hit.groupBy(*scope, "month", "order_key").agg(
        *[F.sum(c).alias(c) for c in ("return_lines", "return_amount", "sale_lines", "sale_amount")])
    unchecked = lines.filter(F.col("returned") & (F.col("customer").isNull() | (F.col("line_class") == "pooled_return")))
    loose = unchecked.groupBy(*scope, "month", "order_key").agg(F.count("*").alias("lines"), F.sum("amount").alias("amount"))
    measure = lambda df, name, n, a: df.filter(F.col(n) > 0).groupBy(*scope, "month").agg(
        F.sum(n).alias("lines"), F.sum(a).alias("amount"), F.count("*").alias("orders")).withColumn("measure", F.lit(name))
    tidy = (
        measure(per_order, "returns", "return_lines", "return_amount")
        .unionByName(measure(per_order, "sales", "sale_lines", "sale_amount"))
        .unionByName(measure(loose, "returns_unchecked", "lines", "amount"))
    )
    return figure_scopes(tidy, period, scope).groupBy(*scope, "measure", "figure_scope").agg(
        F.sum("lines").alias("lines"), F.sum("amount").alias("amount"), F.sum("orders").alias("orders"))


def returns_booked_as_in(classes: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or []
    stock = classes.filter(F.col("line_class") == "stock_in")
    sign = F.when(F.col("no_amount"), "unknown").when(F.col("sign") == "no_money", "zero").otherwise(F.col("sign"))
    return figure_scopes(stock, period, scope).groupBy(*scope, sign.alias("measure"), "figure_scope").agg(
        F.sum("lines").alias("lines"), F.sum("amount").alias("amount"))


def unconfirmed_suggestions(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Counted lines whose key looks like no product and nobody confirmed: lines, keys, returns, whole orders."""
    scope = scope or []
    on = F.coalesce(F.col("suggested_class").isin(*LEAVING), F.lit(False))
    ours = lines.filter("counted").withColumn("on", on)
    per_order = ours.groupBy(*scope, "month", "order_key").agg(
        F.count_if("on").alias("lines"), zero(F.sum(F.when(F.col("on"), F.col("amount")))).alias("amount"),
        F.count_if(F.col("on") & F.col("returned")).alias("return_lines"),
        zero(F.sum(F.when(F.col("on") & F.col("returned"), F.col("amount")))).alias("return_amount"),
        *[F.count_if(F.col(c)).alias(f"{c}_all") for c in ("sale", "returned")],
        *[F.count_if(F.col(c) & F.col("on")).alias(f"{c}_on") for c in ("sale", "returned")])
    only = lambda c: F.count_if((F.col(f"{c}_all") > 0) & (F.col(f"{c}_all") == F.col(f"{c}_on")))
    months = figure_scopes(
        per_order.groupBy(*scope, "month").agg(
            F.sum("lines").alias("lines"), F.sum("amount").alias("amount"), F.sum("return_lines").alias("return_lines"),
            F.sum("return_amount").alias("return_amount"), only("sale").alias("orders_only"), only("returned").alias("return_orders_only")),
        period, scope).groupBy(*scope, "figure_scope").agg(
        *[F.sum(c).alias(c) for c in ("lines", "amount", "return_lines", "return_amount", "orders_only", "return_orders_only")])
    keys = figure_scopes(ours.filter("on").select(*scope, "month", "netting_key").distinct(), period, scope).select(
        *scope, "figure_scope", "netting_key").distinct().groupBy(*scope, "figure_scope").agg(F.count("netting_key").alias("keys"))
    return join_same(months, keys, [*scope, "figure_scope"], "left").fillna(0, ["keys"])


def unconfirmed_deductions(classes: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or []
    ours = classes.filter(F.col("line_class").isin("allowance", "pooled_allowance") & F.col("month").isNotNull())
    return figure_scopes(ours, period, scope).groupBy(*scope, "figure_scope").agg(F.sum("lines").alias("lines"), F.sum("amount").alias("amount"))


def _names_apart(ranked: DataFrame, scope: list[str]) -> DataFrame:
    """``(scope, value, name)``: each named value's spelling, cut to its room and numbered until no other measure has it.

    A scope has at most ``OTHER_TYPES_NAMED`` of them, taken in the order of their values; one rank more means there is a rest,
    whose name is taken.
    """
    entry = F.struct("value", "spelling")
    listed = ranked.groupBy(*scope).agg(
        F.sort_array(F.collect_list(F.when(F.col("rank") <= OTHER_TYPES_NAMED, entry))).alias("entries"), F.max("rank").alias("most"))

    def candidate(name, number):
        suffix = F.when(number == 1, "").otherwise(F.concat(F.lit(" ("), number.cast("string"), F.lit(")")))
        room = F.lit(OTHER_TYPE_NAME_CHARS) - F.length(suffix)
        return F.concat(F.when(F.length(name) <= room, name).otherwise(F.concat(F.substring(name, F.lit(1), room - 3), F.lit("..."))), suffix)

    def step(done, one):
        tries = F.transform(F.sequence(F.lit(1), F.lit(OTHER_TYPES_NAMED + 2)), lambda n: candidate(one["spelling"], n))
        free = F.element_at(F.filter(tries, lambda t: ~F.array_contains(done["taken"], T.fold(t))), 1)
        return F.struct(F.array_append(done["taken"], T.fold(free)).alias("taken"),
                        F.array_append(done["names"], F.struct(one["value"].alias("value"), free.alias("name"))).alias("names"))

    rest = F.when(F.col("most") > OTHER_TYPES_NAMED, F.array(T.fold(F.lit(OTHER_TYPES_REST)))).otherwise(F.array().cast("array<string>"))
    start = F.struct(rest.alias("taken"), F.array().cast("array<struct<value:string,name:string>>").alias("names"))
    named = listed.withColumn("__done", F.aggregate("entries", start, step))
    return named.select(*scope, F.inline("__done.names"))


def other_transaction_types(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Counted lines of a type that is neither in nor out: the five commonest by name, the rest folded."""
    scope = scope or []
    folded = F.lower(T.identifier_text(F.col("transaction_type")))
    counts = (
        lines.filter("counted").withColumn("value", folded)
        .filter(F.col("value").isNotNull() & ~F.col("value").isin("in", "out", ""))
        .groupBy(*scope, "month", "value", "transaction_type").agg(F.count("*").alias("lines"), F.sum("amount").alias("amount"))
    )
    counts = T.compose_columns(materialize(counts, "types"), ["value"])
    spelled = counts.groupBy(*scope, "value", "transaction_type").agg(F.sum("lines").alias("n"))
    values = spelled.groupBy(*scope, "value").agg(
        F.min_by("transaction_type", F.struct(-F.col("n"), F.col("transaction_type"))).alias("spelling"), F.sum("n").alias("n"))
    order = W.partitionBy(*scope).orderBy(F.desc("n"), "value")
    # A row further than the named ones tells whether there is a rest.
    named = values.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= OTHER_TYPES_NAMED + 1)
    names = _names_apart(named, scope)
    labelled = join_same(counts, names, [*scope, "value"], "left")
    months = labelled.groupBy(*scope, "month", F.coalesce("name", F.lit(OTHER_TYPES_REST)).alias("measure")).agg(
        F.sum("lines").alias("lines"), F.sum("amount").alias("amount"))
    return figure_scopes(months, period, scope).groupBy(*scope, "measure", "figure_scope").agg(
        F.sum("lines").alias("lines"), F.sum("amount").alias("amount"))


def placeholder_lines(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Lines left without a customer: receipts not filled by answer, and confirmed placeholders."""
    nameless = F.col("customer").isNull()
    return lines.groupBy(*(scope or [])).agg(
        F.count_if(F.col("receipt_fillable") & nameless & ~F.col("placeholder")).alias("unfilled_receipt_lines"),
        F.count_if(F.col("placeholder") & F.col("counted") & nameless).alias("placeholder_lines"))


def unconfirmed_placeholders(lines: DataFrame, period: DataFrame, candidates: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Counted lines still under a suggested walk-in value: in the file and in each compared month."""
    scope = scope or []
    mine = lines.filter(F.col("counted") & F.col("customer").isNotNull()).groupBy(*scope, "month", "customer").agg(F.count("*").alias("lines"))
    hit = join_same(mine, candidates.select(*scope, "customer"), [*scope, "customer"], "left_semi")
    wide = with_period(hit, period.select(*scope, "current", "previous"), scope)
    part = lambda c: F.coalesce(F.sum(F.when(F.col("month") == F.col(c), F.col("lines"))), F.lit(0))
    return wide.groupBy(*scope, "customer").agg(
        F.sum("lines").alias("lines"), part("current").alias("lines_current"), part("previous").alias("lines_previous"))


def duplicate_effect(copies: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """What removing exact copies takes: ``copies`` is sales lines of the kept rows with ``copies`` each."""
    extra = F.col("copies") - 1
    return copies.groupBy(*(scope or [])).agg(
        F.sum(extra).alias("lines"), zero(F.sum(F.when(F.col("counted"), extra * F.col("amount")))).alias("revenue"))


IDENTITY = ("gross_sales", "returns", "discounts", "other_deductions", "other_revenue")
OUTSIDE = ("gift_card_sale", "gift_card_redemption", "cost", "adjustment", "stock_in")


def _class_blocks() -> Column:
    """The rows of the summary that a row of ``class_amounts`` adds to: (block, item, lines, amount, without_amount)."""
    lines, amount, none = F.col("lines"), F.col("amount"), F.lit(0).cast("long")
    missing = F.when(F.col("no_amount"), lines).otherwise(none)
    row = lambda block, item, n, a, m=none: F.struct(F.lit(block).alias("block"), item.alias("item"), n.alias("lines"), a.alias("amount"), m.alias("without_amount"))
    counted = F.col("line_class").isin(*_counted()) & F.col("month").isNotNull()
    term, stock = term_of(F.col("line_class")), F.col("line_class") == "stock_in"
    rows = []
    for name in IDENTITY:
        mine = F.coalesce(term == name, F.lit(False))
        signed = 0.0 - amount if name in ("returns", "discounts", "other_deductions") else amount
        rows.append(F.when(counted, row("identity", F.lit(name), F.when(mine, lines).otherwise(none), F.when(mine, signed).otherwise(0.0))))
    back = F.col("line_class").isin("customer_return", "pooled_return") & F.col("leaving")
    rows += [
        F.when(counted, row("identity", F.lit("net_revenue"), lines, amount)),
        F.when(counted, row("identity", F.lit("returns_on_suggested_keys"), F.when(back, lines).otherwise(none), F.when(back, 0.0 - amount).otherwise(0.0))),
        F.when(F.col("line_class").isin(*OUTSIDE), row("outside_revenue", F.concat_ws("/", "line_class", F.when(stock, F.col("sign"))), lines, amount, missing)),
        F.when(F.col("line_class") == "unclassified", row("unclassified", F.lit("all"), lines, amount)),
        F.when(stock, row("returns_booked_as_in", F.when(F.col("no_amount"), "unknown").when(F.col("sign") == "no_money", "zero").otherwise(F.col("sign")), lines, amount, missing)),
        F.when(counted & F.col("line_class").isin("allowance", "pooled_allowance"), row("unconfirmed_deductions", F.lit("all"), lines, amount)),
    ]
    return F.explode(F.array_compact(F.array(*rows)))


def line_summary(lines: DataFrame, classes: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Everything said about the lines of a file in one long table: ``figure_scope, block, item, lines, amount, without_amount, orders, keys``.

    The identity's terms, what lies outside of revenue, what is unclassified and the notes read from classes come from one pass
    over the small table of class amounts; lines without a date, figures or a customer are counted in one pass over the lines;
    the notes about orders keep their own reductions. ``orders`` and ``keys`` are null where a row has none.
    """
    scope = scope or []
    columns = [*scope, "figure_scope", "block", "item", "lines", "amount", "without_amount", "orders", "keys"]
    long, money = F.lit(None).cast("long"), F.lit(None).cast("double")

    def tidy(df: DataFrame, block: str, item: Column, **given: Column) -> DataFrame:
        values = {"figure_scope": F.col("figure_scope"), "block": F.lit(block), "item": item, "lines": F.col("lines"), "amount": money, "without_amount": long, "orders": long, "keys": long, **given}
        return df.select(*scope, *[values[c].alias(c) for c in columns[len(scope):]])

    one = figure_scopes(classes, period, scope).select(*scope, "figure_scope", _class_blocks().alias("r")).select(*scope, "figure_scope", "r.*")
    blocks = one.groupBy(*scope, "figure_scope", "block", "item").agg(F.sum("lines").alias("lines"), zero(F.sum("amount")).alias("amount"), F.sum("without_amount").alias("without_amount"))
    out = blocks.select(*scope, *[F.col(c) if c in blocks.columns else long.alias(c) for c in columns[len(scope):]])

    nameless, unmeasured = F.col("customer").isNull(), F.col("line_class") == "unmeasurable"
    reason = F.when(F.col("quantity").isNull(), "no quantity").when(F.col("unit_price").isNull(), "no price").otherwise("amount too large to add")
    counts = {
        "lines/all": F.lit(True), "lines/undated": F.col("txn_ts").isNull() & ~unmeasured,
        **{f"unmeasurable/{r}": unmeasured & (reason == r) for r in ("no quantity", "no price", "amount too large to add")},
        "customers/unfilled receipt lines": F.col("receipt_fillable") & nameless & ~F.col("placeholder"),
        "customers/placeholder lines": F.col("placeholder") & F.col("counted") & nameless,
    }
    wide = lines.groupBy(*scope).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n.split("/")[0]).alias("block"), F.lit(n.split("/")[1]).alias("item"), F.col(n).alias("lines")) for n in counts]))
    told = wide.select(*scope, rows.alias("r")).select(*scope, F.lit("file").alias("figure_scope"), "r.*")
    out = out.unionByName(told.select(*scope, *[F.col(c) if c in told.columns else (money if c == "amount" else long).alias(c) for c in columns[len(scope):]]))

    same = same_day_cancellations(lines, period, scope)
    out = out.unionByName(tidy(same, "same_day_cancellations", F.col("measure"), amount=F.col("amount"), orders=F.col("orders")))
    asked = unconfirmed_suggestions(lines, period, scope)
    out = out.unionByName(tidy(asked, "unconfirmed_suggestions", F.lit("all"), amount=F.col("amount"), orders=F.col("orders_only"), keys=F.col("keys")))
    out = out.unionByName(tidy(asked, "unconfirmed_suggestions", F.lit("returns"), lines=F.col("return_lines"), amount=F.col("return_amount"), orders=F.col("return_orders_only")))
    return out.unionByName(tidy(other_transaction_types(lines, period, scope), "other_transaction_types", F.col("measure"), amount=F.col("amount")))


def note_figures(spark) -> DataFrame:
    """The figures each note about the lines touches, as a small dimension table."""
    rows = [(code, figure) for code, figures in NOTE_FIGURES.items() for figure in figures]
    return spark.createDataFrame(rows, "code string, figure string")
