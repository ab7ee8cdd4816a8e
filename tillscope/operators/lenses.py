"""Why revenue changed: exactly reconciling decompositions of the two months' difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.functions.numbers import RESIDUE, is_negligible, shapley2, shapley3
from tillscope.operators.metrics import monthly_customers
from tillscope.operators.orders import first_purchases
from tillscope.operators.periods import compared, with_period
from tillscope.operators.ranking import join_same
from tillscope.operators.signals import typical_magnitude
from tillscope.session import materialize

# --- fixed values -------------------------------------------------------------------------------
MASKED_GROSS_TO_NET, MASKED_SHARE = 3.0, 0.25
LEFT_CENSOR_MONTHS = 3
RECONCILE, RECONCILE_FLOAT = 1e-6, 1e-12
MIX_METRICS = (("aov", "orders"), ("price_per_unit", "units"))
STOCKOUT_SHARE, STOCKOUT_RATE, STOCKOUT_RUN = 0.02, 0.5, 7
# -------------------------------------------------------------------------------------------------


def zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def period_totals(core: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One row per scope with both months' totals side by side."""
    scope = scope or []
    wide = with_period(core, period.select(*scope, "current", "previous"), scope)
    names = ("revenue", "orders", "buyers", "units", "gross_sales", "returns", "deductions", "charges", "refund_lines", "money_moved")
    at = lambda m, c: zero(F.sum(F.when(F.col("month") == F.col(m), F.col(c).cast("double"))))
    return wide.groupBy(*scope).agg(
        *[at(m, c).alias(f"{c}_{tag}") for c in names for m, tag in (("current", "cur"), ("previous", "prev"))])


def lever(totals: DataFrame, typical: DataFrame | None = None, scope: list[str] | None = None, has_customers: bool = True) -> DataFrame:
    """Customers × frequency × order value (or orders × order value), the basket split, masked shifts.

    One row per scope; ``*_reason`` says why a part is missing.
    """
    scope = scope or []
    c = lambda n: F.col(n)
    o0, o1, r0, r1 = c("orders_prev"), c("orders_cur"), c("revenue_prev"), c("revenue_cur")
    b0, b1, u0, u1 = c("buyers_prev"), c("buyers_cur"), c("units_prev"), c("units_cur")
    a0, a1 = F.try_divide(r0, o0), F.try_divide(r1, o1)
    has_orders = (o0 > 0) & (o1 > 0)
    three = F.lit(has_customers) & (b0 > 0) & (b1 > 0)
    f0, f1 = F.try_divide(o0, b0), F.try_divide(o1, b1)
    phi_c, phi_f, phi_a3 = shapley3(b0, b1, f0, f1, a0, a1)
    phi_o, phi_a2 = shapley2(o0, o1, a0, a1)
    level1 = totals.withColumns({
        "formula": F.when(has_orders, F.when(three, "customers*frequency*aov").otherwise("orders*aov")),
        "aov_prev": a0, "aov_cur": a1, "frequency_prev": f0, "frequency_cur": f1,
        "customers_effect": F.when(has_orders & three, phi_c), "frequency_effect": F.when(has_orders & three, phi_f),
        "orders_effect": F.when(has_orders & ~three, phi_o),
        "aov_effect": F.when(has_orders, F.when(three, phi_a3).otherwise(phi_a2)),
        "pair_orders_effect": F.when(has_orders, phi_o), "pair_aov_effect": F.when(has_orders, phi_a2),
    })
    d_aov = c("aov_cur") - c("aov_prev")
    net_units = (u0 > 0) & (u1 > 0)
    reason2 = (
        F.when(c("formula").isNull(), "no_level1").when(~net_units, "net_units_not_positive")
        .when(is_negligible(d_aov, c("aov_prev"), c("aov_cur")), "aov_unchanged"))
    phi_u, phi_p = shapley2(F.try_divide(u0, o0), F.try_divide(u1, o1), F.try_divide(r0, u0), F.try_divide(r1, u1))
    rescale = lambda phi: F.when(c("level2_reason").isNull(), c("aov_effect") * phi / d_aov)
    level2 = level1.withColumn("level2_reason", reason2).withColumns({
        "units_per_order_prev": F.try_divide(u0, o0), "units_per_order_cur": F.try_divide(u1, o1),
        "price_per_unit_prev": F.try_divide(r0, u0), "price_per_unit_cur": F.try_divide(r1, u1),
        "units_per_order_effect": rescale(phi_u), "price_per_unit_effect": rescale(phi_p),
    })
    moved = r1 - r0
    gross = zero(F.abs(c("customers_effect"))) + zero(F.abs(c("frequency_effect"))) + zero(F.abs(c("orders_effect"))) + zero(F.abs(c("aov_effect")))
    ratio = F.when(c("formula").isNotNull() & ~is_negligible(moved, r0, r1), gross / F.abs(moved))
    out = level2.withColumns({"net_change": moved, "level1_gross": F.when(c("formula").isNotNull(), gross), "gross_to_net": ratio})
    if typical is None:
        return out
    out = with_period(out, typical.select(*scope, "typical"), scope)
    floor = MASKED_SHARE * F.greatest(F.col("typical"), F.abs(r0), F.abs(r1))
    flat = (F.abs(moved) < MASKED_SHARE * F.greatest(F.abs(r0), F.abs(r1))) & (c("gross_to_net").isNull() | (c("gross_to_net") >= MASKED_GROSS_TO_NET))
    up = F.greatest("pair_orders_effect", "pair_aov_effect") >= floor
    down = F.least("pair_orders_effect", "pair_aov_effect") <= -floor
    alert = F.when(c("formula").isNotNull() & (F.col("typical") > 0) & (r0 > 0) & (r1 > 0), flat & up & down)
    return out.withColumn("masked_shift_alert", alert)


def typical_month(core: DataFrame, history: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The size of a month this shop actually trades: the median of the history's non-zero revenue."""
    scope = scope or []
    past = join_same(history, core.select(*scope, "month", "revenue"), [*scope, "month"]).filter("revenue is not null")
    return typical_magnitude(past, scope, "revenue")


def lever_bars(levers: DataFrame, scope: list[str] | None = None, refunds_withhold: bool = True) -> DataFrame:
    """The waterfall's bars in whole cents that sum exactly to the printed change (largest remainder)."""
    scope = scope or []
    cents = lambda x: F.round(x.cast("decimal(28,6)") * 100).cast("long")
    refunds = (F.col("refund_lines_prev") + F.col("refund_lines_cur") > 0) if refunds_withhold else F.lit(False)
    split = F.col("level2_reason").isNull() & ~refunds
    base = levers.withColumns({"c0": cents(F.col("revenue_prev")), "c1": cents(F.col("revenue_cur")), "split": split})
    drawn = base.filter(F.col("formula").isNotNull() & (F.least("c0", "c1") > 0))
    factors = (("customers", 1), ("frequency", 2), ("orders", 3), ("aov", 4), ("units_per_order", 5), ("price_per_unit", 6))
    bars = F.array_compact(F.array(*[
        F.when(F.col(f"{n}_effect").isNotNull() & (
            F.lit(n not in ("aov", "units_per_order", "price_per_unit")) | (F.lit(n == "aov") & ~F.col("split"))
            | (F.lit(n in ("units_per_order", "price_per_unit")) & F.col("split"))),
            F.struct(F.lit(i).alias("position"), F.lit(n).alias("factor"), F.col(f"{n}_effect").alias("effect")))
        for n, i in factors]))
    rows = drawn.select(*scope, "c0", "c1", F.inline(bars))
    every = W.partitionBy(*scope)
    top = F.max(F.abs("effect")).over(every)
    rows = rows.withColumn("effect", F.when((F.abs("effect") <= RESIDUE * top) & (F.abs("effect") < 0.005), 0.0).otherwise(F.col("effect")))
    exact = F.col("effect").cast("decimal(28,10)") * 100
    rows = rows.withColumn("floor_cents", F.floor(exact)).withColumn("rest", exact - F.col("floor_cents"))
    rows = rows.withColumn("left", F.col("c1") - F.col("c0") - F.sum("floor_cents").over(every))
    can_take = F.col("effect") != 0
    can_give = can_take & ~((F.col("effect") > 0) & (F.col("floor_cents") <= 0))
    take = W.partitionBy(*scope).orderBy(can_take.desc(), F.desc("rest"), "position")
    give = W.partitionBy(*scope).orderBy(can_give.desc(), "rest", F.desc("position"))
    step = (
        F.when((F.col("left") > 0) & can_take & (F.row_number().over(take) <= F.col("left")), 1)
        .when((F.col("left") < 0) & can_give & (F.row_number().over(give) <= -F.col("left")), -1).otherwise(0))
    done = rows.withColumn("cents", (F.col("floor_cents") + step).cast("long")).withColumn("__sum", F.sum("cents").over(every))
    return done.filter(F.col("__sum") == F.col("c1") - F.col("c0")).select(*scope, "position", "factor", "effect", "cents", "c0", "c1")


def waterfall(bars: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The bars as steps with a running start and end in cents, last month at 0, then the whole change."""
    scope = scope or []
    order = W.partitionBy(*scope).orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    steps = bars.withColumn("end_cents", F.sum("cents").over(order)).select(
        *scope, "position", "factor", (F.col("end_cents") - F.col("cents")).alias("start_cents"), "end_cents")
    whole = bars.groupBy(*scope).agg(F.max(F.col("c1") - F.col("c0")).alias("end_cents")).select(
        *scope, F.lit(99).alias("position"), F.lit("change").alias("factor"), F.lit(0).cast("long").alias("start_cents"), "end_cents")
    return steps.unionByName(whole)


def returns_lens(totals: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Gross sales, returns, deductions and charges: ``(term, previous, current, effect)``."""
    scope = scope or []
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"{t}_prev").alias("previous"), F.col(f"{t}_cur").alias("current"),
                               ((F.col(f"{t}_cur") - F.col(f"{t}_prev")) * s).alias("effect"))
                      for t, s in (("gross_sales", 1), ("returns", -1), ("deductions", -1), ("charges", 1))])
    return totals.select(*scope, F.inline(terms))


# --- customers -----------------------------------------------------------------------------------


def customer_classes(people: DataFrame, first: DataFrame, pairs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Each customer's class in a transition: new, resurrected, retained or lapsed.

    ``people`` is revenue per month and customer, ``pairs`` is ``(scope, transition, previous, current)``.
    A first purchase in the current month makes a customer new even when the previous month knew them.
    """
    scope = scope or []
    sides = pairs.select(*scope, "transition", "current", F.explode(F.array(
        F.struct(F.col("previous").alias("month"), F.lit("prev").alias("slot")),
        F.struct(F.col("current").alias("month"), F.lit("cur").alias("slot")))).alias("__slot")).select(*scope, "transition", "current", "__slot.*")
    named = people.filter(F.col("customer").isNotNull())
    both = join_same(named, F.broadcast(sides) if not scope else sides, [*scope, "month"])
    at = lambda s: F.sum(F.when(F.col("slot") == s, F.col("amount")))
    wide = both.groupBy(*scope, "transition", "customer", "current").agg(at("prev").alias("prev"), at("cur").alias("cur"))
    wide = join_same(wide, first, [*scope, "customer"], "left")
    kind = (
        F.when(F.col("cur").isNotNull() & (F.col("first_month") == F.col("current")), "new")
        .when(F.col("cur").isNotNull() & F.col("prev").isNotNull(), "retained")
        .when(F.col("cur").isNotNull(), "resurrected").otherwise("lapsed"))
    return wide.select(*scope, "transition", "customer", kind.alias("customer_class"), "prev", "cur", "first_month")


def transitions(period: DataFrame, with_rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The compared pair, and the pair before it where both of its months hold rows."""
    scope = scope or []
    now = period.select(*scope, F.lit("current").alias("transition"), "previous", "current")
    before = period.select(*scope, F.lit("previous").alias("transition"), F.add_months("previous", -1).alias("previous"), F.col("previous").alias("current"))
    rows = with_rows.select(*scope, "month")
    before = join_same(before, rows.withColumnRenamed("month", "previous"), [*scope, "previous"], "left_semi")
    before = join_same(before, rows.withColumnRenamed("month", "current"), [*scope, "current"], "left_semi")
    return now.unionByName(before.select(now.columns))


def customer_bridge(classes: DataFrame, people: DataFrame, pairs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The change by customer class; nameless revenue is its own term, so the terms sum to the change."""
    scope = scope or []
    prev, cur = zero(F.col("prev")), zero(F.col("cur"))
    kind = F.col("customer_class")
    total = lambda k, v: zero(F.sum(F.when(kind == k, v)))
    terms = classes.groupBy(*scope, "transition").agg(
        total("new", cur - prev).alias("new"), total("resurrected", cur).alias("resurrected"),
        total("retained", F.greatest(F.lit(0.0), cur - prev)).alias("expansion"),
        (0.0 - total("retained", F.greatest(F.lit(0.0), prev - cur))).alias("contraction"), (0.0 - total("lapsed", prev)).alias("lapsed"),
        F.count_if(kind == "new").alias("new_customers"),
        F.count_if((kind == "resurrected") & F.col("first_month").isNull()).alias("arrivals_without_first_purchase"))
    blank = people.filter(F.col("customer").isNull()).select(*scope, "month", "amount")
    nameless = with_period(blank, pairs, scope) if scope else blank.crossJoin(F.broadcast(pairs))
    loose = nameless.groupBy(*scope, "transition").agg(
        zero(F.sum(F.when(F.col("month") == F.col("current"), F.col("amount")))).alias("__c"),
        zero(F.sum(F.when(F.col("month") == F.col("previous"), F.col("amount")))).alias("__p"))
    wide = join_same(join_same(pairs.select(*scope, "transition"), terms, [*scope, "transition"], "left"), loose, [*scope, "transition"], "left")
    filled = wide.fillna(0.0, ["new", "resurrected", "expansion", "contraction", "lapsed", "__c", "__p"]).fillna(
        0, ["new_customers", "arrivals_without_first_purchase"])
    return filled.withColumn("unattributed", F.col("__c") - F.col("__p")).drop("__c", "__p")


def customer_lens(lines: DataFrame, period: DataFrame, with_rows: DataFrame, scope: list[str] | None = None,
                  first: DataFrame | None = None, people: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(bridge, classes)`` for the compared pair and the one before."""
    scope = scope or []
    people = materialize(monthly_customers(lines, scope), "month-customers") if people is None else people
    first = first_purchases(lines, scope) if first is None else first
    pairs = transitions(period, with_rows, scope)
    classes = materialize(customer_classes(people, first, pairs, scope), "customer-classes")
    return customer_bridge(classes, people, pairs, scope), classes


# --- products ------------------------------------------------------------------------------------


def product_lens(products: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Volume, mix and price over products sold in both months, launches, discontinuations, unnamed lines.

    Four cross sums of shares and prices give the three Shapley terms in closed form.
    """
    scope = scope or []
    at = lambda s, c: F.sum(F.when(F.col("slot") == s, F.col(c)))
    pair = products.filter(F.col("sale_lines") > 0).groupBy(*scope, "product_key").agg(
        at("prev", "sold").alias("q0"), at("cur", "sold").alias("q1"), at("prev", "gross").alias("g0"), at("cur", "gross").alias("g1"))
    in0, in1 = zero(F.col("q0")) > 0, zero(F.col("q1")) > 0
    named = F.col("product_key").isNotNull()
    live = named & in0 & in1
    p0, p1 = F.try_divide("g0", "q0"), F.try_divide("g1", "q1")
    on = lambda v: zero(F.sum(F.when(live, v)))
    sums = pair.groupBy(*scope).agg(
        on(F.col("q0")).alias("units0"), on(F.col("q1")).alias("units1"),
        on(F.col("q0") * p0).alias("m00"), on(F.col("q0") * p1).alias("m01"), on(F.col("q1") * p0).alias("m10"), on(F.col("q1") * p1).alias("m11"),
        zero(F.sum(F.when(named & in1 & ~in0, F.col("g1")))).alias("new_products"),
        (0.0 - zero(F.sum(F.when(named & in0 & ~in1, F.col("g0"))))).alias("discontinued_products"),
        zero(F.sum(F.when(~named, zero(F.col("g1")) - zero(F.col("g0"))))).alias("unidentified"),
        F.count_if(live).alias("live_products"))
    q0, q1 = F.col("units0"), F.col("units1")
    c00, c01 = zero(F.try_divide("m00", "units0")), zero(F.try_divide("m01", "units0"))
    c10, c11 = zero(F.try_divide("m10", "units1")), zero(F.try_divide("m11", "units1"))
    volume = (q1 - q0) * (2 * c00 + c01 + c10 + 2 * c11) / 6
    mix = (2 * q0 * (c10 - c00) + q0 * (c11 - c01) + q1 * (c10 - c00) + 2 * q1 * (c11 - c01)) / 6
    price = (2 * q0 * (c01 - c00) + q0 * (c11 - c10) + q1 * (c01 - c00) + 2 * q1 * (c11 - c10)) / 6
    return sums.select(*scope, volume.alias("volume"), mix.alias("mix"), price.alias("price"), "new_products", "discontinued_products",
                       "unidentified", "live_products")


def tree(levers: DataFrame, bridge: DataFrame, products: DataFrame, totals: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Every lens as rows ``(lens, term, value)`` and the total each must sum to."""
    scope = scope or []
    net, gross = F.col("revenue_cur") - F.col("revenue_prev"), F.col("gross_sales_cur") - F.col("gross_sales_prev")

    def rows(df: DataFrame, lens: str, terms: tuple[str, ...], total: Column) -> DataFrame:
        listed = F.inline(F.array_compact(F.array(*[
            F.when(F.col(t).isNotNull(), F.struct(F.lit(lens).alias("lens"), F.lit(t).alias("term"), F.col(t).alias("value"), total.alias("lens_total")))
            for t in terms])))
        return df.select(*scope, listed)

    lev = rows(levers.withColumnsRenamed({f"{t}_effect": t for t in ("customers", "frequency", "orders", "aov", "units_per_order", "price_per_unit")}),
               "level1", ("customers", "frequency", "orders", "aov"), net)
    lev2 = rows(levers.withColumnsRenamed({f"{t}_effect": t for t in ("units_per_order", "price_per_unit")}), "level2",
                ("units_per_order", "price_per_unit"), F.col("aov_effect"))
    sums = with_period(totals, bridge.filter(F.col("transition") == "current"), scope)
    cust = rows(sums, "customers", ("new", "resurrected", "expansion", "contraction", "lapsed", "unattributed"), net)
    prod = rows(with_period(totals, products, scope), "products", ("volume", "mix", "price", "new_products", "discontinued_products", "unidentified"), gross)
    ret = totals.select(*scope, F.inline(F.array(*[
        F.struct(F.lit("returns").alias("lens"), F.lit(t).alias("term"), ((F.col(f"{t}_cur") - F.col(f"{t}_prev")) * s).alias("value"), net.alias("lens_total"))
        for t, s in (("gross_sales", 1), ("returns", -1), ("deductions", -1), ("charges", 1))])))
    return lev.unionByName(lev2).unionByName(cust).unionByName(prod).unionByName(ret)


def reconciliation(rows: DataFrame, totals: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per lens the sum of its terms, the total and whether they agree within tolerance."""
    scope = scope or []
    sums = rows.groupBy(*scope, "lens").agg(
        F.sum("value").alias("parts"), F.max("lens_total").alias("total"), F.sum(F.abs("value")).alias("__abs"))
    wide = with_period(sums, totals.select(*scope, (F.col("money_moved_cur") + F.col("money_moved_prev")).alias("__moved")), scope)
    allowed = RECONCILE * F.greatest(F.abs("total"), F.col("__abs")) + RECONCILE_FLOAT * F.col("__moved")
    return wide.select(*scope, "lens", "parts", "total", (F.abs(F.col("parts") - F.col("total")) <= allowed).alias("reconciles"))


# --- mix against rate, stockouts -----------------------------------------------------------------


def mix_rate(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The larger relative move of order value or price per unit, split between category mix and category rate."""
    scope = scope or []
    ours = compared(lines.filter("counted"), period, scope).withColumn("category", F.coalesce("category_key", F.lit("#UNCATEGORISED")))
    per_order = ours.groupBy(*scope, "slot", "category", "order_key").agg(
        F.sum("amount").alias("rev"), F.sum("units").alias("units"), F.bool_or("sale").alias("sale"), F.first("orders_basis").alias("basis"))
    per_order = materialize(per_order, "category-orders")
    spans = per_order.filter(F.col("sale") & (F.col("basis") == "order_id")).groupBy(*scope, "order_key").agg(
        (F.min("category") != F.max("category")).alias("s")).groupBy(*scope).agg(F.bool_or("s").alias("spanning"))
    cells = per_order.groupBy(*scope, "slot", "category").agg(
        F.sum("rev").alias("rev"), F.sum("units").alias("units"), F.count_if("sale").cast("double").alias("orders"))
    at = lambda s, c: zero(F.sum(F.when(F.col("slot") == s, F.col(c))))
    table = cells.groupBy(*scope, "category").agg(*[at(s, c).alias(f"{c}_{s}") for c in ("rev", "units", "orders") for s in ("prev", "cur")])
    stacked = table.select(*scope, "category", "rev_prev", "rev_cur", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{w}_prev").alias("w0"), F.col(f"{w}_cur").alias("w1")) for m, w in MIX_METRICS])))
    group = [*scope, "metric"]
    r0, r1, w0, w1 = F.col("rev_prev"), F.col("rev_cur"), F.col("w0"), F.col("w1")
    facts = stacked.groupBy(*group).agg(
        F.sum("w0").alias("total0"), F.sum("w1").alias("total1"), F.sum("rev_prev").alias("R0"), F.sum("rev_cur").alias("R1"),
        F.sum(F.abs("rev_prev")).alias("A0"), F.sum(F.abs("rev_cur")).alias("A1"),
        F.bool_or(((w0 == 0) & (r0 != 0)) | ((w1 == 0) & (r1 != 0))).alias("weightless"))
    m0, m1 = F.try_divide("R0", "total0"), F.try_divide("R1", "total1")
    ok = (
        (F.col("total0") > 0) & (F.col("total1") > 0) & ~F.col("weightless") & ~is_negligible(F.col("total0"), F.col("A0"), F.col("total0"))
        & ~is_negligible(F.col("total1"), F.col("A1"), F.col("total1")) & (m0 > 0) & (m1 > 0) & ~is_negligible(m1 - m0, m0, m1))
    facts = with_period(facts, spans, scope).filter(ok & ~((F.col("metric") == "aov") & F.coalesce(F.col("spanning"), F.lit(False))))
    best = facts.withColumn("move", F.abs((m1 - m0) / m0)).withColumn(
        "__rank", F.row_number().over(W.partitionBy(*scope).orderBy(F.desc("move"), "metric"))).filter("__rank = 1")
    joined = join_same(stacked, best.select(*group, "total0", "total1"), group)
    s0, s1 = w0 / F.col("total0"), w1 / F.col("total1")
    v0, v1 = zero(F.try_divide(r0, w0)), zero(F.try_divide(r1, w1))
    return joined.groupBy(*group).agg(
        F.sum((s1 - s0) * (v0 + v1) / 2).alias("mix"), F.sum((v1 - v0) * (s0 + s1) / 2).alias("rate"))


def stockouts(lines: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Products sold on most days before that then missed seven trading days in a row.

    Candidates hold at least 2 % of a month's sales, so there are at most fifty per scope: only they
    meet the trading days.
    """
    scope = scope or []
    daily = compared(lines.filter("sale"), period, scope).groupBy(*scope, "slot", "txn_day", "product_key").agg(F.sum("amount").alias("amount"))
    daily = materialize(daily, "product-days")
    trading = daily.select(*scope, "slot", "txn_day").distinct()
    sizes = trading.groupBy(*scope).agg(
        F.count_if(F.col("slot") == "prev").alias("n_prev"), F.count_if(F.col("slot") == "cur").alias("n_cur"))
    before = daily.filter("slot = 'prev'").groupBy(*scope, "product_key").agg(F.count("*").alias("active"), F.sum("amount").alias("revenue"))
    total = before.groupBy(*scope).agg(
        (zero(F.sum(F.when(F.col("product_key").isNotNull() & (F.col("revenue") > 0), F.col("revenue"))))
         + F.greatest(F.lit(0.0), zero(F.sum(F.when(F.col("product_key").isNull(), F.col("revenue")))))).alias("total"))
    rated = with_period(with_period(before.filter("product_key is not null"), sizes, scope), total, scope)
    rate = F.try_divide(F.col("active"), F.col("n_prev"))
    picks = rated.filter((F.col("n_cur") > 0) & (rate >= STOCKOUT_RATE) & (F.col("total") > 0) & (F.col("revenue") >= STOCKOUT_SHARE * F.col("total")))
    picks = picks.select(*scope, "product_key", rate.alias("active_day_rate"), (F.col("revenue") / F.col("n_prev")).alias("revenue_per_day"))
    order = W.partitionBy(*scope).orderBy("txn_day")
    numbered = trading.filter("slot = 'cur'").withColumn("day_no", F.row_number().over(order)).drop("slot")
    sold = join_same(join_same(daily.filter("slot = 'cur'"), numbered, [*scope, "txn_day"]), picks, [*scope, "product_key"])
    # Unsold runs lie between sold days, before the first and after the last.
    wide = with_period(sold.select(*scope, "product_key", "day_no", "active_day_rate", "revenue_per_day"), sizes.select(*scope, "n_cur"), scope)
    by = W.partitionBy(*scope, "product_key").orderBy("day_no")
    gap_before = F.col("day_no") - F.coalesce(F.lag("day_no").over(by), F.lit(0)) - 1
    gap_after = F.coalesce(F.lead("day_no").over(by), F.col("n_cur") + 1) - F.col("day_no") - 1
    runs = wide.withColumn("gap", F.greatest(gap_before, gap_after)).groupBy(*scope, "product_key", "active_day_rate", "revenue_per_day").agg(
        F.max("gap").alias("zero_run_days")).filter(F.col("zero_run_days") >= STOCKOUT_RUN)
    return runs.withColumn("contribution", -F.col("revenue_per_day") * F.col("zero_run_days"))
