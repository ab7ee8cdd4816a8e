"""The registered hypotheses as rows: evidence, verdicts, the headline and the actions it leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.functions.numbers import is_negligible
from tillscope.operators.periods import with_period
from tillscope.operators.ranking import join_same

# --- fixed values -------------------------------------------------------------------------------
SUPPORTED, PARTIAL, CONTEXT_SHARE = 0.20, 0.05, 0.50
MAX_ACTIONS = 3
# id, family, lens, kind, the decomposition it is a term of, the dashboard subject
CATALOGUE = (
    ("D1", "data_quality", "data", "expectation", None, None),
    ("D2", "data_quality", "data", "directional", None, None),
    ("D3", "data_quality", "data", "directional", None, None),
    ("T1", "time", "time", "expectation", None, "Calendar"),
    ("T2", "time", "time", "expectation", None, "Last year"),
    ("T3", "time", "time", "directional", None, None),
    ("C1", "customers", "customers", "expectation", None, "Customers"),
    ("C2", "customers", "customers", "expectation", None, "Customers"),
    ("C3", "customers", "customers", "expectation", None, "Customers"),
    ("C4", "customers", "customers", "directional", None, None),
    ("B1", "lever", "lever", "term", "level1", "Order frequency"),
    ("B2", "lever", "lever", "term", "level2", "Basket size"),
    ("P1", "product_returns", "product", "term", "product", "Prices"),
    ("P2", "product_returns", "product", "term", "product", "Product mix"),
    ("P3", "product_returns", "returns", "term", "returns", "Refunds"),
    ("P4", "product_returns", "returns", "term", "returns", "Discounts"),
    ("P5", "product_returns", "returns", "term", "returns", "Charges"),
    ("R1", "localization_lifecycle", "localization", "directional", None, "One product"),
    ("R2", "localization_lifecycle", "product", "term", "product", "Products in or out"),
    ("R3", "localization_lifecycle", "product", "expectation", None, "Stock"),
)
UNTESTABLE = (
    ("X1", "Marketing and promotions", "no_campaign_data"), ("X2", "Competitor actions", "no_competitor_data"),
    ("X3", "Weather and macro events", "no_external_data"), ("X4", "Traffic and conversion", "no_footfall_data"),
    ("X5", "Margin", "no_cost_column"), ("X6", "Country or region", "no_country_field"),
    ("X7", "Sales channel or payment method", "no_channel_field"),
)
NEVER_ACTED_ON = ("D1", "D2", "D3", "T1", "T2", "T3", "C4", "R2", "B1", "B2", "P4")
ACTION_DIRECTIONS = (
    ("P1", "up"), ("P1", "down"), ("P2", "up"), ("P2", "down"), ("C1", "up"), ("C1", "down"), ("C2", "up"), ("C2", "down"),
    ("C3", "up"), ("C3", "down"), ("P3", "up"), ("P3", "down"), ("P5", "up"), ("P5", "down"), ("R1", "up"), ("R1", "down"), ("R3", "down"),
)
STRENGTH = ("matches", "other way", "moved", "checked", "can't tell")
# -------------------------------------------------------------------------------------------------


def catalogue(spark: SparkSession) -> DataFrame:
    """The twenty testable hypotheses in their fixed order: always small enough to broadcast."""
    rows = [(i, *row) for i, row in enumerate(CATALOGUE)]
    return spark.createDataFrame(rows, "position int, id string, family string, lens string, kind string, decomposition string, subject string")


def untestable(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(UNTESTABLE), "id string, statement string, reason string")


def _outcome(hypothesis: str, verdict: Column | None = None, contribution: Column | None = None, reason: Column | None = None) -> Column:
    """One hypothesis's finding: a fixed verdict, or a contribution to be scored."""
    none = lambda t: F.lit(None).cast(t)
    text = lambda c: none("string") if c is None else c.cast("string")
    amount = none("double") if contribution is None else contribution.cast("double")
    fixed = text(verdict)
    return F.struct(F.lit(hypothesis).alias("id"), fixed.alias("fixed"),
                    F.when(fixed.isNull(), amount).alias("contribution"), text(reason).alias("evidence"))


def evidence(facts: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Rows ``(id, fixed, contribution, evidence)`` from the one row of facts per scope.

    The facts are the results of the trust checks, lenses and comparisons joined by scope; see
    ``plans.analysis.diagnosis_facts`` for their names.
    """
    scope = scope or []
    c = F.col
    inconclusive, not_testable, ruled_out = F.lit("inconclusive"), F.lit("not_testable"), F.lit("ruled_out")
    by_check = lambda s: F.when(c(s) == "caution", "supported").when(c(s) == "inconclusive", "inconclusive").otherwise("ruled_out")
    grain = c("month_grain")
    # D1
    d1_fixed = (
        F.when(grain, not_testable).when(c("learned_months").isNull(), inconclusive)
        .when(~(c("beyond_pattern_cur") | c("beyond_pattern_prev")), ruled_out))
    # T2
    t2_fixed = (
        F.when(c("ly_cur").isNull() | c("ly_prev").isNull(), inconclusive)
        .when(~F.coalesce((c("ly_prev") > 0) & (c("ly_prev") >= 0.03 * c("typical")) & ~is_negligible(c("ly_prev"), c("history_scale")), F.lit(False)), inconclusive)
        .when((c("revenue_prev") <= 0) | (c("ly_cur") <= 0), inconclusive)
        .when(~grain & (F.coalesce(c("ly_excess_cur"), F.lit(1.0)) + F.coalesce(c("ly_excess_prev"), F.lit(1.0)) != 0), inconclusive))
    t2 = c("revenue_prev") * (F.try_divide(c("ly_cur"), c("ly_prev")) - 1)
    # customers
    def bridge(term: str, censored: bool, blank: str) -> tuple[Column, Column]:
        fixed = F.when(~c("has_customers"), not_testable).when(c(blank), not_testable).when(c(f"{term}_before").isNull(), inconclusive)
        if censored:
            fixed = fixed.when(c("left_censored"), inconclusive)
        return fixed, c(f"{term}_now") - c(f"{term}_before")

    c1, c2, c3 = bridge("new", True, "blank_history"), bridge("lapsed", False, "blank_transition"), bridge("resurrected", True, "blank_history")
    c4 = F.when(~c("has_customers") | c("blank_compared"), not_testable).otherwise(inconclusive)
    # levers
    gaps = ~grain & (c("excess_cur").isNull() | c("excess_prev").isNull() | (F.greatest("excess_cur", "excess_prev") > 0))
    b1_fixed = (
        F.when(~c("has_customers") | c("blank_compared"), not_testable).when(gaps, inconclusive)
        .when((c("revenue_prev") <= 0) | (c("revenue_cur") <= 0), inconclusive)
        .when(~c("formula").eqNullSafe(F.lit("customers*frequency*aov")), inconclusive))
    b2_fixed = F.when(c("refund_lines_prev") + c("refund_lines_cur") > 0, inconclusive).when(c("units_per_order_effect").isNull(), inconclusive)
    none_live = F.when(c("common_products") == 0, inconclusive)
    r1 = F.when(
        (c("classification") == "concentrated") & (F.coalesce(c("top_member_delta"), F.lit(0.0)) != 0)
        & ~is_negligible(c("net"), c("revenue_prev"), c("revenue_cur"), c("moved"))
        & ((c("top_member_delta") > 0) == (c("net") > 0)), "supported").otherwise("ruled_out")
    rows = F.array(
        _outcome("D1", d1_fixed, c("revenue_gap_prev") - c("revenue_gap_cur"), c("d1_status")),
        _outcome("D2", by_check("d2_status"), None, c("d2_status")), _outcome("D3", by_check("d3_status"), None, c("d3_status")),
        _outcome("T1", F.when(c("calendar_method") == "not_applicable", not_testable), c("calendar_effect"), c("calendar_method")),
        _outcome("T2", t2_fixed, t2), _outcome("T3", inconclusive),
        _outcome("C1", *c1), _outcome("C2", *c2), _outcome("C3", *c3), _outcome("C4", c4),
        _outcome("B1", b1_fixed, c("frequency_effect")), _outcome("B2", b2_fixed, c("units_per_order_effect")),
        _outcome("P1", none_live, c("price")), _outcome("P2", none_live, c("mix")),
        _outcome("P3", None, c("returns_prev") - c("returns_cur")), _outcome("P4", None, c("deductions_prev") - c("deductions_cur")),
        _outcome("P5", F.when(~c("has_charges"), not_testable), c("charges_cur") - c("charges_prev")),
        _outcome("R1", r1, None, c("top_member")),
        _outcome("R2", None, c("new_products") + c("discontinued_products")),
        _outcome("R3", F.when(grain, not_testable), c("stockout_contribution")),
    )
    return facts.select(*scope, F.inline(rows))


def share_verdict(kind: Column, share: Column, same_sign: Column) -> Column:
    """Supported from a fifth of the change (an expectation up to nine fifths), partial from a twentieth."""
    size = F.abs(share)
    explains = (size >= SUPPORTED) & ((kind != "expectation") | (size <= 2 - SUPPORTED))
    return F.when(same_sign & explains, "supported").when(same_sign & (size >= PARTIAL) & (size < SUPPORTED), "partial").otherwise("ruled_out")


def evaluate(found: DataFrame, facts: DataFrame, specs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The whole catalogue scored: contributions as shares of the change they claim to explain.

    The product lens explains gross sales, the others net revenue; under a masked shift a term is a
    share of its own decomposition's gross movement. A blocked run evaluates the data checks only.
    """
    scope = scope or []
    change = facts.select(
        *scope, "trust_verdict", "net", "gross", "revenue_prev", "revenue_cur", "moved", F.coalesce("masked_shift_alert", F.lit(False)).alias("alert"),
        F.struct(F.col("level1_gross").alias("level1"),
                 (F.abs("units_per_order_effect") + F.abs("price_per_unit_effect")).alias("level2"),
                 (F.abs("volume") + F.abs("mix") + F.abs("price") + F.abs("new_products") + F.abs("discontinued_products") + F.abs("unidentified")).alias("product"),
                 (F.abs(F.col("gross")) + F.abs(F.col("returns_cur") - F.col("returns_prev")) + F.abs(F.col("deductions_cur") - F.col("deductions_prev"))
                  + F.abs(F.col("charges_cur") - F.col("charges_prev"))).alias("returns")).alias("parts"))
    wide = with_period(found.join(F.broadcast(specs), "id"), change, scope)
    total = F.when(F.col("lens") == "product", F.col("gross")).otherwise(F.col("net"))
    total = F.when(~is_negligible(total, F.col("revenue_prev"), F.col("revenue_cur"), F.col("moved")), total)
    part = (
        F.when(F.col("decomposition") == "level1", F.col("parts.level1")).when(F.col("decomposition") == "level2", F.col("parts.level2"))
        .when(F.col("decomposition") == "product", F.col("parts.product")).when(F.col("decomposition") == "returns", F.col("parts.returns")))
    divisor = F.when(F.col("alert") & (F.col("kind") == "term"), part).otherwise(F.abs(total))
    amount = F.col("contribution")
    share = F.when(total.isNotNull(), F.try_divide(amount, divisor))
    same = (amount != 0) & ((amount > 0) == (total > 0))
    blocked = (F.col("trust_verdict") == "blocked") & (F.col("family") != "data_quality")
    scored = F.col("fixed").isNull() & ~blocked
    verdict = (
        F.when(blocked, "inconclusive").when(F.col("fixed").isNotNull(), F.col("fixed"))
        .when(share.isNull(), "ruled_out").otherwise(share_verdict(F.col("kind"), share, F.coalesce(same, F.lit(False)))))
    against = scored & share.isNotNull() & (amount != 0) & ~F.coalesce(same, F.lit(False))
    return wide.select(
        *scope, "position", "id", "family", "lens", "kind", verdict.alias("verdict"), F.when(scored, amount).alias("contribution"),
        F.when(scored, share).alias("share"), F.coalesce(against, F.lit(False)).alias("against_the_change"), "evidence")


def headline_candidates(hypotheses: DataFrame, facts: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Each hypothesis with whether the headline may name it and how far it lands from the change."""
    scope = scope or []
    holds = (F.col("classification") != "outside_products") & F.col("products_share_of_change").isNotNull()
    wide = with_period(hypotheses, facts.select(*scope, "net", "revenue_prev", "revenue_cur", "moved", F.coalesce(holds, F.lit(False)).alias("__holds")), scope)
    residue = lambda x: is_negligible(x, F.col("revenue_prev"), F.col("revenue_cur"), F.col("moved"))
    amount, net = F.col("contribution"), F.col("net")
    with_change = F.when(amount.isNull(), True).when(residue(net), False).otherwise((amount > 0) == (net > 0))
    in_lens = (F.col("lens") != "product") | F.col("__holds")
    eligible = (F.col("verdict") == "supported") & ~F.col("id").isin("D2", "D3") & with_change & in_lens
    context = F.col("id").isin("T1", "T2") & (F.col("verdict") == "supported") & (F.abs("share") >= CONTEXT_SHARE)
    distance = F.abs(net - amount)
    room = F.abs(net) - distance
    fits = (amount.isNotNull()) & (eligible | context) & (room > 0) & ~residue(room)
    measured = ((F.col("kind") == "term") | (F.col("verdict") == "supported")) & amount.isNotNull() & ~residue(amount)
    no = lambda x: F.coalesce(x, F.lit(False))
    marked = wide.withColumns({"eligible": no(eligible), "context": no(context), "fits": no(fits), "measured": no(measured), "distance": distance})
    best = marked.groupBy(*scope).agg(F.min(F.when(F.col("fits"), F.col("distance"))).alias("__best"))
    top = marked.filter("measured").groupBy(*scope, (F.col("contribution") > 0).alias("__up")).agg(F.max(F.abs("contribution")).alias("__top"))
    tops = top.groupBy(*scope).agg(F.max(F.when(F.col("__up"), F.col("__top"))).alias("__top_up"), F.max(F.when(~F.col("__up"), F.col("__top"))).alias("__top_down"))
    joined = with_period(with_period(marked, best, scope), tops, scope)
    closest = F.col("fits") & residue(F.col("distance") - F.col("__best"))
    largest = F.col("measured") & residue(F.abs("contribution") - F.when(amount > 0, F.col("__top_up")).otherwise(F.col("__top_down")))
    return joined.withColumns({"closest": no(closest), "largest_of_its_way": no(largest)}).drop("__holds", "__best", "__top_up", "__top_down", "net", "revenue_prev", "revenue_cur", "moved")


def headline(candidates: DataFrame, facts: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One row per scope: the rule that decides (1–7), the causes named, the note and the hedge.

    1 blocked, 2 days without sales, 3 routine, 4 masked shift, 5 context, 6 best-fitting cause,
    7 none. The size test and the season can turn 5 and 6 into 7.
    """
    scope = scope or []
    names = lambda cond: F.transform(
        F.sort_array(F.collect_list(F.when(cond, F.struct("position", "id")))), lambda x: x.id)
    summed = candidates.groupBy(*scope).agg(
        names(F.col("closest")).alias("closest"), F.bool_and(F.when(F.col("closest"), F.col("context"))).alias("all_context"),
        names(F.col("eligible") & F.col("contribution").isNull()).alias("directional"),
        F.bool_or(F.col("eligible") & F.col("contribution").isNotNull()).alias("any_share"),
        names(F.col("largest_of_its_way")).alias("opposing"),
        F.max(F.when((F.col("id") == "D1") & (F.col("verdict") == "supported"), F.abs("share"))).alias("d1_share"),
        F.bool_or((F.col("id") == "T3") & (F.col("verdict") == "supported")).alias("routine"),
        names(F.col("verdict") == "partial").alias("partly"))
    wide = with_period(summed, facts.select(*scope, "trust_verdict", "masked_shift_alert", "singled_out", "movement_change_pct", "season_claimed", "season_band"), scope)
    alert = F.coalesce("masked_shift_alert", F.lit(False))
    empty = F.array().cast("array<string>")
    base_rule = (
        F.when(F.col("trust_verdict") == "blocked", 1).when(F.coalesce(F.col("d1_share") >= CONTEXT_SHARE, F.lit(False)), 2)
        .when(F.col("routine") & ~alert, 3).when(alert, 4)
        .when((F.size("closest") > 0) & F.col("all_context"), 5).when(F.size("closest") > 0, 6)
        .when(F.size("directional") > 0, 6).when(F.col("any_share"), 6).otherwise(7))
    base = wide.withColumn("base_rule", base_rule).withColumn("offsetting", (F.col("base_rule") == 6) & (F.size("closest") == 0) & (F.size("directional") == 0))
    base = base.withColumn("base_named", F.when(F.col("base_rule").isin(5, 6), F.when(F.size("closest") > 0, F.col("closest")).when(F.size("directional") > 0, F.col("directional")).otherwise(F.col("opposing"))).otherwise(empty))
    ranked = F.col("base_rule").isin(5, 6)
    too_small = ranked & F.col("singled_out").eqNullSafe(F.lit(False))
    too_short = ranked & F.col("singled_out").isNull() & F.col("movement_change_pct").isNotNull()
    sized = F.when(too_small | too_short, 7).otherwise(F.col("base_rule"))
    band = F.when(F.col("season_claimed"), F.col("season_band"))
    far = band.isin("shortfall", "excess")
    t2_named = F.array_contains("base_named", "T2") & ~F.col("offsetting")
    rule = (
        F.when(F.col("base_rule") <= 4, F.col("base_rule")).when(band == "consistent", 7)
        .when(far & ((sized == 7) | t2_named), 7).otherwise(sized))
    note = (
        F.when(rule == 2, "gaps").when((rule != 7) | (F.col("base_rule") <= 4), None).when(band == "consistent", "season").when(far, "beyond_season")
        .when(F.col("singled_out").eqNullSafe(F.lit(False)), "within_usual_movement")
        .when(F.col("singled_out").isNull() & F.col("movement_change_pct").isNotNull(), "history_too_short"))
    hedge = F.when(rule == 4, F.when(band.isin("consistent", "inconclusive"), "seasonal").otherwise("plain"))
    return base.select(
        *scope, rule.alias("rule"), F.when(rule.isin(5, 6), F.col("base_named")).otherwise(empty).alias("named"),
        (F.col("offsetting") & (rule == 6)).alias("offsetting"), "base_rule", note.alias("note"), hedge.alias("hedge"), "partly")


def checklist(hypotheses: DataFrame, head: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Each hypothesis in its group: matches (or moved), against, not the reason, cannot show."""
    scope = scope or []
    wide = with_period(hypotheses.filter(~F.col("id").isin("T3", "C4")), head.select(*scope, "rule"), scope)
    shown = F.col("against_the_change") & (F.round(F.abs("contribution"), 2) > 0)
    group = (
        F.when(shown & (F.abs("share") >= PARTIAL), "against")
        .when(F.col("verdict").isin("supported", "partial") & ~F.col("against_the_change"), F.when(F.col("rule").isin(2, 5, 6), "matches").otherwise("moved"))
        .when(F.col("verdict") == "ruled_out", "not_reason").when(~F.col("id").isin("D1", "D2", "D3"), "cannot_show"))
    return wide.withColumn("checklist_group", group).filter("checklist_group is not null").select(*scope, "position", "id", "verdict", "contribution", "checklist_group")


def subjects(groups: DataFrame, specs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One status per dashboard subject: the strongest of its hypotheses' groups."""
    scope = scope or []
    status = (
        F.when(F.col("checklist_group") == "matches", "matches").when(F.col("checklist_group") == "moved", "moved")
        .when(F.col("checklist_group") == "against", "other way").when(F.col("checklist_group") == "not_reason", "checked").otherwise("can't tell"))
    strength = F.array_position(F.array(*[F.lit(s) for s in STRENGTH]), status)
    named = groups.join(F.broadcast(specs.select("id", "subject")), "id").filter("subject is not null")
    return named.groupBy(*scope, "subject").agg(F.min_by(status, strength).alias("status"))


def actions(hypotheses: DataFrame, head: DataFrame, facts: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """At most three claims worth acting on: the headline's causes first, then the largest amounts.

    Each with its own direction and the figure to watch, now and before.
    """
    scope = scope or []
    spark = hypotheses.sparkSession
    known = spark.createDataFrame(list(ACTION_DIRECTIONS), "id string, direction string")
    figures = facts.select(
        *scope, "trust_verdict", "previous_complete", "net",
        F.map_from_arrays(F.array(*[F.lit(x) for x in ("C1", "C2", "C3", "P3", "P5", "P1", "P2")]), F.array(*[
            F.struct(now.cast("double").alias("now"), was.cast("double").alias("was")) for now, was in (
                (F.col("new_now"), F.col("new_before")),
                (F.when((F.col("lapsed_now") <= 0) & (F.col("lapsed_before") <= 0), F.abs("lapsed_now")),
                 F.when((F.col("lapsed_now") <= 0) & (F.col("lapsed_before") <= 0), F.abs("lapsed_before"))),
                (F.col("resurrected_now"), F.col("resurrected_before")), (F.abs("returns_cur"), F.abs("returns_prev")),
                (F.col("charges_cur"), F.col("charges_prev")), (F.col("price_per_unit_cur"), F.col("price_per_unit_prev")),
                (F.col("price_per_unit_cur"), F.col("price_per_unit_prev")))])).alias("watch"))
    wide = with_period(with_period(hypotheses, head.select(*scope, "rule", "named"), scope), figures, scope)
    moves = F.when(F.col("against_the_change"), F.abs("share") >= SUPPORTED).otherwise(F.col("verdict").isin("supported", "partial"))
    open_run = F.col("rule").isin(5, 6) & (F.col("trust_verdict") != "blocked") & F.col("previous_complete")
    pair = F.col("watch")[F.col("id")]
    by_sign = lambda x: F.when(x > 0, "up").when(x < 0, "down")
    cents = lambda x: F.round(x, 2)
    direction = (
        F.when(F.col("id").isin("C1", "C2", "C3", "P3", "P5"), F.when(cents(pair.now) != cents(pair.was), F.when(pair.now > pair.was, "up").otherwise("down")))
        .when(F.col("id") == "R3", "down").when(F.col("id") == "R1", by_sign(F.col("net"))).otherwise(by_sign(F.col("contribution"))))
    eligible = wide.filter(open_run & moves & ~F.col("id").isin(*NEVER_ACTED_ON)).withColumns({"direction": direction, "__pair": pair})
    listed = eligible.join(F.broadcast(known), ["id", "direction"])
    place = F.array_position("named", F.col("id"))
    order = W.partitionBy(*scope).orderBy(F.when(place == 0, F.size("named") + 1).otherwise(place), F.desc(F.coalesce(F.abs("contribution"), F.lit(0.0))), "position")
    return listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MAX_ACTIONS).select(
        *scope, "rank", "id", "direction", "contribution", F.col("__pair.now").alias("watch_now"), F.col("__pair.was").alias("watch_was"))
