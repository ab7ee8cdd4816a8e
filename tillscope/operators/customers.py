"""Customers: RFM segments, new and returning, walk-in placeholder values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.functions import text as T
from tillscope.functions.numbers import is_negligible
from tillscope.operators.orders import first_purchases
from tillscope.operators.periods import with_period
from tillscope.operators.ranking import join_same, quintiles
from tillscope.session import materialize

# --- fixed values -------------------------------------------------------------------------------
PLACEHOLDER_SHARE = 0.1
PLACEHOLDER_RATIO = 4
_JOIN, _JOINED = r"[\s_-]+", r"[\s_-]*"
PLACEHOLDER_WORDS = (
    "guest", f"walk{_JOINED}in", "cash", "anonymous", "unknown", "none", "null", "blank", "default",
    f"one{_JOINED}time", f"retail{_JOIN}customer", "counter", f"no{_JOIN}customer", "misc", f"non{_JOINED}member",
    "unregistered", "laufkunden?", "barverkauf", "diverse?", f"consumidor{_JOIN}final", f"cliente{_JOIN}(?:final|contado)",
    f"p[uú]blico{_JOIN}en{_JOIN}general", f"pelanggan{_JOIN}umum", f"kh[aá]ch{_JOIN}(?:h[aà]ng{_JOIN})?l[eẻ]",
    f"kh[aá]ch{_JOIN}v[aã]ng{_JOIN}lai",
)
# -------------------------------------------------------------------------------------------------


def rfm(lines: DataFrame, period: DataFrame, scope: list[str] | None = None, at: str = "current") -> DataFrame:
    """One row per customer: recency, frequency, monetary, scores and segment.

    ``at="current"`` is anchored the day after the data's last day; ``at="previous"`` reads only the
    lines up to the end of the previous month.
    """
    scope = scope or []
    who = [*scope, "customer"]
    anchor = F.date_add("data_end", 1) if at == "current" else F.col("current")
    dated = with_period(lines.filter(F.col("counted") & F.col("customer").isNotNull()),
                        period.select(*scope, anchor.alias("reference")), scope)
    if at == "previous":
        dated = dated.filter(F.col("txn_ts") < F.col("reference").cast("timestamp_ntz"))
    sold = F.when(F.col("sale"), F.col("txn_ts"))
    orders = dated.groupBy(*who, "reference", "order_key").agg(
        F.sum("amount").alias("amount"), F.bool_or("sale").alias("sale"), F.max(sold).alias("last"), F.min("txn_ts").alias("first"))
    people = orders.groupBy(*who, "reference").agg(
        F.sum("amount").alias("monetary"), F.count_if("sale").alias("frequency"), F.max("last").alias("last_purchase"),
        F.min("first").alias("first"))
    whole_days = lambda c: F.floor(F.timestamp_diff("HOUR", c, F.col("reference").cast("timestamp_ntz")) / 24).cast("int")
    people = materialize(people, "rfm-customers")
    start = people.groupBy(*scope).agg(F.min("first").alias("file_start"))
    table = with_period(people, start, scope).withColumn(
        "recency_days", F.coalesce(whole_days(F.col("last_purchase")), whole_days(F.col("file_start")) + 1))
    buyers = table.filter(F.col("frequency") > 0)
    score = lambda c, up, name: quintiles(
        buyers.groupBy(*scope, F.col(c).cast("double").alias(c)).agg(F.count("*").alias("n")), scope, c, "n", up
    ).select(*scope, F.col(c).cast("bigint").alias(c), F.col("score").alias(name))
    table = table.withColumn("recency_days", F.col("recency_days").cast("bigint"))
    scored = join_same(table, score("recency_days", False, "r0"), [*scope, "recency_days"], "left")
    scored = join_same(scored, score("frequency", True, "f0"), [*scope, "frequency"], "left")
    never = F.col("frequency") == 0
    r = F.when(never, 1).otherwise(F.col("r0"))
    f = F.when(F.col("frequency") <= 1, 1).otherwise(F.col("f0"))
    return scored.withColumns({"r_score": r, "f_score": f}).withColumn(
        "segment", F.when(F.col("frequency") == 0, "No purchases in file").otherwise(segment(F.col("r_score"), F.col("f_score")))
    ).select(*who, "last_purchase", "recency_days", "frequency", "monetary", "r_score", "f_score", "segment")


def segment(r: Column, f: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4), "Champions").when((r >= 3) & (f >= 3), "Loyal").when((r <= 2) & (f >= 3), "At-risk")
        .when((r <= 2) & (f <= 2), "Hibernating").when((r >= 4) & (f <= 1), "New").otherwise("Needs Attention")
    )


def segment_summary(now: DataFrame, before: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per segment: customers, share of all money, average money, and customers one snapshot earlier."""
    scope = scope or []
    summed = now.groupBy(*scope, "segment").agg(
        F.count("*").alias("customers"), F.sum("monetary").alias("__money"), F.sum(F.abs("monetary")).alias("__moved"))
    total = summed.groupBy(*scope).agg(F.sum("__money").alias("__total"), F.sum("__moved").alias("__all"))
    past = before.groupBy(*scope, "segment").agg(F.count("*").alias("__past"))
    wide = with_period(join_same(with_period(summed, total, scope), past, [*scope, "segment"], "left"),
                       period.select(*scope, "previous_complete"), scope)
    nothing = is_negligible(F.col("__total"), F.col("__all"))
    return wide.select(
        *scope, "segment", "customers",
        F.when(~nothing, F.try_divide(F.col("__money"), F.abs("__total")) * 100).alias("revenue_share_pct"),
        (F.col("__money") / F.col("customers")).alias("avg_monetary"),
        F.when(F.col("previous_complete"), F.coalesce("__past", F.lit(0))).alias("customers_previous"))


def new_vs_returning(lines: DataFrame, period: DataFrame, scope: list[str] | None = None, first: DataFrame | None = None) -> DataFrame:
    """The current month's customers: first purchase in it, or earlier (a refund proves an earlier one)."""
    scope = scope or []
    who = [*scope, "customer"]
    first = first_purchases(lines, scope) if first is None else first
    month = with_period(lines.filter(F.col("counted") & F.col("customer").isNotNull()), period.select(*scope, "current"), scope)
    here = month.filter(F.col("month") == F.col("current")).groupBy(*who, "current").agg(F.sum("amount").alias("amount"))
    joined = join_same(here, first, who, "left")
    new = F.coalesce(F.col("first_month") == F.col("current"), F.lit(False))
    return joined.groupBy(*scope).agg(
        F.count_if(new).alias("new_customers"), F.count_if(~new).alias("returning_customers"),
        F.coalesce(F.sum(F.when(new, F.col("amount"))), F.lit(0.0)).alias("new_revenue"),
        F.coalesce(F.sum(F.when(~new, F.col("amount"))), F.lit(0.0)).alias("returning_revenue"))


# --- walk-in placeholders ------------------------------------------------------------------------


# "Not available", blanks left out.
NOT_AVAILABLE = tuple(mark + text + dot for text in ("na", "n.a", "n/a") for mark in ("", "#") for dot in ("", "."))


def is_placeholder_word(identity: Column) -> Column:
    words = "|".join(PLACEHOLDER_WORDS)
    number = F.trim(identity).try_cast("double")
    return (
        ~identity.rlike(r"[\p{L}\p{N}]") | F.coalesce(number <= 0, F.lit(False)) | (identity == "customer")
        | F.translate(identity, " \t", "").isin(*NOT_AVAILABLE) | identity.rlike(rf"(?U)(?<!\p{{L}})(?:{words})s?(?!\p{{L}})") | identity.rlike("散客")
    )


def _dominant(totals: DataFrame, scope: list[str], value: str) -> DataFrame:
    """Values peeled off the top while each is at least four times the next positive one.

    Values are counted by their power of two. Two values of one power are less than four times apart, so a value that
    qualifies is alone in its power, and what it is held against is the largest value of the next power that has any: the
    table of powers, some two thousand rows per scope at most, decides, whatever the number of customers.
    """
    power = F.floor(F.log2(F.col(value))).cast("int").alias("__power")
    powers = totals.filter(F.col(value) > 0).groupBy(*scope, power).agg(
        F.count("*").alias("__n"), F.max(value).alias("__top"), F.max_by("customer", value).alias("customer"))
    order = W.partitionBy(*scope).orderBy(F.desc("__power"))
    good = (F.col("__n") == 1) & F.coalesce(F.col("__top") >= PLACEHOLDER_RATIO * F.lead("__top").over(order), F.lit(False))
    broken = F.count_if(~F.col("__good")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return powers.withColumn("__good", good).withColumn("__broken", broken).filter("__broken = 0").select(*scope, "customer")


def placeholder_candidates(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Customer values that may stand for walk-ins: by word, by share of lines or revenue, or far above the next.

    ``lines`` holds the sales lines with ``customer_written``; no date is read.
    """
    scope = scope or []
    measurable = ~F.col("stock_in") & F.col("quantity").isNotNull() & F.col("unit_price").isNotNull()
    counted = lines.filter(measurable)
    sold = F.when((F.col("quantity") > 0) & (F.col("amount") > 0), F.col("amount")).otherwise(0.0)
    by_value = counted.groupBy(*scope, F.col("customer_written").alias("customer")).agg(
        F.count("*").alias("lines"), F.sum(sold).alias("revenue"))
    totals = by_value.groupBy(*scope).agg(F.sum("lines").alias("__lines"), F.sum("revenue").alias("__revenue"))
    named = with_period(by_value.filter(F.col("customer").isNotNull()), totals, scope)
    lines_pct = F.col("lines") * 100.0 / F.col("__lines")
    revenue_pct = F.when(F.col("__revenue") > 0, F.least(F.lit(100.0), F.col("revenue") * 100.0 / F.col("__revenue")))
    measured = named.withColumns({
        "lines_pct": lines_pct, "revenue_pct": revenue_pct, "by_word": is_placeholder_word(F.col("customer")),
    }).withColumn("by_share", (F.col("lines_pct") >= 100 * PLACEHOLDER_SHARE) | F.coalesce(F.col("revenue_pct") >= 100 * PLACEHOLDER_SHARE, F.lit(False)))
    rest = measured.filter(~F.col("by_word") & ~F.col("by_share"))
    far_lines = _dominant(rest, scope, "lines")
    left = join_same(rest, far_lines, [*scope, "customer"], "left_anti").filter(F.col("__revenue") > 0)
    far = far_lines.unionByName(_dominant(left, scope, "revenue")).withColumn("__far", F.lit(True))
    joined = join_same(measured, far, [*scope, "customer"], "left")
    return joined.filter(F.col("by_word") | F.col("by_share") | F.col("__far")).select(
        *scope, "customer", "lines", "lines_pct", "revenue_pct", F.when(F.col("by_word"), "word").otherwise("share").alias("why"))


def unanswered_placeholders(candidates: DataFrame, confirmed: list[str], rejected: list[str], scope: list[str] | None = None) -> DataFrame:
    """Candidates the user neither confirmed nor called a real customer."""
    answered = candidates.sparkSession.createDataFrame([(v,) for v in [*confirmed, *rejected]], "value string").select(
        T.nfc(T.customer_identity(F.col("value"))).alias("customer")).distinct()
    return candidates.join(answered, "customer", "left_anti")
