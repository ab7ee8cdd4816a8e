"""Season reading and the three-month forecast with its own back-tested band."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.operators.periods import with_period
from tillscope.operators.ranking import join_same

# --- fixed values -------------------------------------------------------------------------------
HORIZON, CONFIDENCE, MIN_HISTORY, RECENT = 3, 0.8, 3, 12
MIN_SEASON_YEARS, NOTED_YEARS = 2, 2
MIN_GAP, MIN_AGREEMENT, MAX_RAMP, TIE = 0.4, 0.6, 0.9, 1e-9
# -------------------------------------------------------------------------------------------------


def _t_cdf(t: float, df: int) -> float:
    """Student's t distribution for whole degrees of freedom, as its finite trigonometric sum."""
    theta = math.atan2(t, math.sqrt(df))
    cos2 = math.cos(theta) ** 2
    total, term = (0.0, 1.0)
    if df % 2:
        if df > 1:
            term = math.cos(theta)
            total = term
            for k in range(3, df - 1, 2):
                term *= cos2 * (k - 1) / k
                total += term
        area = 2 / math.pi * (theta + math.sin(theta) * total)
    else:
        total = term
        for k in range(2, df - 1, 2):
            term *= cos2 * (k - 1) / k
            total += term
        area = math.sin(theta) * total
    return 0.5 + area / 2


def t_quantile(df: int, p: float = 0.5 + CONFIDENCE / 2) -> float:
    low, high = 0.0, 64.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


TABLED = 400


def t_table(spark: SparkSession, largest: int = TABLED) -> DataFrame:
    """``(df, t)``: one row per degree of freedom, a fixed few hundred rows; :func:`t_series` has the larger ones."""
    return spark.createDataFrame([(df, t_quantile(df)) for df in range(1, largest + 1)], "df int, t double")


def t_series(df: Column, p: float = 0.5 + CONFIDENCE / 2) -> Column:
    """The quantile by its expansion in 1 / df, exact to double precision for more than a few hundred degrees of freedom."""
    z = NormalDist().inv_cdf(p)
    terms = (
        z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    out = F.lit(terms[-1])
    for term in reversed(terms[:-1]):
        out = F.lit(term) + out / df
    return out


def detrended(window: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The counted years' months with their ratio to the trend and the year they belong to.

    The trend's slope is the median change of the logarithms over twelve months; scopes with under
    two years, or with a month not above zero, have no rows.
    """
    scope = scope or []
    counted = F.floor(F.col("n") / 12) * 12
    kept = window.filter(F.col("n") >= 12 * MIN_SEASON_YEARS).withColumn("i", F.col("position") - (F.col("n") - counted)).filter("i >= 0")
    every = W.partitionBy(*scope)
    positive = kept.withColumn("__ok", F.min("revenue").over(every) > 0).filter("__ok").withColumn("y", F.ln("revenue"))
    order = W.partitionBy(*scope).orderBy("i")
    stepped = positive.withColumn("__d", F.col("y") - F.lag("y", 12).over(order))
    slope = stepped.groupBy(*scope).agg((F.median("__d") / 12).alias("slope"))
    sloped = with_period(positive, slope, scope)
    level = sloped.groupBy(*scope).agg(F.avg(F.col("y") - F.col("slope") * F.col("i")).alias("level"))
    return with_period(sloped, level, scope).select(
        *scope, "month", "revenue", "n", "position", "i", F.month("month").alias("moy"), F.floor(F.col("i") / 12).cast("int").alias("year"),
        F.exp(F.col("y") - F.col("level") - F.col("slope") * F.col("i")).alias("ratio"))


def season_indices(ratios: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``(set, moy, index)``: monthly indices scaled to mean 1, of all years (set −1) and without each year."""
    scope = scope or []
    per_month = W.partitionBy(*scope, "moy")
    left = ratios.withColumns({"__sum": F.sum("ratio").over(per_month), "__n": F.count("*").over(per_month)})
    whole = left.groupBy(*scope, "moy").agg((F.max("__sum") / F.max("__n")).alias("raw")).withColumn("set", F.lit(-1))
    out = left.filter("__n > 1").select(*scope, "moy", ((F.col("__sum") - F.col("ratio")) / (F.col("__n") - 1)).alias("raw"), F.col("year").alias("set"))
    both = whole.select(*scope, "set", "moy", "raw").unionByName(out.select(*scope, "set", "moy", "raw"))
    scale = W.partitionBy(*scope, "set")
    return both.select(*scope, "set", "moy", (F.col("raw") / (F.sum("raw").over(scale) / 12)).alias("index"))


def season_claim(ratios: DataFrame, indices: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per scope with two full years: the three tests of a season and which one refuses it, if any."""
    scope = scope or []
    per_month = W.partitionBy(*scope, "moy")
    rest = ratios.withColumn("rest", (F.sum("ratio").over(per_month) - F.col("ratio")) / (F.count("*").over(per_month) - 1))
    years = rest.groupBy(*scope, "year").agg(
        F.corr("ratio", "rest").alias("c"), F.stddev_pop("ratio").alias("s0"), F.stddev_pop("rest").alias("s1"))
    still = (F.col("s0") == 0) | (F.col("s1") == 0)
    agreement = years.groupBy(*scope).agg(
        F.count("*").alias("years"), F.when(F.bool_or(still), 0.0).otherwise(F.avg("c")).alias("agreement"))
    own = indices.filter("set = -1")
    last = ratios.filter(F.col("position") >= F.col("n") - 12).select(*scope, "moy", (F.col("position") - F.col("n") + 12).alias("x"))
    line = join_same(own, last, [*scope, "moy"]).groupBy(*scope).agg(
        F.max("index").alias("strongest"), F.min("index").alias("weakest"),
        F.corr(F.col("x").cast("double"), F.ln("index")).alias("r"), F.stddev_pop(F.ln("index")).alias("s"))
    usable = indices.groupBy(*scope).agg(F.bool_and((F.col("index") > 0) & (F.col("index") < float("inf"))).alias("usable"))
    wide = with_period(with_period(agreement, line, scope), usable, scope)
    gap = (F.col("strongest") - F.col("weakest")) / F.col("strongest")
    ramp = F.when(F.col("s") == 0, 0.0).otherwise(F.col("r") * F.col("r"))
    refusal = (
        F.when(~F.col("usable"), "unusable").when(~F.coalesce(gap > MIN_GAP + TIE, F.lit(False)), "gap")
        .when(~F.coalesce(F.col("agreement") >= MIN_AGREEMENT, F.lit(False)), "agreement")
        .when(~F.coalesce(ramp < MAX_RAMP, F.lit(False)), "ramp"))
    note = F.when(refusal == "ramp", "ramp_not_read_as_season").when(refusal.isNull() & (F.col("years") == NOTED_YEARS), "two_years_only")
    return wide.select(*scope, "years", gap.alias("strength_gap"), "agreement", ramp.alias("ramp"), refusal.alias("refusal"),
                       refusal.isNull().alias("claimed"), note.alias("note"))


def _index_maps(indices: DataFrame, claim: DataFrame, scope: list[str]) -> DataFrame:
    """Claimed seasons only: one map of the twelve indices per set."""
    claimed = claim.filter("claimed").select(*scope, "years")
    sets = with_period(indices, claimed, scope) if scope else indices.crossJoin(F.broadcast(claimed))
    return sets.filter("years is not null").groupBy(*scope, "set", "years").agg(
        F.map_from_entries(F.collect_list(F.struct("moy", "index"))).alias("idx"))


def _index(col: Column, month: Column) -> Column:
    return F.coalesce(F.element_at(col, F.month(month)), F.lit(1.0))


def _level(v: list[Column]) -> Column:
    """Weights 1, 2, 3 over three months, the latest first in the list."""
    return (3 * v[0] + 2 * v[1] + v[2]) / 6


def horizon_errors(window: DataFrame, maps: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The method's own errors one to three months ahead over the history, each with the indices that
    leave the forecast month's year out."""
    scope = scope or []
    order = W.partitionBy(*scope).orderBy("position")
    recent = window.groupBy(*scope).agg(F.bool_and(F.when(F.col("position") >= F.col("n") - RECENT, F.col("revenue") > 0)).alias("logs"))
    years = maps.select(*scope, "years").distinct()
    parts = None
    for h in range(1, HORIZON + 1):
        part = window.select(*scope, "month", "revenue", "position", "n", F.lit(h).alias("h"),
                             *[F.lag("revenue", h + k).over(order).alias(f"v{k}") for k in range(3)]).filter(F.col("position") >= h + 2)
        parts = part if parts is None else parts.unionByName(part)
    wide = with_period(with_period(parts, recent, scope), years, scope)
    first = F.col("n") - 12 * F.col("years")
    chosen = F.when(F.col("position") >= first, F.floor((F.col("position") - first) / 12)).otherwise(-1).cast("int")
    wide = join_same(wide.withColumn("set", chosen), maps.drop("years"), [*scope, "set"], "left")
    shifted = lambda k: F.add_months("month", -1 * (0 + k))
    # v0 lies h months before the forecast month, v1 and v2 one and two earlier.
    months = [F.expr(f"add_months(month, -(h + {k}))") for k in range(3)]
    window_values = [F.col(f"v{k}") / _index(F.col("idx"), months[k]) for k in range(3)]
    forecast = _level(window_values) * _index(F.col("idx"), shifted(0))
    wide = wide.withColumns({"forecast": forecast, "__low": F.least(*window_values)})
    usable = (F.col("forecast") > 0) & (F.col("revenue") > 0) & (F.col("__low") > 0)
    error = F.when(F.col("logs"), F.when(usable, F.ln("revenue") - F.ln("forecast"))).otherwise(F.col("revenue") - F.col("forecast"))
    return wide.select(*scope, "h", "month", "logs", "forecast", F.col("revenue").alias("actual"), error.alias("error")).filter("error is not null")


def forecast(window: DataFrame, indices: DataFrame, claim: DataFrame, period: DataFrame, t: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Three points with an 80 % band; no rows for a scope with under three months of history."""
    scope = scope or []
    maps = _index_maps(indices, claim, scope)
    errors = horizon_errors(window, maps, scope)
    rms = errors.groupBy(*scope, "h").agg(F.count("*").alias("errors"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rms"))
    own = maps.filter("set = -1").select(*scope, "idx")
    last = with_period(window, own, scope).withColumn("d", F.col("revenue") / _index(F.col("idx"), F.col("month")))
    back = F.col("n") - 1 - F.col("position")
    pick = lambda k: F.max(F.when(back == k, F.col("d")))
    level = last.groupBy(*scope).agg(
        F.max("n").alias("n"), pick(0).alias("d0"), pick(1).alias("d1"), pick(2).alias("d2"), F.stddev_samp("revenue").alias("spread"),
        F.bool_and(F.when(back < RECENT, F.col("revenue") > 0)).alias("logs")).filter(F.col("n") >= MIN_HISTORY)
    level = level.withColumn("level", _level([F.col("d0"), F.col("d1"), F.col("d2")]))
    based = with_period(with_period(level, own, scope), period.select(*scope, "current"), scope).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
    pointed = based.withColumn("month", F.expr("add_months(current, h)")).withColumn("point", F.col("level") * _index(F.col("idx"), F.col("month")))
    joined = join_same(pointed, rms, [*scope, "h"], "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    tested = F.col("errors") >= 2
    df = F.when(tested, F.col("errors") - 1).otherwise(F.col("n") - 1).cast("int")
    joined = joined.withColumn("df", df).join(F.broadcast(t), "df", "left").withColumn("t", F.coalesce("t", t_series(F.col("df"))))
    width = F.when(tested, F.col("t") * F.col("rms")).otherwise(F.col("t") * F.col("spread") * F.sqrt("h"))
    logs = tested & F.col("logs") & (F.col("point") > 0)
    low = F.when(logs, F.col("point") * F.exp(-width)).otherwise(F.col("point") - width)
    high = F.when(logs, F.col("point") * F.exp(width)).otherwise(F.col("point") + width)
    return joined.select(*scope, "h", "month", "point", low.alias("low"), high.alias("high"), "errors", F.col("idx").isNotNull().alias("seasonal"))


def forecast_status(window: DataFrame, period: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Months used, and whether they are too few to forecast."""
    scope = scope or []
    used = window.groupBy(*scope).agg(F.count("*").alias("months_used"))
    wide = with_period(period.select(*(scope or [F.lit(1).alias("__one")])), used, scope).withColumn("months_used", F.coalesce("months_used", F.lit(0)))
    return wide.select(*scope, "months_used", (F.col("months_used") < MIN_HISTORY).alias("insufficient_history"))
