"""Data-quality issues: counts per column, rows that show a problem, before and after a plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.functions import dates as D
from tillscope.functions import numbers as N
from tillscope.functions import text as T
from tillscope.operators import profile as P
from tillscope.operators.ranking import join_same

# Fixed values.
TEXTUAL_TYPES = ("categorical_nominal", "categorical_ordinal", "text")
PROFILED_CODES = ("missing_values", "all_null_column", "duplicate_rows")
COLUMN_CODES = (
    "invalid_dates", "mixed_date_formats", "negative_values", "zero_values", "inconsistent_case",
    "trailing_whitespace", "near_duplicate_labels", "outliers_iqr", "mixed_types", "constant_column",
    "non_numeric_in_numeric",
)


def _cells(counts: DataFrame) -> DataFrame:
    """Each distinct non-missing cell with what every issue asks about it."""
    v = F.col("value")
    date = F.when(v.rlike(r"\d"), D.read_date(v)).isNotNull()
    return counts.filter(v.isNotNull()).select(
        "column", "value", "n", N.strict_number(v).alias("num"), date.alias("is_date"), T.is_padded(v).alias("padded")
    )


def issue_counts(counts: DataFrame, business_key: DataFrame | None = None) -> DataFrame:
    """Every computable issue of every column, ``(column, code, count)``, those with cells only.

    One aggregation of the counts gives the plain codes; spellings, near-twins and date shapes each
    aggregate the counts by their own key. ``business_key`` adds the dataset's duplicate-key row.
    """
    n = F.col("n")
    cells = _cells(counts)
    fenced = cells.join(F.broadcast(P.iqr_fences(counts)), "column", "left")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    num = F.col("num")
    plain = fenced.groupBy("column").agg(
        F.sum("n").alias("present"), F.count("*").alias("kinds"),
        total(num.isNotNull()).alias("numeric"), total(F.col("is_date")).alias("dates"),
        total(num < 0).alias("negative_values"), total(num == 0).alias("zero_values"),
        total(F.col("padded")).alias("trailing_whitespace"),
        total((num < F.col("low")) | (num > F.col("high"))).alias("outliers_iqr"),
    )
    spelled = P.dominant_spellings(counts).groupBy("column").agg(F.sum("variants").alias("inconsistent_case"))
    folded = (
        cells.groupBy("column", T.label_key(F.col("value")).alias("twin"), T.fold(F.col("value")).alias("label"))
        .agg(F.sum("n").alias("n"))
        .groupBy("column", "twin").agg((F.sum("n") - F.max("n")).alias("x"))
        .groupBy("column").agg(F.sum("x").alias("near_duplicate_labels"))
    )
    shapes = P.date_shapes(counts).groupBy("column").agg((F.sum("n") - F.max("n")).alias("__other_shapes"))
    wide = plain.join(spelled, "column", "left").join(folded, "column", "left").join(shapes, "column", "left")
    other = F.col("present") - F.col("numeric")
    mostly_dates = F.col("dates") / F.col("present") > P.MAJORITY
    mostly_numbers = F.col("numeric") / F.col("present") > P.MAJORITY
    wide = wide.withColumns({
        "invalid_dates": F.when(mostly_dates, F.col("present") - F.col("dates")),
        "mixed_date_formats": F.when(mostly_dates, F.col("__other_shapes")),
        "non_numeric_in_numeric": F.when(mostly_numbers, other),
        "mixed_types": F.least(F.col("numeric"), other),
        "constant_column": F.when(F.col("kinds") == 1, F.col("present")),
    })
    tidy = wide.select("column", *[F.col(c).cast("long").alias(c) for c in COLUMN_CODES]).unpivot(
        ["column"], list(COLUMN_CODES), "code", "count"
    )
    missing = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("missing_values"),
        F.when(F.count("value") == 0, F.sum("n")).alias("all_null_column"),
    ).select("column", F.col("missing_values").cast("long"), F.col("all_null_column").cast("long")).unpivot(
        ["column"], ["missing_values", "all_null_column"], "code", "count")
    out = tidy.unionByName(missing)
    if business_key is not None:
        out = out.unionByName(business_key)
    return out.filter(F.col("count") > 0)


def duplicate_key_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row sharing its business key with another row, as one issue row (missing keys are equal)."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("count")).select(
        F.lit(None).cast("string").alias("column"), F.lit("duplicate_business_key").alias("code"), "count"
    )


def duplicate_row_issue(stats: DataFrame) -> DataFrame:
    return stats.select(F.lit(None).cast("string").alias("column"), F.lit("duplicate_rows").alias("code"),
                        F.col("duplicate_rows").alias("count"))


def order_id_issue(check: DataFrame, column: str) -> DataFrame:
    """The order-id column flagged when more than a tenth of its ids span days or customers."""
    return check.filter((F.col("ids") > 0) & (F.col("spanning") > F.col("ids") * 0.1)).select(
        F.lit(column).alias("column"), F.lit("order_id_not_one_order").alias("code"), F.col("spanning").alias("count")
    )


def reads_back_as_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells whose text would read as missing when the cleaned file is read again."""
    counts = df.agg(*[F.count_if(T.reads_as_missing(F.col(f"`{c}`"))).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "cells")


def reconcile(claimed: DataFrame, measured: DataFrame) -> DataFrame:
    """Claimed issues with measured counts in place of theirs, and why each other one was dropped.

    ``claimed`` is ``(column, code, count, semantic_type)``; ``measured`` is ``(column, code, count)``.
    A claimed code the data does not show, one that is not a column's (or the dataset's) own, a
    repeated one, and near-twins outside text columns are dropped.
    """
    dataset = F.col("column").isNull()
    first = W.partitionBy("column", "code").orderBy(F.col("count").desc_nulls_last())
    numbered = claimed.withColumn("__repeat", F.row_number().over(first))
    joined = join_same(numbered, measured.withColumnRenamed("count", "measured"), ["column", "code"], "left")
    column_code, dataset_code = (
        F.col("code").isin(*COLUMN_CODES, "missing_values", "all_null_column"),
        F.col("code").isin("duplicate_business_key", "duplicate_rows"),
    )
    recounted = F.col("code").isin(*COLUMN_CODES, "duplicate_business_key")
    outcome = (
        F.when(F.col("__repeat") > 1, "dropped_repeated")
        .when((dataset & ~dataset_code) | (~dataset & ~column_code), "dropped_wrong_level")
        .when((F.col("code") == "near_duplicate_labels") & ~F.coalesce(F.col("semantic_type").isin(*TEXTUAL_TYPES), F.lit(False)), "dropped_not_text")
        .when(recounted & F.col("measured").isNull(), "dropped_not_found")
        .when(~recounted & (F.col("count") == 0), "dropped_zero")
        .when(recounted & F.col("count").isNotNull() & (F.col("count") != F.col("measured")), "replaced")
        .otherwise("kept")
    )
    return joined.select("column", "code", F.col("count").alias("claimed"),
                         F.when(recounted, F.col("measured")).otherwise(F.col("count")).alias("count"),
                         outcome.alias("outcome"))


# --- rows that show a problem --------------------------------------------------------------------

PROBLEMS = ("any_missing", "duplicate", "negative", "non_numeric", "padded", "bad_date")


def with_duplicate_mark(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Mark every row whose keys (nulls equal) another row shares.

    Keys are counted with map-side combining first; only keys that repeat are joined back, and a hot
    key's rows are split by the skew join because the counted side holds it once.
    """
    repeated = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("__n")).filter("__n > 1")
    return join_same(df, repeated, keys, "left").withColumn(name, F.col("__n").isNotNull()).drop("__n")


def problem_marks(df: DataFrame, columns: list[str], numeric: list[str], dates: list[str]) -> DataFrame:
    """The frame with one boolean per kind of problem."""
    any_of = lambda found: reduce(lambda a, b: a | b, found, F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False))
    cell = lambda c: F.col(f"`{c}`")
    marked = with_duplicate_mark(df, columns, "duplicate")
    return marked.withColumns({
        "any_missing": any_of([cell(c).isNull() for c in columns]),
        "negative": any_of([no(N.strict_number(cell(c)) < 0) for c in numeric]),
        "non_numeric": any_of([cell(c).isNotNull() & N.strict_number(cell(c)).isNull() for c in numeric]),
        "padded": any_of([T.is_padded(cell(c)) for c in columns]),
        "bad_date": any_of([cell(c).isNotNull() & D.read_date(cell(c)).isNull() for c in dates]),
    })


def first_rows_per_problem(marked: DataFrame, per_kind: int, line_no: str = "line_no") -> DataFrame:
    """The first ``per_kind`` line numbers of every problem, in file order."""
    kinds = F.explode(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in PROBLEMS]))).alias("kind")
    order = W.partitionBy("kind").orderBy(line_no)
    return (
        marked.select(line_no, kinds).withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= per_kind)
    )


def stratified_sample(marked: DataFrame, limit: int, per_kind: int, problem_share: float = 1.0,
                      line_no: str = "line_no") -> DataFrame:
    """Rows of every problem kind, then evenly spaced rows, ``limit`` in all, in file order."""
    room = int(limit * problem_share)
    chosen = (
        first_rows_per_problem(marked, per_kind, line_no).select(line_no).distinct().orderBy(line_no).limit(room)
        .withColumn("priority", F.lit(0))
    )
    last = marked.agg(F.max(line_no).alias("__last"))
    grid = last.select(
        F.explode(F.expr(f"transform(sequence(0, {limit - 1}), i -> cast(floor(i * __last / {max(limit - 1, 1)}) as bigint))")).alias(line_no)
    ).distinct().withColumn("priority", F.lit(1))
    picks = chosen.unionByName(grid).groupBy(line_no).agg(F.min("priority").alias("priority"))
    picks = picks.orderBy("priority", line_no).limit(limit).select(line_no)
    return marked.drop(*PROBLEMS).join(F.broadcast(picks), line_no)


# --- before and after a plan ---------------------------------------------------------------------


def plan_diff(before: DataFrame, after: DataFrame, line_no: str = "line_no") -> DataFrame:
    """Per line what a plan did: the columns changed, the flags set, or that the row was dropped."""
    shared = [c for c in after.columns if c in before.columns and c != line_no]
    added = [c for c in after.columns if c not in before.columns]
    b = before.select(line_no, F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in shared]).alias("was"), F.lit(True).alias("__b"))
    a = after.select(line_no, F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in shared]).alias("now"),
                     *[F.col(f"`{c}`") for c in added], F.lit(True).alias("__a"))
    joined = b.join(a, line_no, "full")
    changed = F.array_compact(F.array(
        *[F.when(~F.col(f"was.`{c}`").eqNullSafe(F.col(f"now.`{c}`")), F.lit(c)) for c in shared],
        *[F.when(F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False)), F.lit(c)) for c in added],
    )) if shared or added else F.array().cast("array<string>")
    dropped = F.col("__a").isNull()
    return joined.select(
        line_no, dropped.alias("dropped"),
        F.when(dropped, F.array().cast("array<string>")).otherwise(changed).alias("changed"),
    )


def rows_to_show(diff: DataFrame, limit: int, line_no: str = "line_no") -> DataFrame:
    """Lines to show: the first line of each effect, then other affected lines, then untouched ones."""
    effects = F.when(F.col("dropped"), F.array(F.lit("\u0000dropped"))).otherwise(F.col("changed"))
    tagged = diff.withColumn("__effects", effects)
    first = tagged.select(line_no, F.explode("__effects").alias("effect")).groupBy("effect").agg(F.min(line_no).alias(line_no))
    ranked = tagged.join(F.broadcast(first.select(line_no).distinct().withColumn("__first", F.lit(0))), line_no, "left").withColumn(
        "priority", F.coalesce("__first", F.when(F.size("__effects") > 0, 1).otherwise(2))
    )
    return ranked.orderBy("priority", line_no).limit(limit).select(line_no, "dropped", "changed", "priority")


def first_positions(df: DataFrame, mask: Column, limit: int, line_no: str = "line_no") -> DataFrame:
    """The first line numbers a mask selects, in file order."""
    return df.filter(mask).select(line_no).orderBy(line_no).limit(limit)


def column_deltas(before: DataFrame, after: DataFrame, exclude: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Per column the share of missing cells (percent) and distinct values before and after."""

    def measured(df: DataFrame, tag: str) -> DataFrame:
        names = [c for c in df.columns if c not in exclude]
        return P.value_counts(df, names).groupBy("column").agg(
            (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) * 100 / F.sum("n")).alias(f"null_pct_{tag}"),
            F.count("value").alias(f"unique_{tag}"),
        )

    return measured(before, "before").join(measured(after, "after"), "column", "full")
