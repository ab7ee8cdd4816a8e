"""The cleaning actions. Each one is a projection (or a join with one row of statistics) plus marks.

Rows an action drops are only marked, and every action marks the cells it changed, so the change log
of a whole plan is one aggregation over the finished frame instead of one pass per action.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions import dates as D
from tillscope.functions import numbers as N
from tillscope.functions import text as T
from tillscope.operators.issues import with_duplicate_mark
from tillscope.operators.ranking import percentiles

# Boolean words, and the flag prefix.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
FLAG = "__flag_"


@dataclass(frozen=True)
class Frame:
    """A frame being cleaned: its data columns, the marks so far and what each step will log."""

    df: DataFrame
    line_no: str = "line_no"
    steps: tuple[dict[str, Any], ...] = ()
    flags: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.line_no and not c.startswith("__mark_")]

    @property
    def alive(self) -> Column:
        drops = [c for c in self.df.columns if c.startswith("__mark_drop_")]
        out = F.lit(True)
        for c in drops:
            out = out & ~F.col(c)
        return out

    def logged(self, df: DataFrame, action: str, column: str | None, cells: Column | None = None,
               rows: Column | None = None, flag: str | None = None, drops: bool = False) -> "Frame":
        step = {"position": len(self.steps), "action": action, "column": column, "cells": cells, "rows": rows, "drops": drops}
        return replace(self, df=df, steps=(*self.steps, step), flags=self.flags + ((flag,) if flag else ()))

    def mark(self, kind: str) -> str:
        return f"__mark_{kind}_{len(self.steps)}"


def start(df: DataFrame, line_no: str = "line_no") -> Frame:
    return Frame(df.withColumn("__mark_copies", F.lit(1).cast("long")), line_no)


def _cell(frame: Frame, column: str) -> Column:
    if column not in frame.columns:
        raise ValueError(f"no such column: {column!r}")
    return F.col(f"`{column}`")


def _number(frame: Frame, column: str) -> Column:
    cell = _cell(frame, column)
    kind = dict(frame.df.dtypes)[column]
    return N.strict_number(cell) if kind == "string" else cell.cast("double")


def _as_type(frame: Frame, column: str, value: Column) -> Column:
    return value.cast(dict(frame.df.dtypes)[column])


def _changed(frame: Frame, action: str, column: str, new: Column, changed: Column, df: DataFrame | None = None) -> Frame:
    """Write ``new`` into the cells ``changed`` marks and log how many there were."""
    base = frame.df if df is None else df
    mark = frame.mark("cells")
    hit = F.coalesce(changed, F.lit(False)) & frame.alive
    out = base.withColumn(mark, hit).withColumn(
        column, F.when(F.col(mark), _as_type(frame, column, new)).otherwise(_cell(frame, column))
    )
    return frame.logged(out, action, column, cells=F.count_if(F.col(mark)))


def _dropped(frame: Frame, action: str, column: str | None, gone: Column) -> Frame:
    mark = frame.mark("drop")
    out = frame.df.withColumn(mark, F.coalesce(gone, F.lit(False)) & frame.alive)
    return frame.logged(out, action, column, rows=F.count_if(F.col(mark)), drops=True)


def _flagged(frame: Frame, action: str, column: str | None, kind: str, hit: Column,
             df: DataFrame | None = None, cells: Column | None = None) -> Frame:
    name = FLAG + kind + (f"__{column}" if column else "")
    base = frame.df if df is None else df
    out = base.withColumn(name, F.coalesce(hit, F.lit(False)))
    return frame.logged(out, action, column, cells=cells, rows=F.count_if(F.col(f"`{name}`") & frame.alive), flag=name)


def _fill(frame: Frame, action: str, column: str, statistic: DataFrame) -> Frame:
    """Fill missing cells with a one-row statistic of the rows that stay; nothing when it is null."""
    df = frame.df.crossJoin(F.broadcast(statistic))
    filled = _changed(frame, action, column, F.col("__stat"), _cell(frame, column).isNull() & F.col("__stat").isNotNull(), df)
    return replace(filled, df=filled.df.drop("__stat"))


def _alive_counts(frame: Frame, value: Column) -> DataFrame:
    return frame.df.filter(frame.alive).select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))


def impute_median(frame: Frame, column: str, params: dict) -> Frame:
    counts = _alive_counts(frame, _number(frame, column))
    return _fill(frame, "impute_median", column, percentiles(counts, [], "v", "n", {"__stat": 0.5}))


def impute_mean(frame: Frame, column: str, params: dict) -> Frame:
    return _fill(frame, "impute_mean", column, frame.df.filter(frame.alive).agg(F.avg(_number(frame, column)).alias("__stat")))


def impute_mode(frame: Frame, column: str, params: dict) -> Frame:
    counts = _alive_counts(frame, _cell(frame, column).cast("string"))
    return _fill(frame, "impute_mode", column, counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("__stat")))


def impute_constant(frame: Frame, column: str, params: dict) -> Frame:
    if params.get("value") is None:
        raise ValueError("impute_constant needs a value that is not missing")
    return _changed(frame, "impute_constant", column, F.lit(params["value"]), _cell(frame, column).isNull())


def drop_rows_missing(frame: Frame, column: str, params: dict) -> Frame:
    return _dropped(frame, "drop_rows_missing", column, T.is_blank(_cell(frame, column).cast("string")))


def drop_column(frame: Frame, column: str, params: dict) -> Frame:
    _cell(frame, column)
    return frame.logged(frame.df.drop(column), "drop_column", column, cells=F.coalesce(F.sum("__mark_copies"), F.lit(0)))


def remove_exact_duplicates(frame: Frame, column: None, params: dict) -> Frame:
    """The first of equal rows stays. A grouped minimum combines copies before the shuffle, so a row
    copied into a third of the data costs one row per task."""
    keys = [F.col(f"`{c}`") for c in frame.columns]
    df = frame.df.groupBy(*keys).agg(
        F.min(frame.line_no).alias(frame.line_no), F.sum("__mark_copies").alias("__mark_copies")
    )
    return frame.logged(df, "remove_exact_duplicates", None, rows=F.coalesce(F.sum(F.col("__mark_copies") - 1), F.lit(0)), drops=True)


def trim_whitespace(frame: Frame, column: str, params: dict) -> Frame:
    cell = _cell(frame, column).cast("string")
    return _changed(frame, "trim_whitespace", column, T.strip(cell), T.is_padded(cell))


def normalize_case(frame: Frame, column: str, params: dict) -> Frame:
    cased = {"title": T.title_case, "lower": F.lower, "upper": F.upper}[params["mode"]](_cell(frame, column).cast("string"))
    return _changed(frame, "normalize_case", column, cased, _cell(frame, column).cast("string") != cased)


def standardize_categories(frame: Frame, column: str, params: dict) -> Frame:
    mapping: dict[str, str] = params["mapping"]
    pairs = frame.df.sparkSession.createDataFrame(list(mapping.items()) or [("", "")], "__from string, __stat string")
    df = frame.df.join(pairs, _cell(frame, column).cast("string") == F.col("__from"), "left")
    out = _changed(frame, "standardize_categories", column, F.col("__stat"), F.col("__stat") != _cell(frame, column), df)
    return replace(out, df=out.df.drop("__from", "__stat"))


def _converted(frame: Frame, action: str, column: str, new: Column, kind: str) -> Frame:
    """The column in its new type; present cells that do not convert become missing and flagged."""
    done, name = frame.mark("cells"), FLAG + kind + f"__{column}"
    present = _cell(frame, column).isNotNull()
    df = frame.df.withColumn("__new", new).withColumns({
        done: present & F.col("__new").isNotNull() & frame.alive, name: present & F.col("__new").isNull(),
    }).withColumn(column, F.col("__new")).drop("__new")
    return frame.logged(df, action, column, cells=F.count_if(F.col(done)),
                        rows=F.count_if(F.col(f"`{name}`") & frame.alive), flag=name)


def parse_datetime(frame: Frame, column: str, params: dict) -> Frame:
    order = F.lit("day_first") if params.get("dayfirst") else None
    read = D.read_date(_cell(frame, column).cast("string"), order, params.get("format"))
    return _converted(frame, "parse_datetime", column, read, "invalid_date")


def cast_type(frame: Frame, column: str, params: dict) -> Frame:
    text, number, target = _cell(frame, column).cast("string"), _number(frame, column), params["target"]
    word = T.fold(T.strip(text))
    whole = (number % 1 == 0) & (number >= -(2.0**63)) & (number < 2.0**63)
    new = {
        "string": text, "float": number, "integer": F.when(whole, number).cast("long"),
        "boolean": F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False),
    }[target]
    return _converted(frame, "cast_type", column, new, "cast_failed")


def fix_negative(frame: Frame, column: str, params: dict) -> Frame:
    number, strategy = _number(frame, column), params.get("strategy", "flag")
    if strategy == "abs":
        return _changed(frame, "fix_negative", column, F.abs(number), number < 0)
    if strategy == "drop":
        return _dropped(frame, "fix_negative", column, number < 0)
    return _flagged(frame, "fix_negative", column, "negative", number < 0)


def clip_outliers_iqr(frame: Frame, column: str, params: dict) -> Frame:
    k = float(params.get("k", 1.5))
    cuts = percentiles(_alive_counts(frame, _number(frame, column)), [], "v", "n", {"__q1": 0.25, "__q3": 0.75})
    spread = (F.col("__q3") - F.col("__q1")) * k
    fence = cuts.select((F.col("__q1") - spread).alias("__low"), (F.col("__q3") + spread).alias("__high"))
    df = frame.df.crossJoin(F.broadcast(fence))
    number = _number(frame, column)
    out = _changed(frame, "clip_outliers_iqr", column, F.greatest(F.least(number, F.col("__high")), F.col("__low")),
                   (number < F.col("__low")) | (number > F.col("__high")), df)
    return replace(out, df=out.df.drop("__low", "__high"))


def flag_duplicate_keys(frame: Frame, column: None, params: dict) -> Frame:
    keys = list(params["keys"])
    name = FLAG + "duplicate_key"
    # Rows already dropped keep no key in common with the rest: each is its own group.
    guard = F.when(~frame.alive, F.col(frame.line_no))
    marked = with_duplicate_mark(frame.df.withColumn("__gone", guard), [*keys, "__gone"], name).drop("__gone")
    return frame.logged(marked, "flag_duplicate_keys", None, rows=F.count_if(F.col(name) & frame.alive), flag=name)


def flag_only(frame: Frame, column: str, params: dict) -> Frame:
    return frame.logged(frame.df, "flag_only", column)


ACTIONS = {
    f.__name__: f for f in (
        impute_median, impute_mean, impute_mode, impute_constant, drop_rows_missing, drop_column,
        remove_exact_duplicates, trim_whitespace, normalize_case, standardize_categories, parse_datetime,
        cast_type, fix_negative, clip_outliers_iqr, flag_duplicate_keys, flag_only,
    )
}
