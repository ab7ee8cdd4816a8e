"""Running a cleaning plan: fixed order, one pass for the data, one aggregation for the change log."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import text as T
from tillscope.operators import issues, transforms
from tillscope.operators.profile import rewrite_numbers
from tillscope.session import materialize

# The order actions run in, whatever order the plan lists them.
EXECUTION_ORDER = (
    ("drop_column",),
    ("remove_exact_duplicates",),
    ("trim_whitespace",),
    ("normalize_case",),
    ("parse_datetime", "cast_type"),
    ("drop_rows_missing",),
    ("impute_median", "impute_mean", "impute_mode", "impute_constant"),
    ("standardize_categories",),
    ("fix_negative", "clip_outliers_iqr"),
    ("flag_duplicate_keys", "flag_only"),
)
RANK = {action: rank for rank, group in enumerate(EXECUTION_ORDER) for action in group}


@dataclass(frozen=True)
class Step:
    action: str
    column: str | None = None
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class CleaningPlan:
    """Dataset steps, column steps, and the answers that decide how numbers are written."""

    dataset: tuple[Step, ...] = ()
    columns: tuple[Step, ...] = ()
    number_columns: tuple[str, ...] = ()
    number_formats: dict[str, str] = field(default_factory=dict)
    compose: tuple[str, ...] = ()

    def ordered(self) -> list[Step]:
        return sorted([*self.dataset, *self.columns], key=lambda s: RANK[s.action])


LOG_SCHEMA = "position int, action string, column string, cells bigint, rows bigint, drops boolean"


def run_plan(df: DataFrame, plan: CleaningPlan, line_no: str = "line_no", write: bool = False) -> tuple[DataFrame, DataFrame]:
    """The cleaned frame and its change log ``(position, action, column, cells, rows, drops)``.

    ``write=True`` stores the marked frame once, so that the log and later jobs read it instead of
    running the plan again.
    """
    if plan.number_columns:
        df, _ = rewrite_numbers(df, list(plan.number_columns), plan.number_formats)
    if plan.compose:
        df = T.compose_columns(df, list(plan.compose))
    frame = transforms.start(df, line_no)
    for step in plan.ordered():
        frame = transforms.ACTIONS[step.action](frame, step.column, step.params)
    marked = materialize(frame.df, "cleaned") if write else frame.df
    counts = marked.agg(
        *[F.coalesce(s[k], F.lit(0)).cast("long").alias(f"{k}_{s['position']}")
          for s in frame.steps for k in ("cells", "rows") if s[k] is not None],
        *[F.coalesce(F.bool_or(F.col(f"`{f}`") & frame.alive), F.lit(False)).alias(f"set_{i}") for i, f in enumerate(frame.flags)],
        F.count("*").alias("all_rows"),
    ).first().asDict()
    log = marked.sparkSession.createDataFrame(
        [(s["position"], s["action"], s["column"], counts.get(f"cells_{s['position']}", 0), counts.get(f"rows_{s['position']}", 0), s["drops"])
         for s in frame.steps], LOG_SCHEMA,
    )
    empty = [f for i, f in enumerate(frame.flags) if not counts[f"set_{i}"] and f not in df.columns]
    marks = [c for c in marked.columns if c.startswith("__mark_")]
    return marked.filter(frame.alive).drop(*marks, *empty), log


def apply_action(df: DataFrame, action: str, column: str | None = None, params: dict | None = None,
                 line_no: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """One action on its own: ``(frame, log)``."""
    step = Step(action, column, params or {})
    return run_plan(df, CleaningPlan(columns=(step,)), line_no)


def dropped_rows_report(log: DataFrame) -> DataFrame:
    """What the report says about dropped rows: the dropping actions that took any."""
    return log.filter(F.col("drops") & (F.col("rows") > 0)).select("action", "column", "rows")


def preview(df: DataFrame, plan: CleaningPlan, columns: list[str], numeric: list[str], dates: list[str],
            sample_rows: int = 500, per_kind: int = 40, show: int = 20, line_no: str = "line_no") -> dict[str, DataFrame]:
    """A plan tried on a stratified sample: rows to show, per-column deltas, rows left."""
    marked = issues.problem_marks(df, columns, numeric, dates)
    sample = materialize(issues.stratified_sample(marked, sample_rows, per_kind, 0.5, line_no), "preview")
    after, log = run_plan(sample, plan, line_no)
    diff = issues.plan_diff(sample, after, line_no)
    return {
        "rows": issues.rows_to_show(diff, show, line_no),
        "deltas": issues.column_deltas(sample, after, (line_no,)),
        "log": log,
        "size": sample.agg(F.count("*").alias("sample_rows")).crossJoin(after.agg(F.count("*").alias("rows_after"))),
    }
