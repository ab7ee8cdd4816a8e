"""Profiling of untyped text columns.

Everything here is computed from one table, ``value_counts``: each column's distinct cells and how
many rows hold them. It is the only step that reads the data; the rest reads the counts.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.functions import dates as D
from tillscope.functions import numbers as N
from tillscope.functions import text as T
from tillscope.operators.ranking import join_same, percentiles

# --- fixed values -------------------------------------------------------------------------------
TOP_VALUES = 10
SAMPLE_VALUES = 5
MAJORITY = 0.5
IQR_K = 1.5
# -------------------------------------------------------------------------------------------------


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n)``: every column's distinct cells, missing as null."""
    names = columns or df.columns
    cells = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    return cells.unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def dataset_stats(df: DataFrame) -> DataFrame:
    """Rows, columns, rows equal to an earlier one, share of missing cells (percent)."""
    missing = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0))
    rows = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("__n"))
    return rows.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
        (F.coalesce(F.sum("__n"), F.lit(0)) - F.count("*")).alias("duplicate_rows"),
        F.coalesce(F.sum(missing * F.col("__n")), F.lit(0)).alias("__missing"),
    ).select(
        "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"), "duplicate_rows",
        F.coalesce(F.try_divide(F.col("__missing"), F.col("row_count") * len(df.columns)) * 100, F.lit(0.0))
        .alias("missing_cells_pct"),
    )


def _measured(counts: DataFrame) -> DataFrame:
    return counts.withColumn("num", N.strict_number(F.col("value")))


def numeric_columns(counts: DataFrame) -> DataFrame:
    """Columns every non-missing cell of which is a finite number."""
    present = _measured(counts.filter(F.col("value").isNotNull()))
    return (
        present.groupBy("column").agg(F.bool_and(F.col("num").isNotNull()).alias("__all"))
        .filter("__all").select("column")
    )


def number_counts(counts: DataFrame) -> DataFrame:
    """``(column, num, n)`` over the cells that are numbers."""
    return (
        _measured(counts.filter(F.col("value").isNotNull())).filter(F.col("num").isNotNull())
        .groupBy("column", "num").agg(F.sum("n").alias("n"))
    )


def column_profile(counts: DataFrame) -> DataFrame:
    """One row per column: missing, distinct, and for all-number columns min to q3."""
    present = F.col("value").isNotNull()
    base = _measured(counts).groupBy("column").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
        (F.coalesce(F.bool_and(F.when(present, F.col("num").isNotNull())), F.lit(False))).alias("is_numeric"),
        F.min("num").alias("__min"), F.max("num").alias("__max"),
        (F.sum(F.col("num") * F.col("n")) / F.sum(F.when(F.col("num").isNotNull(), F.col("n")))).alias("__mean"),
    )
    cuts = percentiles(number_counts(counts), ["column"], "num", "n", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    only = lambda c: F.when(F.col("is_numeric"), F.col(c))
    return base.join(cuts, "column", "left").select(
        "column", "null_count", (F.col("null_count") / F.col("row_count") * 100).alias("null_pct"), "unique_count",
        "is_numeric", only("__min").alias("min_value"), only("__max").alias("max_value"), only("__mean").alias("mean_value"),
        only("q1").alias("q1"), only("median").alias("median"), only("q3").alias("q3"),
    )


def top_values(counts: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The commonest ``k`` cells of each column, ties by value."""
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        counts.filter(F.col("value").isNotNull()).withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
    )


def sample_values(df: DataFrame, columns: list[str] | None = None, line_no: str = "line_no") -> DataFrame:
    """Five evenly spaced cells of each column, the first and last included; ``line_no`` is 0, 1, 2, …"""
    names = columns or [c for c in df.columns if c != line_no]
    last = df.agg((F.max(line_no)).alias("__last"))
    spots = last.select(
        F.explode(F.array_distinct(F.array(*[
            F.floor(F.lit(i) * F.col("__last") / (SAMPLE_VALUES - 1)) for i in range(SAMPLE_VALUES)
        ]))).alias(line_no)
    )
    picked = df.join(F.broadcast(spots), line_no)
    return picked.select(line_no, *[F.col(f"`{c}`").cast("string").alias(c) for c in names]).unpivot(
        [line_no], names, "column", "value"
    )


# --- dates ---------------------------------------------------------------------------------------


def date_order_evidence(counts: DataFrame) -> DataFrame:
    """Per column: day/month/year cells, those only one order can read, the ambiguous, and the decision."""
    cells = (
        counts.filter(F.col("value").rlike(r"\d")).withColumn("__d", D.day_month_year(F.col("value")))
        .filter(F.col("__d").isNotNull())
        .select("column", "value", "n", F.col("__d.first").alias("a"), F.col("__d.second").alias("b"),
                F.col("__d.written").alias("written"))
    )
    a, b = F.col("a"), F.col("b")
    kinds = {
        "day_first": a.between(13, 31) & b.between(1, 12),
        "month_first": b.between(13, 31) & a.between(1, 12),
        "ambiguous": a.between(1, 12) & b.between(1, 12) & (a != b),
    }
    order = F.struct(-F.col("n"), F.col("value"))
    aggs = [F.sum("n").alias("shaped")]
    for name, kind in kinds.items():
        aggs.append(F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0)).alias(name))
        aggs.append(F.min_by("written", F.when(kind, order)).alias(f"__{name}_example"))
        aggs.append(F.count_if(kind).alias(f"__{name}_kinds"))
    aggs += [
        F.bool_and(T.strip(F.col("value")) == F.col("written")).alias("__date_only"),
        F.min("a").alias("__a0"), F.max("a").alias("__a1"), F.min("b").alias("__b0"), F.max("b").alias("__b1"),
    ]
    day, month = F.col("day_first") > 0, F.col("month_first") > 0
    decision = (
        F.when(day & ~month, "day_first").when(month & ~day, "month_first")
        .when((day & month) | (F.col("ambiguous") > 0), "ask")
    )
    hint = F.when(F.col("__date_only") & (day == month), F.when(
        (F.col("__a0") == 1) & (F.col("__a1") == 1) & (F.col("__b0") != F.col("__b1")), "day_first"
    ).when((F.col("__b0") == 1) & (F.col("__b1") == 1) & (F.col("__a0") != F.col("__a1")), "month_first"))
    example = lambda k: F.when(F.col(f"__{k}_kinds") > 0, F.col(f"__{k}_example")).alias(f"{k}_example")
    return cells.groupBy("column").agg(*aggs).select(
        "column", "shaped", "day_first", "month_first", "ambiguous", *[example(k) for k in kinds],
        decision.alias("decision"), hint.alias("hint"),
    )


def applied_order(evidence: DataFrame, answers: dict[str, bool] | None = None) -> DataFrame:
    """The order each column is read in: the user's answer, else what its cells prove, else null."""
    answer = F.lit(None).cast("string")
    for column, day_first in (answers or {}).items():
        answer = F.when(F.col("column") == column, "day_first" if day_first else "month_first").otherwise(answer)
    proved = F.when(F.col("decision") != "ask", F.col("decision"))
    return evidence.withColumn("applied", F.coalesce(answer, proved)).withColumn(
        "unanswered", (F.col("decision") == "ask") & answer.isNull()
    )


def first_misread(df: DataFrame, column: str, order: str, fmt: str | None = None, line_no: str = "line_no") -> DataFrame:
    """The first day/month/year cell an explicit format reads differently from the decided order."""
    cell = F.col(f"`{column}`")
    step, decided = D.read_date(cell, fmt=fmt), D.read_date(cell, F.lit(order))
    wrong = D.day_month_year(cell).isNotNull() & step.isNotNull() & ~step.eqNullSafe(decided)
    return (
        df.filter(wrong)
        .agg(F.min_by(F.struct(F.col(line_no).alias(line_no), cell.alias("cell"), step.alias("format_reads"),
                               decided.alias("order_reads")), line_no).alias("r"))
        .filter("r is not null").select("r.*")
    )


def month_grain(lines: DataFrame, ts: str, scope: list[str] | None = None) -> DataFrame:
    """Do the dates record months: all at midnight on the 1st, or all on month ends, over two months or more?"""
    t = F.col(ts)
    midnight = t == F.to_date(t).cast("timestamp_ntz")
    first, last = midnight & (F.dayofmonth(t) == 1), midnight & (F.to_date(t) == F.last_day(t))
    return lines.filter(t.isNotNull()).groupBy(*(scope or [])).agg(
        (F.coalesce(F.bool_and(first) | F.bool_and(last), F.lit(False))
         & F.coalesce(F.min(D.month_of(t)) < F.max(D.month_of(t)), F.lit(False))).alias("month_grain")
    )


# --- numbers -------------------------------------------------------------------------------------


def number_format_evidence(counts: DataFrame) -> DataFrame:
    """Per column: cells by the decimal mark they prove, currency signs, unreadable cells, and the decision."""
    cells = counts.filter(F.col("value").isNotNull()).withColumn("__r", N.human_number(F.col("value")))
    shape = F.col("__r.shape")
    blank = T.strip(F.col("value")) == ""
    unread = shape.isNull() & ~blank & N.strict_number(F.col("value")).isNull()
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    example = lambda cond: F.min_by(F.col("value"), F.when(cond, F.struct(-F.col("n"), F.col("value"))))
    found = cells.groupBy("column").agg(
        total(shape.isNotNull()).alias("readable"),
        *[total(shape == s).alias(s) for s in ("plain", "point", "comma", "ambiguous")],
        total(F.col("__r.currency")).alias("signed_currency"), total(unread).alias("unreadable"),
        *[F.when(F.max(shape == s), example(shape == s)).alias(f"{s}_example") for s in ("point", "comma", "ambiguous")],
    )
    point, comma = F.col("point") > 0, F.col("comma") > 0
    return found.withColumn(
        "decision",
        F.when(point & ~comma, "decimal_point").when(comma & ~point, "decimal_comma")
        .when(F.col("ambiguous") > 0, "ask"),
    )


class AnswerNeeded(ValueError):
    """A column's cells can be read two ways and nobody said which."""


def rewrite_numbers(df: DataFrame, columns: list[str], answers: dict[str, str] | None = None,
                    refuse: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rewrite human-written numbers as plain ones; also the per-column log of what was decided.

    The decision is one small row per column. A column that can be read two ways without an answer,
    or whose answer its own cells contradict, refuses the run.
    """
    answers = answers or {}
    evidence = number_format_evidence(value_counts(df, columns))
    decided: dict[str, str | None] = {}
    for row in evidence.select("column", "decision").collect():
        answer, proof = answers.get(row.column), row.decision
        if refuse and proof == "ask" and answer is None:
            raise AnswerNeeded(f"the numbers of column {row.column!r} can be read two ways")
        if refuse and answer is not None and proof not in (None, "ask", answer):
            raise AnswerNeeded(f"the answer for column {row.column!r} contradicts its own cells")
        decided[row.column] = answer if proof == "ask" else proof
    names = F.create_map(*[F.lit(x) for c in columns for x in (c, decided.get(c) or "")])
    changes = value_counts(df, columns).withColumn(
        "__new", N.number_as_decided(F.col("value"), names[F.col("column")])
    )
    log = (
        changes.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("__new") != F.col("value"), F.col("n"))), F.lit(0)).alias("rewritten"))
        .join(evidence.select("column", "unreadable"), "column")
        .withColumn("format", F.nullif(names[F.col("column")], F.lit("")))
    )
    out = df.withColumns({
        c: N.number_as_decided(F.col(f"`{c}`"), F.lit(decided.get(c))) for c in columns
    })
    return out, log


# --- kinds, spellings, identities ----------------------------------------------------------------


def column_kinds(counts: DataFrame) -> DataFrame:
    """Per column, how many non-missing cells are numbers, dates, padded, or carry a UTC offset."""
    cell = F.col("value")
    has_digit = cell.rlike(r"\d")
    date = F.when(has_digit, D.read_date(cell)).isNotNull()
    n = F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    marked = counts.filter(cell.isNotNull()).select(
        "column", "n", N.strict_number(cell).isNotNull().alias("num"), date.alias("date"), T.is_padded(cell).alias("padded"),
        D.has_utc_offset(cell).alias("utc"), T.is_number_like(cell).alias("numlike"),
        (T.is_period_like(cell) | T.is_time_like(cell)).alias("period"),
    )
    return marked.groupBy("column").agg(
        F.sum("n").alias("present"), total(F.col("num")).alias("numeric"), total(F.col("date")).alias("dates"),
        total(F.col("padded")).alias("padded"), F.bool_or("utc").alias("has_utc_offset"),
        F.bool_or("numlike").alias("any_number_like"), F.bool_or("period").alias("any_period_like"),
    ).withColumn("mostly_numeric", F.col("numeric") / F.col("present") > MAJORITY).withColumn(
        "mostly_dates", F.col("dates") / F.col("present") > MAJORITY
    )


def cell_masks(df: DataFrame, column: str) -> DataFrame:
    """The frame with one boolean per question about each cell of a column."""
    cell = F.col(f"`{column}`")
    num, date = N.strict_number(cell).isNotNull(), D.read_date(cell).isNotNull()
    return df.withColumns({
        "is_present": cell.isNotNull(), "is_number": num, "is_not_number": cell.isNotNull() & ~num,
        "is_date": date, "is_not_date": cell.isNotNull() & ~date, "has_padding": T.is_padded(cell),
    })


def date_shapes(counts: DataFrame) -> DataFrame:
    """How each column's dates are written, with cell counts."""
    cells = counts.filter(F.col("value").rlike(r"\d")).withColumn("shape", D.date_shape(F.col("value")))
    return cells.filter(F.col("shape").isNotNull()).groupBy("column", "shape").agg(F.sum("n").alias("n"))


def iqr_fences(counts: DataFrame, k: float = IQR_K) -> DataFrame:
    """Per column ``low = q1 - k·iqr`` and ``high = q3 + k·iqr`` over its numbers."""
    cuts = percentiles(number_counts(counts), ["column"], "num", "n", {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return cuts.select("column", (F.col("q1") - k * spread).alias("low"), (F.col("q3") + k * spread).alias("high"))


def dominant_spellings(counts: DataFrame) -> DataFrame:
    """Per column and case-folded label, its commonest spelling (ties alphabetical) and the other cells."""
    cells = counts.filter(F.col("value").isNotNull()).withColumn("label", T.fold(F.col("value")))
    return cells.groupBy("column", "label").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("spelling"),
        (F.sum("n") - F.max("n")).alias("variants"),
    )


def identity_merges(counts: DataFrame) -> DataFrame:
    """Per column, how many distinct values become one once read as identities."""
    read = counts.filter(~T.is_blank(F.col("value"))).withColumn("id", T.customer_identity(F.col("value")))
    read = T.compose_columns(read.select("column", "id"), ["id"])
    return read.groupBy("column", "id").agg(F.count("*").alias("raw")).groupBy("column").agg(
        F.sum(F.col("raw") - 1).alias("merged")
    )


# --- personal columns ----------------------------------------------------------------------------

# Header words and value shapes that name or locate a person.
# Words before "name" that make a header a person's.
NAMED = (
    "first", "last", "full", "given", "family", "middle", "sur", "billing", "shipping", "ship", "delivery", "ship to", "bill to", "customer",
    "client", "buyer", "purchaser", "recipient", "contact", "cardholder", "card holder", "account holder", "holder", "member", "user",
    "employee", "staff", "cashier", "seller", "salesperson", "sales person", "sales rep", "rep", "agent", "owner", "person", "guest",
    "driver", "courier",
)
# Headers that are a person as they stand.
PEOPLE = (
    "customer", "client", "buyer", "purchaser", "recipient", "contact", "cardholder", "salesperson", "sales rep", "cashier", "employee",
    "staff", "server", "user", "seller", "served by", "sold by", "created by", "name", "name billing", "name shipping", "name bill to",
    "name ship to",
)
# Words anywhere in a header.
PERSONAL_WORDS = (
    "username", "salesperson", "sales person", "salesman", "sales man", "saleswoman", "sales woman", "contact person", "account holder",
    "cardholder", "card holder", "email", "e mail", "phone", "telephone", "tel", "mobile", "cell", "fax", "address", "addr", "street",
    "postcode", "post code", "postal", "zip", "zipcode", "zip code", "eircode",
)
# Postal codes, letters as A and digits as 9; a blank may be left out.
POSTAL_SHAPES = (
    "A9 9AA", "AA9 9AA", "A9A 9AA", "AA9A 9AA", "A99 9AA", "AA99 9AA", "A9A 9A9", "9999 AA", "99999-9999", "99999-999",
)
# -------------------------------------------------------------------------------------------------
MIN_PHONE_DIGITS = 7


def _shape(text: Column) -> Column:
    """Every ASCII letter as A, every digit as 9, white space as one blank."""
    letters = F.translate(F.upper(text), "BCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 25)
    return F.regexp_replace(F.translate(letters, "012345678", "9" * 9), r"\s+", " ")


def _is_mail(text: Column) -> Column:
    parts = F.split(text, "@")
    host = F.element_at(parts, -1)
    inner = F.substring(host, F.lit(2), F.length(host) - 2)
    return (F.size(parts) == 2) & (F.element_at(parts, 1) != "") & F.contains(inner, F.lit(".")) & ~text.rlike(r"\s")


def _is_phone(text: Column) -> Column:
    """Digits with a leading plus, brackets or at least two separators; neither a date nor a span of numbers."""
    tail = F.when(F.startswith(text, F.lit("+")), F.substring(text, 2, 1_000)).otherwise(text)
    digits = F.translate(tail, "() .-\t", "")
    separators = F.length(tail) - F.length(F.translate(tail, " .-\t", ""))
    bracketed = F.length(tail) > F.length(F.translate(tail, "()", ""))
    groups, marks = F.split(text, "[^0-9]"), F.translate(text, "0123456789", "")
    longest = F.transform(groups, lambda g: F.length(g))
    date = (F.length(marks) == 2) & (F.translate(marks, "-./", "") == "") & F.get(longest, 0).between(1, 4) & F.get(longest, 1).between(1, 2) & F.get(longest, 2).between(1, 4)
    sides = F.transform(F.split(text, "-"), lambda part: F.trim(part))
    span = (F.size(sides) == 2) & F.forall(sides, lambda part: (F.translate(part, "0123456789.,:", "") == "") & part.rlike("^[0-9]"))
    return (
        digits.rlike("^[0-9]+$") & (F.length(digits) >= MIN_PHONE_DIGITS) & ((tail != text) | bracketed | (separators >= 2))
        & ~F.coalesce(date, F.lit(False)) & ~span
    )


def personal_value(col: Column) -> Column:
    """A mail address, a postal code or a phone number."""
    text = T.strip(col)
    shape = _shape(text)
    postal = shape.isin(*POSTAL_SHAPES, *(s.replace(" ", "") for s in POSTAL_SHAPES))
    return _is_mail(text) | postal | _is_phone(text)


def personal_header(header: Column) -> Column:
    """A header of plain words that names or locates a person."""
    padded = F.concat(F.lit(" "), header, F.lit(" "))
    phrases = [*PERSONAL_WORDS, *(f"{n}{gap}name" for n in NAMED for gap in ("", " "))]
    within = F.exists(F.array(*(F.lit(f" {p} ") for p in phrases)), lambda p: F.contains(padded, p))
    numbered = F.exists(F.split(header, " "), lambda w: (F.length(w) == 8) & F.startswith(w, F.lit("address")) & F.substring(w, 8, 1).between("0", "9"))
    return header.isin(*PEOPLE) | within | numbered


def personal_columns(counts: DataFrame) -> DataFrame:
    """Columns whose header or commonest values name or locate a person."""
    by_value = top_values(counts).groupBy("column").agg(F.bool_or(personal_value(F.col("value"))).alias("by_value"))
    spaced = F.regexp_replace(F.col("column"), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    header = F.trim(F.regexp_replace(F.lower(spaced), r"[\W_]+", " "))
    return by_value.select("column", personal_header(header).alias("by_header"), "by_value").withColumn(
        "personal", F.col("by_header") | F.col("by_value")
    )


def check_claims(claimed: DataFrame, profile: DataFrame, stats: DataFrame) -> DataFrame:
    """Claimed issue figures that contradict the profile: ``(column, code, problem)``.

    ``claimed`` is ``(column, code, count, pct)``, column null for the whole dataset.
    """
    joined = join_same(claimed.crossJoin(F.broadcast(stats)), profile.select("column", "null_count", "null_pct"), ["column"], "left")
    count, rows = F.col("count"), F.col("row_count")
    dataset = F.col("column").isNull()
    problem = (
        F.when(~dataset & F.col("null_count").isNull(), "unknown_column")
        .when(dataset & (count > rows * F.col("column_count")), "count_above_cells")
        .when(~dataset & (count > rows), "count_above_rows")
        .when(dataset & (F.col("code") == "duplicate_rows") & ~count.eqNullSafe(F.col("duplicate_rows")), "duplicate_rows_differs")
        .when((F.col("code") == "missing_values") & ~count.eqNullSafe(F.col("null_count")), "missing_values_differs")
        .when((F.col("code") == "all_null_column") & (F.col("null_count") != rows), "not_all_null")
        .when((F.col("code") == "all_null_column") & ~count.eqNullSafe(rows), "all_null_count_differs")
        .when(F.col("code").isin("missing_values", "all_null_column") & (F.abs(F.col("pct") - F.col("null_pct")) > 0.1), "pct_differs")
        .when(~dataset & ~F.col("code").isin("missing_values", "all_null_column") & F.col("pct").isNotNull(), "pct_must_be_null")
    )
    return joined.withColumn("problem", problem).filter("problem is not null").select("column", "code", "problem")
