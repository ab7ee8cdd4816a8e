"""Every registered query: ``name -> callable(spark, sf_dir)``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions import dates as D
from tillscope.functions import numbers as N
from tillscope.functions import text as T
from tillscope.operators import (
    classify, currency, customers, forecast, hypotheses, issues, lenses, members, metrics, movements, orders, periods, products,
    profile, report, signals, trust,
)
from tillscope.operators.ranking import join_same
from tillscope.plans.analysis import Analysis
from tillscope.plans.cleaning import CleaningPlan, Step, apply_action, dropped_rows_report, run_plan
from tillscope.plans.run import Outcome, Run, run_files
from tillscope.plans.sales_lines import Answers, Mapping, build_sales_lines
from tillscope.session import configure, materialize, shared_folder
from tillscope.sources.csv_text import read_text_csv
from tillscope.sources.extracts import sample_customers, union_extracts
from tillscope.sources.ledger import ANSWERS, MAPPING, ledger, read_table
from tillscope.sources.sinks import read_results, with_iso_dates, write_results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_KEPT: dict[tuple, object] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _once(spark: SparkSession, key: tuple, make):
    """The written fact tables are shared by the queries of one session."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _KEPT:
        _KEPT[full] = make()
    return _KEPT[full]


def analysis(spark: SparkSession, sf: str, *scope: str) -> Analysis:
    configure(spark)
    make = lambda: Analysis(build_sales_lines(ledger(spark, sf), MAPPING, list(scope), ANSWERS), list(scope))
    return _once(spark, ("analysis", sf, scope), make)


def ro(c: str, digits: int = 4):
    return (F.round(c, digits) + 0.0).alias(c)


def day(c: str):
    return F.to_date(c).alias(c)


def messy(spark: SparkSession, sf: str) -> DataFrame:
    """The orders table as an untyped extract with the dirt of a real one; every row kept."""
    configure(spark)
    k = F.col("o_orderkey")
    whole = F.floor("o_totalprice")
    written = F.concat((F.floor(whole / 1000)).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))
    price = (
        F.when(k % 7 == 0, F.concat(F.lit("$"), written, F.lit(".50"))).when(k % 7 == 1, F.concat(whole.cast("string"), F.lit(",25")))
        .when(k % 7 == 2, None).when(k % 7 == 3, "abc").when(k % 7 == 4, (-whole).cast("string")).when(k % 7 == 5, "0").otherwise(whole.cast("string")))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    date = (
        F.when(k % 10 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k % 10 == 1, F.date_format("o_orderdate", "dd.MM.yyyy"))
        .when(k % 10 == 2, "not a date").otherwise(iso))
    status = F.when(k % 9 == 0, F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).when(k % 8 == 1, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    priority = F.when(k % 11 == 0, F.replace("o_orderpriority", F.lit("-"), F.lit(" "))).otherwise(F.col("o_orderpriority"))
    qty = F.when(k % 5 == 0, None).when(k % 13 == 1, "x").otherwise((k % 17 - 2).cast("string"))
    return read_table(spark, sf, "orders").select(
        k.alias("line_no"), F.concat(F.lit("O"), (k % 500).cast("string")).alias("order_id"), date.alias("day"), price.alias("price"), qty.alias("qty"),
        status.alias("status"), priority.alias("priority"), F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@shop.test")).alias("contact"))


MESSY = ["order_id", "day", "price", "qty", "status", "priority", "contact"]


def messy_table(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, ("messy", sf), lambda: materialize(messy(spark, sf), "messy"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, ("counts", sf), lambda: materialize(profile.value_counts(messy_table(spark, sf), MESSY), "value-counts"))


# --- sources -------------------------------------------------------------------------------------


@query
def s1_read_text_csv(spark, sf):
    def make() -> DataFrame:
        path = f"{shared_folder(spark)}/csv-{dt.datetime.now().timestamp()}"
        messy(spark, sf).drop("line_no").write.option("header", "true").csv(path)
        return read_text_csv(spark, path)

    back = _once(spark, ("csv", sf), make)
    return back.agg(F.count("*").alias("row_count"), (F.max("line_no") + 1).alias("line_numbers"), F.countDistinct("line_no").alias("distinct_lines"),
                    *[F.count(c).alias(f"n_{c}") for c in MESSY])


@query
def s1_quoted_records(spark, sf):
    """Orders with notes that hold line breaks, blank lines, quotes and delimiters, every cell read back; files without any lie beside them."""
    def make() -> DataFrame:
        path = f"{shared_folder(spark)}/quoted-{dt.datetime.now().timestamp()}"
        o, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
        note = (F.when(k % 5 == 0, F.concat("o_orderpriority", F.lit("\n\n"), "o_orderstatus")).when(k % 5 == 1, F.concat(F.lit('say "'), "o_orderpriority", F.lit('",\nthen ""')))
                .when(k % 5 == 2, F.concat(F.lit("a,b;"), "o_orderstatus")).when(k % 5 == 3, F.concat("o_orderstatus", F.lit('5" wide'))).otherwise(F.col("o_orderpriority")))
        rows = o.select(k.cast("string").alias("key"), note.alias("note"), F.col("o_custkey").cast("string").alias("customer"))
        writer = lambda part: part.write.mode("append").option("header", "true").option("escape", '"')
        writer(rows.filter(k % 5 < 3)).csv(path)
        writer(rows.filter(k % 5 >= 3).select("customer", "note", "key")).option("sep", ";").csv(path)
        return read_text_csv(spark, path)

    back = _once(spark, ("quoted", sf), make)
    return back.select(F.col("key").cast("bigint").alias("order_key"), "note", F.col("customer").cast("bigint").alias("customer"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("key"), F.concat(F.lit("é"), F.col("o_orderkey") % 7).alias("label"), F.col("o_custkey").cast("string").alias("customer"))


@query
def s2_encodings(spark, sf):
    """One folder in two encodings: every file is read in its own."""
    def make() -> DataFrame:
        path = f"{shared_folder(spark)}/encodings-{dt.datetime.now().timestamp()}"
        rows = _labelled(spark, sf)
        for rest, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
            rows.filter(F.col("key") % 2 == rest).write.mode("append").option("header", "true").option("encoding", encoding).csv(path)
        return read_text_csv(spark, path, line_no=None)

    return _once(spark, ("encodings", sf), make).groupBy("label").agg(F.count("*").alias("orders"))


@query
def s3_delimiters(spark, sf):
    """One folder of files with four delimiters, one of them with its columns in another order; fields are matched by name."""
    def make() -> DataFrame:
        path = f"{shared_folder(spark)}/delimiters-{dt.datetime.now().timestamp()}"
        rows = _labelled(spark, sf)
        for rest, sep in enumerate((",", ";", "\t", "|")):
            part = rows.filter(F.col("key") % 4 == rest)
            (part.select("customer", "label", "key") if sep == ";" else part).write.mode("append").option("header", "true").option("sep", sep).csv(path)
        return read_text_csv(spark, path)

    back = _once(spark, ("delimiters", sf), make)
    return back.groupBy((F.col("key").cast("bigint") % 4).alias("file")).agg(
        F.count("*").alias("orders"), F.sum(F.col("customer").cast("bigint")).alias("customers"), F.countDistinct("line_no").alias("lines"))


@query
def s7_results_read_back(spark, sf):
    """A set of result tables published together and read through its manifest."""
    def make() -> str:
        path = f"{shared_folder(spark)}/results-{dt.datetime.now().timestamp()}"
        write_results({"core": analysis(spark, sf).core, "days": trust.trading_days(analysis(spark, sf).lines)}, path)
        return path

    return read_results(spark, _once(spark, ("results", sf), make), "core").select("month", "revenue", "orders")


@query
def s5_iso_dates(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "ts")
    lines = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"))
    return with_iso_dates(lines).unionByName(with_iso_dates(events)).groupBy(F.length("ts").alias("width")).agg(F.count("*").alias("cells"))


@query
def s8_union_extracts(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    old, new = o.filter("o_orderdate < timestamp_ntz'1999-03-01'"), o.filter("o_orderdate >= timestamp_ntz'1998-11-01'")
    both = union_extracts(old, new, "o_orderdate", "1999-03-01")
    return both.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.count("*").alias("orders"), F.countDistinct("o_orderkey").alias("order_keys"))


@query
def s9_sample_customers(spark, sf):
    a = analysis(spark, sf)
    return sample_customers(a.lines.select("customer", "order_id", "product_key", "amount"), 0.25, "customer", "order_id", ["sku:p1"], "product_key", 7)


# --- profiling -----------------------------------------------------------------------------------


@query
def p1_dataset_stats(spark, sf):
    return profile.dataset_stats(messy_table(spark, sf).select(MESSY[1:6])).select("row_count", "column_count", "duplicate_rows", ro("missing_cells_pct"))


@query
def p2_column_profile(spark, sf):
    return profile.column_profile(counts(spark, sf)).select("column", "null_count", ro("null_pct"), "unique_count", "is_numeric")


@query
def p3_numeric_stats(spark, sf):
    """All-number columns and their quartiles, over the ledger's figures as text."""
    item = read_table(spark, sf, "lineitem").select(*[F.col(c).cast("string").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")])
    out = profile.column_profile(profile.value_counts(item))
    return out.select("column", "is_numeric", *[ro(c) for c in ("min_value", "max_value", "mean_value", "median", "q1", "q3")])


@query
def p5_top_values(spark, sf):
    return profile.top_values(counts(spark, sf)).select("column", "value", "n", F.col("position").cast("long").alias("position"))


@query
def p6_sample_values(spark, sf):
    return profile.sample_values(messy_table(spark, sf), ["day", "price"])


@query
def p7_date_order(spark, sf):
    e = profile.applied_order(profile.date_order_evidence(counts(spark, sf)))
    return e.select("column", "shaped", "day_first", "month_first", "ambiguous", "decision", "applied")


@query
def p8_number_formats(spark, sf):
    return profile.number_format_evidence(counts(spark, sf)).filter(F.col("column").isin("price", "qty")).select(
        "column", "readable", "plain", "point", "comma", "ambiguous", "signed_currency", "unreadable", "decision")


@query
def p9_column_kinds(spark, sf):
    return profile.column_kinds(counts(spark, sf)).select("column", "present", "numeric", "dates", "padded", "has_utc_offset", "mostly_numeric", "mostly_dates")


@query
def p10_cell_masks(spark, sf):
    m = profile.cell_masks(messy_table(spark, sf), "day")
    return m.select("line_no", "is_present", "is_number", "is_date", "is_not_date", "has_padding")


@query
def p11_date_shapes(spark, sf):
    return profile.date_shapes(counts(spark, sf))


@query
def p13_iqr_fences(spark, sf):
    item = read_table(spark, sf, "lineitem").select(F.col("l_quantity").cast("string").alias("l_quantity"), F.col("l_extendedprice").cast("string").alias("l_extendedprice"))
    return profile.iqr_fences(profile.value_counts(item)).select("column", ro("low"), ro("high"))


@query
def p14_spellings(spark, sf):
    return profile.dominant_spellings(counts(spark, sf).filter(F.col("column").isin("status", "priority")))


@query
def p15_identity_merges(spark, sf):
    return profile.identity_merges(counts(spark, sf)).filter(F.col("column").isin("status", "priority", "order_id", "contact"))


@query
def l15_personal_columns(spark, sf):
    return profile.personal_columns(counts(spark, sf)).select("column", "by_header", "by_value", "personal")


@query
def t3_rewrite_numbers(spark, sf):
    out, _ = profile.rewrite_numbers(messy_table(spark, sf), ["price"], {"price": "decimal_point"})
    return out.select("line_no", F.col("price"))


@query
def t5_read_dates(spark, sf):

    return messy_table(spark, sf).select("line_no", F.to_date(D.read_date(F.col("day"), F.lit("day_first"))).alias("read"))


def _written_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates in eight shapes, by key; some with a time of day or a zone."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    of = lambda pattern: F.date_format(d, pattern)
    shapes = (of("d-MMM-yy"), of("d MMM yyyy"), of("EEE MMM dd yyyy"), F.concat(of("EEEE"), F.lit(", "), of("d MMMM yyyy")), F.concat(F.lit("10.30.00 "), of("dd/MM/yy")),
              F.concat(of("yyyy-MM-dd"), F.lit("T10:30:00+02:00")), F.concat(of("MMMM d, yyyy"), F.lit(" 3:05 PM")), F.concat(of("yyyyMMdd"), F.lit("T101500Z")))
    cell = shapes[-1]
    for rest, shape in enumerate(shapes[:-1]):
        cell = F.when(k % 8 == rest, shape).otherwise(cell)
    return read_table(spark, sf, "orders").select(k.alias("line_no"), cell.alias("written"))


@query
def t5_written_shapes(spark, sf):
    return _written_dates(spark, sf).select("line_no", D.read_date(F.col("written"), F.lit("day_first")).cast("string").alias("read"))


@query
def t7_utc_offsets(spark, sf):
    return _written_dates(spark, sf).groupBy((F.col("line_no") % 8).alias("shape")).agg(F.count_if(D.has_utc_offset(F.col("written"))).alias("offsets"))


@query
def x11_written_format(spark, sf):
    """A plan's own format, of percent directives: the lines of the whole table that it reads."""
    return x11_written_format_marks(spark, sf).filter("day is not null").select("line_no", "day")


@query
def x11_written_format_marks(spark, sf):
    """The same on every line: the day read, and the mark of a cell the format does not read."""
    out = apply_action(messy_table(spark, sf).select("line_no", "day"), "parse_datetime", "day", {"format": "%d/%m/%Y"})[0]
    return out.select("line_no", F.to_date("day").alias("day"), F.col("__flag_invalid_date__day").alias("invalid_date"))


@query
def t9_first_misread(spark, sf):
    return profile.first_misread(messy_table(spark, sf), "day", "day_first", "MM/dd/yyyy").select("line_no", "cell", day("format_reads"), day("order_reads"))


@query
def t10_month_grain(spark, sf):
    return profile.month_grain(analysis(spark, sf).lines.filter("counted"), "txn_ts")


@query
def n_text_identities(spark, sf):
    c = F.col("status")
    m = messy_table(spark, sf)
    return m.select("line_no", T.is_blank(c).alias("blank"), T.identifier_text(c).alias("identifier"), T.category_key(c).alias("category"),
                    T.product_text(F.col("priority")).alias("product"), T.label_key(F.col("priority")).alias("label"), T.title_case(F.col("priority")).alias("title"))


@query
def n10_value_shapes(spark, sf):
    c = F.col("value")
    return counts(spark, sf).filter("value is not null").groupBy("column").agg(
        F.sum(F.when(T.is_number_like(c), F.col("n")).otherwise(0)).alias("number_like"),
        F.sum(F.when(T.is_period_like(c), F.col("n")).otherwise(0)).alias("period_like"),
        F.sum(F.when(T.is_time_like(c), F.col("n")).otherwise(0)).alias("time_like"))


@query
def n_document_words(spark, sf):
    """The readings over whole prose texts: blank lines, shown length, class words at an end."""
    d = read_table(spark, sf, "documents")
    shown = T.product_text(F.col("text"))
    return d.select("lang", T.is_blank(F.col("text")).alias("blank"), F.length(shown).alias("shown"), classify.class_word(T.fold(shown)).alias("word")).groupBy("lang").agg(
        F.count("*").alias("texts"), F.count_if("blank").alias("blank_texts"), F.sum("shown").alias("shown_chars"), F.count("word").alias("worded"))


# --- issues --------------------------------------------------------------------------------------


@query
def c15_issue_counts(spark, sf):
    return issues.issue_counts(counts(spark, sf), issues.duplicate_key_rows(messy_table(spark, sf), ["order_id", "status"]))


@query
def c16_reconcile(spark, sf):
    claimed = counts(spark, sf).groupBy("column").agg(F.count("*").alias("count")).crossJoin(
        F.broadcast(spark.createDataFrame([(c,) for c in ("negative_values", "trailing_whitespace", "near_duplicate_labels", "missing_values", "duplicate_rows")], "code string"))
    ).withColumn("semantic_type", F.when(F.col("column") == "priority", "categorical_nominal").otherwise("identifier"))
    return issues.reconcile(claimed, issues.issue_counts(counts(spark, sf)))


@query
def c17_reads_as_missing(spark, sf):
    return issues.reads_back_as_missing(read_table(spark, sf, "pages").select("url", "html"), ["url", "html"])


def _marked(spark, sf) -> DataFrame:
    return _once(spark, ("marked", sf), lambda: materialize(issues.problem_marks(messy_table(spark, sf), MESSY[1:6], ["price", "qty"], ["day"]), "marked"))


@query
def c18_problem_marks(spark, sf):
    return _marked(spark, sf).select("line_no", *issues.PROBLEMS)


@query
def c19_first_problem_rows(spark, sf):
    return issues.first_rows_per_problem(_marked(spark, sf), 40).select("kind", "line_no", F.col("position").cast("long").alias("position"))


@query
def c19_stratified_sample(spark, sf):
    return issues.stratified_sample(_marked(spark, sf), 500, 40, 0.5).select("line_no", "day", "price")


def _cleaned(spark, sf):
    plan = CleaningPlan(
        dataset=(Step("flag_duplicate_keys", None, {"keys": ["order_id", "status"]}),),
        columns=(Step("drop_rows_missing", "price"), Step("trim_whitespace", "status"), Step("normalize_case", "status", {"mode": "upper"}),
                 Step("cast_type", "qty", {"target": "integer"}), Step("impute_constant", "priority", {"value": "none"}),
                 Step("standardize_categories", "priority", {"mapping": {"1 URGENT": "1-URGENT", "5 LOW": "5-LOW"}}),
                 Step("fix_negative", "qty", {"strategy": "abs"}), Step("flag_only", "contact")))
    return _once(spark, ("cleaned", sf), lambda: run_plan(messy_table(spark, sf), plan, write=True))


@query
def x22_cleaned_frame(spark, sf):
    out = _cleaned(spark, sf)[0]
    return out.select("line_no", "status", "priority", "qty", F.col("__flag_cast_failed__qty").alias("qty_failed"), F.col("__flag_duplicate_key").alias("duplicate_key"))


def _text_run(spark: SparkSession, sf: str) -> Outcome:
    """The ledger written as text with day-first dates and sums like €12,00, and run from its files."""
    def make() -> Outcome:
        configure(spark)
        path = f"{shared_folder(spark)}/ledger-{dt.datetime.now().timestamp()}"
        # The lines of an invoice stand together, as a till writes them; nothing is sorted across files.
        text = ledger(spark, sf).sortWithinPartitions("order_id", "line_no").drop("line_no", "nation").withColumns({
            "txn": F.date_format("txn", "dd/MM/yyyy"), "quantity": F.col("quantity").cast("long").cast("string"),
            "unit_price": F.concat(F.lit("€"), F.col("unit_price").cast("long").cast("string"), F.lit(",00"))})
        text.write.option("header", "true").option("compression", "gzip").csv(path)
        told = [("line_class", f"{f}:{v}", c) for f, v, c in ANSWERS.line_classes] + [("placeholder", v, "yes") for v in ANSWERS.customer_placeholders]
        return run_files(spark, path, Run(MAPPING, CleaningPlan(columns=(Step("trim_whitespace", "kind"),)), tuple(told)))

    return _once(spark, ("text-run", sf), make)


@query
def x22_run_lines(spark, sf):
    """Classed lines of a run from written text."""
    lines = _text_run(spark, sf).lines
    return lines.groupBy("line_class", "class_source", "month").agg(
        F.count("*").alias("lines"), F.sum("amount").alias("amount"), F.countDistinct("customer").alias("customers"), F.countDistinct("product_key").alias("products"))


@query
def x22_run_decisions(spark, sf):
    """What the run decided, on whose word."""
    return _text_run(spark, sf).decisions.groupBy("question", "answer", "source").agg(F.count("*").alias("subjects"))


@query
def x22_open_questions(spark, sf):
    """Products nobody decided about and walk-in values still to be told."""
    return _text_run(spark, sf).open_questions.select("question", "subject", "hint")


@query
def x26_change_log(spark, sf):
    _cleaned(spark, sf)
    return _cleaned(spark, sf)[1].select("action", "column", "cells", "rows")


@query
def c20_plan_diff(spark, sf):
    d = issues.plan_diff(messy_table(spark, sf), _cleaned(spark, sf)[0])
    return d.select("line_no", "dropped", F.array_join(F.array_sort("changed"), ",").alias("changed"))


@query
def c21_rows_to_show(spark, sf):
    return issues.rows_to_show(issues.plan_diff(messy_table(spark, sf), _cleaned(spark, sf)[0]), 20).select("line_no", "priority")


@query
def c22_column_deltas(spark, sf):
    out = _cleaned(spark, sf)[0].select("line_no", *MESSY)
    return issues.column_deltas(messy_table(spark, sf), out).select("column", ro("null_pct_before"), "unique_before", ro("null_pct_after"), "unique_after")


@query
def c23_first_positions(spark, sf):
    return issues.first_positions(messy_table(spark, sf), F.col("price").isNull(), 25)


@query
def c24_check_claims(spark, sf):
    stats = profile.dataset_stats(messy_table(spark, sf).select(MESSY[1:6]))
    prof = profile.column_profile(counts(spark, sf))
    claimed = prof.select("column", F.lit("missing_values").alias("code"), (F.col("null_count") + F.when(F.col("column") == "qty", 1).otherwise(0)).alias("count"),
                          F.when(F.col("column") == "price", 0.0).otherwise(F.col("null_pct")).alias("pct"))
    return profile.check_claims(claimed, prof, stats)


# --- single cleaning actions ---------------------------------------------------------------------


def _action(name: str, action: str, column: str | None, params: dict | None = None, shows: str | None = None) -> None:
    def run(spark, sf):
        out, _ = apply_action(messy_table(spark, sf), action, column, params)
        flags = [c for c in out.columns if c.startswith("__flag_")]
        cells = [F.col(shows or column).cast("string").alias("cell")] if (shows or column) in out.columns else [F.lit(len(out.columns)).alias("columns_left")]
        return out.select("line_no", *cells, *[F.col(f"`{f}`").alias("flag") for f in flags])

    run.__name__ = name
    query(run)


for _spec in (
    ("x3_impute_mode", "impute_mode", "qty", {}), ("x4_impute_constant", "impute_constant", "price", {"value": "0"}),
    ("x5_drop_rows_missing", "drop_rows_missing", "qty", {}), ("x6_drop_column", "drop_column", "contact", {}),
    ("x8_trim_whitespace", "trim_whitespace", "status", {}), ("x9_normalize_case", "normalize_case", "priority", {"mode": "title"}),
    ("x10_standardize", "standardize_categories", "priority", {"mapping": {"1 URGENT": "1-URGENT", "3 MEDIUM": "3-MEDIUM"}}),
    ("x11_parse_datetime", "parse_datetime", "day", {"dayfirst": True}), ("x12_cast_integer", "cast_type", "qty", {"target": "integer"}),
    ("x13_fix_negative_drop", "fix_negative", "qty", {"strategy": "drop"}), ("x13_fix_negative_flag", "fix_negative", "price", {"strategy": "flag"}),
    ("x15_flag_duplicate_keys", "flag_duplicate_keys", None, {"keys": ["order_id", "status"]}, "order_id"),
):
    _action(*_spec)


def _figures(spark, sf) -> DataFrame:
    configure(spark)
    p = F.col("p_partkey")
    return read_table(spark, sf, "part").select(p.alias("line_no"), F.when(p % 6 != 0, F.col("p_retailprice")).alias("price"), "p_brand")


@query
def x1_impute_median(spark, sf):
    return apply_action(_figures(spark, sf), "impute_median", "price")[0].select("line_no", ro("price"))


@query
def x2_impute_mean(spark, sf):
    return apply_action(_figures(spark, sf), "impute_mean", "price")[0].select("line_no", ro("price"))


@query
def x7_remove_duplicates(spark, sf):
    item = read_table(spark, sf, "lineitem").select(F.col("_metadata.row_index").alias("line_no"), "l_suppkey", "l_quantity", "l_returnflag")
    return apply_action(item, "remove_exact_duplicates")[0].select("l_suppkey", "l_quantity", "l_returnflag", "line_no")


@query
def x14_clip_outliers(spark, sf):
    return apply_action(_figures(spark, sf), "clip_outliers_iqr", "price", {"k": 0.2})[0].select("line_no", ro("price"))


@query
def x24_dropped_rows(spark, sf):
    return dropped_rows_report(_cleaned(spark, sf)[1])


@query
def r6_not_after(spark, sf):
    """Lines dated by the day before an upload, a clock fourteen hours ahead included, or not dated at all."""
    cutoff = periods.upload_cutoff(dt.datetime(1998, 1, 1, 11, 0))
    return periods.not_after(analysis(spark, sf).lines, cutoff).agg(F.count("*").alias("lines"), F.max("txn_day").alias("latest"))


@query
def x23_duplicate_effect(spark, sf):
    """What removing equal rows of the ledger would take; equality ignores the line's number."""
    def make() -> DataFrame:
        raw = ledger(spark, sf).drop("nation", "segment", "kind")
        keep = raw.groupBy(*[c for c in raw.columns if c != "line_no"]).agg(F.min("line_no").alias("line_no"), F.count("*").alias("copies"))
        fields = {k: v for k, v in MAPPING.fields.items() if v != "kind"}
        return build_sales_lines(keep, type(MAPPING)(fields, ("copies",)), [], ANSWERS, suggest=False)

    return metrics.duplicate_effect(_once(spark, ("dups", sf), make))


# --- classification, orders, products ------------------------------------------------------------


@query
def l2_composed_names(spark, sf):
    """Lines whose product, customer, category and order are written with letter and accent as one character or as two, some with
    an invisible character between: one identity each."""
    def make() -> DataFrame:
        configure(spark)
        item, order = read_table(spark, sf, "lineitem"), read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        accented = lambda text, k: F.concat(F.lit(text), F.when(k % 3 == 0, "\u00e9").when(k % 3 == 1, "e\u0301").otherwise("e\u200b\u0301"))
        ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
        rows = item.join(order, ok == F.col("o_orderkey")).select(
            (ok * 8 + ln).alias("line_no"), F.col("o_orderdate").alias("txn"), F.col("l_quantity").cast("double").alias("quantity"), F.lit(2.0).alias("unit_price"),
            F.concat(accented("Caf", ok + ln), F.lit(" "), (F.col("l_partkey") % 40).cast("string")).alias("product"),
            F.concat(F.when(ln % 2 == 0, "\u00c9").otherwise("E\u0301"), F.lit("ve "), (F.col("o_custkey") % 30).cast("string")).alias("who"),
            accented("Soir", ln).alias("kind"), F.concat(accented("N", ln), ok.cast("string")).alias("receipt"))
        mapping = Mapping({"transaction_date": "txn", "quantity": "quantity", "unit_price": "unit_price", "product_name": "product", "category": "kind",
                           "customer": "who", "order_id": "receipt"})
        answers = Answers(line_classes=(("product_name", "Cafe\u0301 7", "charge"),), customer_placeholders=("E\u0301VE 3",))
        return build_sales_lines(rows, mapping, [], answers)

    lines = _once(spark, ("accented", sf), make)
    return lines.groupBy("item_key", "line_class", "category_key").agg(
        F.count("*").alias("lines"), F.countDistinct("customer_written").alias("customers"), F.count_if("placeholder").alias("placeholders"),
        F.countDistinct("order_id").alias("orders"), F.countDistinct("product_name").alias("spellings"), F.min("product_label_text").alias("shown"))


@query
def l2_line_classes(spark, sf):
    return analysis(spark, sf).lines.groupBy("line_class", "class_source").agg(F.count("*").alias("lines"), F.sum("amount").alias("amount"))


@query
def l6_candidates(spark, sf):
    def make():
        a = analysis(spark, sf).lines
        return materialize(classify.non_product_candidates(a), "candidates")

    return _once(spark, ("cand", sf), make).select("item_key", "field", "value", "name", "lines", "positive", "negative", "suggested")


@query
def l7_suggestions(spark, sf):
    return analysis(spark, sf).lines.filter("suggested_class is not null").groupBy("suggested_class", "line_class").agg(F.count("*").alias("lines"))


@query
def l9_line_masks(spark, sf):
    masks = ("counted", "sale", "returned", "charge", "deduction", "left_out")
    joined = analysis(spark, sf).lines.groupBy("line_class").agg(*[F.count_if(F.col(m)).alias(m) for m in masks], F.sum("units").alias("units"))
    effects = classify.effects_table(spark).select("line_class", "term", "reported")
    return joined.join(F.broadcast(effects), "line_class", "left")


@query
def l10_class_violations(spark, sf):
    """A file's own type column read as a class column: every value outside the closed list is reported."""
    lines = analysis(spark, sf).lines.withColumn("line_class", F.coalesce(F.nullif("transaction_type", F.lit("in")), F.col("line_class")))
    return classify.class_violations(lines)


@query
def l11_placeholders(spark, sf):
    c = customers.placeholder_candidates(analysis(spark, sf).lines)
    return c.select("customer", "lines", ro("lines_pct"), ro("revenue_pct"), "why")


@query
def l12_unanswered_placeholders(spark, sf):
    c = customers.placeholder_candidates(analysis(spark, sf).lines)
    return customers.unanswered_placeholders(c, ["Walk-In "], []).select("customer", "lines")


@query
def l13_currency(spark, sf):
    return currency.currency_finding(messy_table(spark, sf), ["price"])[0].select("kind", "code", F.size("candidates").cast("long").alias("candidates"), "unreadable")


@query
def l13_currency_parts(spark, sf):
    return currency.currency_finding(messy_table(spark, sf), ["price"])[1]


@query
def o1_spanning_ids(spark, sf):
    return orders.spanning_ids(analysis(spark, sf).lines.withColumn("customer", F.col("customer_written")))


@query
def c14_order_id_issue(spark, sf):
    """The order ids tried as order ids, and so is a column that names no order."""
    a = analysis(spark, sf).lines.withColumn("customer", F.col("customer_written"))
    tried = [issues.order_id_issue(orders.spanning_ids(a.withColumn("order_id", F.col(c))), c) for c in ("order_id", "category_key")]
    return tried[0].unionByName(tried[1])


@query
def o5_order_basis(spark, sf):
    a = analysis(spark, sf).lines.withColumn("customer", F.when(~F.col("placeholder"), F.col("customer_written")))
    r = orders.receipt_lines(a, [])
    f = orders.order_id_facts(r, orders.receipt_fills(r, []), [])
    d = orders.order_decisions(a, f, [], True, None)
    return d.select("orders_basis", "orders_reason", "date_only_reason", "ids", "spanning", "blank_ids", "moved_lines")


@query
def o5_order_basis_by_shipdate(spark, sf):
    """With the ship date as the date most ids span days, so the figures count lines."""
    def make():
        return build_sales_lines(ledger(spark, sf, "l_shipdate"), MAPPING, [], ANSWERS, suggest=False)

    lines = _once(spark, ("shipped", sf), make)
    return lines.groupBy("orders_basis", "orders_reason").agg(F.count("*").alias("lines"), F.countDistinct(F.when(F.col("sale"), F.col("order_key"))).alias("orders"))


@query
def o6_orders(spark, sf):
    a = analysis(spark, sf)
    return orders.count_orders(a.lines, ["month"], F.col("sale"))


@query
def o8_order_checks(spark, sf):
    return orders.order_checks(analysis(spark, sf).lines).select("fillable_lines", "spanning", "ids")


@query
def o10_first_purchases(spark, sf):
    return analysis(spark, sf).first_purchases


@query
def r1_product_keys(spark, sf):
    return analysis(spark, sf).lines.groupBy("product_key", "netting_key").agg(F.count("*").alias("lines"))


@query
def n8_numbered_labels(spark, sf):
    """Customers of a nation as products named by their market segment, some as if they were numbered already."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    number = F.concat(F.lit(" ("), (key % 41 + 1).cast("string"), F.lit(")"))
    shown = F.when(key % 9 == 0, F.concat(F.lower(segment), number, F.lit(" (2)"))).when(key % 3 == 0, F.concat(segment, number)).otherwise(segment)
    lines = read_table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation"), key.cast("string").alias("product_key"), key.alias("line_no"), F.lit(None).cast("string").alias("sku_label_text"),
        F.lit(True).alias("sale"), shown.alias("product_label_text"), F.lit(None).cast("date").alias("txn_ts"))
    return products.product_labels(lines, ["nation"])


@query
def r3_product_labels(spark, sf):
    return analysis(spark, sf).labels


@query
def r4_product_suggestions(spark, sf):
    return products.product_suggestions(analysis(spark, sf).lines)


@query
def r5_period(spark, sf):
    return analysis(spark, sf).period.select("data_start", "data_end", "current", "previous", "first_sale", "leading_days_missing", "previous_complete", "month_grain")


@query
def r5_period_by_nation(spark, sf):
    return analysis(spark, sf, "nation").period.select("nation", "data_start", "data_end", "current", "previous", "first_sale", "previous_complete")


@query
def r7_future_lines(spark, sf):
    return periods.future_lines(analysis(spark, sf).lines, dt.date(2000, 12, 31))


@query
def r9_complete_months(spark, sf):
    return analysis(spark, sf).complete


@query
def r10_partial_months(spark, sf):
    return periods.partial_months(analysis(spark, sf).period)


@query
def r11_months_with_rows(spark, sf):
    return analysis(spark, sf).rows.select("month", "lines", "blank_customers")


# --- metrics -------------------------------------------------------------------------------------


CORE = ("revenue", "money_moved", "units", "orders", "return_orders", "gross_sales", "returns", "deductions", "charges", "refund_lines", "active_customers", "buyers")


@query
def m1_monthly_core(spark, sf):
    return analysis(spark, sf).core.select("month", *CORE, ro("aov"), ro("return_rate", 6))


@query
def m1_monthly_core_by_nation(spark, sf):
    return analysis(spark, sf, "nation").core.select("nation", "month", *CORE, ro("aov"))


@query
def m3_kpis(spark, sf):
    a = analysis(spark, sf)
    return metrics.kpis(a.core, a.period).select("kpi", ro("current_value"), ro("previous_value"), ro("change"), ro("change_pct"), "reason")


@query
def m7_undated_lines(spark, sf):
    return metrics.undated_lines(analysis(spark, sf).lines)


@query
def m8_non_product_lines(spark, sf):
    a = analysis(spark, sf)
    return metrics.non_product_lines(a.lines, a.period)


@query
def m9_revenue_identity(spark, sf):
    a = analysis(spark, sf)
    return metrics.revenue_identity(a.classes, a.period)


@query
def m9_identity_violations(spark, sf):
    a = analysis(spark, sf, "nation")
    return metrics.identity_violations(metrics.revenue_identity(a.classes, a.period, ["nation"])).select("nation", "figure_scope")


@query
def m10_outside_revenue(spark, sf):
    a = analysis(spark, sf)
    return metrics.outside_revenue(a.classes, a.period)


@query
def m11_unclassified(spark, sf):
    return metrics.unclassified(analysis(spark, sf).classes)


@query
def m12_unmeasurable(spark, sf):
    a = analysis(spark, sf)
    return metrics.unmeasurable(a.lines, a.period)


@query
def m13_same_day_cancellations(spark, sf):
    a = analysis(spark, sf)
    return metrics.same_day_cancellations(a.lines, a.period)


@query
def m14_returns_booked_as_in(spark, sf):
    a = analysis(spark, sf)
    return metrics.returns_booked_as_in(a.classes, a.period)


@query
def m15_unconfirmed_suggestions(spark, sf):
    a = analysis(spark, sf)
    return metrics.unconfirmed_suggestions(a.lines, a.period)


@query
def m16_unconfirmed_deductions(spark, sf):
    a = analysis(spark, sf)
    return metrics.unconfirmed_deductions(a.classes, a.period)


@query
def m17_other_types(spark, sf):
    a = analysis(spark, sf)
    return metrics.other_transaction_types(a.lines, a.period)


@query
def m18_note_figures(spark, sf):
    """The figures each note touches, for the notes this ledger raises."""
    a = analysis(spark, sf)
    raised = metrics.other_transaction_types(a.lines, a.period).select(F.lit("other_transaction_types").alias("code")).unionByName(
        metrics.returns_booked_as_in(a.classes, a.period).select(F.lit("returns_booked_as_in").alias("code"))).distinct()
    return metrics.note_figures(spark).join(F.broadcast(raised), "code")


def _rfm(spark, sf, at="current"):
    a = analysis(spark, sf)
    return _once(spark, ("rfm", sf, at), lambda: materialize(customers.rfm(a.lines, a.period, [], at), "rfm"))


@query
def m19_rfm(spark, sf):
    return _rfm(spark, sf).select("customer", day("last_purchase"), "recency_days", "frequency", "monetary", F.col("r_score").cast("long").alias("r_score"),
                                  F.col("f_score").cast("long").alias("f_score"), "segment")


@query
def m22_segments(spark, sf):
    a = analysis(spark, sf)
    return customers.segment_summary(_rfm(spark, sf), _rfm(spark, sf, "previous"), a.period).select(
        "segment", "customers", ro("revenue_share_pct"), ro("avg_monetary", 2), "customers_previous")


@query
def m23_new_vs_returning(spark, sf):
    a = analysis(spark, sf)
    return customers.new_vs_returning(a.lines, a.period, [], a.first_purchases)


@query
def m24_placeholder_lines(spark, sf):
    return metrics.placeholder_lines(analysis(spark, sf).lines)


@query
def m24_unconfirmed_placeholders(spark, sf):
    a = analysis(spark, sf)
    frequent = a.lines.filter("counted and customer is not null").groupBy("customer").agg(F.count("*").alias("n")).filter("n >= 60").select("customer")
    return metrics.unconfirmed_placeholders(a.lines, a.period, frequent)


@query
def m25_pareto(spark, sf):
    return movements.pareto(analysis(spark, sf).product_months).select("products_for_80pct", "total_products", ro("concentration_pct"))


@query
def m25_pareto_by_nation(spark, sf):
    return movements.pareto(analysis(spark, sf, "nation").product_months, ["nation"]).select("nation", "products_for_80pct", "total_products")


@query
def m26_top_products(spark, sf):
    a = analysis(spark, sf)
    return movements.top_products(a.product_months, a.labels).select(F.col("rank").cast("long").alias("rank"), "product_label", "revenue", "units")


@query
def m27_decliners(spark, sf):
    a = analysis(spark, sf)
    return movements.decliners(a.product_months, a.labels, a.period).select(F.col("rank").cast("long").alias("rank"), "product_label", "revenue_change", ro("change_pct"), "reason")


@query
def m28_categories(spark, sf):
    a = analysis(spark, sf)
    return movements.category_changes(a.lines, a.period).select("category_key", "revenue_current", "revenue_previous", ro("contribution_pct"))


@query
def m29_breakdown(spark, sf):
    a = analysis(spark, sf)
    return movements.breakdown(a.lines, a.period, "segment").select("kind", "member", "revenue_current", "revenue_previous", "change", "withheld")


@query
def m29_breakdown_folded(spark, sf):
    a = analysis(spark, sf)
    wide = a.lines.withColumn("brand", F.concat(F.lit("B"), (F.length("product_label_text") * 7 + F.ascii("product_label_text")).cast("string")))
    return movements.breakdown(wide, a.period, "brand").select("kind", "member", "revenue_current", "revenue_previous")


@query
def m30_split_values(spark, sf):
    a = analysis(spark, sf)
    s = movements.split_values(a.lines, "priority", fill=True)
    return s.groupBy("split_key", "first_line_only").agg(F.count("*").alias("lines"))


@query
def m31_breakdown_measures(spark, sf):
    a = analysis(spark, sf)
    return movements.breakdown_measures(a.lines, "priority").select("column", "first_line_only", "value_count", "units", "blank_units", "purchases", "sale_or_return").unionByName(
        movements.breakdown_measures(a.lines, "segment").select("column", "first_line_only", "value_count", "units", "blank_units", "purchases", "sale_or_return"))


@query
def m35_eligible_columns(spark, sf):
    a = analysis(spark, sf)
    c = profile.value_counts(a.lines, ["priority", "segment", "quantity", "order_id"])
    measures = movements.breakdown_measures(a.lines, "priority").unionByName(movements.breakdown_measures(a.lines, "segment"))
    types = c.select("column").distinct().withColumn("semantic_type", F.lit("categorical_nominal"))
    out = movements.eligible_columns(profile.column_profile(c), profile.column_kinds(c), profile.personal_columns(c), types, measures)
    return out.select("column", "eligible", "refusal")


@query
def m32_line_summary(spark, sf):
    a = analysis(spark, sf)
    return metrics.revenue_identity(a.classes, a.period).filter("figure_scope = 'file'").crossJoin(F.broadcast(metrics.undated_lines(a.lines)))


@query
def m32_file_summary(spark, sf):
    """Every row said about the lines, for the file and the compared months."""
    a = analysis(spark, sf)
    return metrics.line_summary(a.lines, a.classes, a.period)


@query
def m34_trend(spark, sf):
    a = analysis(spark, sf)
    return metrics.monthly_trend(a.core, a.complete).select("month", "revenue", "orders", "complete", "is_gap")


# --- trust ---------------------------------------------------------------------------------------


@query
def d1_trading_pace(spark, sf):
    return trust.trading_pace(trust.trading_days(analysis(spark, sf).lines)).select("month", "trading_days", ro("revenue_per_day", 2))


def _zeros(spark, sf):
    """Per nation: shops of that size do have days without a sale."""
    a = analysis(spark, sf, "nation")
    return trust.zero_days(a.history, trust.trading_days(a.lines, ["nation"]), ["nation"])


@query
def d2_zero_days(spark, sf):
    return _zeros(spark, sf).select("nation", "month", F.col("weekday").cast("long").alias("weekday"), "days", "zeros")


@query
def d3_weekday_rates(spark, sf):
    return trust.weekday_zero_rates(_zeros(spark, sf), ["nation"]).select("nation", F.col("weekday").cast("long").alias("weekday"), "zeros", "days", ro("zero_rate", 6))


@query
def d3_expected_zero_days(spark, sf):
    e = trust.expected_zero_days(_zeros(spark, sf), ["nation"])
    return e.select("nation", "month", "observed", ro("pattern"), ro("expected"))


@query
def d4_leave_one_out(spark, sf):
    e = trust.leave_one_out_excess(_zeros(spark, sf), ["nation"])
    return e.select("nation", "month", "observed", ro("pattern"), ro("season"), ro("excess"))


@query
def d7_coverage_by_nation(spark, sf):
    return analysis(spark, sf, "nation").coverage


@query
def d9_price_medians(spark, sf):
    a = analysis(spark, sf, "nation")
    wide = a.lines.withColumn("product_key", F.col("category_key"))
    return trust.price_medians(wide, a.period, ["nation"]).select("nation", "slot", F.col("product_key").alias("category"), ro("median_price"), "n")


@query
def d9_price_level(spark, sf):
    a = analysis(spark, sf, "nation")
    wide = a.lines.withColumn("product_key", F.col("category_key"))
    return trust.price_level_check(wide, a.period, ["nation"]).select("nation", "status", "comparable_products", ro("median_ratio", 6), ro("share_extreme", 6))


@query
def d10_flagged_rows(spark, sf):
    a = analysis(spark, sf)
    flagged = a.lines.withColumn("__flag_no_sku", F.col("sku").isNull().cast("string"))
    return trust.flag_check(flagged, a.period, ["__flag_no_sku"]).select("status", ro("flagged_share_cur", 6), ro("flagged_share_prev", 6))


@query
def d11_uncategorised(spark, sf):
    a = analysis(spark, sf)
    return trust.uncategorised_share(a.lines, a.period).select("slot", ro("uncategorised_share", 6))


@query
def d12_verdict_by_nation(spark, sf):
    return analysis(spark, sf, "nation").verdict


# --- calendar and signals ------------------------------------------------------------------------


@query
def g1_history(spark, sf):
    return analysis(spark, sf).history


@query
def g2_weekday_weights(spark, sf):
    a = analysis(spark, sf)
    return signals.weekday_weights(a.lines, a.history).select(F.col("weekday").cast("long").alias("weekday"), ro("weight"), "dates")


@query
def g3_calendar_effect(spark, sf):
    return analysis(spark, sf).calendar.select("method", ro("expected_cur"), ro("expected_prev"), ro("calendar_effect", 2), ro("adjusted_change", 2))


@query
def g4_monthly_series(spark, sf):
    return analysis(spark, sf).series.select("month", "series", ro("value"))


@query
def g5_year_over_year(spark, sf):
    a = analysis(spark, sf)
    return signals.year_over_year(a.series, a.history).select("series", "month", ro("yoy"))


@query
def g8_signals(spark, sf):
    return analysis(spark, sf).signals.select("series", "mode", ro("value_cur"), ro("center"), ro("lower", 3), ro("upper", 3), "signal", "limits_method")


@query
def g8_signals_by_nation(spark, sf):
    return analysis(spark, sf, "nation").signals


@query
def g9_movement(spark, sf):
    return analysis(spark, sf).movement.select(ro("change_pct"), ro("typical_pct"), "movements", "singled_out", "reason")


@query
def g10_season_comparison(spark, sf):
    a = analysis(spark, sf)
    return signals.season_comparison(a.window, a.period).select(ro("change_pct"), ro("expected_change_pct"), "years", ro("difference_pct"), ro("typical_pct"), "differences", "band")


# --- lenses --------------------------------------------------------------------------------------


@query
def a3_lever(spark, sf):
    return analysis(spark, sf).levers.select("formula", ro("customers_effect", 2), ro("frequency_effect", 2), ro("aov_effect", 2), ro("pair_orders_effect", 2),
                                             ro("pair_aov_effect", 2), ro("gross_to_net"), "masked_shift_alert")


@query
def a4_lever_level2(spark, sf):
    return analysis(spark, sf).levers.select("level2_reason", ro("units_per_order_effect", 2), ro("price_per_unit_effect", 2))


@query
def a6_masked_shift_by_nation(spark, sf):
    return analysis(spark, sf, "nation").levers.select("nation", ro("typical", 2), ro("gross_to_net"), "masked_shift_alert")


@query
def a8_bars_sum_to_the_cent(spark, sf):
    a = analysis(spark, sf, "nation")
    b = lenses.lever_bars(a.levers, ["nation"], refunds_withhold=False)
    return b.groupBy("nation").agg(F.count("*").alias("bars"), F.sum("cents").alias("cents"), F.max(F.col("c1") - F.col("c0")).alias("change_cents"))


@query
def v4_waterfall(spark, sf):
    a = analysis(spark, sf, "nation")
    return lenses.waterfall(lenses.lever_bars(a.levers, ["nation"]), ["nation"])


@query
def a9_returns_lens(spark, sf):
    return lenses.returns_lens(analysis(spark, sf).totals)


@query
def a10_customer_classes(spark, sf):
    return analysis(spark, sf).customer_classes.groupBy("transition", "customer_class").agg(F.count("*").alias("customers"), F.sum("cur").alias("cur"), F.sum("prev").alias("prev"))


BRIDGE = ("new", "resurrected", "expansion", "contraction", "lapsed", "unattributed", "new_customers")


@query
def a11_customer_bridge(spark, sf):
    return analysis(spark, sf).bridge.select("transition", *BRIDGE)


@query
def a12_product_lens(spark, sf):
    return analysis(spark, sf).product_lens.select(*[ro(c, 1) for c in ("volume", "mix", "price", "new_products", "discontinued_products", "unidentified")], "live_products")


@query
def a13_reconciliation(spark, sf):
    a = analysis(spark, sf, "nation")
    return lenses.reconciliation(a.tree, a.totals, ["nation"]).select("nation", "lens", "reconciles")


@query
def a14_category_members(spark, sf):
    a = analysis(spark, sf)
    t = members.category_totals(a.lines, a.period)
    return members.members(t, a.totals).select("dimension", F.col("rank").cast("long").alias("rank"), "label", "rev_prev", "rev_cur", "delta", ro("share_of_change", 6), "is_data_gap")


@query
def a14_product_members(spark, sf):
    a = analysis(spark, sf)
    return members.members(a.product_totals, a.totals).select(F.col("rank").cast("long").alias("rank"), "label", "rev_prev", "rev_cur", "delta", "member_count")


@query
def a14_new_and_removed(spark, sf):
    return members.new_and_removed(analysis(spark, sf).product_totals)


@query
def a15_customer_type_members(spark, sf):
    a = analysis(spark, sf)
    t = members.customer_type_totals(a.lines, a.period, a.customer_classes)
    return members.members(t, a.totals).select("label", "rev_prev", "rev_cur", "delta", "is_data_gap")


@query
def a16_breadth(spark, sf):
    return analysis(spark, sf).breadth.select(ro("declining_base_share", 6), ro("top_member_share", 6), "classification", ro("products_share_of_change", 6))


@query
def a17_mix_rate(spark, sf):
    a = analysis(spark, sf)
    return lenses.mix_rate(a.lines, a.period).select("metric", ro("mix"), ro("rate"))


@query
def a18_stockouts(spark, sf):
    """Categories within a nation stand in for products, so that some are sold on most days."""
    a = analysis(spark, sf, "nation")
    wide = a.lines.withColumn("product_key", F.col("category_key"))
    return lenses.stockouts(wide, a.period, ["nation"]).select("nation", "product_key", ro("active_day_rate"), F.col("zero_run_days").cast("long").alias("zero_run_days"), ro("contribution", 2))


# --- hypotheses, headline, actions ---------------------------------------------------------------


@query
def h13_hypotheses(spark, sf):
    return analysis(spark, sf).hypotheses


@query
def h13_hypotheses_by_nation(spark, sf):
    return analysis(spark, sf, "nation").hypotheses


@query
def h14_change_to_explain(spark, sf):
    return analysis(spark, sf).facts.select("revenue_prev", "revenue_cur", "net", "gross", "moved")


@query
def h7_headline(spark, sf):
    return analysis(spark, sf, "nation").headline


@query
def h10_headline_candidates(spark, sf):
    return analysis(spark, sf, "nation").candidates


@query
def h11_checklist(spark, sf):
    a = analysis(spark, sf, "nation")
    return hypotheses.checklist(a.hypotheses, a.headline, ["nation"])


@query
def h11_subjects(spark, sf):
    a = analysis(spark, sf, "nation")
    return hypotheses.subjects(hypotheses.checklist(a.hypotheses, a.headline, ["nation"]), a.specs, ["nation"])


@query
def h12_named_suggestions(spark, sf):
    a = analysis(spark, sf)
    named = movements.decliners(a.product_months, a.labels, a.period).select("product_key", "product_label")
    return movements.suggested_products(named, products.product_suggestions(a.lines)).select("product_label", "suggested_class")


@query
def h15_year_ago(spark, sf):
    a = analysis(spark, sf)
    return report.year_ago(a.core, a.period, a.rows).select("ly_current", "ly_previous", "ly_cur", "ly_prev")


# --- season and forecast -------------------------------------------------------------------------


@query
def f1_season_window(spark, sf):
    return analysis(spark, sf).window.select("month", "revenue", F.col("position").cast("long").alias("position"), "n")


@query
def f2_detrended(spark, sf):
    return analysis(spark, sf).ratios.select("month", F.col("year").cast("long").alias("year"), ro("ratio", 6))


@query
def f3_season_indices(spark, sf):
    return analysis(spark, sf).indices.select(F.col("set").cast("long").alias("set_no"), F.col("moy").cast("long").alias("moy"), ro("index", 6))


@query
def f6_season_claim(spark, sf):
    return analysis(spark, sf).claim.select("years", ro("strength_gap"), ro("agreement"), ro("ramp"), "refusal", "claimed")


@query
def f8_forecast_points(spark, sf):
    return analysis(spark, sf).forecast.select(F.col("h").cast("long").alias("h"), "month", ro("point", 2), "errors", "seasonal")


@query
def f9_horizon_errors(spark, sf):
    a = analysis(spark, sf)
    e = forecast.horizon_errors(a.window, forecast._index_maps(a.indices, a.claim, []))
    return e.select(F.col("h").cast("long").alias("h"), "month", ro("error", 6))


@query
def f10_forecast_by_nation(spark, sf):
    return analysis(spark, sf, "nation").forecast


@query
def f11_forecast_status(spark, sf):
    a = analysis(spark, sf, "nation")
    return forecast.forecast_status(a.window, a.period, ["nation"])


@query
def f12_actions_by_nation(spark, sf):
    return analysis(spark, sf, "nation").actions


@query
def v1_chart_series(spark, sf):
    a = analysis(spark, sf)
    chart = report.chart_series(metrics.monthly_trend(a.core, a.complete), a.forecast)
    return chart.filter(~F.col("series").isin("forecast_low", "forecast_high")).select("series", "month", ro("value", 2))


@query
def v3_bars(spark, sf):
    a = analysis(spark, sf)
    return report.bars(movements.breakdown(a.lines, a.period, "priority")).select(F.col("position").cast("long").alias("position"), "member", "revenue_current", "revenue_previous")
