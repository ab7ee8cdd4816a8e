"""The typed fact table every metric reads: one row per sales line."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions import dates as D
from tillscope.functions import numbers as N
from tillscope.functions import text as T
from tillscope.operators import classify as C
from tillscope.operators import orders as O
from tillscope.operators import products as R
from tillscope.operators.ranking import is_small, join_same, sent
from tillscope.session import materialize

FIELDS = ("transaction_date", "quantity", "unit_price", "product_name", "sku", "category", "customer", "order_id",
          "transaction_type")
REQUIRED = ("transaction_date", "quantity", "unit_price")


@dataclass(frozen=True)
class Answers:
    """What the user decided: classes per product, receipts, placeholders, the order dates are written in."""

    line_classes: tuple[tuple[str, str, str], ...] = ()  # (field sku|product_name, value, class)
    order_id_is_receipt: bool | None = None
    customer_on_first_line_only: bool | None = None
    customer_placeholders: tuple[str, ...] = ()
    dates_day_first: bool | None = None


class MissingField(ValueError):
    """A required field has no mapped column."""


@dataclass(frozen=True)
class Mapping:
    """Source columns by canonical field, and the columns to carry along unread."""

    fields: dict[str, str]
    carry: tuple[str, ...] = field(default=())


def _typed(df: DataFrame, mapping: Mapping, scope: list[str], answers: Answers) -> DataFrame:
    kinds = dict(df.dtypes)
    have = mapping.fields
    for name in REQUIRED:
        if name not in have:
            raise MissingField(name)

    def source(name: str) -> Column:
        return F.col(f"`{have[name]}`") if name in have else F.lit(None).cast("string")

    def number(name: str) -> Column:
        if kinds[have[name]] == "string":
            return N.strict_number(source(name))
        value = source(name).cast("double")
        return F.when(F.abs(value) < float("inf"), value)

    date = source("transaction_date")
    if kinds[have["transaction_date"]] == "string":
        order = None if answers.dates_day_first is None else F.lit("day_first" if answers.dates_day_first else "month_first")
        date = D.read_date(date, order)
    else:
        date = D.accepted(date.cast("timestamp_ntz"))
    text = lambda name: source(name).cast("string")
    return df.select(
        *scope, "line_no", date.alias("txn_ts"), number("quantity").alias("quantity"), number("unit_price").alias("unit_price"),
        C.is_stock_in(text("transaction_type")).alias("stock_in"), text("transaction_type").alias("transaction_type"),
        T.product_text(text("product_name")).alias("product_label_text"), T.product_text(text("sku")).alias("sku_label_text"),
        text("product_name").alias("product_name"), text("sku").alias("sku"),
        T.identifier_or_null(text("order_id")).alias("order_id"), T.customer_or_null(text("customer")).alias("customer_written"),
        T.category_or_null(text("category")).alias("category_label"),
        *[F.col(f"`{c}`") for c in mapping.carry],
    )


# Texts that decide which lines are one product, customer, order or category.
READ_TEXTS = ["product_label_text", "sku_label_text", "order_id", "customer_written", "category_label"]


# A shown text, the cell it is read from, and what is written of it: nothing where it is the cell, an empty text where nothing is shown.
SHOWN = (("product_label_text", "product_name", "__name_shown"), ("sku_label_text", "sku", "__sku_shown"))


def _differing(text: str, told: Column) -> Column:
    """What is written of a text that is mostly ``told`` by other columns; none is empty by itself."""
    return F.when(~F.col(text).eqNullSafe(told), F.coalesce(text, F.lit("")))


def _as_told(kept: str, told: Column) -> Column:
    return F.when(F.col(kept).isNull(), told).otherwise(F.nullif(F.col(kept), F.lit("")))


def _only_differing(lines: DataFrame) -> DataFrame:
    """Shown texts as they are written."""
    return lines.withColumns({kept: _differing(text, F.col(cell)) for text, cell, kept in SHOWN}).drop(*[text for text, _, _ in SHOWN])


def _shown(lines: DataFrame) -> DataFrame:
    """Shown texts beside what is written of them."""
    return lines.withColumns({text: _as_told(kept, F.col(cell)) for text, cell, kept in SHOWN})


def _keyed(lines: DataFrame) -> DataFrame:
    """Written lines with all that is told again at each reading: to write a text costs several times what it costs to tell it from another."""
    return _shown(lines).withColumns({"amount": F.col("quantity") * F.col("unit_price"), "category_key": F.lower("category_label")})


def _written(typed: DataFrame) -> DataFrame:
    """Typed lines, written, with all that follows from their figures, dates and texts. The key and the name, which many rules ask, are written."""
    ids = typed.withColumns({"name_id": T.fold(F.col("product_label_text")), "item_key": T.fold(F.col("sku_label_text"))})
    ids = ids.withColumn("item_key", T.keyed(F.col("name_id"), F.col("item_key")))
    return _keyed(materialize(_only_differing(ids), "typed-lines")).withColumns({
        "txn_day": F.to_date("txn_ts"), "sku_id": T.fold(F.col("sku_label_text")),
    }).withColumn("would_sell", F.coalesce(
        F.col("txn_ts").isNotNull() & ~F.col("stock_in") & (F.col("quantity") > 0) & (F.col("amount") > 0), F.lit(False)))


def _answer_table(df: DataFrame, answers: Answers) -> DataFrame:
    """One row per answered key; a later answer about the same key holds."""
    rows = [(i, f, v, c) for i, (f, v, c) in enumerate(answers.line_classes)]
    # A user's answers are few: one task starts Python once.
    table = df.sparkSession.createDataFrame(rows, "position int, field string, value string, answer string").coalesce(1)
    prefix = F.when(F.col("field") == "sku", "sku:").otherwise("name:")
    keyed = table.withColumn("item_key", F.concat(prefix, T.fold(T.nfc(T.product_text(F.col("value")))))).filter("item_key is not null")
    # Written: read once by Python, and small enough to be told so before the lines move.
    return materialize(keyed.groupBy("item_key").agg(F.max_by("answer", "position").alias("answer")), "answers")


def _with_candidates(lines: DataFrame, candidates: DataFrame, scope: list[str]) -> DataFrame:
    """Add ``suggested``. Candidates are sent to the lines if they are small; of lines in many scopes else only those move whose key is a candidate in one."""
    keys = [*scope, "item_key"]
    if is_small(candidates):
        return join_same(lines, F.broadcast(candidates), keys, "left")
    some = materialize(candidates.select("item_key").distinct(), "suggested-keys") if scope else None
    if some is not None and is_small(some):
        marked = lines.join(F.broadcast(some.withColumn("__some", F.lit(True))), "item_key", "left")
        asked = join_same(marked.filter("__some"), candidates, keys, "left")
        return asked.unionByName(marked.filter("__some is null"), allowMissingColumns=True).drop("__some")
    # Lines without a key match nothing; spread, they do not meet in one task.
    spread = F.concat(F.lit("\u0000"), F.pmod(F.col("line_no"), F.lit(4096)).cast("string"))
    lines = lines.withColumn("__key", F.coalesce("item_key", spread))
    return join_same(lines, candidates.withColumnRenamed("item_key", "__key"), [*scope, "__key"], "left").drop("__key")


def _with_answers(lines: DataFrame, typed: DataFrame, answers: Answers, scope: list[str], has_sku: bool, suggest: bool) -> DataFrame:
    """Add ``one_sku`` (a name-only line's SKU), ``item`` (the user's answer) and ``suggested_class``; ``typed`` are the lines as written."""
    none = F.lit(None).cast("string")
    table = _answer_table(typed, answers) if answers.line_classes else None
    # The side tables are written first: their real size then decides, before the lines move at all,
    # whether the join can broadcast them or has to shuffle.
    candidates = materialize(C.non_product_candidates(typed, scope, write=True).select(*scope, "item_key", "suggested"), "suggestions") if suggest else None
    names = materialize(R.name_skus(typed, scope), "name-skus") if has_sku else None
    if names is not None:
        names = names.withColumn("item_key", F.concat(F.lit("sku:"), F.col("one_sku")))
        names = names.join(table.withColumnRenamed("answer", "sku_answer"), "item_key", "left") if table is not None else names.withColumn("sku_answer", none)
        names = (join_same(names, candidates.withColumnRenamed("suggested", "sku_suggested"), [*scope, "item_key"], "left")
                 if candidates is not None else names.withColumn("sku_suggested", none))
        names = materialize(names.select(*scope, F.col("name_id").alias("__name"), "one_sku", "sku_answer", "sku_suggested"), "name-classes")
        spread = F.concat(F.lit("\u0000"), F.pmod(F.col("line_no"), F.lit(4096)).cast("string"))
        name_only = F.when(F.col("sku_id").isNull(), F.col("name_id"))
        lines = join_same(lines.withColumn("__name", F.coalesce(name_only, spread)), sent(names), [*scope, "__name"], "left").drop("__name")
    else:
        lines = lines.withColumns({"one_sku": none, "sku_answer": none, "sku_suggested": none})
    if table is not None:
        lines = lines.join(table, "item_key", "left")
    else:
        lines = lines.withColumn("answer", none)
    if candidates is not None:
        lines = _with_candidates(lines, candidates, scope)
    else:
        lines = lines.withColumn("suggested", none)
    item = F.coalesce("answer", "sku_answer")
    return lines.withColumns({
        "item": item, "suggested_class": F.when(item.isNull(), F.coalesce("suggested", "sku_suggested")),
    })


def build_sales_lines(df: DataFrame, mapping: Mapping, scope: list[str] | None = None, answers: Answers | None = None,
                      suggest: bool = True, partition_by: list[str] | None = None) -> DataFrame:
    """Type, classify, group into orders and key the products of every line of ``df``.

    ``df`` has a unique ``line_no``. With ``scope`` columns every figure downstream is per scope.
    The typed and the finished lines are each written once to the shared folder: several small side
    tables (names, candidates, receipts) read a few columns of the typed ones, and none of them parses
    the source again. Keys and texts that follow from written columns are told from these at each reading.
    """
    scope, answers = scope or [], answers or Answers()
    marks = T.may_compose(*[F.col(c) for c in READ_TEXTS])
    read = _typed(df, mapping, scope, answers)
    lines = _written(read.withColumn("__marks", marks))
    if not lines.filter("__marks").isEmpty():
        # Texts are composed once read, so that a mark behind an invisible character meets its letter too.
        lines = _written(T.compose_columns(lines.select(*[F.col(f"`{c}`") for c in read.columns]), READ_TEXTS))
    typed = lines = lines.drop("__marks")
    # Joined before the others: whether a line names a customer is then known where it is read, and lines are parted there.
    placeholder = F.lit(False)
    if answers.customer_placeholders:
        told = lines.sparkSession.createDataFrame([(p,) for p in answers.customer_placeholders], "value string").coalesce(1)
        told = materialize(told.select(F.lower(T.nfc(T.identifier_text(F.col("value")))).alias("__told")).distinct(), "placeholders")
        lines = lines.join(told, F.col("customer_written") == F.col("__told"), "left")
        placeholder = F.col("__told").isNotNull()
    lines = _with_answers(lines, typed, answers, scope, "sku" in mapping.fields and "product_name" in mapping.fields, suggest)
    line_class = C.classify(F.col("stock_in"), F.col("quantity"), F.col("unit_price"), F.col("amount"), F.col("item"), F.col("item_key"))
    measurable = ~F.col("stock_in") & F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & (F.abs(F.col("amount")) < float("inf"))
    dated = F.col("txn_ts").isNotNull()
    is_in = lambda names: F.col("line_class").isin(*names) & dated
    lines = lines.withColumn("line_class", line_class).withColumns({
        "class_source": F.when(F.col("item").isNotNull() & F.coalesce(measurable, F.lit(False)), "user").otherwise("rule"),
        "answered_class": F.when(F.col("item") != "product", F.col("item")),
        "counted": is_in(C.COUNTED), "sale": is_in(C.GROSS), "returned": is_in(C.RETURNS),
        "charge": is_in(("charge",)), "deduction": is_in(C.DEDUCTIONS), "left_out": is_in(C.LEFT_OUT),
        "placeholder": placeholder,
    })
    resolved_classed = F.coalesce(F.col("sku_answer") != "product", F.lit(False))
    name_only = F.col("sku_id").isNull() & F.col("one_sku").isNotNull()
    customer = F.when(~F.col("placeholder"), F.col("customer_written"))
    lines = lines.withColumns({
        "customer": customer, "__borrowed": F.when(name_only, F.concat(F.lit("sku:"), F.col("one_sku"))), "__resolved": resolved_classed,
    })
    # Not written: the receipts, the order basis and the finished lines each read few columns and join the same small tables.
    # A key mostly follows from its SKU's cell; lines that move carry it where it does not.
    key_told = F.concat(F.lit("sku:"), F.lower("sku"))
    lines = lines.withColumn("__key", _differing("item_key", key_told)).drop(
        "sku_answer", "sku_suggested", "answer", "suggested", "would_sell", "one_sku", "item", "__told", "item_key")
    fill = answers.customer_on_first_line_only is not False
    lines = O.with_orders(lines, scope, "order_id" in mapping.fields, "customer" in mapping.fields, answers.order_id_is_receipt, fill, False)
    # Only columns that do not follow from others are written, and the days and months a reader may pick files by.
    stored = lines.withColumn("month", F.trunc("txn_day", "MM")).select(
        *scope, "line_no", "txn_ts", "txn_day", "month", "quantity", "unit_price", "line_class", "class_source",
        "suggested_class", "answered_class", "counted", "sale", "returned", "charge", "deduction", "left_out", "__borrowed", "__resolved",
        "__key", "__name_shown", "__sku_shown", "product_name", "sku", "stock_in", "transaction_type", "order_id", "orders_basis", "orders_reason",
        "__fill", "__on_receipt_day",
        "customer_written", "placeholder", "category_label", *mapping.carry,
    )
    lines = _keyed(materialize(stored, "sales-lines", partition_by)).withColumns({"customer": customer, "item_key": _as_told("__key", key_told)})
    lines = lines.withColumn("name_id", T.fold(F.col("product_label_text")))
    lines = O.order_keys(lines, fill, "order_id" in mapping.fields).withColumns({
        "units": F.when(F.col("sale") | F.col("returned"), F.col("quantity")).otherwise(0.0),
        "netting_key": F.coalesce("__borrowed", "item_key"),
        "product_key": F.when(F.col("answered_class").isNull(), F.coalesce(F.when(~F.col("__resolved"), F.col("__borrowed")), "item_key")),
    })
    return lines.select(
        *scope, "line_no", "txn_ts", "txn_day", "month", "quantity", "unit_price", "amount", "line_class", "class_source",
        "suggested_class", "answered_class", "counted", "sale", "returned", "charge", "deduction", "left_out", "units",
        "item_key", "product_key", "netting_key", "product_label_text", "sku_label_text", "product_name", "sku", "name_id",
        "stock_in", "transaction_type", "order_id", "order_key", "orders_basis", "orders_reason", "customer", "customer_written",
        "receipt_fillable", "placeholder", "category_key", "category_label", *mapping.carry,
    )
