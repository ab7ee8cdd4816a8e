"""Orders: whether the id column can be trusted, one customer per receipt, order keys.

Lines are reduced once to ``(scope, id, day, customer)`` with counts; every check, fill and decision
reads that table. Lines move for it once, by id and day, so an id on a third of all lines is parted by its days.
"Exactly one value" is asked as minimum = maximum, which combines before the shuffle of what is asked of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.operators.ranking import join_same, sent
from tillscope.session import materialize

# Fixed values.
MAX_SPANNING_SHARE = 0.1
KEY_SEPARATOR = "␟"
LINE_KEY = "␞line "


def _one(low: str, high: str) -> Column:
    """The value when it is the only one."""
    return F.when(F.col(low) == F.col(high), F.col(low))


def _is_placed() -> Column:
    return F.col("order_id").isNotNull() & F.col("txn_day").isNotNull()


def receipt_lines(lines: DataFrame, scope: list[str], rest: bool = False, dealt: bool = False) -> DataFrame:
    """``(scope, order_id, day, customer)`` with the sale, moved, counted and naming lines it holds.

    With ``rest`` the lines without an id or a day are one more row of their scope, whose keys are null. ``dealt`` moves the
    lines by id and day before they are counted, so that what asks about an id's day finds it in one place.
    """
    moved = F.col("sale") | F.col("returned")
    names = ~((F.col("line_class") == "stock_in") | F.col("left_out"))
    keys = ["order_id", "txn_day", "customer"]
    marks = {"n_sale": F.col("sale"), "n_moved": moved, "n_counted": F.col("counted"), "n_naming": names}
    if rest:
        marks["n_blank"] = moved & F.col("order_id").isNull()
        keys = [F.when(_is_placed(), F.col(c)).alias(c) for c in keys]
    else:
        lines = lines.filter(_is_placed())
    marked = lines.select(*scope, *keys, *[on.alias(n) for n, on in marks.items()])
    if dealt:
        marked = marked.repartition(*scope, "order_id", "txn_day")
    return marked.groupBy(*scope, "order_id", "txn_day", "customer").agg(*[F.count_if(n).alias(n) for n in marks])


def receipt_fills(receipts: DataFrame, scope: list[str]) -> DataFrame:
    """The one customer named on an id's day: by its sale and return lines, else by its other lines."""
    moved = F.when(F.col("n_moved") > 0, F.col("customer"))
    naming = F.when(F.col("n_naming") > 0, F.col("customer"))
    days = receipts.groupBy(*scope, "order_id", "txn_day").agg(
        F.min(moved).alias("m0"), F.max(moved).alias("m1"), F.min(naming).alias("s0"), F.max(naming).alias("s1"))
    fill = F.when(F.col("m0").isNotNull(), _one("m0", "m1")).otherwise(_one("s0", "s1"))
    return days.select(*scope, "order_id", "txn_day", fill.alias("fill"))


def with_fills(receipts: DataFrame, scope: list[str]) -> DataFrame:
    """``receipts`` with ``fill``, as ``receipt_fills`` tells it: the rows of an id's day meet once, and none moves again to be told."""
    day = W.partitionBy(*scope, "order_id", "txn_day")
    moved = F.when(F.col("n_moved") > 0, F.col("customer"))
    naming = F.when(F.col("n_naming") > 0, F.col("customer"))
    names = {"m0": F.min(moved).over(day), "m1": F.max(moved).over(day), "s0": F.min(naming).over(day), "s1": F.max(naming).over(day)}
    fill = F.when(F.col("m0").isNotNull(), _one("m0", "m1")).otherwise(_one("s0", "s1"))
    return receipts.withColumns(names).withColumn("fill", fill).drop(*names)


def order_id_facts(receipts: DataFrame, fills: DataFrame | None, scope: list[str], write: bool = False) -> DataFrame:
    """One row per id: days and customers of its sale lines, its receipt day, its commonest customer.

    Without ``fills`` the receipts hold them. Only ids sold to several customers are counted by customer. ``write=True`` stores
    what the rows of an id say together, which both kinds of id are read from, and the columns that decisions and days need.
    """
    keys = [*scope, "order_id"]
    filled = receipts if fills is None else join_same(receipts, fills, [*keys, "txn_day"], "left")
    filled = filled.withColumn("filled", F.coalesce("customer", "fill"))
    sale, moved = (F.col(c) > 0 for c in ("n_sale", "n_moved"))
    # Asked of ids without a sale alone.
    counted = (F.col("n_counted") > 0) & ~sale
    facts = filled.groupBy(*keys).agg(
        F.sum("n_sale").alias("n_sale"),
        F.min(F.when(sale, F.col("filled"))).alias("filled0"), F.max(F.when(sale, F.col("filled"))).alias("filled1"),
        *[f(F.when(on, F.col(c))).alias(f"{tag}_{kind}{i}")
          for tag, on in (("sale", sale), ("counted", counted), ("moved", moved))
          for kind, c in (("day", "txn_day"), ("name", "customer"))
          for i, f in enumerate((F.min, F.max))],
    )
    has_sale = F.col("n_sale") > 0

    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    # Sale lines are among those that move: where these name one customer, so do they.
    sale_day, counted_day = (_one(f"{tag}_day0", f"{tag}_day1") for tag in ("sale", "counted"))
    receipt_day = F.when(
        has_sale, F.when(~((F.col("moved_day0") < sale_day) | differ("moved_name0", "moved_name1")), sale_day)
    ).otherwise(F.when(~differ("counted_name0", "counted_name1"), counted_day))
    facts = facts.withColumns({
        "receipt_day": receipt_day,
        "spans": has_sale & (differ("sale_day0", "sale_day1") | differ("filled0", "filled1")),
        "spans_raw": has_sale & (differ("sale_day0", "sale_day1") | differ("sale_name0", "sale_name1")),
        "__several": differ("filled0", "filled1"),
    })
    if write:
        facts = materialize(facts.select(*keys, "n_sale", "receipt_day", "spans", "filled0", "__several"), "order-facts")
    one, several = facts.filter(~F.col("__several")), facts.filter("__several")
    one = one.withColumn("top", F.col("filled0"))
    if not write or not several.isEmpty():
        sold = filled.filter(sale & F.col("filled").isNotNull())
        asked = sent(several.select(*keys)) if write else several.select(*keys)
        by_name = join_same(sold, asked, keys, "left_semi").groupBy(*keys, "filled").agg(F.sum("n_sale").alias("n_sale"))
        tops = by_name.groupBy(*keys).agg(F.min(F.struct(-F.col("n_sale"), "filled"))["filled"].alias("top"))
        one = one.unionByName(join_same(several, tops, keys, "left"))
    return one.drop("__several")


def spanning_ids(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Ids on sale lines covering several days or customers (as written), and all ids."""
    scope = scope or []
    sold = lines.filter(F.col("sale") & F.col("order_id").isNotNull()).groupBy(*scope, "order_id").agg(
        F.min("txn_day").alias("d0"), F.max("txn_day").alias("d1"), F.min("customer").alias("c0"), F.max("customer").alias("c1"))
    spans = (F.col("d0") != F.col("d1")) | F.coalesce(F.col("c0") != F.col("c1"), F.lit(False))
    return sold.groupBy(*scope).agg(F.count_if(spans).alias("spanning"), F.count("*").alias("ids"))


def order_decisions(lines: DataFrame | None, facts: DataFrame, scope: list[str], customer_column: bool,
                    receipt_answer: bool | None, receipts: DataFrame | None = None) -> DataFrame:
    """One row per scope: count orders by id or by line, and why.

    Blank ids come first, then the user's "no", then a check that could read dates only and was not
    confirmed, then too many ids spanning days or customers. ``receipts``, with their rest, spare reading the lines.
    """
    if receipts is not None:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        base = receipts.groupBy(*scope).agg(total("n_blank").alias("blank_ids"), total("n_moved").alias("moved_lines"))
    else:
        moved = F.col("sale") | F.col("returned")
        base = lines.groupBy(*scope).agg(
            F.count_if(moved & F.col("order_id").isNull()).alias("blank_ids"), F.count_if(moved).alias("moved_lines"))
    sold = facts.filter(F.col("n_sale") > 0)
    per_scope = sold.groupBy(*scope).agg(
        F.count("*").alias("ids"), F.count_if(F.col("spans")).alias("spanning"), F.count("top").alias("named"),
        F.min("top").alias("t0"), F.max("top").alias("t1"))
    busiest = (
        sold.filter(F.col("top").isNotNull()).groupBy(*scope, "top").agg(F.count("*").alias("n"))
        .groupBy(*scope).agg(F.max("n").alias("busiest"))
    )
    wide = join_same(join_same(base, per_scope, scope, "left"), busiest, scope, "left")
    wide = wide.fillna(0, ["ids", "spanning", "named", "busiest"])
    ids = F.col("ids")
    why = (
        F.when(F.lit(not customer_column), "no_customer_column").when(ids == 0, None)
        .when((ids - F.col("named")) * 2 > ids, "most_receipts_nameless")
        .when(F.col("busiest") * 2 > ids, "one_customer_on_most")
        .when(F.col("t0").isNull() | (F.col("t0") == F.col("t1")), "never_two_customers")
    )
    wide = wide.withColumn("date_only_reason", why)
    no = F.lit(receipt_answer is False)
    unconfirmed = F.lit(receipt_answer is None) & F.col("date_only_reason").isNotNull()
    reason = (
        F.when(F.col("blank_ids") > 0, "blank_order_ids").when(no, "answered_not_a_receipt")
        .when(unconfirmed, "dates_only_unconfirmed").when(ids == 0, "no_sale_line")
        .when(F.col("spanning") > ids * MAX_SPANNING_SHARE, "ids_span_days_or_customers")
    )
    return wide.select(
        *scope, F.when(reason.isNull(), "order_id").otherwise("lines").alias("orders_basis"), reason.alias("orders_reason"),
        "date_only_reason", "ids", "spanning", "blank_ids", "moved_lines")


def with_orders(lines: DataFrame, scope: list[str] | None = None, has_order_id: bool = True, customer_column: bool = True,
                receipt_answer: bool | None = None, fill: bool = True, keys: bool = True) -> DataFrame:
    """Add ``order_key``, the filled ``customer``, ``receipt_fillable`` and the scope's order basis.

    Without ``keys`` only what ``order_keys`` tells them from: the basis, ``__fill`` and ``__on_receipt_day``.
    """
    scope = scope or []
    if not has_order_id:
        none = F.lit(None).cast("string")
        lines = lines.withColumns({"orders_basis": F.lit("lines"), "orders_reason": none, "__fill": none, "__on_receipt_day": F.lit(False)})
        return order_keys(lines, fill, False) if keys else lines
    # Written once each: receipts with their fills, and facts, are read several times.
    # Lines without an id or a day would all meet in one task: they are counted apart.
    placed = with_fills(receipt_lines(lines, scope, dealt=True), scope).withColumn("n_blank", F.lit(0).cast("long"))
    rest = receipt_lines(lines.filter(~_is_placed()), scope, rest=True).withColumn("fill", F.lit(None).cast("string"))
    every = materialize(placed.unionByName(rest).drop("n_naming"), "receipts")
    filled = every.filter("order_id is not null").drop("n_blank")
    facts = order_id_facts(filled, None, scope, write=True)
    decided = materialize(
        order_decisions(None, facts, scope, customer_column, receipt_answer, every).select(*scope, "orders_basis", "orders_reason"), "order-basis")
    # Only lines that name nobody ask for a fill: one row for each day of an id that has such lines and a fill.
    asked = filled.filter("customer is null and fill is not null").select(*scope, "order_id", "txn_day", "fill")
    days = join_same(asked, facts.select(*scope, "order_id", "receipt_day"), [*scope, "order_id"], "left").select(
        *scope, "order_id", "txn_day", "fill",
        F.coalesce(F.col("receipt_day") == F.col("txn_day"), F.lit(False)).alias("__on_receipt_day"))
    days = materialize(days, "receipt-days").withColumnRenamed("fill", "__fill")
    # The other lines, and those without an id or a date, do not move at all.
    asks = F.col("customer").isNull() & F.col("order_id").isNotNull() & F.col("txn_day").isNotNull()
    joined = join_same(lines.filter(asks), sent(days), [*scope, "order_id", "txn_day"], "left").unionByName(lines.filter(~asks), allowMissingColumns=True)
    joined = join_same(joined, decided, scope, "left")
    return order_keys(joined, fill) if keys else joined


def order_keys(lines: DataFrame, fill: bool = True, has_order_id: bool = True) -> DataFrame:
    """``order_key``, the filled ``customer`` and ``receipt_fillable`` in place of ``__fill`` and ``__on_receipt_day``."""
    by_line = F.concat(F.lit(LINE_KEY), F.col("line_no").cast("string"))
    if not has_order_id:
        return lines.withColumns({"order_key": by_line, "receipt_fillable": F.lit(False)}).drop("__fill", "__on_receipt_day")
    trusted, on_day = F.col("orders_basis") == "order_id", F.coalesce(F.col("__on_receipt_day"), F.lit(False))
    filled = F.coalesce("customer", "__fill")
    fillable = trusted & F.col("counted") & F.col("customer").isNull() & F.col("__fill").isNotNull() & on_day
    owner = F.when(trusted & F.lit(fill) & on_day, filled).otherwise(F.col("customer"))
    order_key = F.when(
        trusted & F.col("order_id").isNotNull(),
        F.concat("order_id", F.lit(KEY_SEPARATOR), F.col("txn_day").cast("string"), F.lit(KEY_SEPARATOR), F.coalesce(filled, F.lit(""))),
    ).otherwise(by_line)
    return lines.withColumns({"order_key": order_key, "receipt_fillable": fillable, "customer": owner}).drop("__fill", "__on_receipt_day")


def order_checks(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per scope: spanning ids as written, and lines a receipt's customer would fill."""
    scope = scope or []
    fillable = lines.groupBy(*scope).agg(F.count_if(F.col("receipt_fillable")).alias("fillable_lines"))
    return join_same(fillable, spanning_ids(lines.withColumn("customer", F.col("customer_written")), scope), scope, "left")


def count_orders(lines: DataFrame, group: list[str], mask: Column, name: str = "orders") -> DataFrame:
    """Distinct orders among the masked lines, counted over one row per order."""
    per_order = lines.filter(mask).groupBy(*group, "order_key").agg(F.lit(1).alias("one"))
    return per_order.groupBy(*group).agg(F.count("*").alias(name))


def first_purchases(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per customer the month of the first purchase; null when the history opens with a refund.

    The first day with a sale or return is netted per product: more taken back than bought that day,
    or a return of no known product, proves a purchase before the file. Lines are reduced to one row per customer; only
    the first days that hold a return are netted.
    """
    scope = scope or []
    who = [*scope, "customer"]
    seen = lines.filter(F.col("counted") & F.col("customer").isNotNull())
    moved = F.col("sale") | F.col("returned")
    first = materialize(seen.groupBy(*who).agg(
        F.min(F.when(F.col("sale"), F.col("txn_day"))).alias("first_sale_day"), F.min(F.when(moved, F.col("txn_day"))).alias("txn_day")), "first-days")
    back = seen.filter(F.col("returned")).select(*who, "txn_day").distinct()
    opened = materialize(join_same(back, first.select(*who, "txn_day"), [*who, "txn_day"], "left_semi"), "first-returns")
    daily = join_same(seen, sent(opened), [*who, "txn_day"], "left_semi").groupBy(*who, "netting_key").agg(
        F.bool_or(moved).alias("moved"),
        F.sum(F.when(F.col("sale"), F.col("units")).otherwise(0.0)).alias("bought"),
        F.sum(F.when(F.col("returned"), -F.col("units")).otherwise(0.0)).alias("back"),
    )
    excess = F.col("back") - F.col("bought")
    uncovered = (F.col("back") > 0) & (
        F.col("netting_key").isNull() | ((excess > 0) & (excess > 1e-9 * F.greatest("bought", "back"))))
    refunds = daily.filter(F.col("moved") & uncovered).select(*who).distinct().withColumn("opens_with_refund", F.lit(True))
    return join_same(first, refunds, who, "left").select(
        *who, F.when(~F.coalesce(F.col("opens_with_refund"), F.lit(False)), F.trunc("first_sale_day", "MM")).alias("first_month"))
