"""What every line is: seventeen accounting classes, class words, suggestions, the effects of a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions import text as T
from tillscope.operators.ranking import is_small, join_same
from tillscope.session import materialize

# --- fixed values -------------------------------------------------------------------------------
# class, counted in the figures, term of the revenue identity, where it is reported when not counted
EFFECTS = (
    ("sale", True, "gross_sales", None),
    ("pooled_sale", True, "gross_sales", None),
    ("customer_return", True, "returns", None),
    ("pooled_return", True, "returns", None),
    ("allowance", True, "other_deductions", None),
    ("pooled_allowance", True, "other_deductions", None),
    ("discount", True, "discounts", None),
    ("charge", True, "other_revenue", None),
    ("no_money", True, None, None),
    ("pooled_no_money", True, None, None),
    ("gift_card_sale", False, None, "outside_revenue"),
    ("gift_card_redemption", False, None, "outside_revenue"),
    ("cost", False, None, "outside_revenue"),
    ("adjustment", False, None, "outside_revenue"),
    ("stock_in", False, None, "outside_revenue"),
    ("unclassified", False, None, "unclassified"),
    ("unmeasurable", False, None, "unmeasurable"),
)
COUNTED = tuple(c for c, counted, _, _ in EFFECTS if counted)
GROSS = ("sale", "pooled_sale")
RETURNS = ("customer_return", "pooled_return")
DEDUCTIONS = tuple(c for c, counted, term, _ in EFFECTS if counted and term in ("discounts", "other_deductions", None))
LEFT_OUT = ("gift_card_sale", "gift_card_redemption", "cost", "adjustment")
USER_CLASSES = ("charge", "discount", "cost", "adjustment", "gift_card", "pooled", "product")
LEAVING = ("cost", "charge", "discount", "adjustment", "gift_card")
TERM_OF = {c: term for c, _, term, _ in EFFECTS if term}

# Words at either end of a product text, the classes in the order they are tried.
CLASS_WORDS = (
    ("adjustment", ("adjust", "adjustment", "bad debt", r"write[\s-]?off", "written off", "điều chỉnh", "dieu chinh")),
    ("pooled", ("manual",)),
    ("discount", ("discount", "coupon", "giảm giá", "giam gia", "chiết khấu", "chiet khau")),
    ("gift_card", ("gift card", "gift voucher", "gift certificate", "gift_")),
    ("charge", ("postage", "shipping", "delivery", "carriage", "freight", r"p\s?&\s?p",
                "phí vận chuyển", "phi van chuyen", "phí ship", "phi ship")),
    ("cost", ("fee", "bank charge", "commission", "sample")),
)
# -------------------------------------------------------------------------------------------------


def effects_table(spark: SparkSession) -> DataFrame:
    """The class dimension: seventeen rows, always small enough to broadcast."""
    return spark.createDataFrame(list(EFFECTS), "line_class string, counted boolean, term string, reported string")


_WORDS = [word for _, words in CLASS_WORDS for word in words]
# Looked for only where a word's first letter stands: elsewhere one look spares trying every word.
_SOME_WORD = f"(?=[{''.join(sorted({word[0] for word in _WORDS}))}])(?:{'|'.join(_WORDS)})"


def class_word(text: Column) -> Column:
    """The class whose word starts or ends the text, the first class that matches; null for none.

    Most texts hold no word at all: one search for any of them spares the anchored ones.
    """
    out = F.when(~text.rlike(_SOME_WORD), None)
    for name, words in CLASS_WORDS:
        any_word = "|".join(words)
        hit = text.rlike(rf"(?U)^(?:{any_word})s?(?!\p{{L}})|(?<!\p{{L}})(?:{any_word})s?$")
        out = out.when(hit, name)
    return out


def is_stock_in(kind: Column) -> Column:
    return F.coalesce(F.lower(T.identifier_text(kind)) == "in", F.lit(False))


def term_of(line_class: Column) -> Column:
    out = None
    for name, term in TERM_OF.items():
        out = F.when(line_class == name, term) if out is None else out.when(line_class == name, term)
    return out


def classify(stock_in: Column, quantity: Column, price: Column, amount: Column, item: Column, key: Column) -> Column:
    """The class of a line, first rule that holds.

    ``item`` is the user's answer for the line's key (null when nobody answered), ``quantity`` and
    ``price`` are null where they cannot be measured.
    """
    pooled = F.coalesce(item == "pooled", F.lit(False)) | (item.isNull() & key.isNull())
    twin = lambda base: F.when(pooled, f"pooled_{base}").otherwise(base)
    chain = F.when(stock_in, "stock_in").when(
        quantity.isNull() | price.isNull() | amount.isNull() | (F.abs(amount) == float("inf")), "unmeasurable")
    for name in ("charge", "discount", "cost", "adjustment"):
        chain = chain.when(item == name, name)
    return (
        chain.when((item == "gift_card") & (amount >= 0), "gift_card_sale")
        .when(item == "gift_card", "gift_card_redemption")
        .when(amount == 0, twin("no_money"))
        .when((quantity > 0) & (amount > 0), twin("sale"))
        .when((quantity < 0) & (amount < 0), F.when(pooled, "pooled_return").otherwise("customer_return"))
        .otherwise(twin("allowance"))
    )


def commonest_name(counted: DataFrame, scope: list[str], key: str, name: str) -> DataFrame:
    """Per key the name its lines (``n`` a row) carry most; a tie goes to one with a class word, then alphabetically."""
    counts = counted.filter(F.col(name).isNotNull()).groupBy(*scope, key, name).agg(F.sum("n").alias("n"))
    worded = class_word(T.text_identity(F.col(name))).isNotNull()
    order = F.struct(-F.col("n"), F.when(worded, 0).otherwise(1), F.col(name))
    return counts.groupBy(*scope, key).agg(F.min_by(name, order).alias("commonest"))


def non_product_candidates(lines: DataFrame, scope: list[str] | None = None, write: bool = False) -> DataFrame:
    """Keys whose text, or commonest name, starts or ends with a class word, and the money they move.

    ``lines`` holds ``item_key, name_id, product_name, sku, stock_in, quantity, unit_price, amount``.
    Only keys with a word on some line are counted at all; names, spellings and money follow from one table of their lines
    counted by key and spelling, which ``write=True`` stores, as it does the keys, so that the lines are read for each once.
    """
    scope = scope or []
    key = F.col("item_key")
    key_text = F.when(key.startswith("sku:"), F.expr("substring(item_key, 5)")).when(key.startswith("name:"), F.expr("substring(item_key, 6)")).otherwise(key)
    has_word = class_word(key_text).isNotNull() | F.coalesce(class_word(F.col("name_id")).isNotNull(), F.lit(False))
    keyed = lines.filter(F.col("item_key").isNotNull())
    keys = keyed.filter(has_word).select(*scope, "item_key").distinct()
    theirs = keyed
    if write:
        # Written first: a line whose key has no word in any scope then stays where it is read.
        keys = materialize(keys, "worded-keys")
        if is_small(keys):
            keys = F.broadcast(keys)
        elif scope and is_small(some := materialize(keys.select("item_key").distinct(), "worded-keys")):
            theirs = join_same(theirs, F.broadcast(some), ["item_key"], "left_semi")
    theirs = join_same(theirs, keys, [*scope, "item_key"], "left_semi")
    counted = ~F.col("stock_in") & F.col("quantity").isNotNull() & F.col("unit_price").isNotNull()
    amount = F.when(counted & (F.abs(F.col("amount")) < float("inf")), F.col("amount"))
    spellings = theirs.groupBy(*scope, "item_key", "product_name", F.col("sku").cast("string").alias("sku")).agg(
        F.count("*").alias("n"), F.count(amount).alias("lines"),
        F.coalesce(F.sum(F.greatest(amount, F.lit(0.0))), F.lit(0.0)).alias("positive"),
        F.coalesce(F.sum(F.least(amount, F.lit(0.0))), F.lit(0.0)).alias("negative"),
    )
    if write:
        spellings = materialize(spellings, "worded-spellings")
    named = commonest_name(spellings, scope, "item_key", "product_name")
    spelled = commonest_name(spellings, scope, "item_key", "sku").withColumnRenamed("commonest", "sku_spelled")
    money = spellings.groupBy(*scope, "item_key").agg(*[F.sum(c).alias(c) for c in ("lines", "positive", "negative")])
    joined = join_same(join_same(money, named, [*scope, "item_key"], "left"), spelled, [*scope, "item_key"], "left")
    field = F.when(F.col("item_key").startswith("sku:"), "sku").otherwise("product_name")
    suggested = F.coalesce(class_word(key_text), class_word(T.text_identity(F.col("commonest"))))
    return (
        joined.withColumn("suggested", suggested)
        .filter(F.col("suggested").isNotNull() & ((F.col("positive") != 0) | (F.col("negative") != 0)))
        .select(*scope, "item_key", field.alias("field"),
                F.when(field == "sku", F.col("sku_spelled")).otherwise(F.col("commonest")).alias("value"),
                F.col("commonest").alias("name"), "lines", "positive", "negative", "suggested")
    )


def class_violations(lines: DataFrame) -> DataFrame:
    """Class columns of an already classed file that are blank or outside their closed lists."""
    known = [c for c, *_ in EFFECTS]
    checks = {
        "line_class": F.col("line_class").isNull() | ~F.col("line_class").isin(*known),
        "class_source": F.col("class_source").isNull() | ~F.col("class_source").isin("user", "rule"),
        "suggested_class": F.col("suggested_class").isNotNull() & ~F.col("suggested_class").isin(*USER_CLASSES),
    }
    found = F.array_compact(F.array(*[
        F.when(bad, F.struct(F.lit(name).alias("column"), F.coalesce(F.col(name), F.lit("(blank)")).alias("value")))
        for name, bad in checks.items()
    ]))
    return (
        lines.select(F.explode(found).alias("v")).groupBy("v.column", "v.value").agg(F.count("*").alias("lines"))
    )
