"""The stateless readings also run on a stream of raw lines; nothing here keeps state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import dates as D
from tillscope.functions import numbers as N
from tillscope.functions import text as T
from tillscope.operators.classify import classify, is_stock_in


def read_lines(stream: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Type and classify each line of a (streaming) frame by its own cells; no user answers, no orders."""
    cell = lambda name: F.col(f"`{fields[name]}`").cast("string") if name in fields else F.lit(None).cast("string")
    typed = stream.select(
        "*", D.read_date(cell("transaction_date")).alias("txn_ts"), N.strict_number(cell("quantity")).alias("quantity_read"),
        N.strict_number(cell("unit_price")).alias("price_read"),
        T.keyed(T.text_identity(cell("product_name")), T.text_identity(cell("sku"))).alias("item_key"),
        T.customer_or_null(cell("customer")).alias("customer_id"), is_stock_in(cell("transaction_type")).alias("stock_in"))
    amount = F.col("quantity_read") * F.col("price_read")
    return typed.withColumn("amount_read", amount).withColumn(
        "line_class", classify(F.col("stock_in"), F.col("quantity_read"), F.col("price_read"), F.col("amount_read"),
                               F.lit(None).cast("string"), F.col("item_key")))
