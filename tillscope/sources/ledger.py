"""A sales ledger over the order/line/customer/part tables, with the defects real files have.

The defects are expressions on keys, so the whole table keeps its rows and a SQL engine can repeat
them: missing dates and figures, nameless and placeholder customers, header-style receipts,
name-only products, stock movements, worded non-products, zero prices and returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.plans.sales_lines import Answers, Mapping

MAPPING = Mapping(
    {
        "transaction_date": "txn", "quantity": "quantity", "unit_price": "unit_price", "product_name": "product_name",
        "sku": "sku", "category": "category", "customer": "customer", "order_id": "order_id", "transaction_type": "kind",
    },
    carry=("priority", "segment"),
)
ANSWERS = Answers(
    line_classes=(
        ("sku", "P9", "charge"), ("sku", "P110", "charge"), ("sku", "P10", "gift_card"), ("sku", "P11", "discount"),
        ("sku", "P12", "pooled"), ("sku", "P13", "cost"), ("sku", "P14", "adjustment"), ("sku", "P115", "product"),
    ),
    customer_placeholders=("Walk-in",),
)
WORDED = {9: "Postage", 10: "Gift card", 11: "Discount", 12: "Manual", 13: "Bank charge", 14: "Bad debt"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ledger(spark: SparkSession, folder: str, date: str = "o_orderdate") -> DataFrame:
    """One row per line item; only the columns named here reach the scan."""
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    # What follows from a line's own columns is told before it moves, so that few and short ones do.
    item = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", F.col("_metadata.row_index").alias("line_no"),
        F.when(ok % 223 != 5, F.when((F.col("l_returnflag") == "R") & (ln == 1), -quantity).otherwise(quantity)).cast("double").alias("quantity"),
        F.when(ok % 211 != 3, F.when(pk % 97 == 5, F.lit(0.0)).otherwise(F.floor(price / quantity).cast("double"))).alias("unit_price"),
        F.when(sk % 50 == 1, "in").when(sk % 50 == 2, "exchange").otherwise("out").alias("kind"),
        ((ok % 53 == 0) & (ln >= 4)).alias("late"), ((pk % 31 == 0) & (ln == 2)).alias("lower"),
        ((ok % 37 == 0) | ((ok % 5 == 0) & (ln > 2))).alias("nameless"),
    )
    order = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    part = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    # Orders meet their customers first: they are fewer than the lines, which then move for them once. Parts are narrower and come before them.
    # Dealt by the key of the last join, which needs it so at any size; a small file becomes as many tasks as there are cores.
    order = order.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    named = item.join(part, pk == F.col("p_partkey")).repartition("l_orderkey")
    joined = named.join(order, ok == F.col("o_orderkey"))
    name = F.when(pk % 43 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    for rest, text in WORDED.items():
        name = F.when(pk % 101 == rest, text).otherwise(name)
    when = F.when(F.col("late"), F.col(date) + F.expr("interval 1 day")).otherwise(F.col(date))
    return joined.select(
        "line_no", F.col("c_nationkey").alias("nation"), F.concat(F.lit("INV"), ok.cast("string")).alias("order_id"),
        F.when(ok % 307 != 0, when).alias("txn"),
        F.when(pk % 23 != 7, F.concat(F.lit("P"), pk.cast("string"))).alias("sku"), name.alias("product_name"),
        F.when(pk % 29 != 0, F.when(F.col("lower"), F.lower("p_type")).otherwise(F.col("p_type"))).alias("category"),
        F.when(F.col("nameless"), None).otherwise(F.when(ok % 11 == 3, "Walk-in").otherwise(F.col("c_name"))).alias("customer"),
        "quantity", "unit_price", "kind", F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
    )
