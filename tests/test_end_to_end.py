import pytest
from pyspark.sql import functions as F

from suite.compare import compare
from suite.oracles import ORACLES
from suite.registry import QUERIES
from tillscope.plans.analysis import Analysis
from tillscope.plans.sales_lines import build_sales_lines
from tillscope.sources.ledger import ANSWERS, MAPPING, ledger
from tillscope.streaming.lines import read_lines

# A slice of every group; the whole list runs with ``python -m suite.compare``.
CHOSEN = ("p2_column_profile", "p5_top_values", "c15_issue_counts", "x22_cleaned_frame", "x26_change_log", "l2_line_classes", "o10_first_purchases",
          "m1_monthly_core", "m9_revenue_identity", "m19_rfm", "m25_pareto", "m27_decliners", "d4_leave_one_out", "g5_year_over_year", "a3_lever",
          "a11_customer_bridge", "a12_product_lens", "a17_mix_rate", "f3_season_indices", "f9_horizon_errors")


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_the_second_engine(spark, sf, name):
    assert compare(spark, sf, [name])[name].startswith("ok")


def test_a_written_format_meets_every_shape(spark, sf):
    """Cells in other shapes reach the action, become missing and are marked."""
    names = ["x11_written_format", "x11_written_format_marks"]
    assert all(v.startswith("ok") for v in compare(spark, sf, names).values())
    marks = QUERIES["x11_written_format_marks"](spark, sf)
    shapes = {r["shape"]: r["invalid_date"] for r in marks.select((F.col("line_no") % 10).alias("shape"), "invalid_date").distinct().collect()}
    assert shapes == {shape: shape != 0 for shape in range(10)}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


def test_scopes_equal_separate_runs(spark, sf):
    """The scoped run gives every nation what it gets alone."""
    raw = ledger(spark, sf).filter(F.col("nation").isin(3, 11))
    both = Analysis(build_sales_lines(raw, MAPPING, ["nation"], ANSWERS), ["nation"])
    for nation in (11,):
        alone = Analysis(build_sales_lines(raw.filter(F.col("nation") == nation), MAPPING, [], ANSWERS))
        pick = lambda df: df.filter(F.col("nation") == nation).drop("nation")
        for whole, one in ((both.core, alone.core), (both.hypotheses, alone.hypotheses), (both.headline, alone.headline), (both.labels, alone.labels),
                           (both.product_lens, alone.product_lens)):
            key = lambda r: repr([round(x, 6) + 0.0 if isinstance(x, float) else x for x in r])
            assert sorted(map(key, pick(whole).collect())) == sorted(map(key, one.collect()))


def test_stream_reads_the_same_lines(spark, sf, tmp_path):
    batch = ledger(spark, sf).select("line_no", F.col("txn").cast("string").alias("txn"), F.col("quantity").cast("string").alias("quantity"),
                                     F.col("unit_price").cast("string").alias("unit_price"), "product_name", "sku", "customer", "kind")
    source = str(tmp_path / "in")
    batch.write.parquet(source)
    fields = {"transaction_date": "txn", "quantity": "quantity", "unit_price": "unit_price", "product_name": "product_name", "sku": "sku",
              "customer": "customer", "transaction_type": "kind"}
    stream = read_lines(spark.readStream.schema(batch.schema).parquet(source), fields)
    q = stream.writeStream.format("memory").queryName("lines_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("lines_out").groupBy("line_class").agg(F.count("*").alias("n"), F.sum("amount_read").alias("a"))
    want = read_lines(spark.read.parquet(source), fields).groupBy("line_class").agg(F.count("*").alias("n"), F.sum("amount_read").alias("a"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hot_keys_keep_results_whole(spark):
    """One id, customer and product on a third of all lines, and blank ones on another third."""
    from tillscope.operators import metrics

    rows = 12000
    raw = spark.range(rows).select(
        F.col("id").alias("line_no"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=F.col("id") % 60)).alias("d"),
        F.lit(1.0).alias("q"), F.lit(2.0).alias("p"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("c"), (F.col("id") % 500).cast("string"))).alias("c"),
        F.when(F.col("id") % 3 == 0, "Hot mug").otherwise(F.concat(F.lit("item "), (F.col("id") % 900).cast("string"))).alias("n"),
        F.concat(F.lit("o"), F.when(F.col("id") % 3 == 0, F.col("id") % 60).otherwise(F.col("id")).cast("string")).alias("o"))
    mapping = type(MAPPING)({"transaction_date": "d", "quantity": "q", "unit_price": "p", "customer": "c", "product_name": "n", "order_id": "o"})
    lines = build_sales_lines(raw, mapping)
    core = metrics.monthly_core(lines).agg(F.sum("revenue"), F.sum("lines")).first()
    assert tuple(core) == (2.0 * rows, rows)
    assert lines.count() == rows and lines.select("line_no").distinct().count() == rows
