"""Benchmark: the pipeline's stages and headline queries, one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import time

from tillscope.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

# The stages, each computed in full: typed and classified lines first, then what reads them.
HEADLINE = (
    "p2_column_profile", "p5_top_values", "c15_issue_counts", "x22_cleaned_frame", "l2_line_classes", "m1_monthly_core", "m3_kpis",
    "m9_revenue_identity", "m13_same_day_cancellations", "m22_segments", "m23_new_vs_returning", "m25_pareto", "m26_top_products",
    "m27_decliners", "m28_categories", "m29_breakdown", "g8_signals", "a3_lever", "a11_customer_bridge", "a12_product_lens",
    "a14_product_members", "a16_breadth", "a17_mix_rate", "h13_hypotheses", "f8_forecast_points", "m1_monthly_core_by_nation",
)


def main() -> None:
    spark = local_session(CPUS, "bench", "16g")
    from suite.registry import QUERIES, analysis

    times: dict[str, float] = {}
    start = time.time()
    analysis(spark, SF).lines.limit(1).collect()
    times["build_sales_lines"] = round(time.time() - start, 3)
    for name in HEADLINE:
        begun = time.time()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begun, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": SF.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
