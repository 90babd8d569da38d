"""Headline timings: one JSON line with seconds per query.

Two load steps are timed from the given tables (``load_lines``, ``load_star``);
the queries then run on what was loaded.  A query's time covers planning and
collecting its whole result, and is the better of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from orderlens.plans import registry, warehouse  # noqa: E402
from orderlens.session import build_session  # noqa: E402

HEADLINE = [
    "c6_from_given_tables",
    "c6_discount_bucket_margin",
    "a1_headline_kpis",
    "a2_region_sales",
    "a3_top_customers",
    "b1_product_health",
    "b3_segments_above_average_discount",
    "b4_industry_segment",
    "b5_monthly_trend",
    "c1_pareto",
    "c2_best_product_by_region",
    "c3_month_over_month",
    "c4_share_of_industry",
    "c5_year_to_date",
    "d2_monthly_kpis",
    "e1_region_kpis",
    "ag1_order_level",
    "ag2_headline_kpis",
    "ag3_breakdowns_all",
    "ag4_top_customers",
    "ag9_correlation_matrix",
    "ag11_hierarchy",
    "ag14_eda_report",
    "pr5_numeric_summary",
    "me9_sales_ly",
    "me15_running_total",
    "me16_product_rank",
    "me17_cumulative_share",
    "me19_measure_layer",
    "vi9_product_region_matrix",
    "vi12_customer_table",
]


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    times = {
        "load_lines": timed(lambda: warehouse.lines(spark, sf_dir)),
        "load_star": timed(lambda: warehouse.star(spark, sf_dir)),
    }
    for name in HEADLINE:
        query = registry.QUERIES[name]
        times[name] = min(timed(lambda q=query: q(spark, sf_dir).toArrow()) for _ in range(2))
    times = {k: round(v, 3) for k, v in times.items()}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
