"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark import queries, queries_listing, queries_lookups, queries_meetings, queries_records  # noqa: F401
from tidemark.session import session

HEADLINE = [
    "filter_blocks_and_or",
    "filter_dedup_sorted",
    "title_facet",
    "company_search",
    "company_classification",
    "ohlc_daily",
    "ohlc_weekly",
    "ohlc_nrow_5",
    "asof_forward",
    "asof_forward_split",
    "triple_barrier_intraday",
    "triple_barrier_summary",
    "market_history_intervals",
    "change_log_severity",
    "merge_last_non_null",
    "graph_degrees",
    "graph_neighborhood_2hop",
    "graph_collapse_minor",
    "clean_search_titles",
    "full_search",
    "listing_pages",
    "bond_records",
    "rights_graph_edges",
    "legacy_agendas",
    "anchored_spans",
    "visible_graph_all",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0) if os.path.basename(sf_dir.rstrip("/")).startswith("sf") else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
