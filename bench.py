"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (best of, default 2).
The alert, bundle and feed lines are landed before the clock starts: these are the input files. The
two feeds are parsed into Parquet once, and that is timed too (``parse_bundle``, ``parse_feed``). Every query is run to its last row (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sievewatch.session import build_session  # noqa: E402
from sievewatch.workloads import catalog, knowledge  # noqa: E402
from sievewatch.workloads.inputs import Tables  # noqa: E402

HEADLINE = [
    "f1_forwarded_by_agent", "n1_normalise", "n7_validate", "t3_route_requests", "t7_queue_order",
    "a4_tag_counts", "a10_latest_classification", "a11_severity_by_hour", "k9_group_edges",
    "k11_technique_rows", "v9_cve_rows", "v10_cve_lookup", "v12_cves_in_text",
    "r2_nearest_techniques", "r5_search_both", "r11_context_blocks", "r13_alert_context",
    "p1_classify_prompts", "p5_investigation_logs", "p6_parse_answers", "p17_section_items",
    "t8_most_recent", "r18_pruned_search", "d1_brute_force", "d1_brute_force_windows", "d3_file_changes", "d5_silent_agents",
    "d9_failures_without_success", "d11_port_scans", "st1_live_alerts", "st4_brute_force_stream",
]
# queries whose input rows per second are reported
RATES = {
    "n1_normalise": "events", "r2_nearest_techniques": "embeddings", "k9_group_edges": "lineitem",
    "d1_brute_force": "events",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    for name in ("raw_lines", "posted", "stix_lines", "cve_lines"):
        tables.landed(name)
    jobs, seconds = catalog.jobs(), {}
    for name, parse in (("parse_bundle", knowledge.objects), ("parse_feed", knowledge.items)):
        start = time.perf_counter()
        parse(tables).count()
        seconds[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            jobs[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    rates = {n: round(tables.base(t).count() / seconds[n]) for n, t in RATES.items()}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rates, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
