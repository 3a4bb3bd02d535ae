"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from answerscope.session import local_session  # noqa: E402
from catalog import QUERIES  # noqa: E402

HEADLINE = [
    "share_of_voice_from_text", "e01_find_mentions", "visibility_summary_from_text", "b04_sentences",
    "f01_summarise", "f04_06_breakdowns", "f08_find_gaps", "f09_find_wins", "f10_citation_domains",
    "g02_surface_breakdown", "c01_to_text", "c12_page_snapshot", "d04_is_allowed", "d07_select_pages",
    "i27_run_checks", "j05_priority", "h03_balance", "k02_compute_delta", "k05_lag_run", "l01_purge_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # warm the JVM
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # every output row and column is produced, nothing is brought to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": spark.sparkContext.defaultParallelism,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
