"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tickloom.plans.registry import all_queries
from tickloom.session import build_session

HEADLINE = [
    "raw_parse_outcomes", "binance_parse", "coinbase_parse", "dead_letter_replay", "ingest_audit",
    "latest_per_pair", "throttle_latest", "throttle_closed", "late_ticks", "spread_snapshot", "spread_changelog",
    "ticks_normalized", "ticks_dedupe", "ticks_idempotent_append", "ohlc_minute", "ohlc_30min", "ohlc_hourly",
    "ohlc_daily", "ohlc_weekly", "refresh_window_hourly", "retention_filter", "ohlc_history",
    "ohlc_history_daily", "compare_exchanges", "monitor_reshape", "relay_json",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tickloom-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(once(name), 3)
    print(json.dumps({
        "metric": "headline query time after one warm-up each", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
