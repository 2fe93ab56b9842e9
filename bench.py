"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leafledger.plans.registry import QUERIES  # noqa: E402
from leafledger.session import build_session, local_master  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = (
    "profile_report", "language_stats", "extension_topk", "size_distribution", "mtime_distribution",
    "file_metrics", "classify_lines", "estimate_tokens", "classify_text", "select_files",
    "selection_audit", "ignore_rules_apply", "tracked_only", "entries", "tree_order", "render_tree",
    "budget_cut", "truncation_rows", "budget_by_conversation", "file_status", "health_check",
    "render_text", "render_markdown", "render_html", "export_files", "bundle", "corpus_growth",
    "corpus_stats_stream",
)


def run(spark, name: str) -> tuple[float, float]:
    """Seconds to build a query's plan, with the jobs that takes, and then to compute all its rows."""
    start = time.perf_counter()
    frame = QUERIES[name](spark, SF_DIR)
    built = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return built - start, time.perf_counter() - built


def main() -> None:
    spark = build_session(
        "leafledger-bench",
        local_master(),
        spark__sql__shuffle__partitions=os.environ.get("BENCH_CPUS", "8"),
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, building = {}, {}
    for name in HEADLINE:
        run(spark, name)  # not timed: start-up, code generation and the file cache
        built, computed = run(spark, name)
        seconds[name], building[name] = round(built + computed, 3), round(built, 3)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "building": building,
                "sf": float(scale[1]) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
