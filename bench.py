"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS (default 2, best counts).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "cleaned_revenue", "typed_columns", "type_votes", "number_styles", "auto_numbers", "dates", "percentages",
    "currencies", "unicode_nfc", "dedup_rows", "ditto_marks", "row_types", "header_rows", "header_names",
    "raw_grid", "raw_grid_quoted", "cleaned_files", "example_values", "schema_text", "prompts", "minibatches_lines",
    "chat_requests", "extracted_sql", "collected_results", "query_status", "value_equality", "column_ranks",
    "execution_accuracy", "reparsed_predictions",
]


def main() -> None:
    from bindings import QUERIES
    from gridsmith.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"))
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            started = time.time()
            # Every column of every row is computed; nothing is gathered on the driver.
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - started
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline queries, best run each", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
