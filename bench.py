"""Headline queries on local cores: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from curbline.checks import registry  # noqa: E402
from curbline.runtime import local_session  # noqa: E402

HEADLINE = (
    "knn_vote",
    "cheap_prediction",
    "as_of_retrieval",
    "nearest_candidate",
    "canonical_assignment",
    "triage_pass",
    "evaluation_report",
    "redaction",
    "text_flags",
    "text_vectors",
    "multi_agency",
    "ticket_upsert",
    "landing_scan",
    "isotonic_fit",
    "calibrated_lookup",
    "temporal_halves",
    "bootstrap_interval",
    "spend_allocation",
    "operations",
    "field_profile",
    "stream_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores, int(cores))
    queries, seconds = registry.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
