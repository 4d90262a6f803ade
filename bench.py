"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from auditspark.plans.bindings import QUERIES
from auditspark.session import local_session

HEADLINE = [
    "impossible_travel", "suspicious_logins", "suspicious_mail", "filter_contains", "filter_compare", "filter_compare_text",
    "filter_any_field", "filter_alias", "operation_facets", "value_facets", "review_metrics", "enrich_left", "domain_attributes",
    "service_domains", "distinct_ips", "email_domain_list", "ip_classes", "findings_join", "tag_change", "narrative_activity",
    "reviewed_page", "flatten_props", "rule_details", "message_pairs", "pairs_dedup", "clean_table", "sort_time", "sort_number",
    "page_rows", "row_ordinals", "previous_event", "target_dedup", "collection_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    # Start the session's reader once, so that no query pays for it.
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
