"""Seconds per headline query, as one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores; names on the command line
replace the headline queries. Every result is computed in full and thrown away."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siteloom.plans.catalog import QUERIES  # noqa: E402
from siteloom.session import local_session  # noqa: E402
from siteloom.sources.tables import table  # noqa: E402

HEADLINES = [
    "canonical_urls", "site_page_counts", "link_inventory", "link_graph", "page_texts", "page_names",
    "page_types", "page_fields", "site_profiles", "document_emails", "document_phones", "noise_audit", "heading_items", "card_items",
    "feed_extract", "company_profiles", "frontier_round", "site_reach", "url_variants",
    "retry_final", "fetch_outcomes", "robots_decisions", "politeness", "pages_replace", "fetch_health",
]
# Queries that read every raw page once.
PAGE_QUERIES = ["site_profiles", "link_inventory", "page_texts", "page_names", "page_types", "feed_extract"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, max(8, int(cpus) if cpus.isdigit() else 8))
    pages = table(spark, folder, "pages").count()  # also warms up the session
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "pages_per_second": {
                    n: round(pages / seconds[n], 1) for n in PAGE_QUERIES if n in seconds
                },
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
