"""Time headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1 after one
warm-up of the JVM), BENCH_QUERIES (comma separated names; default the headline list).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallybridge import catalog  # noqa: E402
from tallybridge.session import local_session  # noqa: E402

HEADLINE = [
    "w1_dedupe_statement", "d1_classify", "p2_plan_disposition", "d2_post_vouchers", "w4_number_vouchers", "close_month",
    "j3_resolve_vendor", "x1_money_archive", "x5_clean_text", "x7_money_mentions", "x9_html_to_text", "x11_document_date",
    "j5_candidates", "j6_blocked_pairs", "w2_rank_candidates", "d9_route", "j14_match_record", "m1_upsert_archive", "d17_plausibility",
    "j19_ledger_star", "d13_ledger_state", "a3_expense_months", "d20_todo", "d11_lane", "r2_inbox_match",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    catalog.load()
    spark = local_session("bench", cores=cpus, partitions=int(cpus))
    catalog.QUERIES["a1_tag_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        took = []
        for _ in range(runs):
            started = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - started)
        seconds[name] = round(statistics.median(took), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
