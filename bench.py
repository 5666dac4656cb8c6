"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shirabe import catalog  # noqa: E402
from shirabe.session import build_session  # noqa: E402

HEADLINE = [
    "job_payment_method_master",
    "job_payment_alert_list",
    "job_payment_alert_history",
    "job_opening_payment_guide",
    "job_thanks_history",
    "job_repair_follow_up",
    "job_action_point_entries",
    "job_usage_by_member",
    "job_unified_customer_mart",
    "job_contract_presence",
    "job_member_master",
    "job_wide_mart",
    "win_latest_per_key",
    "win_lag_change",
    "win_sessionize",
    "join_any_slot",
    "join_any_key",
    "join_only_one_in_group",
    "join_outlier_count",
    "inc_delta_upsert",
    "inc_track_history",
    "dq_rules",
    "dq_profile",
    "dq_pii_scan",
    "dq_reconcile",
    "mkt_churn_risk",
    "mkt_segment_metrics",
    "mkt_product_performance",
    "ev_sliding",
    "ev_session_patterns",
    "ev_rate_limit",
    "st_tumbling",
    "st_uniques",
    "win_number_rows",
    "inc_spans",
    "sink_csv_gz",
    "sink_json",
    "write_upsert",
    "fn_flatten_json",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    # One untimed query loads the engine; each timed query then runs once, in full.
    catalog.QUERIES["agg_group_by"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
