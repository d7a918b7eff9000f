"""Times the queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Batch queries are run in full into a sink that discards rows, and the better of
two runs counts. Streaming jobs run once over the event table as it is. Without
arguments the headline queries run; ``all`` or names choose others.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidewatch.catalog import QUERIES  # noqa: E402
from tidewatch.session import spark_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "log_search log_search_total event_by_id live_feed event_type_counts event_totals hourly_stats event_trend "
    "retention parsed_events user_minute_agg user_running_stats user_stat rule_context rule_matches "
    "rule_match_counts rule_validation action_results tag_actions audit_actions tumbling_offset_counts "
    "sliding_counts window_aggregates session_counts new_session_flags session_max_length "
    "detect_high_frequency detect_rapid_click detect_unusual_purchase detect_login_failure all_alerts "
    "default_alerts current_tags tags_as_of batch_tags tag_statistics profile_partial_update delete_users "
    "audit_list_page audit_todo audit_replay audit_replayed_orders audit_status_counts recent_activity "
    "activity_counters stream_minute_totals stream_alerts stream_capped_sessions stream_deduplicated"
).split()


def timed(spark, name: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main(names: list[str]) -> None:
    spark = spark_session(
        f"local[{CPUS}]", "tidewatch-bench",
        **{
            "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
            "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = list(QUERIES) if names == ["all"] else names or HEADLINE
    timed(spark, "event_totals")
    seconds, streams = {}, {}
    for name in chosen:
        if name.startswith("stream_"):
            streams[name] = round(timed(spark, name), 3)
        else:
            seconds[name] = round(min(timed(spark, name) for _ in range(2)), 3)
    events = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {**seconds, **streams},
        "sf": Path(FOLDER).name.removeprefix("sf"),
        "events": events,
        "rows_per_sec": {n: round(events / s) for n, s in seconds.items() if s},
        "stream_events_per_sec": {n: round(events / s) for n, s in streams.items() if s},
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
