"""Times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed in full (all rows written to Spark's noop sink).
"""

import json
import os
import sys
import time

NAMES = """flagship_revenue agg_group agg_distinct cube grouping_sets rollup pivot_two_columns unpivot_measures agg_statistics
join_semi join_anti join_anti_null_aware join_hint_hash join_hint_merge subquery_correlated window_ranking window_frames_rows
window_frames_range rownum_total_order set_except_all set_intersect connect_by_tree dml_merge fn_strings fn_regexp fn_dates
fn_json events_tumbling""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from tidemill.plans.registry import QUERIES
    from tidemill.session import SETTINGS

    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=SETTINGS | {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in NAMES:
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
