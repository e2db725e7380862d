"""Times of headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = ["trx_summary", "continuity_trx", "continuity_event", "segment_trx", "filter_shell", "table_map_lookup", "flatten_changes", "schema_asof", "gtid_merge", "split_rows", "merge_empty", "accept_packages", "metric_meter", "replica_gate", "verbose_rows", "dump_row_groups"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidelog.plans import catalog

    run = lambda q: catalog.QUERIES[q](spark, sf).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])
    times = {}
    for q in HEADLINE:
        t = time.perf_counter()
        run(q)
        times[q] = round(time.perf_counter() - t, 3)
    events = catalog.ev(spark, sf).count()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "events": events, "events_per_s": {q: round(events / times[q]) for q in ("trx_summary", "continuity_trx", "segment_trx", "verbose_rows")}}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
