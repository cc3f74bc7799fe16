"""One JSON line: seconds of the headline queries, each the median of five runs after a warm-up."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tidewell.plans import catalogue

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NAMES = ("digest_all_periods", "digest_blocks", "insert_if_absent", "apply_update", "dedup_first", "contact_scrub", "html_escape")


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(6):
            t = time.time()
            catalogue.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
