"""Seconds for each audit query at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import re
import time

from pyspark.sql import SparkSession

from plumbline import queries


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries.Q["profile_text"](spark, sf).collect()  # starts the session's machinery
    took = {}
    for name in queries.SQL:
        began = time.time()
        queries.Q[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "audit queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float((re.search(r"sf([\d.]+)", sf) or [0, "0"])[1])}))


if __name__ == "__main__":
    main()
