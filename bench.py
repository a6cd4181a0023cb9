"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "J02_A02_unit_listing",
    "J01_A01_filtered_counts",
    "J03_A03_usage_details",
    "V06_J11_W01_effective_find",
    "V07_effective_diff",
    "J07_V11_categories",
    "V12_V13_J08_O05_C19_constant_diff",
    "X05_find_unit",
    "R01_S16_postings",
    "R05_ranked",
    "K01_K05_K07_X01_call_rules",
    "A14_T06_job_counters",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from stratalode.catalog import Catalogue
    from stratalode.plans.registry import QUERIES, _index

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    setup = {}
    for name, write in (("catalogue_write", Catalogue.over), ("index_write", _index)):  # once a session
        began = time.perf_counter()
        write(spark, sf_dir)
        setup[name] = round(time.perf_counter() - began, 3)
    took = {}
    for name in HEADLINES:
        times = []
        for _ in range(2):  # the second run counts: code is compiled
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "catalogue_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "setup": setup, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
