"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

NAMES = ["entity_counts", "pii_spans_email", "resolved_spans", "redacted_text", "typed_recall", "typed_precision", "section_locations", "normalized_markdown", "char_windows"]


def main() -> None:
    from pyspark.sql import SparkSession

    from maskwright.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name, d: catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
    run(NAMES[0], sf_dir)  # starts the session's machinery
    times = {}
    for name in NAMES:
        began = time.perf_counter()
        run(name, sf_dir)
        times[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    chars = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text)) AS n").first().n
    print(json.dumps({
        "metric": "seconds of all headline queries, warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
        "detection_chars_per_second": round(chars / times["entity_counts"]), "spark": spark.version, "cores": int(cpus), "shuffle_partitions": int(cpus),
    }))


if __name__ == "__main__":
    main()
