"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query runs once to warm up and is
then timed; all rows are computed and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barspark.operators import features, indicators, prepare, zones  # noqa: E402
from barspark.plans import number_rows  # noqa: E402
from barspark.registry import QUERIES  # noqa: E402
from barspark.registry.base import DAILY, brand_days  # noqa: E402


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        # windows cost far more than their bytes suggest: keep small exchanges spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def brand_sequences(spark: SparkSession, sf: str) -> DataFrame:
    rows = number_rows(brand_days(spark, sf), DAILY)
    columns = ["open", "high", "low", "close", "volume"]
    fitted = prepare.fit_minmax_train(rows, columns, 90, 15)
    scaled = prepare.scale(rows, fitted, columns, DAILY)
    return prepare.split_by_fraction(prepare.sequences(scaled, columns, 90, 15, layout=DAILY))


HEADLINE = {
    "bars_from_ticks": QUERIES["bars_h1"],
    "brand_day_bars": brand_days,
    "brand_day_features_simple": lambda s, d: features.technical_features(
        brand_days(s, d), indicators.SIMPLE, DAILY
    ),
    "brand_day_features_wilder": lambda s, d: features.technical_features(
        brand_days(s, d), indicators.WILDER, DAILY
    ),
    "brand_day_zones": lambda s, d: zones.detect_zones(brand_days(s, d), layout=DAILY),
    "brand_day_sequences": brand_sequences,
    "order_intents": QUERIES["order_intents"],
    "trailing_stops": QUERIES["trailing_stops"],
    "quotes_at": QUERIES["quotes_at"],
    "metric_rows": QUERIES["metric_rows"],
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    chosen = sys.argv[1:] or list(HEADLINE)
    took = {}
    for name in chosen:
        for _ in range(2):
            started = time.perf_counter()
            HEADLINE[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - started, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    print(
        json.dumps(
            {"metric": "total_wall_time", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
