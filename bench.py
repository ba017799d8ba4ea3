"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select
data and cores.  Every figure is the wall time of building the plan, analysing
it and running it into a no-op sink: the median of BENCH_RUNS (default 3) after
one warm-up on the smallest tables, under Spark's default settings.  For queries
over given texts the line also has documents and MB of text a second, for all
of them the MB that were shuffled.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from doctriage.plans import render  # noqa: E402
from doctriage.plans.queries import QUERIES, all_texts  # noqa: E402

HEADLINE = [
    "normalize_text",
    "score_wide",
    "score_long",
    "route_documents",
    "find_matches",
    "extract_invoices",
    "extract_tickets",
    "extract_passports",
    "best_names",
    "rename_plan",
    "analyze_corpus",
    "report_rows",
]
#: Queries over all given texts; the others have a document per order or customer.
OVER_TEXTS = {"normalize_text", "score_wide", "score_long", "route_documents", "find_matches"}
ROWS = {"extract_invoices": ["orders"], "extract_tickets": ["orders"], "extract_passports": ["customer"], "best_names": ["customer"], "rename_plan": ["orders"]}


def shuffled(spark: SparkSession) -> int:
    """Bytes written by all shuffles so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def run(query, spark: SparkSession, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # The given files have one row group each: rows are dealt out so that all cores work.
        .config("doctriage.spread", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    texts, size = all_texts(spark, sf_dir).agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    counts = {t: render.table(spark, sf_dir, t).count() for t in ("orders", "customer")}
    timings, rates = {}, {}
    for name in names:
        run(QUERIES[name], spark, small if os.path.isdir(small) else sf_dir)
        before = shuffled(spark)
        timings[name] = round(statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
        docs = texts if name in OVER_TEXTS else sum(counts[t] for t in ROWS.get(name, ["orders", "orders", "customer"]))
        rates[name] = {"docs_per_sec": round(docs / timings[name]), "shuffle_mb": round((shuffled(spark) - before) / runs / 1e6, 1)}
        if name in OVER_TEXTS:
            rates[name]["text_mb_per_sec"] = round(size / 1e6 / timings[name], 1)
        print(name, timings[name], rates[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "rates": rates,
    }
    if {"score_long", "score_wide"} <= timings.keys():
        line["table_to_unrolled"] = round(timings["score_long"] / timings["score_wide"], 2)
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
