"""Headline timings as one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: cores of the local session.

Every query of the catalog runs once over whole tables into a sink that drops rows, after one small
query that starts the session's workers. ``search`` holds the figures of a saved index: seconds to build
it, median seconds of a single warm query, queries a second in a batch, and hit rate.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.operators import evaluate
from lectern.operators.index import Index, build_index
from lectern.operators.search import search, search_batch
from lectern.plans import catalog
from lectern.plans.fixtures import document_units, table

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
REPEAT = 5


def seconds(f) -> float:
    began = time.perf_counter()
    f()
    return round(time.perf_counter() - began, 3)


def search_figures(spark: SparkSession, folder: str) -> dict:
    units = document_units(table(spark, SF, "documents"))
    build = seconds(lambda: build_index(units.select("id", "text"), ["text"]).save(folder))
    index = Index.load(spark, folder, ["text"], True)
    texts = [r[0] for r in table(spark, SF, "benchmark").select(F.substring("text", 1, 40)).limit(REPEAT + 1).collect()]
    single = [seconds(lambda t=t: search(index, units, t, 5, (10.0,)).collect()) for t in texts]
    cases = catalog._cases(spark, SF)
    n = cases.count()
    batch = seconds(lambda: search_batch(index, units, cases.select("case_id", "query"), 5, (10.0,)).write.format("noop").mode("overwrite").save())
    rate = evaluate.score_cases(index, units, cases, 5, (10.0,)).first().hit_rate
    return {"index_build_s": build, "single_query_s": statistics.median(single[1:]), "batch_queries_per_s": round(n / batch, 2), "top5_hit_rate": round(rate, 3)}


def main() -> int:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS))).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["porter_vocab"](spark, SF).limit(10).collect()
    folder = tempfile.mkdtemp(prefix="bench-")
    times = {n: seconds(lambda q=q: q(spark, SF).write.format("noop").mode("overwrite").save()) for n, q in catalog.QUERIES.items()}
    try:
        figures = search_figures(spark, folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "catalog_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "search": figures, "cpus": int(CPUS), "sf": SF}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
