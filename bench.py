"""Headline timings, as one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the cores. Each query runs twice into
a sink that reads every row and keeps none; the faster run counts. Some entries measure
the same thing in several ways and are not part of the total:

* all claims of a table in one scan, or one query per claim;
* the side of the median from counts, the exact median by clamping, or from a value map.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimcheck.operators import probes
from claimcheck.session import configure
from workload.inputs import relation, table
from workload.queries import AS_OF, FUSED, QUERIES

HEADLINE = (
    "adjudicate", "fused_profile", "unit_profile", "reconcile_100x", "distinct_values",
    "usage_window", "freshness_profile", "effective_descriptions", "extract_claims",
    "merge_upstreams", "verdict_summary", "dossiers", "corrections", "incidents_to_resolve",
    "drain_corrections", "dossiers_to_delete", "asset_context", "asset_report", "score_table",
)


def _consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def comparisons(sf_dir: str) -> dict[str, Callable[[SparkSession], list[DataFrame]]]:
    def lineitem(spark):
        return table(spark, sf_dir, "lineitem")

    columns = FUSED[probes.UNIT]
    return {
        "claims_fused": lambda s: [probes.fused_profile(lineitem(s), FUSED, as_of=AS_OF)],
        "claims_one_by_one": lambda s: [
            probes.fused_profile(lineitem(s), {kind: [c]})
            for kind, wanted in FUSED.items() for c in wanted]
            + [probes.freshness_profile(lineitem(s), AS_OF)],
        "median_side_by_counts": lambda s: [
            probes.fused_profile(lineitem(s), {probes.UNIT: columns})],
        "median_by_selection": lambda s: [probes.exact_medians(lineitem(s), columns)],
        "median_exact_value_map": lambda s: [
            lineitem(s).agg(*[F.median(c) for c in columns])],
        "reconcile_by_counts": lambda s: [
            probes.reconcile_100x(relation(s, sf_dir, "lineitem_hundred"), lineitem(s),
                                  "l_suppkey", "l_suppkey", "hundredfold", "l_quantity")],
    }


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    runs = {name: (lambda s, n=name: [QUERIES[n](s, sf_dir)]) for name in HEADLINE}
    runs.update(comparisons(sf_dir))
    only = sys.argv[1:]
    timings: dict[str, float] = {}
    for name, build in runs.items():
        if only and name not in only:
            continue
        best = None
        for _ in range(2):
            start = time.perf_counter()
            for df in build(spark):
                _consume(df)
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)
        print(f"{name} {best:.3f}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "claim verification, headline queries",
        "value": round(sum(v for k, v in timings.items() if k in HEADLINE), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
