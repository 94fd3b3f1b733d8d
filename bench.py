"""Time the headline queries at ``$BENCH_SF_DIR`` and print one JSON line.

``cells_per_sec`` relates detection time to the number of cells, the only rate the published
figures allow a comparison with (2.46 million cells a second for one amplitude detection).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import all_queries  # noqa: E402
from checks import views as V  # noqa: E402
from deltacell.operators import focal, stack  # noqa: E402
from deltacell.session import build_session, settle  # noqa: E402

HEADLINE = (
    "wi_minimum", "median_composite", "background_offset", "index_family", "threshold_adaptive_median", "auc",
    "reference_evaluation", "youden_quantile", "background_sensitivity", "box_mean", "median_filter", "lee_filter",
    "binary_closing", "threshold_map", "components", "objects", "object_metrics", "resample_nearest", "resample_bilinear",
    "resample_average", "burn_polygon", "distance_ring", "slc_chains", "scene_plan", "parse_products",
    "suitability_score", "crosstab_year_type", "site_match", "detect_wi", "detect_coherence", "annual_mask",
)


def scene(spark, sf: str):
    """A large scene laid out from the embeddings: every value becomes a 14 x 14 block of cells."""
    n = 14
    f = V.raw_field(spark, sf).selectExpr("grid_id", "row", "explode(sequence(0, 13)) as dr", "col", "value")
    f = f.repartition("grid_id", "row", "dr").selectExpr("*", "explode(sequence(0, 13)) as dc")
    return f.selectExpr(
        "grid_id", f"row * {n} + dr as row", f"col * {n} + dc as col", "value + (hash(dr, dc) % 100) / 1000 as value"
    )


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    queries["auc"](spark, sf).collect()  # start the JVM's and the workers' engines
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)

    cells = settle(scene(spark, sf))
    n_cells = cells.count()
    t = time.time()
    limits = stack.mean_threshold(cells, 0.2)
    focal.threshold_map(cells, limits, 3).write.format("noop").mode("overwrite").save()
    spent = time.time() - t
    seconds["scene_threshold"] = round(spent, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "scene_cells": n_cells, "cells_per_sec": round(n_cells / spent),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
