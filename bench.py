"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the no-op sink (no collect), timed
individually. A synthetic panel of $BENCH_SERIES series (default 100,000 x 30
years) measures fit + forecast throughput at a scale the driver tables do not
reach. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "demand_panel",
    "forecast_linear_price",
    "forecast_logistic_price",
    "forecast_implied_price",
    "forecast_blend",
    "leaderboard",
    "best_model_forecast",
    "rolling_backtest",
    "backtest_leaderboard",
    "sensitivity_sweep",
    "panel_clean",
    "panel_validation",
    "param_noise_forecast",
    "bootstrap_forecast",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    n_series = int(os.environ.get("BENCH_SERIES", "100000"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("panelcast-bench")
             .config("spark.sql.shuffle.partitions", str(max(8, int(cpus) * 2)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from panelcast.plans.queries import QUERIES
    from panelcast.operators import horizon as H
    from panelcast.operators import models as M
    from panelcast.sources.panel import synthetic_panel

    times: dict[str, float] = {}
    # Warm-up: JVM class loading and codegen caches, not counted.
    QUERIES["demand_panel"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    t0 = time.perf_counter()
    panel = synthetic_panel(spark, n_series, n_years=30)
    fits = M.fit_linear_price(panel)
    H.predict_linear_price(fits, 10).write.format("noop").mode("overwrite").save()
    syn = time.perf_counter() - t0
    times[f"synthetic_{n_series}_series_fit_forecast"] = round(syn, 3)

    from panelcast.operators import bootstrap as B
    n_boot, sims = int(os.environ.get("BENCH_BOOT_SERIES", "2000")), 100
    t0 = time.perf_counter()
    bfits = B.fit_bootstrap_logistic(synthetic_panel(spark, n_boot, n_years=20),
                                     {"optimize_parameters": True, "n_simulations": sims})
    B.predict_bootstrap_logistic(bfits, 10).write.format("noop").mode("overwrite").save()
    boot = time.perf_counter() - t0
    times[f"synthetic_bootstrap_{n_boot}_series_x{sims}"] = round(boot, 3)

    total = round(sum(v for k, v in times.items() if not k.startswith("synthetic")), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": int(cpus),
        "synthetic_series_per_sec": round(n_series / syn, 1),
        "bootstrap_series_x_sims_per_sec": round(n_boot * sims / boot, 1),
    }))


if __name__ == "__main__":
    main()
