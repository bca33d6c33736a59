"""Benchmark of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Times run
from building a query to its last row, intermediate tables included; start-up of the session and one
untimed backtest (compilation, file listing) come before. `signals_local_N` is the signal workload in a process of
its own on N cores, start-up and a first run again excluded.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import time

from barloom.plans import catalog
from barloom.session import local_session

HEADLINE = [
    "backtest_result",
    "backtest_sweep",
    "sma",
    "crossover_signals",
    "drawdown_curve",
    "volatility",
    "bars_position",
    "custom_strategy",
    "liveness_gaps",
    "ledger_counts",
    "price_path",
]
SCALING = (1, 2, 4)


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def scaling(cpus: str) -> None:
    """One workload on a given number of cores; prints its seconds."""
    spark = local_session(cpus, shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    timed(lambda: catalog.generated_signals(spark))
    print(timed(lambda: catalog.generated_signals(spark)))
    spark.stop()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    seconds = {}
    for n in SCALING:
        said = subprocess.run([sys.executable, __file__, str(n)], capture_output=True, text=True, check=True).stdout
        seconds[f"signals_local_{n}"] = float(said.split()[-1])
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus)))
    spark.sparkContext.setLogLevel("ERROR")
    timed(lambda: catalog.QUERIES["backtest_result"](spark, folder))
    seconds.update({name: timed(lambda: catalog.QUERIES[name](spark, folder)) for name in HEADLINE})
    seconds.update(catalog.workloads(spark, folder, timed))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    scaling(sys.argv[1]) if len(sys.argv) > 1 else main()
