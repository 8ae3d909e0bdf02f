"""Time the reports end to end; prints one JSON line.

Every report is built, planned and executed in full into Spark's ``noop`` sink.
``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from poolscope.catalog import REPORTS  # noqa: E402
from poolscope.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "poolscope-bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        REPORTS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("top_pools_by_class")  # starts the JVM's code paths; not counted
    seconds = {name: round(run(name), 3) for name in REPORTS}
    print(
        json.dumps(
            {
                "metric": "report_seconds_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
