"""Benchmark: every registered report at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

The star schema is derived from the test tables once and written as Parquet
under the session's ``spark.checkpoint.dir`` (timed as ``materialize_star``),
as a deployment would hold it; each report then runs over that copy. A
report run is a full execution into the ``noop`` sink (no collect). Each
report gets one warm-up and ``$BENCH_RUNS`` (default 3) timed runs; the
median is reported, the spread is kept in ``spread``.

Reports are benchmarked over every day of the data and over March 1995.
Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens import registry  # noqa: E402
from ledgerlens.session import ensure_checkpoint_dir, local_session  # noqa: E402
from ledgerlens.sources.tables import read_parquet_tables, write_parquet_tables  # noqa: E402
from ledgerlens.sources.tpch import star_from_tpch  # noqa: E402


# Further forms of a report (one day, other patterns, one list of the
# composite) are for correctness; BENCH_ONLY can name them.
_FORMS = re.compile(r"_(one_day|names|busy_day|every_day|one_customer)$|^r22_(?!daily)")


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    shuffle = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, int(cpus) * 2))))
    spark = local_session(cores=cpus, shuffle_partitions=shuffle, app="ledgerlens-bench")

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-star-{uuid.uuid4().hex[:12]}"
    t0 = time.perf_counter()
    write_parquet_tables(star_from_tpch(spark, sf_dir), root)
    materialize = time.perf_counter() - t0
    tables = read_parquet_tables(spark, root)

    medians, spread, rows = {}, {}, {}
    for name, build in registry.REPORTS.items():
        if name not in only if only else _FORMS.search(name):
            continue
        _run(build(tables))  # warm-up: code generation, file listings
        times = []
        for _ in range(runs):
            s = time.perf_counter()
            _run(build(tables))
            times.append(time.perf_counter() - s)
        medians[name] = round(statistics.median(times), 4)
        spread[name] = [round(min(times), 4), round(max(times), 4)]
        rows[name] = build(tables).count()

    sf = os.path.basename(sf_dir).removeprefix("sf")
    out = {
        "metric": "sum_of_median_report_seconds",
        "value": round(sum(medians.values()), 4),
        "unit": "sec",
        "queries": medians,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "materialize_star_sec": round(materialize, 4),
        "spread": spread,
        "rows": rows,
        "config": {
            "spark": spark.version, "master": f"local[{cpus}]", "shuffle_partitions": shuffle,
            "aqe": spark.conf.get("spark.sql.adaptive.enabled"), "runs": runs,
            "driver_memory": spark.conf.get("spark.driver.memory"),
        },
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
