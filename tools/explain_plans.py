"""Write the formatted physical plan of every registered report.

usage: python tools/explain_plans.py [sf_dir] [out_dir]

The star schema is derived from ``sf_dir`` once and written as Parquet under
the session's ``spark.checkpoint.dir``, so the plans show real Parquet scans
(``PushedFilters``, ``ReadSchema``) as a deployment over stored tables would.
"""

import contextlib
import io
import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens import registry  # noqa: E402
from ledgerlens.session import ensure_checkpoint_dir, local_session  # noqa: E402
from ledgerlens.sources.tables import read_parquet_tables, write_parquet_tables  # noqa: E402
from ledgerlens.sources.tpch import star_from_tpch  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out_dir = sys.argv[2] if len(sys.argv) > 2 else "docs/plans"
    spark = local_session()
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/plans-star-{uuid.uuid4().hex[:12]}"
    write_parquet_tables(star_from_tpch(spark, sf_dir), root)
    tables = read_parquet_tables(spark, root)
    os.makedirs(out_dir, exist_ok=True)
    for name, build in registry.REPORTS.items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            build(tables).explain(mode="formatted")
        text = buf.getvalue().replace(root, "<star>")
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as f:
            f.write(text)
        print(name, len(text))


if __name__ == "__main__":
    main()
