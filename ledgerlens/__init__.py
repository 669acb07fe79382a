"""ledgerlens — sales, receivables and fulfilment reports as Spark plans.

Each report is a function ``(Tables, parameters) -> DataFrame`` built from
built-in DataFrame operations; see README.md for the report inventory.
"""

from ledgerlens.plans.params import DEFAULT_PARAMS, ReportParams  # noqa: F401
from ledgerlens.sources.tables import (  # noqa: F401
    Tables,
    read_catalog_tables,
    read_jdbc_tables,
    read_parquet_tables,
    write_bucketed_tables,
    write_parquet_tables,
)
