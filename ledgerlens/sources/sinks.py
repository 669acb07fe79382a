"""Report sinks: any report DataFrame written as files, day-keyed reports
partitioned by ``report_date`` so one day can be replaced on its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: Sequence[str] | None = None) -> None:
    """Write ``df`` as ``fmt`` (parquet / json / csv / orc) under ``path``.

    ``partition_by`` defaults to ``report_date`` when the report has that
    column. With ``mode="overwrite"`` and a partitioned layout, the write
    replaces only the partitions present in ``df`` (dynamic overwrite).
    """
    if partition_by is None:
        partition_by = ["report_date"] if "report_date" in df.columns else []
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.save(path)
