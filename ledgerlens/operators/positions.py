"""Output order as data: the place of every row of a sorted report.

A report ends with a global sort, i.e. Spark's range partitions in order, each
sorted. :func:`with_positions` adds the rows' places, 1 to n, by prefix counts:

1. A row's partition and its place there come with the sorted rows, without a
   further exchange or window. The rows are written so to the shared folder:
   range bounds are sampled, so sorting twice could place a row twice.
2. Rows are counted per partition; the counts, one row per partition of the
   sort, add up to each partition's start.
3. The start joins the stored rows by partition. Their sizes are known from
   the files, so Spark broadcasts the starts by its own threshold.

Nothing sees all rows in one window or task, and rows keep whatever order the
report has, also by columns it does not show. Rows that tie in the report's
order get their places in the order they came out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

#: Bits of ``monotonically_increasing_id`` below the partition number.
_PLACE_BITS = 33


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_positions(report: DataFrame, name: str = "pos") -> DataFrame:
    """The rows of a sorted ``report`` with their places as the long column
    ``name``, from 1, in no particular order. Runs the report once and keeps
    its rows in ``spark.checkpoint.dir``. An empty report stays empty."""
    if name.lower() in (c.lower() for c in report.columns):
        raise ValueError(f"the report has a column {name}")
    root = f"{ensure_checkpoint_dir(report.sparkSession).rstrip('/')}/positions-{uuid.uuid4().hex[:12]}"
    part, place = "_part_of_" + name, "_place_of_" + name
    at = F.monotonically_increasing_id()
    rows = report.withColumn(place, at)
    rows = _stored(rows.withColumn(part, F.shiftright(place, _PLACE_BITS).cast("int"))
                   .withColumn(place, F.col(place).bitwiseAND((1 << _PLACE_BITS) - 1)), f"{root}/rows")
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the sort
    starts = _stored(counts.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), f"{root}/starts")
    return rows.join(starts, part).select(*report.columns, (F.col("_start") + F.col(place) + 1).alias(name))
