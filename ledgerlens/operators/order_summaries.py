"""R9 from summaries: a customer's orders at a site within a period as one row.

A segment is (party_id, period, site_id) with the number of orders, the sums
behind R9's means and the segment's first and last order. Segments of adjacent
periods merge into those of a longer one: sums add up, and between the last
order of a period and the first one of the next lies one more gap, which is
credited to the site of the later order, as all gaps are. The merge is
associative: days make months, months make years or all time, in any grouping
(:func:`merged`), and the follow-up report is the merge over all time
(:func:`followup_from`).

:func:`create` stores the segments of every month, one directory per month.
New vouchers change their own months only, and :func:`refresh` recomputes
these from the vouchers of these months. A report reads a row per customer,
month and site instead of the vouchers.

Definitions. The orders are those of ``sales_invoices`` under the
``ReportParams`` at writing (organisation, sites, type, time zone), at a known
site, with a customer. Orders without a date form the period NULL; R9 drops
their customers. A month that has lost all its orders keeps an empty marker row
(without customer), so that a refresh replaces it too. Of a site that becomes
known later, make the months anew. Repeated voucher ids count as often as they
come, as in R9.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X
from ledgerlens.operators.customers import branch_keys, listed_customers, predictions
from ledgerlens.plans import base as B
from ledgerlens.plans.params import DEFAULT_PARAMS, ReportParams
from ledgerlens.sources.sinks import write_report
from ledgerlens.sources.tables import Tables

SUMS = ("orders", "gap_sum", "hour_sum", "hour_n", "undated")
SCHEMA = ("party_id bigint, site_id int, orders bigint, gap_sum bigint, hour_sum bigint, hour_n bigint, undated bigint, "
          "first struct<day:int,id:bigint>, last struct<day:int,id:bigint,amount:decimal(18,2)>, period date")


def day_segments(t: Tables, p: ReportParams = DEFAULT_PARAMS, extra: Column | None = None) -> DataFrame:
    """The orders as segments of one day; the orders of a day have no gap.
    ``extra``: a condition on the vouchers, pushed into their scan."""
    day, hour = F.datediff("transaction_date", F.lit("1970-01-01")), X.local_hour(F.col("created_at"), p.tz)
    orders = (B.sales_invoices(t, p, extra=extra).filter("party_id IS NOT NULL")
              .join(t.sites.select(F.col("id").alias("site_id")), "site_id", "left_semi"))
    return orders.groupBy("party_id", "site_id", F.col("transaction_date").alias("period")).agg(
        F.count(F.lit(1)).alias("orders"), F.lit(0).cast("bigint").alias("gap_sum"),
        F.coalesce(F.sum(hour), F.lit(0)).cast("bigint").alias("hour_sum"), F.count(hour).alias("hour_n"),
        F.count(F.when(F.col("transaction_date").isNull(), 1)).alias("undated"),
        F.min(F.struct(day.alias("day"), "id")).alias("first"),
        F.max(F.struct(day.alias("day"), "id", F.col("total_amount").alias("amount"))).alias("last"))


def merged(segments: DataFrame, into: Column, by: str = "site_id", *carried: str) -> DataFrame:
    """Segments merged into the longer periods ``into`` (an expression over
    ``period``), per column ``by`` of a customer; columns that depend on the
    customer are ``carried`` along.

    Windows and aggregate run on one partitioning, by customer and period; a
    window sees the segments of one customer within one longer period, a part
    of the calendar times the sites.
    """
    whole = Window.partitionBy("party_id", "_into")
    earlier = whole.orderBy(F.datediff("period", F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -1)
    s = (segments.withColumn("_into", into)
         .withColumn("_before", F.max("last.day").over(earlier))
         .withColumn("_opens", F.min("first").over(Window.partitionBy("party_id", "_into", "period"))))
    gap = F.when(F.col("first") == F.col("_opens"), F.col("first.day") - F.col("_before")).otherwise(0)
    s = s.withColumn("gap_sum", F.col("gap_sum") + F.coalesce(gap, F.lit(0)))
    return s.groupBy("party_id", *carried, by, "_into").agg(
        *(F.sum(c).alias(c) for c in SUMS), F.min("first").alias("first"), F.max("last").alias("last")
    ).withColumnRenamed("_into", "period")


def month_segments(t: Tables, p: ReportParams = DEFAULT_PARAMS, extra: Column | None = None) -> DataFrame:
    return merged(day_segments(t, p, extra), F.trunc("period", "MM"))


def followup_from(t: Tables, segments: DataFrame, as_of=None, p: ReportParams = DEFAULT_PARAMS, recent_days: int = 30) -> DataFrame:
    """R9 (``customers.followup_customers``) from segments of any periods.

    Only customers with a segment that reaches into the last ``recent_days``
    days can be reported; the others' segments are dropped ahead of the merge.
    Vouchers are not read.
    """
    since = F.datediff(F.date_sub(X.as_date(as_of), recent_days), F.lit("1970-01-01"))
    active = segments.filter(F.col("last.day") >= since).select("party_id").distinct()
    listed = listed_customers(t, p, "phone", "responsible_party_id").join(active, "party_id", "left_semi")
    known = segments.join(branch_keys(t).select("site_id", "branch_key"), "site_id").join(listed, "party_id")
    branches = merged(known, F.lit(0), "branch_key", "customer_name", "phone", "responsible_party_id")
    return predictions(t, branches.withColumnsRenamed(
        {"orders": "total_orders", "first": "_first", "last": "_last", **{c: f"_{c}" for c in SUMS[1:]}}).drop("period"), as_of, recent_days)


def touched_months(added: DataFrame) -> list[dt.date | None]:
    """The months (first days; None: undated) of new vouchers: a part of the
    calendar."""
    return [r[0] for r in added.select(F.trunc("transaction_date", "MM")).distinct().collect()]


def _among(months: Iterable[dt.date | None]) -> Column:
    """Vouchers of the months, as date ranges that reach the scan."""
    day, out = F.col("transaction_date"), F.lit(False)
    for m in months:
        if m is None:
            out = out | day.isNull()
        else:
            after = (m.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
            out = out | ((day >= F.lit(m.replace(day=1))) & (day < F.lit(after)))
    return out


def _write(df: DataFrame, path: str) -> None:
    # one task per month writes its file unless AQE splits a large month
    write_report(df.select(*SUMS, "party_id", "site_id", "first", "last", "period").hint("rebalance", F.col("period")), path, partition_by=["period"])


def create(t: Tables, path: str, p: ReportParams = DEFAULT_PARAMS) -> None:
    """Store the segments of every month under ``path``."""
    _write(month_segments(t, p), path)


def refresh(t: Tables, path: str, months: Iterable[dt.date | None], p: ReportParams = DEFAULT_PARAMS) -> None:
    """Replace the stored segments of ``months`` (None: undated orders) by
    those of ``t``; the other months' files stay. Repeating it is harmless."""
    months = sorted({m and m.replace(day=1) for m in months}, key=str)
    if not months:
        return
    markers = t.spark.createDataFrame([(m,) for m in months], "period date").withColumn("orders", F.lit(0).cast("bigint"))
    _write(month_segments(t, p, _among(months)).unionByName(markers, allowMissingColumns=True), path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The segments under ``path``."""
    return spark.read.schema(SCHEMA).parquet(path).filter("party_id IS NOT NULL")
