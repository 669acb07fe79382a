"""Sales reports: two-day summary (R1), 12-month trend (R2), two-day
breakdowns by site and by party group (R3, R4), and the day / week / month
trend with per-site pivot (R5). ``as_of`` defaults to today."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X
from ledgerlens.plans import base as B
from ledgerlens.plans.params import DEFAULT_PARAMS, ReportParams
from ledgerlens.sources.tables import Tables

GRANULARITY_UNITS = {"daily": "day", "weekly": "week", "monthly": "month"}


def _two_days(as_of) -> tuple[Column, Column]:
    today = X.as_date(as_of)
    return today, F.date_sub(today, 1)


def _period(labels: tuple[str, str], as_of) -> Column:
    today, yesterday = _two_days(as_of)
    d = F.col("transaction_date")
    return F.when(d == today, F.lit(labels[0])).when(d == yesterday, F.lit(labels[1]))


def _two_day_invoices(t: Tables, as_of, p: ReportParams) -> DataFrame:
    today, yesterday = _two_days(as_of)
    return B.sales_invoices(t, p, extra=F.col("transaction_date").isin(today, yesterday))


def sales_summary(t: Tables, as_of=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Invoice count and sales for ``as_of`` and the day before.

    Columns: label, transaction_date, invoice_count, sales. A day without
    invoices has no row. Sorted by date descending.
    """
    v = _two_day_invoices(t, as_of, p)
    agg = v.groupBy("transaction_date").agg(
        F.count(F.lit(1)).alias("invoice_count"), F.sum("total_amount").alias("_sales"))
    return (agg.select(_period(("Today", "Yesterday"), as_of).alias("label"), "transaction_date",
                       "invoice_count", X.money_or_zero(F.col("_sales")).alias("sales"))
            .orderBy(F.col("transaction_date").desc_nulls_first()))


def _pivot_sums(p: ReportParams, amount: str = "total_amount") -> list[Column]:
    """``COALESCE(SUM(amount) FILTER (WHERE site_id = k), 0)`` per pivot
    column, then the all-site total; one aggregate, no pivot shuffle."""
    cols = [F.sum(F.when(F.col("site_id") == k, F.col(amount))).alias(f"_p_{name}")
            for name, k in p.site_pivot.items()]
    return cols + [F.sum(amount).alias("_total")]


def _pivot_output(p: ReportParams) -> list[Column]:
    return ([X.money_or_zero(F.col(f"_p_{name}")).alias(name) for name in p.site_pivot]
            + [X.money_or_zero(F.col("_total")).alias("total_sales")])


def monthly_sales(t: Tables, as_of=None, p: ReportParams = DEFAULT_PARAMS, months: int = 12) -> DataFrame:
    """R2: sales per calendar month from the month ``months - 1`` before
    ``as_of`` onwards (no upper bound), one column per pivot site and the
    total. Columns: month (DATE), <pivot columns>, total_sales."""
    lower = F.trunc(F.add_months(X.as_date(as_of), -(months - 1)), "MM")
    v = B.sales_invoices(t, p, extra=F.col("transaction_date") >= lower)
    agg = v.groupBy(F.trunc("transaction_date", "MM").alias("month")).agg(*_pivot_sums(p))
    return agg.select("month", *_pivot_output(p)).orderBy(F.col("month").asc_nulls_last())


def sales_by_site(t: Tables, as_of=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Two-day invoice count and total per site.

    Columns: period, site_id, site_name, invoice_count, total_amount.
    """
    v = _two_day_invoices(t, as_of, p).join(B.site_names(t, "_site", "site_name"),
                                            F.col("site_id") == F.col("_site"))
    agg = v.groupBy("transaction_date", "site_id", "site_name").agg(
        F.count(F.lit(1)).alias("invoice_count"), F.sum("total_amount").alias("_amt"))
    return (agg.orderBy(F.col("transaction_date").desc_nulls_first(), F.col("site_id").asc_nulls_last())
            .select(_period(("today", "yesterday"), as_of).alias("period"), "site_id", "site_name",
                    "invoice_count", X.money_or_zero(F.col("_amt")).alias("total_amount")))


def sales_by_group(t: Tables, as_of=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Two-day invoice count and total per site and party group.

    The NULL group is reported as ``Other`` after grouping, so a group that
    is really named ``Other`` stays a separate row.
    Columns: period, site_id, group_name, invoice_count, total_amount.
    """
    # Pre-aggregate per customer so the customer join sees one row per
    # (day, site, customer); a customer with a huge share of invoices is
    # collapsed map-side before any shuffle.
    per_party = _two_day_invoices(t, as_of, p).groupBy("transaction_date", "site_id", "party_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("total_amount").alias("_amt"))
    v = (per_party.join(B.customers(t, "party_group_id"), "party_id")
         .join(B.group_names(t), "party_group_id", "left"))
    agg = v.groupBy("transaction_date", "site_id", "group_name").agg(
        F.sum("_n").cast("bigint").alias("invoice_count"), F.sum("_amt").alias("_amt"))
    return (agg.orderBy(F.col("transaction_date").desc_nulls_first(), F.col("_amt").desc_nulls_first(),
                        F.col("site_id").asc_nulls_last(), F.coalesce(F.col("group_name"), F.lit("Other")))
            .select(_period(("today", "yesterday"), as_of).alias("period"), "site_id",
                    F.coalesce(F.col("group_name"), F.lit("Other")).alias("group_name"),
                    "invoice_count", X.money_or_zero(F.col("_amt")).alias("total_amount")))


def sales_trend(t: Tables, from_date, to_date, granularity: str = "daily",
                exclude_corporate: bool = False, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Sales per day / week (Monday start) / month in ``[from, to]``.

    Both bounds are inclusive; the first week or month bucket may start
    before ``from`` and then holds only the days from ``from`` on. With
    ``exclude_corporate`` invoices of customers whose group name matches
    ``p.corporate_like`` (case-insensitive) are dropped, and so are invoices
    without a known customer (the customer join is inner).
    Columns: date (DATE), <pivot columns>, total_sales.
    """
    if granularity not in GRANULARITY_UNITS:
        raise ValueError("granularity must be one of daily, weekly, monthly")
    if from_date in (None, "") or to_date in (None, ""):
        raise ValueError("from_date and to_date are required")
    unit = GRANULARITY_UNITS[granularity]
    d = F.col("transaction_date")
    v = B.sales_invoices(t, p, extra=d.between(X.as_date(from_date), X.as_date(to_date)))
    bucket = X.trunc_date(unit, d).alias("date")
    if exclude_corporate:
        # Sum per (bucket, site, customer) first, then drop corporate
        # customers on that aggregate: the customer join sees one row per
        # customer and bucket instead of one per invoice.
        per_party = v.groupBy(bucket, "site_id", "party_id").agg(F.sum("total_amount").alias("total_amount"))
        v = (per_party.join(B.customers(t, "party_group_id"), "party_id")
             .join(B.group_names(t), "party_group_id", "left")
             .filter(F.col("group_name").isNull() | ~F.col("group_name").ilike(p.corporate_like)))
        agg = v.groupBy("date").agg(*_pivot_sums(p))
    else:
        agg = v.groupBy(bucket).agg(*_pivot_sums(p))
    return agg.select("date", *_pivot_output(p)).orderBy(F.col("date").asc_nulls_last())
