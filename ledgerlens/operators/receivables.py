"""Receivables: aging buckets (R6), at-risk customers (R7), open invoices of
customers (R8) and outstanding receivables by site (R19)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X
from ledgerlens.plans import base as B
from ledgerlens.plans.params import DEFAULT_PARAMS, ReportParams
from ledgerlens.sources.tables import Tables


def _open_with_due(t: Tables, p: ReportParams, **kw) -> DataFrame:
    """Open invoices (unpaid / partially paid) with a positive amount due."""
    return B.sales_invoices(t, p, extra=X.is_open_invoice() & (F.col("amount_due") > 0), **kw)


def ar_aging(t: Tables, as_of=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Open receivables in 0-30 / 31-60 / 61-90 / 90+ day buckets.

    Bucket bounds are inclusive; future-dated invoices fall in 0-30 and an
    invoice without a date in 90+. Sorted by the youngest age in the bucket.
    Columns: age_bucket, invoice_count, outstanding.
    """
    age = X.days_between(X.as_date(as_of), F.col("transaction_date"))
    v = _open_with_due(t, p).select(age.alias("_age"), "amount_due")
    agg = v.groupBy(X.aging_bucket(F.col("_age")).alias("age_bucket")).agg(
        F.count(F.lit(1)).alias("invoice_count"), F.sum("amount_due").alias("_due"),
        F.min("_age").alias("_min_age"))
    return (agg.orderBy(F.col("_min_age").asc_nulls_last())
            .select("age_bucket", "invoice_count", X.money_or_zero(F.col("_due")).alias("outstanding")))


def at_risk_customers(t: Tables, as_of=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Customers with a positive open balance, per branch.

    Over every invoice of the customer: last purchase (paid or not), days
    since, and for open invoices (any amount due, credits included) their
    count, balance and oldest date. Customers in the excluded group, with a
    NULL group, or whose name matches ``p.exclude_name_like`` are left out.
    Branches are merged by name. Sorted by balance descending, then customer
    and branch.

    Plan: the invoice history is first reduced to one row per (customer,
    site) with a map-side-combined aggregate, so a customer holding a large
    share of all invoices costs one partial row per task; the customer,
    branch and representative lookups then join that small aggregate.
    Columns: party_id, customer_name, branch, sales_rep, last_purchase_date,
    days_inactive, open_invoice_count, total_outstanding, oldest_due_date.
    """
    is_open = X.is_open_invoice()
    per_site = B.sales_invoices(t, p).groupBy("party_id", "site_id").agg(
        F.max("transaction_date").alias("_last"),
        F.count(F.when(is_open, F.lit(1))).alias("_open_n"),
        F.sum(F.when(is_open, F.col("amount_due")).otherwise(F.lit(0))).alias("_due"),
        F.min(F.when(is_open, F.col("transaction_date"))).alias("_oldest"))
    cust = (B.customers(t, F.col("name").alias("customer_name"), "party_group_id", "responsible_party_id")
            .filter(~F.col("customer_name").ilike(p.exclude_name_like)
                    & (F.col("party_group_id") != F.lit(p.excluded_group_id))))
    rows = (per_site.join(cust, "party_id")
            .join(B.site_names(t, "site_id", "branch"), "site_id")
            .groupBy("party_id", "customer_name", "branch", "responsible_party_id").agg(
                F.max("_last").alias("last_purchase_date"),
                F.sum("_open_n").alias("open_invoice_count"),
                F.sum("_due").alias("_due"),
                F.min("_oldest").alias("oldest_due_date"))
            .filter(F.col("_due") > 0))
    rows = B.attach(rows, B.rep_names(t, "sales_rep"), "responsible_party_id", "party_id")
    return (rows.orderBy(F.col("_due").desc_nulls_first(), "party_id", "branch")
            .select("party_id", "customer_name", "branch",
                    X.blank_to_null(F.col("sales_rep")).alias("sales_rep"),
                    "last_purchase_date",
                    X.days_between(X.as_date(as_of), F.col("last_purchase_date")).cast("bigint")
                    .alias("days_inactive"),
                    F.col("open_invoice_count").cast("bigint").alias("open_invoice_count"),
                    X.money(F.col("_due")).alias("total_outstanding"),
                    "oldest_due_date"))


def open_invoices(t: Tables, party_id, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Open invoices (positive amount due) of one customer, any site.

    ``party_id`` must be a positive integer. Sorted by date, then id.
    Columns: voucher_number, transaction_date, total_amount, amount_due,
    payment_status.
    """
    if isinstance(party_id, bool) or not isinstance(party_id, int) or party_id <= 0:
        raise ValueError("party_id is required and must be a positive integer")
    v = _open_with_due(t, p, sites=False).filter(F.col("party_id") == F.lit(party_id))
    return (v.orderBy(F.col("transaction_date").asc_nulls_last(), F.col("id"))
            .select("voucher_number", "transaction_date", X.money(F.col("total_amount")).alias("total_amount"),
                    X.money(F.col("amount_due")).alias("amount_due"), "payment_status"))


def open_invoices_for(t: Tables, parties: DataFrame | Iterable[int] | None = None,
                      p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """R8 for a set of customers in one job: ``parties`` is a frame whose
    first column holds party ids, an iterable of ids (made into such a
    frame), or None for every customer. Adds ``party_id``; sorted by
    customer, date, id."""
    v = _open_with_due(t, p, sites=False)
    if parties is not None:
        if not isinstance(parties, DataFrame):
            parties = t.spark.createDataFrame([(int(i),) for i in parties], "party_id bigint")
        ids = parties.select(F.col(parties.columns[0]).alias("party_id"))
        v = v.join(ids, "party_id", "left_semi")
    return (v.orderBy("party_id", F.col("transaction_date").asc_nulls_last(), "id")
            .select("party_id", "voucher_number", "transaction_date",
                    X.money(F.col("total_amount")).alias("total_amount"),
                    X.money(F.col("amount_due")).alias("amount_due"), "payment_status"))


def _outstanding_agg(t: Tables, p: ReportParams) -> DataFrame:
    v = _open_with_due(t, p).join(B.site_names(t, "_sid", "site_name"), F.col("site_id") == F.col("_sid"))
    return v.groupBy("site_id", "site_name").agg(F.sum("amount_due").alias("_due"),
                                                  F.count(F.lit(1)).alias("open_invoice_count"))


def outstanding_by_site(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Open receivables per site as of now (independent of any report
    date). Columns: site_id, site_name, outstanding, open_invoice_count;
    sorted by outstanding descending."""
    return (_outstanding_agg(t, p).orderBy(F.col("_due").desc_nulls_first())
            .select("site_id", "site_name", X.money_or_zero(F.col("_due")).alias("outstanding"),
                    "open_invoice_count"))


def outstanding_summary(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """R19 as one row: ``total`` (exact decimal sum over the sites) and the
    ``by_site`` array in outstanding-descending order. The array has one
    entry per report site."""
    entry = F.struct("site_id", "site_name", X.money_or_zero(F.col("_due")).alias("outstanding"),
                     "open_invoice_count")
    return _outstanding_agg(t, p).agg(
        X.money_or_zero(F.sum("_due")).alias("total"),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_due")).alias("k"), F.col("site_id").alias("s"),
                                                         entry.alias("e")))),
                    lambda x: x["e"]).alias("by_site"))
