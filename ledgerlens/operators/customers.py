"""Customer reports: next-order follow-up (R9), customer locations over the
last 30 days (R10) and customers added per local day (R17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X
from ledgerlens.plans import base as B
from ledgerlens.plans.params import DEFAULT_PARAMS, ReportParams
from ledgerlens.sources.tables import Tables


def listed_customers(t: Tables, p: ReportParams, *cols) -> DataFrame:
    """Customers shown in the follow-up lists: name not matching
    ``p.exclude_name_like`` and group different from the excluded one (a
    NULL name or group drops the customer, as in SQL)."""
    return (B.customers(t, F.col("name").alias("customer_name"), "party_group_id", *cols)
            .filter(~F.col("customer_name").ilike(p.exclude_name_like)
                    & (F.col("party_group_id") != F.lit(p.excluded_group_id)))
            .drop("party_group_id"))


def branch_keys(t: Tables) -> DataFrame:
    """(site_id, branch, branch_key). Branches are site names (sites sharing a
    name are one branch); a small integer key per name goes through the
    aggregates, names come at the end."""
    return t.sites.select(F.col("id").alias("site_id"), F.col("name").alias("branch"),
                          F.min("id").over(Window.partitionBy("name")).alias("branch_key"))


def predictions(t: Tables, branches: DataFrame, as_of, recent_days: int) -> DataFrame:
    """R9's rows from one row per listed customer and branch: the customer's
    columns, branch_key, total_orders, the sums ``_gap_sum``, ``_hour_sum``,
    ``_hour_n``, ``_undated``, and the branch's ``_first`` (day, id) and
    ``_last`` (day, id, amount) order."""
    site_branch, by_customer = branch_keys(t), Window.partitionBy("party_id")
    rows = (branches
            .withColumn("_opening", F.min("_first").over(by_customer))
            .withColumn("_latest", F.max("_last").over(by_customer))
            .withColumn("_undated", F.sum("_undated").over(by_customer))
            .withColumn("last_purchase_date", F.date_add(F.lit("1970-01-01").cast("date"), F.col("_latest.day")))
            .filter((F.col("_undated") == 0) & (F.col("_last") == F.col("_latest"))
                    & (F.col("last_purchase_date") >= F.date_sub(X.as_date(as_of), recent_days))))
    branch_names = site_branch.select("branch_key", "branch").dropDuplicates(["branch_key"])
    rows = B.attach(rows.join(branch_names, "branch_key"), B.rep_names(t, "sales_rep"), "responsible_party_id", "party_id")

    n_gaps = F.col("total_orders") - F.when(F.col("_opening") == F.col("_first"), 1).otherwise(0)
    avg_cycle = X.round_ratio(F.coalesce(F.col("_gap_sum"), F.lit(0)), n_gaps)
    rows = rows.withColumn("avg_cycle_days", avg_cycle).withColumn(
        "usual_order_hour", X.round_ratio(F.col("_hour_sum"), F.col("_hour_n")))
    predicted = F.when(F.col("avg_cycle_days").isNotNull(),
                       F.date_add(F.col("last_purchase_date"), F.col("avg_cycle_days").cast("int")))
    rows = rows.withColumn("predicted_next_order_date", predicted).withColumn(
        "days_until_order", X.days_between(F.col("predicted_next_order_date"), X.as_date(as_of)).cast("bigint"))
    return (rows.orderBy(F.col("usual_order_hour").asc_nulls_last(), F.col("days_until_order").asc_nulls_last(),
                         "party_id")
            .select("party_id", "customer_name", "branch",
                    X.blank_to_null(F.col("sales_rep")).alias("sales_rep"),
                    X.blank_to_null(F.col("phone")).alias("phone"),
                    "last_purchase_date",
                    X.money_or_zero(F.col("_latest.amount")).alias("last_order_amount"),
                    F.col("total_orders").cast("bigint").alias("total_orders"),
                    "avg_cycle_days", "usual_order_hour", "predicted_next_order_date", "days_until_order"))


def followup_customers(t: Tables, as_of=None, p: ReportParams = DEFAULT_PARAMS, recent_days: int = 30) -> DataFrame:
    """Predicted next order per customer from the gaps between orders.

    Semantics: orders of a customer are ordered by (date, id); each order's
    gap is the days since the previous order *at any branch*, and is credited
    to the branch of the later order. Only the branch of the customer's
    latest order is reported, with that branch's order count, mean gap
    (rounded half away from zero), mean local order hour, and the predicted
    date ``last + mean gap``. Customers whose latest order is older than
    ``recent_days`` before ``as_of`` are dropped after all history is used;
    a customer with an undated order is dropped (its latest order is
    undated). Sorted by usual hour, then days until the order, NULLS LAST.

    Plan: one scan of the orders, reduced with map-side combine to (customer,
    day, branch) cells; a dominant customer is at most one cell per calendar
    day and branch. The cells meet the listed customers by customer id, and
    everything after runs on that partitioning, without a self-join: the
    previous order day (a range window over the day), the day's first branch,
    the sums per branch, and the customer's first and last order as windows
    over the few branch rows. On a day's first order's branch falls the gap
    to the previous order day; the day's other orders have a gap of 0.

    Columns: party_id, customer_name, branch, sales_rep, phone,
    last_purchase_date, last_order_amount, total_orders, avg_cycle_days,
    usual_order_hour, predicted_next_order_date, days_until_order.
    """
    orders = (B.sales_invoices(t, p)
              .join(branch_keys(t).select("site_id", "branch_key"), "site_id")
              .select("party_id", "branch_key", F.datediff("transaction_date", F.lit("1970-01-01")).alias("day"), "id",
                      "total_amount", X.local_hour(F.col("created_at"), p.tz).alias("_hour")))
    cells = orders.groupBy("party_id", "day", "branch_key").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_hour").alias("_hour_sum"), F.count("_hour").alias("_hour_n"),
        F.min("id").alias("_min_id"), F.max("id").alias("_max_id"),
        F.max_by("total_amount", "id").alias("_amount"))

    listed = listed_customers(t, p, "phone", "responsible_party_id")
    by_customer = Window.partitionBy("party_id")
    cells = (cells.join(listed, "party_id")
             .withColumn("_day_first", F.min("_min_id").over(Window.partitionBy("party_id", "day")))
             .withColumn("_before", F.max("day").over(by_customer.orderBy("day").rangeBetween(Window.unboundedPreceding, -1))))
    opens_day = F.col("_min_id") == F.col("_day_first")
    branches = cells.groupBy("party_id", "customer_name", "phone", "responsible_party_id", "branch_key").agg(
        F.sum("_n").alias("total_orders"), F.sum("_hour_sum").alias("_hour_sum"), F.sum("_hour_n").alias("_hour_n"),
        F.sum(F.when(opens_day, F.col("day") - F.col("_before"))).alias("_gap_sum"),
        F.count(F.when(F.col("day").isNull(), 1)).alias("_undated"),
        F.min(F.struct("day", F.col("_min_id").alias("id"))).alias("_first"),
        F.max(F.struct("day", F.col("_max_id").alias("id"), F.col("_amount").alias("amount"))).alias("_last"))
    return predictions(t, branches, as_of, recent_days)


def customer_locations(t: Tables, as_of=None, p: ReportParams = DEFAULT_PARAMS, days: int = 30) -> DataFrame:
    """Per customer and site, invoices since ``as_of - days`` (no upper
    bound): last order date, count and revenue, with the customer's geo
    location and phone. Unlike R7 / R9 no customer group is excluded.

    Plan: invoices are aggregated per (customer, site) first; customer and
    site attributes are then looked up on that aggregate.
    Columns: party_id, customer_name, site_id, branch, geo_location, phone,
    last_order_date, orders_last_30d, revenue_last_30d.
    """
    v = B.sales_invoices(t, p, extra=F.col("transaction_date") >= F.date_sub(X.as_date(as_of), days))
    agg = v.groupBy("party_id", "site_id").agg(
        F.max("transaction_date").alias("last_order_date"),
        F.count(F.lit(1)).alias("orders_last_30d"), F.sum("total_amount").alias("_rev"))
    cust = (B.customers(t, F.col("name").alias("customer_name"), "geo_location", "phone")
            .filter(~F.col("customer_name").ilike(p.exclude_name_like)))
    rows = agg.join(cust, "party_id").join(B.site_names(t, "site_id", "branch"), "site_id")
    return (rows.orderBy(F.col("_rev").desc_nulls_first(), "party_id", "site_id")
            .select("party_id", "customer_name", "site_id", "branch",
                    X.blank_to_null(F.col("geo_location")).alias("geo_location"),
                    X.blank_to_null(F.col("phone")).alias("phone"),
                    "last_order_date", "orders_last_30d", X.money(F.col("_rev")).alias("revenue_last_30d")))


def new_customers(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS,
                  with_created_at: bool = False) -> DataFrame:
    """Customers created on each local day (zone ``p.tz``) of the range,
    at their home site (a report site), not in the new-customer excluded
    groups (NULL group kept), with the representative who added them
    (``Unknown`` when none). Open bounds cover every day.

    The local-day bounds are also stated on ``created_at`` itself so the
    range is pushed into the scan.
    Columns: report_date, customer_name, site_name, site_id, added_by (and
    created_at with ``with_created_at``); sorted by report_date, created_at.
    """
    created = F.col("created_at")
    local_day = X.local_date(created, p.tz)
    cond = ((F.col("organization_id") == F.lit(p.org_id)) & F.col("site_id").isin(*p.site_ids)
            & ~F.coalesce(F.col("party_group_id"), F.lit(0)).isin(*p.new_customer_excluded_group_ids))
    if from_date is not None:
        lo = X.as_date(from_date)
        cond = cond & (local_day >= lo) & (created >= X.local_midnight(lo, p.tz))
    if to_date is not None:
        hi = F.date_add(X.as_date(to_date), 1)
        cond = cond & (local_day < hi) & (created < X.local_midnight(hi, p.tz))
    ps = (t.parties.filter(cond)
          .select(local_day.alias("report_date"), F.col("name").alias("customer_name"), "site_id",
                  "responsible_party_id", "created_at")
          .filter(F.col("report_date").isNotNull()))
    rows = B.attach(ps.join(B.site_names(t, "site_id", "site_name"), "site_id"),
                    B.rep_names(t, "_rep"), "responsible_party_id", "customer_name", "created_at")
    return (rows.orderBy("report_date", F.col("created_at").asc_nulls_last(), "customer_name")
            .select("report_date", "customer_name", "site_name", "site_id",
                    F.coalesce(F.col("_rep"), F.lit("Unknown")).alias("added_by"),
                    *(["created_at"] if with_created_at else [])))


def new_customer_counts(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Count of :func:`new_customers` per report_date."""
    return (new_customers(t, from_date, to_date, p).groupBy("report_date")
            .agg(F.count(F.lit(1)).alias("new_customer_count")))
