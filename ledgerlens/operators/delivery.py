"""Fulfilment reports: the delivery board (R11), delivered / total invoices
per day (R13), delivery operations per site and day (R20) and delivery
agents per site and day (R21). Milestones (R11a) live in
:func:`ledgerlens.plans.base.milestones`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X
from ledgerlens.plans import base as B
from ledgerlens.plans.params import DEFAULT_PARAMS, ReportParams
from ledgerlens.sources.tables import Tables


def delivery_board(t: Tables, as_of=None, p: ReportParams = DEFAULT_PARAMS, days: int = 30) -> DataFrame:
    """Invoices of the last ``days`` days (no upper bound) that are not
    delivered yet or are dated ``as_of``, with delivery milestones.

    Customers in the excluded group (or with a NULL group) are left out.
    Stage durations are rounded minutes, NULL when negative; the status is
    shown normalised; ``current_status_since`` is the time of the latest
    known milestone not after the current status.

    Plan: the recent-invoice filter is pushed into the voucher scan.
    Invoices meet their customers once; representatives come from the small
    frame of those that are named. Only challans (and so history events) of
    those invoices enter the milestone aggregate, which is then left-joined
    by invoice id.
    Sorted by stage rank (pending/unknown 0, packed 1, shipped 2,
    delivered 3), date descending, voucher number.
    """
    today = X.as_date(as_of)
    status = F.col("delivery_status")
    open_or_today = (~F.lower(F.coalesce(status, F.lit(""))).isin(*X.DELIVERED_STATUSES)
                     | (F.col("transaction_date") == today))
    recent = B.sales_invoices(t, p, extra=(F.col("transaction_date") >= F.date_sub(today, days)) & open_or_today)
    cust = (B.customers(t, F.col("name").alias("party_name"), "party_group_id", "responsible_party_id")
            .filter(F.col("party_group_id") != F.lit(p.excluded_group_id)))
    v = recent.join(cust, "party_id").join(B.site_names(t), "site_id")
    v = B.attach(v, B.rep_names(t, "salesperson_name"), "responsible_party_id", "id")
    ms = B.milestones(t, recent.select("id"))
    v = v.join(ms, F.col("id") == F.col("voucher_id"), "left")

    shown = X.normalize_status(F.coalesce(status, F.lit("Pending")))
    created, packed, shipped, delivered = (F.col(c) for c in ("created_at", "packed_at", "shipped_at", "delivered_at"))
    since = (F.when(shown == "Delivered", F.coalesce(delivered, shipped, packed, created))
             .when(shown == "Shipped", F.coalesce(shipped, packed, created))
             .when(shown == "Packed", F.coalesce(packed, created))
             .otherwise(created))
    return (v.orderBy(X.status_rank(status), F.col("transaction_date").desc_nulls_first(),
                      F.col("voucher_number").asc_nulls_last(), "id")
            .select("id", "voucher_number", X.money(F.col("total_amount")).alias("total_amount"),
                    shown.alias("delivery_status"), "party_name", "site_id", "site_name", "transaction_date",
                    (F.col("transaction_date") == today).alias("is_today"),
                    X.rounded_minutes_nonneg(created, packed).alias("pending_to_packed_min"),
                    X.rounded_minutes_nonneg(packed, shipped).alias("packed_to_shipped_min"),
                    X.rounded_minutes_nonneg(shipped, delivered).alias("shipped_to_delivered_min"),
                    X.rounded_minutes_nonneg(created, delivered).alias("total_delivery_minutes"),
                    "delivered_by", "delivery_person", "salesperson_name", "created_at",
                    since.alias("current_status_since")))


def _day_vouchers(t: Tables, p: ReportParams, from_date, to_date) -> DataFrame:
    """Vouchers of the organisation at the report sites in the date range,
    of any type and cancelled or not (the delivery sections do not filter
    on either)."""
    v = B.voucher_scope(t, p, not_cancelled=False)
    cond = B.date_window("transaction_date", from_date, to_date)
    return v.filter(cond) if cond is not None else v


def _windowed(from_date, to_date) -> bool:
    return from_date is not None or to_date is not None


def delivery_counts(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS,
                    every_day: bool = False) -> DataFrame:
    """Per day, invoices having at least one challan, and how many of
    them have a delivered status. A semi-join (over all days) or one row per
    invoice of the window replaces the distinct count over the challan
    fan-out. With ``every_day`` a day of the range without
    such invoices has a row of zeros.
    Columns: report_date, delivered, delivery_total."""
    v = _day_vouchers(t, p, from_date, to_date)
    if not _windowed(from_date, to_date):
        # Distinct invoice ids of challans (combined map-side) before the
        # semi-join, so an invoice with very many challans is one row.
        invoiced = B.challans_of(t).select(F.col("voucher_id").alias("id")).distinct()
        with_challan = v.join(invoiced, "id", "left_semi")
    else:
        # The window's invoices reduce the challans; then one row per invoice.
        v = v.select(F.col("id").alias("voucher_id"), "transaction_date", "delivery_status")
        with_challan = B.challans_of(t).join(v, "voucher_id").drop("document_id").distinct()
    out = with_challan.groupBy(F.col("transaction_date").alias("report_date")).agg(
        F.count(F.when(X.status_in(F.col("delivery_status"), X.DELIVERED_STATUSES), 1)).alias("delivered"),
        F.count(F.lit(1)).alias("delivery_total"))
    if not every_day:
        return out
    cal = B.calendar(B.voucher_scope(t, p, not_cancelled=False), from_date, to_date)
    return cal.join(out, "report_date", "left").select("report_date", *(
        F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("delivered", "delivery_total")))


def _challans(t: Tables, from_date, to_date, p: ReportParams) -> DataFrame:
    """(document_id, voucher_id, site_id, report_date, delivery_status) of the
    challans of the range's vouchers."""
    v = _day_vouchers(t, p, from_date, to_date).select(
        F.col("id").alias("voucher_id"), "site_id", F.col("transaction_date").alias("report_date"), "delivery_status")
    return B.challans_of(t).join(v, "voucher_id")


_INVOICE = ("report_date", "site_id", "voucher_id", "delivery_status")


def _agent() -> Column:
    return F.when(F.col("has_shipped") & F.col("_user_found"), F.struct("full_name"))


def invoice_delivery(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Per invoice of the range that has a challan: report_date, site_id,
    voucher_id, delivery_status, ``_n`` (its challans), packed_at, shipped_at,
    delivered_at and ``agents`` (the names, as structs, of the known users
    that marked a challan shipped; at most one entry per user).

    Vouchers and challans are joined once, carrying the invoice's attributes;
    challans are counted per invoice, and status cells go straight to their
    invoice, both with map-side combine, so an invoice with very many challans
    never is a list of them. R20 and the composite read this frame.
    """
    challans = _challans(t, from_date, to_date, p)
    counted = challans.groupBy(*_INVOICE).agg(F.count("document_id").alias("_n"))
    stages = ("packed_at", "shipped_at", "delivered_at")
    # Both branches need all columns of ``challans``, so Spark reuses its exchanges.
    staged = B.status_events(t, challans, windowed=_windowed(from_date, to_date)).groupBy(*_INVOICE).agg(
        *(F.min(c).alias(c) for c in stages), F.collect_set(_agent()).alias("agents")).drop("report_date", "site_id", "delivery_status")
    return (counted.join(staged, "voucher_id", "left")
            .withColumn("agents", F.coalesce("agents", F.array().cast("array<struct<full_name:string>>"))))


def _stage_sums(weight) -> list:
    """Exact sums of the stage durations, times ``weight``, and of the weights."""
    out = []
    for name, (a, b) in {"ps": ("packed_at", "shipped_at"), "sd": ("shipped_at", "delivered_at"),
                         "pd": ("packed_at", "delivered_at")}.items():
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        diff = (X.epoch_micros(F.col(b)) - X.epoch_micros(F.col(a))).cast("decimal(20,0)")
        out += [F.sum(F.when(both, diff * weight.cast("decimal(20,0)"))).alias(f"_{name}_us"),
                F.sum(F.when(both, weight)).alias(f"_{name}_w")]
    return out


_SUMS = ("_ps_us", "_ps_w", "_sd_us", "_sd_w", "_pd_us", "_pd_w")


def _delivery_columns() -> list:
    means = [X.round_mean_minutes(F.col(f"_{k}_us"), F.col(f"_{k}_w")) for k in ("ps", "sd", "pd")]
    return ["report_date", "site_id", "total", "delivered",
            *(m.alias(f"avg_{c}_min") for m, c in zip(means, ("packed_to_shipped", "shipped_to_delivered", "end_to_end"), strict=True)),
            *(X.fmt_minutes(m).alias(c) for m, c in zip(means, ("packed_to_shipped", "shipped_to_delivered", "end_to_end"), strict=True))]


def _totals(dedupe: bool) -> list:
    weight = F.lit(1) if dedupe else F.col("_n")
    return [F.count(F.lit(1)).alias("total"),
            F.count(F.when(X.status_in(F.col("delivery_status"), X.DELIVERED_STATUSES), 1)).alias("delivered"),
            *_stage_sums(weight)]


def delivery_operations(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS,
                        dedupe: bool = False) -> DataFrame:
    """Per day and site, invoices with challans, how many are delivered,
    and mean stage durations (packed->shipped, shipped->delivered,
    packed->delivered) in minutes, rounded half away from zero, with
    ``Xh Ym`` renderings. Negative durations are kept.

    Each invoice's durations are weighted by its number of challans, as the
    per-challan join of the original report does (``dedupe=True`` weighs
    every invoice once); means are exact (decimal sums of microseconds,
    integer rounding).
    Columns: report_date, site_id, total, delivered, avg_packed_to_shipped_min,
    avg_shipped_to_delivered_min, avg_end_to_end_min, packed_to_shipped,
    shipped_to_delivered, end_to_end.
    """
    invoices = invoice_delivery(t, from_date, to_date, p)
    return invoices.groupBy("report_date", "site_id").agg(*_totals(dedupe)).select(*_delivery_columns())


def delivery_agents(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Per day, site and user name, the number of distinct invoices the
    user marked shipped / in transit. Events of unknown users are dropped.

    The distinct count is one aggregate to (invoice, name) rows, combined
    map-side, and a plain count of them; no list is made of any invoice.
    Columns: report_date, site_id, agent_name, order_count; sorted by site,
    count descending."""
    challans = _challans(t, from_date, to_date, p).drop("delivery_status")
    cells = B.status_events(t, challans, windowed=_windowed(from_date, to_date))
    pairs = cells.filter("has_shipped AND _user_found").select(
        "report_date", "site_id", "voucher_id", F.col("full_name").alias("agent_name")).distinct()
    agg = pairs.groupBy("report_date", "site_id", "agent_name").agg(F.count(F.lit(1)).alias("order_count"))
    return agg.orderBy("report_date", "site_id", F.col("order_count").desc(), F.col("agent_name").asc_nulls_last())


def rollup_agents(daily: DataFrame, unit: str = "day", by_site: bool = True) -> DataFrame:
    """R21 over longer periods or all sites, from rows of
    :func:`delivery_agents` (fresh, stored, or several disjoint day ranges in
    one frame).

    An invoice has one date and one site, so the distinct invoices of a week,
    a month or all sites are the disjoint union of those of its days and
    sites: the exact counts merge by a sum, without a second distinct.
    Columns: period, [site_id,] agent_name, order_count."""
    period = F.col("report_date") if unit == "day" else X.trunc_date(unit, F.col("report_date"))
    keys = [period.alias("period"), *(["site_id"] if by_site else []), "agent_name"]
    return daily.groupBy(*keys).agg(F.sum("order_count").cast("bigint").alias("order_count"))


def delivery_with_agents(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS,
                         dedupe: bool = False) -> DataFrame:
    """R20's rows with R21's as ``agents[]`` (count descending, then name), in
    one pass: every invoice gives a row of its own and one per agent; both
    kinds are counted by one aggregate and folded per (day, site)."""
    rows = invoice_delivery(t, from_date, to_date, p).withColumn("who", F.explode(F.concat(
        F.array(F.struct(F.lit(True).alias("own"), F.lit(None).cast("string").alias("name"))),
        F.transform("agents", lambda a: F.struct(F.lit(False).alias("own"), a["full_name"].alias("name"))))))
    counted = rows.groupBy("report_date", "site_id", F.col("who.own").alias("own"), F.col("who.name").alias("name")).agg(*_totals(dedupe))
    own = F.col("own")
    agent = F.when(~own, F.struct((-F.col("total")).alias("k"), F.col("name"), F.col("total").alias("order_count")))
    folded = counted.groupBy("report_date", "site_id").agg(
        *(F.max(F.when(own, F.col(c))).alias(c) for c in ("total", "delivered", *_SUMS)),
        F.transform(F.sort_array(F.collect_list(agent)), lambda x: F.struct(x["name"].alias("name"), x["order_count"].alias("order_count"))).alias("agents"))
    return folded.select(*_delivery_columns(), "agents")
