"""Daily report sections and the composite daily report (R12, R14-R16, R18,
R22), for every day of a date range in one job.

Every section is keyed by ``report_date``; a single day is
``from_date == to_date``. Open bounds (None) cover every day in the data.
The composite joins the per-day sections onto a calendar, so a day without
any voucher still gets a row with zeros and empty lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X
from ledgerlens.operators import customers as C
from ledgerlens.operators import delivery as D
from ledgerlens.operators import receivables as R
from ledgerlens.plans import base as B
from ledgerlens.plans.params import DEFAULT_PARAMS, ReportParams
from ledgerlens.sources.tables import Tables


def _in_range(from_date, to_date) -> Column | None:
    return B.date_window("transaction_date", from_date, to_date)


def _invoices(t: Tables, p: ReportParams, from_date, to_date, codes=None) -> DataFrame:
    codes = codes or (p.invoice_code,)
    return B.typed_vouchers(t, p, codes, extra=_in_range(from_date, to_date)).withColumnRenamed(
        "transaction_date", "report_date")


def _sorted_entries(entries: Column, *keys: Column) -> Column:
    """``collect_list`` of ``entries`` ordered by ``keys`` (ascending struct
    order, NULLs first); the keys are dropped from the result."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*keys).alias("k"), entries.alias("e")))),
                       lambda x: x["e"])


def _desc(c: Column) -> Column:
    """Sort key that orders a numeric column descending with NULLs first."""
    return -c


def day_cells(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS, codes=None) -> DataFrame:
    """Voucher totals per (report_date, site_id, party_id, type_code):
    ``_amt`` (exact decimal sum) and ``_n`` (count), combined map-side."""
    v = _invoices(t, p, from_date, to_date, codes or (p.invoice_code, p.receipt_code))
    return v.groupBy("report_date", "site_id", "party_id", "type_code").agg(
        F.sum("total_amount").alias("_amt"), F.count(F.lit(1)).alias("_n"))


def day_totals(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS, codes=None) -> DataFrame:
    """Voucher totals per (report_date, site_id, type_code, party_group_id,
    responsible_party_id, known): the cells with the customer's attributes in
    place of the customer (``known``: the customer exists). A few rows per day,
    from which all revenue and collection sections follow."""
    cust = B.customers(t, "party_group_id", "responsible_party_id", F.lit(True).alias("known"))
    cells = B.attach(day_cells(t, from_date, to_date, p, codes), cust, "party_id", "report_date", "site_id")
    return (cells.withColumn("known", F.coalesce("known", F.lit(False)))
            .groupBy("report_date", "site_id", "type_code", "party_group_id", "responsible_party_id", "known")
            .agg(F.sum("_amt").alias("_amt"), F.sum("_n").alias("_n")))


def _hero(totals: DataFrame, p: ReportParams) -> DataFrame:
    """R12's rows from any frame with report_date, type_code, _amt and _n."""
    inv, rct = F.col("type_code") == p.invoice_code, F.col("type_code") == p.receipt_code
    agg = totals.groupBy("report_date").agg(
        F.sum(F.when(inv, F.col("_amt"))).alias("_rev"),
        F.sum(F.when(inv, F.col("_n"))).alias("_inv_n"),
        F.sum(F.when(rct, F.col("_amt"))).alias("_coll"),
        F.sum(F.when(rct, F.col("_n"))).alias("_rct_n"))
    return agg.select("report_date", X.money_or_zero(F.col("_rev")).alias("revenue"),
                      X.count_or_zero(F.col("_inv_n")).alias("invoice_count"),
                      X.money_or_zero(F.col("_coll")).alias("collections"),
                      X.count_or_zero(F.col("_rct_n")).alias("receipt_count"))


def _by_type(t: Tables, p: ReportParams, from_date, to_date, codes, *keys: str) -> DataFrame:
    """Totals per day, ``keys`` and type, summed straight from the vouchers."""
    return _invoices(t, p, from_date, to_date, codes).groupBy("report_date", *keys, "type_code").agg(
        F.sum("total_amount").alias("_amt"), F.count(F.lit(1)).alias("_n"))


def daily_hero(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS,
               every_day: bool = False) -> DataFrame:
    """Per day, invoice revenue and count, receipt collections and count
    (one aggregate over both voucher types). With ``every_day`` a day of the
    range without vouchers has a row of zeros.
    Columns: report_date, revenue, invoice_count, collections, receipt_count."""
    hero = _hero(_by_type(t, p, from_date, to_date, (p.invoice_code, p.receipt_code)), p)
    if not every_day:
        return hero
    cal = B.calendar(B.voucher_scope(t, p, not_cancelled=False), from_date, to_date)
    return cal.join(hero, "report_date", "left").select("report_date", *(
        F.coalesce(c, F.lit(0).cast(hero.schema[c].dataType)).alias(c) for c in hero.columns if c != "report_date"))


def _site_groups(t: Tables, p: ReportParams, totals: DataFrame) -> DataFrame:
    return (totals.filter((F.col("type_code") == p.invoice_code) & F.col("known"))
            .join(B.group_names(t), "party_group_id", "left")
            .join(B.site_names(t), "site_id")
            .groupBy("report_date", "site_id", "site_name", "group_name").agg(
                F.sum("_amt").alias("_rev"), F.sum("_n").cast("bigint").alias("invoice_count")))


def site_group_revenue(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """R14 rows: per day, site and customer group, invoice revenue and count
    (NULL group shown as ``Other`` after grouping).
    Columns: report_date, site_id, site_name, party_group, revenue, invoice_count."""
    agg = _site_groups(t, p, day_totals(t, from_date, to_date, p, (p.invoice_code,)))
    return (agg.orderBy("report_date", "site_id", F.col("_rev").desc_nulls_first())
            .select("report_date", "site_id", "site_name",
                    F.coalesce(F.col("group_name"), F.lit("Other")).alias("party_group"),
                    X.money_or_zero(F.col("_rev")).alias("revenue"), "invoice_count"))


def _sites(t: Tables, p: ReportParams, totals: DataFrame, hero: DataFrame) -> DataFrame:
    entry = F.struct(F.coalesce(F.col("group_name"), F.lit("Other")).alias("party_group"),
                     X.money_or_zero(F.col("_rev")).alias("revenue"), F.col("invoice_count"))
    sites = _site_groups(t, p, totals).groupBy("report_date", "site_id").agg(
        F.first("site_name").alias("site_name"),
        F.sum("_rev").alias("_total"),
        F.sum("invoice_count").alias("invoice_count"),
        _sorted_entries(entry, _desc(F.col("_rev")), F.col("group_name")).alias("breakdown"))
    sites = sites.join(hero.select("report_date", F.col("revenue").alias("_hero")), "report_date", "left")
    total = X.money_or_zero(F.col("_total"))
    hero_rev = F.coalesce(F.col("_hero"), F.lit(0.0))
    pct = F.when(hero_rev > 0, X.js_round(total / hero_rev * F.lit(1000.0)) / F.lit(10.0)).otherwise(F.lit(0.0))
    return sites.select(
        "report_date", "site_id", "site_name", total.alias("total_revenue"),
        F.col("invoice_count").cast("bigint").alias("invoice_count"), "breakdown",
        pct.cast("double").alias("revenue_pct"))


def site_revenue(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """R14 site rollup: per day and site, total revenue and invoice count,
    the group breakdown (revenue descending) and the share of the day's
    hero revenue in percent with one decimal (0 when that revenue is not
    positive; shares need not add up to 100).
    Columns: report_date, site_id, site_name, total_revenue, invoice_count,
    breakdown, revenue_pct."""
    folded = _folded(day_totals(t, from_date, to_date, p, (p.invoice_code,)))
    return _sites(t, p, folded, _hero(folded, p)).orderBy("report_date", "site_id")


def _salesmen(t: Tables, p: ReportParams, totals: DataFrame) -> DataFrame:
    own = totals.filter((F.col("type_code") == p.invoice_code) & F.col("known")
                        & ~F.coalesce(F.col("party_group_id"), F.lit(0)).isin(*p.salesman_excluded_group_ids))
    return (B.attach(own, B.rep_names(t, "_rep"), "responsible_party_id", "report_date", "site_id")
            .join(B.site_names(t), "site_id")
            .groupBy("report_date", "site_id", "site_name", "_rep").agg(F.sum("_amt").alias("_rev"))
            .withColumn("salesperson", F.coalesce(F.col("_rep"), F.lit("Unassigned"))))


def salesman_revenue(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """R15 rows: per day, site and sales representative, invoice revenue of
    customers outside the salesman-excluded groups (NULL group kept); no
    representative shows as ``Unassigned`` (after grouping).

    Plan: invoices are summed per (day, site, customer) before the customer
    join, and per (day, site, representative id) before the representative
    names are looked up, so neither join sees one row per invoice.
    Columns: report_date, site_id, site_name, salesperson, revenue."""
    agg = _salesmen(t, p, day_totals(t, from_date, to_date, p, (p.invoice_code,)))
    return (agg.orderBy("report_date", "site_id", F.col("_rev").desc_nulls_first())
            .select("report_date", "site_id", "site_name", "salesperson", X.money_or_zero(F.col("_rev")).alias("revenue")))


def _collections(t: Tables, p: ReportParams, totals: DataFrame) -> DataFrame:
    return (totals.filter(F.col("type_code") == p.receipt_code).join(B.site_names(t), "site_id")
            .groupBy("report_date", "site_id", "site_name").agg(
                F.sum("_amt").alias("_coll"), F.sum("_n").cast("bigint").alias("receipt_count")))


def collections_by_site(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Per day and site, receipt total and count.
    Columns: report_date, site_id, site_name, collections, receipt_count."""
    agg = _collections(t, p, _by_type(t, p, from_date, to_date, (p.receipt_code,), "site_id"))
    return (agg.orderBy("report_date", F.col("_coll").desc_nulls_first())
            .select("report_date", "site_id", "site_name", X.money_or_zero(F.col("_coll")).alias("collections"),
                    "receipt_count"))


def _top(t: Tables, p: ReportParams, from_date, to_date, k: int) -> DataFrame:
    inv = _invoices(t, p, from_date, to_date).select(F.col("id").alias("voucher_id"), "report_date")
    per_item = (t.voucher_items.join(inv, "voucher_id")
                .groupBy("report_date", "item_id")
                .agg(F.sum("quantity").alias("_units"), F.sum("total_amount").alias("_rev")))
    per_name = (per_item.join(t.items.select(F.col("id").alias("item_id"), "name"), "item_id")
                .groupBy("report_date", "name").agg(F.sum("_units").alias("_units"), F.sum("_rev").alias("_rev")))
    w = Window.partitionBy("report_date").orderBy(F.col("_rev").desc_nulls_first(), F.col("name").asc_nulls_last())
    ranked = per_name.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(
        "report_date", F.col("rank").cast("bigint").alias("rank"), "name",
        X.js_round(X.money_or_zero(F.col("_units"))).cast("bigint").alias("units"),
        X.money_or_zero(F.col("_rev")).alias("revenue"))


def top_products(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS, k: int = 5) -> DataFrame:
    """Per day, the ``k`` item names with the highest invoice-line
    revenue (NULL revenue first, ties by name), with rounded units (summed as
    decimals).

    Plan: lines are joined to the day's invoices and aggregated per (day,
    item id) with map-side combine; item names are looked up on that
    aggregate and merged per name; a ``row_number`` window limited to ``k``
    (planned as a group limit before the exchange) ranks each day.
    Columns: report_date, rank, name, units, revenue."""
    return _top(t, p, from_date, to_date, k).orderBy("report_date", "rank")


def _folded(totals: DataFrame) -> DataFrame:
    """``totals`` by way of one row per day. The rows of a day are bounded by
    sites, types, groups and representatives. Sections that fork from this
    frame share its exchange (nothing can be pruned from below the fold), so
    the vouchers are read once."""
    rows = F.collect_list(F.struct(*(c for c in totals.columns if c != "report_date"))).alias("rows")
    return totals.groupBy("report_date").agg(rows).select("report_date", F.inline("rows"))


#: The nested lists of the composite report, in output order.
SECTIONS = ("sites", "salesman_by_site", "collections_by_site", "new_customers", "top_products", "outstanding", "delivery_by_site")
_REVENUE = ("sites", "salesman_by_site", "collections_by_site")


def _revenue_by_day(t: Tables, p: ReportParams, totals: DataFrame) -> DataFrame:
    """Hero figures and the revenue and collection lists of every day, from one
    grouping-set aggregate over ``totals`` (day_totals).

    Sets: the day (hero), the day's sites (site totals, collections), its
    (site, customer group) and its (site, representative) cells. All rows of a
    day are bounded by sites, groups and representatives; they meet once per
    day, where the lists are sorted and nested.
    """
    kind, money = F.col("type_code"), F.col("_amt")
    named = (totals.join(B.group_names(t), "party_group_id", "left")
             .join(B.site_names(t).withColumn("_site", F.lit(True)), "site_id", "left"))
    named = B.attach(named, B.rep_names(t, "_rep"), "responsible_party_id", "report_date", "site_id")
    invoice, receipt, at_site = kind == p.invoice_code, kind == p.receipt_code, F.coalesce("_site", F.lit(False))
    listed = invoice & F.col("known") & at_site
    sold = listed & ~F.coalesce("party_group_id", F.lit(0)).isin(*p.salesman_excluded_group_ids)
    till = receipt & at_site
    flagged = named.select("report_date", "site_id", "group_name", "_rep", "site_name", "_amt", "_n", invoice.alias("_inv"),
                           receipt.alias("_rct"), listed.alias("_listed"), sold.alias("_sold"), till.alias("_till"))
    sets = [["report_date"], ["report_date", "site_id"], ["report_date", "site_id", "group_name"], ["report_date", "site_id", "_rep"]]
    sums = [F.sum(F.when(F.col(f), c)).alias(f"{f}{c_name}") for f in ("_inv", "_rct", "_listed", "_sold", "_till")
            for c_name, c in (("_amt", money), ("_n", F.col("_n")))]
    cells = flagged.groupingSets(sets, "report_date", "site_id", "group_name", "_rep").agg(
        F.grouping_id().alias("_set"), F.max("site_name").alias("site_name"), *sums)
    day, site, by_group, by_rep = 7, 3, 1, 2  # which of site, group and representative are folded, as bits

    def when(level: int, rows: Column, value: Column) -> Column:
        return F.when((F.col("_set") == level) & rows, value)

    def listing(level: int, flag: str, *fields: Column, keys: tuple[Column, ...]) -> Column:
        entry = F.struct(F.struct(*keys).alias("k"), F.col("site_id").alias("s"), F.struct(*fields).alias("e"))
        return F.sort_array(F.collect_list(when(level, F.col(f"{flag}_n").isNotNull(), entry)))

    revenue = lambda c: X.money_or_zero(F.col(c)).alias("revenue")
    count = lambda c: F.col(c).cast("bigint")
    rep = F.coalesce("_rep", F.lit("Unassigned"))
    days = cells.groupBy("report_date").agg(
        *(F.max(F.when(F.col("_set") == day, F.col(c))).alias(c) for c in ("_inv_amt", "_inv_n", "_rct_amt", "_rct_n")),
        listing(site, "_listed", F.col("site_name"), X.money_or_zero(F.col("_listed_amt")).alias("total_revenue"),
                count("_listed_n").alias("invoice_count"), keys=(F.col("site_id"),)).alias("_sites"),
        listing(by_group, "_listed", F.coalesce("group_name", F.lit("Other")).alias("party_group"), revenue("_listed_amt"),
                count("_listed_n").alias("invoice_count"), keys=(_desc(F.col("_listed_amt")), F.col("group_name"))).alias("_groups"),
        listing(site, "_sold", F.col("site_name"), keys=(F.col("site_id"),)).alias("_sold_sites"),
        listing(by_rep, "_sold", rep.alias("name"), revenue("_sold_amt"), keys=(_desc(F.col("_sold_amt")), rep)).alias("_reps"),
        listing(site, "_till", F.col("site_id"), F.col("site_name"), X.money_or_zero(F.col("_till_amt")).alias("collections"),
                count("_till_n").alias("receipt_count"), keys=(_desc(F.col("_till_amt")), F.col("site_id"))).alias("_tills"))
    hero = X.money_or_zero(F.col("_inv_amt"))

    def of_site(entries: str, s: Column) -> Column:
        return F.transform(F.filter(entries, lambda x: x["s"] == s), lambda x: x["e"])

    def share(total: Column) -> Column:
        return F.when(hero > 0, X.js_round(total / hero * F.lit(1000.0)) / F.lit(10.0)).otherwise(F.lit(0.0)).cast("double")

    sites = F.transform("_sites", lambda x: F.struct(
        x["s"].alias("site_id"), x["e"]["site_name"].alias("site_name"), x["e"]["total_revenue"].alias("total_revenue"),
        x["e"]["invoice_count"].alias("invoice_count"), of_site("_groups", x["s"]).alias("breakdown"),
        share(x["e"]["total_revenue"]).alias("revenue_pct")))
    salesmen = F.transform("_sold_sites", lambda x: F.struct(
        x["s"].alias("site_id"), x["e"]["site_name"].alias("site_name"), of_site("_reps", x["s"]).alias("salesmen")))
    return days.select(
        "report_date", hero.alias("revenue"), X.count_or_zero(F.col("_inv_n")).alias("invoice_count"),
        X.money_or_zero(F.col("_rct_amt")).alias("collections"),
        sites.alias("sites"), salesmen.alias("salesman_by_site"), F.transform("_tills", lambda x: x["e"]).alias("collections_by_site"))


def _days(t: Tables, p: ReportParams, from_date, to_date, outstanding: bool) -> DataFrame:
    """The days of the report and, if wanted, the outstanding receivables on
    each (the same for all). An open range takes its ends from the vouchers, in
    the scan that also sums the receivables."""
    scope = B.voucher_scope(t, p, not_cancelled=False)
    if not outstanding:
        return B.calendar(scope, from_date, to_date)
    if from_date is not None and to_date is not None:
        whole = R.outstanding_summary(t, p).select(F.struct("total", "by_site").alias("o")).scalar()
        return B.calendar(scope, from_date, to_date).withColumn("outstanding", whole)
    types = t.voucher_types.filter(F.col("code") == p.invoice_code).select(F.col("id").alias("voucher_type_id"), F.lit(True).alias("_invoice"))
    sites = B.site_names(t).withColumn("_site", F.lit(True))
    per_site = (scope.groupBy("site_id", "voucher_type_id", "is_cancelled", X.is_open_invoice().alias("_open")).agg(
        F.min("transaction_date").alias("lo"), F.max("transaction_date").alias("hi"),
        F.sum(F.when(F.col("amount_due") > 0, F.col("amount_due"))).alias("_due"), F.count(F.when(F.col("amount_due") > 0, 1)).alias("_n"))
        .join(types, "voucher_type_id", "left").join(sites, "site_id", "left"))
    due = F.col("_invoice") & (F.col("is_cancelled") == F.lit(False)) & F.col("_open") & F.col("_site") & (F.col("_n") > 0)
    per_site = per_site.groupBy("site_id").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("site_name").alias("site_name"),
        F.sum(F.when(due, F.col("_due"))).alias("_due"), F.sum(F.when(due, F.col("_n"))).alias("_n"))
    entry = F.struct("site_id", "site_name", X.money_or_zero(F.col("_due")).alias("outstanding"), F.col("_n").cast("bigint").alias("open_invoice_count"))
    one = per_site.agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), X.money_or_zero(F.sum("_due")).alias("total"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") > 0, F.struct((-F.col("_due")).alias("k"), F.col("site_id").alias("s"), entry.alias("e"))))),
                    lambda x: x["e"]).alias("by_site"))
    lo = X.as_date(from_date) if from_date is not None else F.col("lo")
    hi = X.as_date(to_date) if to_date is not None else F.col("hi")
    return one.filter(lo.isNotNull() & hi.isNotNull() & (lo <= hi)).select(
        F.explode(F.sequence(lo, hi)).alias("report_date"), F.struct("total", "by_site").alias("outstanding"))


def daily_report(t: Tables, from_date=None, to_date=None, p: ReportParams = DEFAULT_PARAMS,
                 nest_new_customers: bool = False, dedupe_delivery: bool = False, sections: Sequence[str] | None = None) -> DataFrame:
    """The composite daily report, one row per day of the range.

    Columns: date, revenue, invoice_count, collections,
    new_customer_count, delivered, delivery_total, and the lists of
    ``sections`` (any of ``SECTIONS``, in that order; default: all but
    new_customers, which ``nest_new_customers`` adds): sites[],
    salesman_by_site[], collections_by_site[], new_customers[],
    top_products[], outstanding{total, by_site[]}, delivery_by_site[].

    What is not asked for is not planned: with ``sections=()`` the row is seven
    scalars and costs the hero, delivery count and new customer aggregates.

    Every nested list but new_customers is bounded by a dimension (sites,
    groups, representatives, users) or by ``k``; the list of a day's new
    customers grows with the data, so by default only its count is nested
    and the rows come from :func:`ledgerlens.operators.customers.new_customers`
    (R17), the companion of this report: same days, as many rows as the count
    says. ``outstanding`` does not depend on the day: it is computed once.

    Plan: hero, revenue and collection lists come from one grouping-set
    aggregate over one frame of day totals (one voucher scan); an open range
    and the outstanding sums share a scan; the delivery sections are one pass
    over invoices with challans (one voucher and one history scan), top
    products one over the lines. Nothing is sorted but the nested lists and
    the days.
    """
    if sections is None:
        sections = [s for s in SECTIONS if s != "new_customers" or nest_new_customers]
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown section(s) {sorted(unknown)}")
    wanted = [s for s in SECTIONS if s in sections or (s == "new_customers" and nest_new_customers)]

    out = _days(t, p, from_date, to_date, "outstanding" in wanted)
    if any(s in wanted for s in _REVENUE):
        by_day = _revenue_by_day(t, p, day_totals(t, from_date, to_date, p)).select(
            "report_date", "revenue", "invoice_count", "collections", *(s for s in _REVENUE if s in wanted))
    else:
        by_day = daily_hero(t, from_date, to_date, p).drop("receipt_count")
    parts = [by_day]

    newc = C.new_customers(t, from_date, to_date, p, with_created_at=True)
    nested = [_sorted_entries(F.struct("customer_name", "site_name", "site_id", "added_by"),
                              F.isnull("created_at"), F.col("created_at"), F.col("customer_name")).alias("new_customers")]
    parts.append(newc.groupBy("report_date").agg(F.count(F.lit(1)).alias("new_customer_count"), *(nested if "new_customers" in wanted else [])))

    if "top_products" in wanted:
        parts.append(_top(t, p, from_date, to_date, 5).groupBy("report_date").agg(
            _sorted_entries(F.struct("rank", "name", "units", "revenue"), F.col("rank")).alias("top_products")))

    if "delivery_by_site" in wanted:
        # R13 (invoices with challans / delivered) is the per-day sum of R20's
        # per-site counts.
        parts.append(D.delivery_with_agents(t, from_date, to_date, p, dedupe=dedupe_delivery).groupBy("report_date").agg(
            F.sum("delivered").cast("bigint").alias("delivered"),
            F.sum("total").cast("bigint").alias("delivery_total"),
            _sorted_entries(
                F.struct("site_id", "total", "delivered", "avg_packed_to_shipped_min", "avg_shipped_to_delivered_min",
                         "avg_end_to_end_min", "agents", "packed_to_shipped", "shipped_to_delivered", "end_to_end"),
                F.col("site_id")).alias("delivery_by_site")))
    else:
        parts.append(D.delivery_counts(t, from_date, to_date, p))

    for part in parts:
        out = out.join(part, "report_date", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        F.col("report_date").alias("date"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"), F.coalesce("invoice_count", zero).alias("invoice_count"),
        F.coalesce("collections", F.lit(0.0)).alias("collections"),
        *(F.coalesce(c, zero).alias(c) for c in ("new_customer_count", "delivered", "delivery_total")),
        *(F.col(s) if s == "outstanding" else F.coalesce(s, F.array()).alias(s) for s in wanted)).orderBy("date")


def daily_report_for_day(t: Tables, day=None, p: ReportParams = DEFAULT_PARAMS, **kw) -> DataFrame:
    """R22 for one date (default: today's UTC date). Always one row: a day
    without data gets zeros and empty lists."""
    import datetime as _dt
    day = day if day is not None else _dt.datetime.now(_dt.timezone.utc).date()
    return daily_report(t, day, day, p, **kw)
