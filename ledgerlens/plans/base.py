"""Shared plan fragments: voucher selections, dimension lookups, milestones.

No join carries a broadcast hint and building a report runs no job: Spark
picks each join from file sizes and, at run time, from the sizes of finished
stages (AQE), by ``spark.sql.autoBroadcastJoinThreshold`` in bytes. The same
plan serves every size. Where a report aggregates over a party's whole
history the plans aggregate first and join the party attributes onto the
(much smaller) aggregate. Lookups by a key that a few values or NULL
dominate go through :func:`attach`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X
from ledgerlens.plans.params import ReportParams
from ledgerlens.sources.tables import Tables


def voucher_scope(t: Tables, p: ReportParams, *, sites: bool = True,
                  not_cancelled: bool = True) -> DataFrame:
    """Vouchers of the organisation, optionally restricted to the report
    sites and to non-cancelled documents (all filters push into the scan)."""
    v = t.vouchers
    cond = F.col("organization_id") == F.lit(p.org_id)
    if sites:
        cond = cond & F.col("site_id").isin(*p.site_ids)
    if not_cancelled:
        cond = cond & (F.col("is_cancelled") == F.lit(False))
    return v.filter(cond)


def typed_vouchers(t: Tables, p: ReportParams, codes: tuple[str, ...], *,
                   sites: bool = True, not_cancelled: bool = True,
                   extra: Column | None = None) -> DataFrame:
    """``vouchers JOIN voucher_types`` restricted to type ``codes``.

    Adds ``type_code``. The type table is filtered to the requested codes
    before the join, so the join itself is the type filter.
    """
    v = voucher_scope(t, p, sites=sites, not_cancelled=not_cancelled)
    if extra is not None:
        v = v.filter(extra)
    types = (t.voucher_types.filter(F.col("code").isin(*codes))
             .select(F.col("id").alias("_vt_id"), F.col("code").alias("type_code")))
    return v.join(types, F.col("voucher_type_id") == F.col("_vt_id")).drop("_vt_id")


def sales_invoices(t: Tables, p: ReportParams, **kw) -> DataFrame:
    """The SINV base: organisation, invoice type, not cancelled, report sites."""
    return typed_vouchers(t, p, (p.invoice_code,), **kw)


def site_names(t: Tables, key: str = "site_id", name: str = "site_name") -> DataFrame:
    return t.sites.select(F.col("id").alias(key), F.col("name").alias(name))


def group_names(t: Tables) -> DataFrame:
    return t.party_groups.select(F.col("id").alias("party_group_id"), F.col("name").alias("group_name"))


def attach(df: DataFrame, lookup: DataFrame, key: str, *spread: str) -> DataFrame:
    """``df LEFT JOIN lookup USING (key)`` for a key that is often NULL.

    NULL matches nothing, but in a shuffle join all NULL rows would meet in
    one task; here they are dealt out by a hash of the ``spread`` columns. A
    key that is merely frequent is left to AQE's skew join: ``lookup`` is
    unique by key, so only ``df``'s side of it is large.
    """
    found = F.col(key).isNotNull()
    dealt = F.coalesce(F.col(key).cast("bigint"), F.xxhash64(*spread))
    right = lookup.select(F.lit(True).alias("_found"), F.col(key).cast("bigint").alias("_dealt"),
                          *(c for c in lookup.columns if c != key))
    return (df.withColumn("_found", found).withColumn("_dealt", dealt)
            .join(right, ["_found", "_dealt"], "left").drop("_found", "_dealt"))


def rep_names(t: Tables, name: str = "rep_name") -> DataFrame:
    """The sales representatives, i.e. the parties that some party names as
    responsible: (responsible_party_id, name). A few rows, found from the
    distinct ids, so joins with it move no customer table."""
    ids = t.parties.select("responsible_party_id").filter("responsible_party_id IS NOT NULL").distinct()
    return (t.parties.select(F.col("id").alias("responsible_party_id"), F.col("name").alias(name))
            .join(ids, "responsible_party_id", "left_semi"))


def customers(t: Tables, *cols: str) -> DataFrame:
    """``parties`` keyed as ``party_id`` with the requested attributes."""
    return t.parties.select(F.col("id").alias("party_id"), *cols)


def stage_flags(status: Column) -> tuple[Column, Column, Column]:
    s = F.lower(status)
    return (s.isin(*X.PACKED_STATUSES), s.isin(*X.SHIPPED_STATUSES), s.isin(*X.DELIVERED_STATUSES))


def _first_actor(has_stage: str, at: str) -> Column:
    # Earliest event of the stage whose user exists; changed_at NULLS LAST as
    # in an ascending SQL sort, ties broken by name (non-NULL first). Rows
    # are (challan, user) cells: ``at`` is that user's earliest time for the
    # stage (NULL when all their events of the stage lack a time).
    order = F.struct(F.col(at).isNull(), F.col(at), F.col("full_name").isNull(), F.col("full_name"))
    return F.min_by(F.col("full_name"), F.when(F.col(has_stage) & F.col("_user_found"), order))


def challans_of(t: Tables, invoice_ids: DataFrame | None = None) -> DataFrame:
    """(document_id, voucher_id) of every challan, optionally only for the
    invoices in ``invoice_ids`` (a one-column frame of voucher ids)."""
    ch = t.delivery_challans.select(F.col("id").alias("document_id"),
                                    F.col("related_invoice_voucher_id").alias("voucher_id"))
    if invoice_ids is not None:
        ids = invoice_ids.select(F.col(invoice_ids.columns[0]).alias("voucher_id"))
        ch = ch.join(ids, "voucher_id", "left_semi")
    return ch


def status_events(t: Tables, challans: DataFrame | None = None, windowed: bool = False) -> DataFrame:
    """Per (challan, user) stage cells of the status history, joined to the
    invoice and the user: the columns of ``challans`` (document_id and more;
    default: document_id, voucher_id of all challans), changed_by,
    full_name, _user_found, packed_at / shipped_at / delivered_at (the user's
    earliest time of the stage on that challan) and has_packed / has_shipped /
    has_delivered.

    ``windowed`` says that ``challans`` are those of a window: then they reduce
    the history first. Events meet them ahead of the aggregate, so what is
    shuffled and aggregated follows the window (the few challans of a day are
    broadcast by Spark, and the events of other days never leave their scan
    task). Otherwise the history is reduced to cells before the join, with
    map-side combine, so a challan carrying a large share of all events is
    collapsed in the scan tasks. Events outside the packed / shipped / delivered stages are dropped
    at the scan. Milestones and delivery agents read the same frame, so a
    report needing both scans the history once.
    """
    packed, shipped, delivered = stage_flags(F.col("new_status"))
    at = F.col("changed_at")
    events = (t.document_status_history.select("document_id", "new_status", "changed_at", "changed_by")
              .filter(packed | shipped | delivered))
    challans = challans_of(t) if challans is None else challans
    keys = ["document_id", "changed_by"]
    if windowed:
        events = events.join(challans, "document_id")
        keys += [c for c in challans.columns if c not in keys]
    cells = events.groupBy(*keys).agg(
        F.min(F.when(packed, at)).alias("packed_at"),
        F.min(F.when(shipped, at)).alias("shipped_at"),
        F.min(F.when(delivered, at)).alias("delivered_at"),
        F.max(packed).alias("has_packed"),
        F.max(shipped).alias("has_shipped"),
        F.max(delivered).alias("has_delivered"))
    if not windowed:
        cells = cells.join(challans, "document_id")
    users = t.users.select(F.col("id").alias("changed_by"), "full_name", F.lit(True).alias("_user_found"))
    ev = attach(cells, users, "changed_by", "document_id")
    return ev.withColumn("_user_found", F.coalesce(F.col("_user_found"), F.lit(False)))


def milestones(t: Tables, invoice_ids: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Per invoice: first packed / shipped / delivered time and first actors.

    One aggregate keyed by voucher over the (challan, user) stage cells of
    :func:`status_events` (or ``events`` when given): conditional ``min`` /
    ``min_by``, combined map-side. Restricting to ``invoice_ids`` leaves the
    result for those ids unchanged.

    Output: voucher_id, packed_at, shipped_at, delivered_at, delivered_by,
    shipped_by, delivery_person.
    """
    ev = events if events is not None else status_events(t, challans_of(t, invoice_ids), windowed=invoice_ids is not None)
    out = ev.groupBy("voucher_id").agg(
        F.min("packed_at").alias("packed_at"),
        F.min("shipped_at").alias("shipped_at"),
        F.min("delivered_at").alias("delivered_at"),
        _first_actor("has_delivered", "delivered_at").alias("delivered_by"),
        _first_actor("has_shipped", "shipped_at").alias("shipped_by"),
    )
    return out.withColumn("delivery_person", F.coalesce("delivered_by", "shipped_by"))


def calendar(spark_df: DataFrame, from_date, to_date, date_col: str = "report_date") -> DataFrame:
    """One row per day of ``[from_date, to_date]``.

    With both bounds given it is a literal sequence; with either bound
    missing it spans the min / max of ``spark_df``'s ``transaction_date``
    (computed by Spark, not on the driver).
    """
    if from_date is not None and to_date is not None:
        one = spark_df.sparkSession.range(1)
        return one.select(F.explode(F.sequence(X.as_date(from_date), X.as_date(to_date))).alias(date_col))
    bounds = spark_df.agg(F.min("transaction_date").alias("lo"), F.max("transaction_date").alias("hi"))
    lo = X.as_date(from_date) if from_date is not None else F.col("lo")
    hi = X.as_date(to_date) if to_date is not None else F.col("hi")
    return bounds.filter(lo.isNotNull() & hi.isNotNull() & (lo <= hi)).select(
        F.explode(F.sequence(lo, hi)).alias(date_col))


def date_window(col: str, from_date, to_date) -> Column | None:
    """``col BETWEEN from AND to`` with open ends for missing bounds."""
    cond = None
    if from_date is not None:
        cond = F.col(col) >= X.as_date(from_date)
    if to_date is not None:
        c2 = F.col(col) <= X.as_date(to_date)
        cond = c2 if cond is None else cond & c2
    return cond
