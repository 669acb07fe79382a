"""Stored daily reports kept up to date day by day.

New rows of the star schema touch few days of a stored report. A late status
event, a new challan or a new line changes the day of its *invoice*, however
old; a new customer changes its own day and those of invoices that name it; a
new user those of the invoices whose events name it. :func:`touched_days`
follows these references with joins, :func:`refresh` recomputes those days
from the whole tables and replaces their partitions (dynamic overwrite); the
files of other days stay as they are.

Tables only grow here. Changed rows are covered if both their old and their
new form are among the added rows. Changes of the small dimensions (voucher
types, sites, groups, items) may change any day: recompute the whole report.

Definitions. Vouchers without a date belong to the day NULL, which is a
partition like the others; rows that refer to nothing touch no day; null keys
match nothing; repeated rows count once. Without touched days nothing is
written.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X
from ledgerlens.plans.params import DEFAULT_PARAMS, ReportParams
from ledgerlens.sources.sinks import write_report
from ledgerlens.sources.tables import Tables

#: Tables whose new rows are followed to their days.
FOLLOWED = ("vouchers", "voucher_items", "delivery_challans", "document_status_history", "parties", "users")


def _keys(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).filter(F.col(name).isNotNull()).distinct()


def touched_days(t: Tables, added: Mapping[str, DataFrame], p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """(report_date, NULL included) of the days whose daily reports the rows ``added`` (table
    name -> new rows, which ``t`` already holds) can change.

    Every step joins the few new keys to one table; the largest, the vouchers,
    is read once, for all keys together.
    """
    unknown = set(added) - set(FOLLOWED)
    if unknown:
        raise ValueError(f"new rows of {sorted(unknown)} may change any day; recompute the report")
    documents, invoices, days = [], [], []
    if "vouchers" in added:
        days.append(added["vouchers"].select(F.col("transaction_date").alias("report_date")))
    if "voucher_items" in added:
        invoices.append(_keys(added["voucher_items"], "voucher_id", "id"))
    if "delivery_challans" in added:
        invoices.append(_keys(added["delivery_challans"], "related_invoice_voucher_id", "id"))
    if "document_status_history" in added:
        documents.append(_keys(added["document_status_history"], "document_id", "id"))
    if "users" in added:
        of_users = t.document_status_history.join(_keys(added["users"], "id", "changed_by"), "changed_by", "left_semi")
        documents.append(_keys(of_users, "document_id", "id"))
    for d in documents:
        invoices.append(_keys(t.delivery_challans.join(d, "id", "left_semi"), "related_invoice_voucher_id", "id"))
    dated = t.vouchers.select("id", "party_id", F.col("transaction_date").alias("report_date"))
    for v in invoices:
        days.append(dated.join(v, "id", "left_semi").select("report_date"))
    if "parties" in added:
        new, own = added["parties"], X.local_date(F.col("created_at"), p.tz).alias("report_date")
        days.append(new.select(own).filter("report_date IS NOT NULL"))
        days.append(dated.join(_keys(new, "id", "party_id"), "party_id", "left_semi").select("report_date"))
        reps = t.parties.join(_keys(new, "id", "responsible_party_id"), "responsible_party_id", "left_semi")
        days.append(reps.select(own).filter("report_date IS NOT NULL"))
        days.append(dated.join(_keys(reps, "id", "party_id"), "party_id", "left_semi").select("report_date"))
    out = t.spark.createDataFrame([], "report_date date")
    for d in days:
        out = out.union(d)
    return out.distinct()


def refresh(report: Callable[..., DataFrame], t: Tables, added: Mapping[str, DataFrame], path: str,
            p: ReportParams = DEFAULT_PARAMS, fmt: str = "parquet", day: str = "report_date") -> list:
    """Recompute the touched days of a stored daily ``report(t, from, to, p=p)``
    at ``path``, partitioned by its column ``day``. Returns the days, sorted
    (NULL last).

    The days, a part of the calendar, come to the driver and go into the
    voucher scan as a list, which prunes the directories of a table that is
    stored by date (``write_parquet_tables(partition_vouchers_by_date=True)``).
    """
    found = {r[0] for r in touched_days(t, added, p).collect()}
    if not found:
        return []
    days = sorted(d for d in found if d is not None)

    def among(column: str) -> Column:
        c = F.col(column)
        return c.isin(days) | c.isNull() if None in found else c.isin(days)

    some = dataclasses.replace(t, vouchers=t.vouchers.filter(among("transaction_date")))
    ends = (None, None) if None in found else (days[0], days[-1])  # a bounded range has no day NULL
    write_report(report(some, *ends, p=p).filter(among(day)), path, fmt, "overwrite", [day])
    return [*days, *([None] if None in found else [])]
