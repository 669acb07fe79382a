"""R11a as maintained state: milestones of invoices kept up to date by merging.

The state has one row per invoice and batch: the earliest time of each stage,
and for the shipped and delivered stage the first actor together with the key
by which first actors are ordered. All are minima, so states merge by a
minimum in any order and grouping, and merging the same events twice changes
nothing. :func:`append` adds the state of new rows to a table bucketed by
invoice, :func:`stored` merges the rows of an invoice, which a bucketed scan
has together already: no exchange. A batch that failed half-way or ran twice
is harmless; run it again. :func:`compact` writes the merged rows as a table of
its own when the batches have become many; the old one stays until the caller
drops it.

Tables only grow here, as in :mod:`ledgerlens.operators.refresh`: an event, a
challan and a user may come in any order and batch. A user's changed name or a
deleted event needs a state made anew.

Definitions. Challans without an invoice form the row of the invoice NULL, as
in ``milestones``; events without a document, or of a document that is no
challan, wait until the challan comes; repeated rows count once. A batch
without such rows appends nothing.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.plans import base as B
from ledgerlens.sources.tables import Tables

TIMES = ("packed_at", "shipped_at", "delivered_at")
ACTORS = {"shipped_by": ("has_shipped", "shipped_at"), "delivered_by": ("has_delivered", "delivered_at")}
#: Tables whose new rows can change milestones.
FOLLOWED = ("document_status_history", "delivery_challans", "users")


def _candidate(has_stage: str, at: str) -> Column:
    """What orders the actors of a stage, ending with the name itself; null
    where the row is no event of the stage by a known user."""
    key = F.struct(F.col(at).isNull().alias("timeless"), F.col(at).alias("at"),
                   F.col("full_name").isNull().alias("nameless"), F.col("full_name").alias("name"))
    return F.when(F.col(has_stage) & F.col("_user_found"), key)


def state_of(events: DataFrame) -> DataFrame:
    """The state of stage cells (``plans.base.status_events``)."""
    return events.groupBy("voucher_id").agg(
        *(F.min(c).alias(c) for c in TIMES),
        *(F.min(_candidate(*of)).alias(name) for name, of in ACTORS.items()))


def merged(state: DataFrame) -> DataFrame:
    """One row per invoice from the rows of any number of batches."""
    return state.groupBy("voucher_id").agg(*(F.min(c).alias(c) for c in (*TIMES, *ACTORS)))


def united(states: Sequence[DataFrame]) -> DataFrame:
    """The rows of several states, each state read by tasks of its own.

    All states are dealt out by invoice alike, and Spark unites such frames
    partition by partition: one task would then hold the sorts of the same
    invoices of every batch at once. ``coalesce`` to the number of partitions
    they have at most moves nothing, but gives the common layout up.
    """
    n = int(states[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = states[0].coalesce(n)
    for s in states[1:]:
        out = out.unionByName(s.coalesce(n))
    return out


def milestones_of(state: DataFrame) -> DataFrame:
    """The rows of ``plans.base.milestones`` from merged state."""
    out = state.select("voucher_id", *TIMES, F.col("delivered_by.name").alias("delivered_by"),
                       F.col("shipped_by.name").alias("shipped_by"))
    return out.withColumn("delivery_person", F.coalesce("delivered_by", "shipped_by"))


def _distinct(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).filter(F.col(name).isNotNull()).distinct()


def state_of_added(t: Tables, added: Mapping[str, DataFrame]) -> DataFrame | None:
    """The state of what the rows ``added`` (table name -> new rows, which
    ``t`` already holds) bring; None if they bring nothing.

    New events are read from ``added`` alone. The history is read only for new
    challans and new users, whose earlier events had nothing to meet, and is
    reduced to theirs ahead of its aggregate.
    """
    unknown = set(added) - set(FOLLOWED)
    if unknown:
        raise ValueError(f"new rows of {sorted(unknown)} do not change milestones")
    challans, history, parts = B.challans_of(t), t.document_status_history, []
    columns = ["document_id", "new_status", "changed_at", "changed_by"]

    def cells(events: DataFrame, of: DataFrame) -> DataFrame:
        return B.status_events(dataclasses.replace(t, document_status_history=events.select(*columns)), of, windowed=True)

    if "document_status_history" in added:
        # cells first: they meet the challans in one join, without a list of
        # the documents, whose aggregate and join would share a task with it
        new = added["document_status_history"]
        parts.append(B.status_events(dataclasses.replace(t, document_status_history=new.select(*columns)), challans))
    if "delivery_challans" in added:
        new = added["delivery_challans"]
        parts.append(cells(history, new.select(F.col("id").alias("document_id"), F.col("related_invoice_voucher_id").alias("voucher_id"))))
    if "users" in added:
        theirs = history.join(_distinct(added["users"], "id", "changed_by"), "changed_by", "left_semi")
        parts.append(cells(theirs, challans))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return state_of(out)


def _save(state: DataFrame, table: str, path: str | None, buckets: int, mode: str) -> None:
    w = state.write.mode(mode).format("parquet").bucketBy(buckets, "voucher_id").sortBy("voucher_id")
    (w.option("path", path) if path else w).saveAsTable(table)


def create(t: Tables, table: str, path: str | None = None, buckets: int = 64) -> None:
    """The state of all of ``t`` as a new catalog table (at ``path``, if
    given). Size ``buckets`` as in ``write_bucketed_tables``: with the same
    count, vouchers and their milestones join without an exchange."""
    # one task per bucket writes one file
    _save(state_of(B.status_events(t)).repartition(buckets, "voucher_id"), table, path, buckets, "errorifexists")


def append(t: Tables, added: Mapping[str, DataFrame], table: str, buckets: int = 64) -> None:
    """Add the state of new rows; ``t`` holds them already. ``buckets`` is
    the count the table was made with."""
    state = state_of_added(t, added)
    if state is not None:
        _save(state.repartition(buckets, "voucher_id"), table, None, buckets, "append")


def stored(spark: SparkSession, table: str) -> DataFrame:
    """The milestones that a table holds, as ``plans.base.milestones`` gives them."""
    return milestones_of(merged(spark.table(table)))


def compact(spark: SparkSession, table: str, new_table: str, path: str | None = None, buckets: int = 64) -> None:
    """Write the merged rows of ``table`` as ``new_table``: one row per invoice."""
    _save(merged(spark.table(table)).repartition(buckets, "voucher_id"), new_table, path, buckets, "errorifexists")
