"""Star-schema adapter over the TPC-H-style test tables.

The test data holds ``orders``, ``lineitem``, ``customer``, ``nation``,
``region``, ``part`` and ``supplier``; this module derives the ten voucher
tables from them with the column rules of FIXTURES.md §2. It is a lazy plan:
each report reads only the source columns its output depends on.

Source timestamps are zone-less (``timestamp_ntz``) and hold UTC wall-clock
time; they become instants (``timestamp``) independent of the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import Tables

# Fixed values of the synthetic mapping (FIXTURES.md §2).
ORGANIZATION_ID = 2
VOUCHER_TYPE_ROWS = [(1, "SINV"), (2, "RCT")]
RECEIPT_PRIORITY = "5-LOW"
PAYMENT_STATUS = {"O": "Unpaid", "P": "Partially Paid", "F": "Paid"}
PARTIAL_PAYMENT_OFFSET = 50000
DELIVERY_STATUS_BY_MOD6 = [None, "Packed", "in_transit", "Delivered", "partially_delivered", "pending"]
PARTY_GROUP_ROWS = [(1, "BUILDING"), (2, "AUTOMOBILE"), (3, "FURNITURE"), (4, "HOUSEHOLD")]
HISTORY_STATUS_BY_RETURNFLAG = {"A": "Packed", "N": "in_transit", "R": "Delivered"}

SOURCE_TABLES = ("orders", "lineitem", "customer", "nation", "region", "part", "supplier")


def _utc_instant(ntz: Column) -> Column:
    """A zone-less UTC wall-clock value as an instant.

    Built from the wall-clock fields with an explicit zone, so the value
    never depends on ``spark.sql.session.timeZone`` — not even when the zone
    changes between building and running a plan.
    """
    micros = F.pmod(F.unix_micros(ntz.cast("timestamp")), F.lit(1_000_000)).cast("decimal(8,6)") / 1_000_000
    secs = (F.second(ntz).cast("decimal(8,6)") + micros).cast("decimal(8,6)")
    return F.make_timestamp(F.year(ntz), F.month(ntz), F.dayofmonth(ntz), F.hour(ntz), F.minute(ntz),
                            secs, F.lit("UTC"))


def _plus_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def _case(key: Column, mapping, default=None) -> Column:
    out = None
    for k, v in mapping:
        out = (F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v)))
    return out.otherwise(F.lit(default)) if default is not None else out


def _literal_table(spark: SparkSession, rows, names: tuple[str, str], types: tuple[str, str]) -> DataFrame:
    """A small literal table evaluated in the JVM (no Python-side RDD)."""
    structs = [F.struct(F.lit(a).cast(types[0]).alias(names[0]), F.lit(b).cast(types[1]).alias(names[1]))
               for a, b in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def read_source(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in SOURCE_TABLES}


def star_from_tpch(spark: SparkSession, sf_dir: str) -> Tables:
    src = read_source(spark, sf_dir)
    o, li, c = src["orders"], src["lineitem"], src["customer"]

    money = F.col("o_totalprice").cast("decimal(18,2)")
    k = F.col("o_orderkey")
    vouchers = o.select(
        k.alias("id"),
        F.concat(F.lit("V"), k.cast("string")).alias("voucher_number"),
        F.lit(ORGANIZATION_ID).cast("int").alias("organization_id"),
        F.when(F.col("o_orderpriority") == RECEIPT_PRIORITY, 2).otherwise(1).cast("int").alias("voucher_type_id"),
        F.col("o_custkey").alias("party_id"),
        (k % 5).cast("int").alias("site_id"),
        F.to_date(F.col("o_orderdate")).alias("transaction_date"),
        _plus_minutes(_utc_instant(F.col("o_orderdate")), k % 1440).alias("created_at"),
        money.alias("total_amount"),
        F.when(F.col("o_orderstatus") == "O", money)
         .when(F.col("o_orderstatus") == "P", (money - PARTIAL_PAYMENT_OFFSET).cast("decimal(18,2)"))
         .otherwise(F.lit(0).cast("decimal(18,2)")).alias("amount_due"),
        _case(F.col("o_orderstatus"), PAYMENT_STATUS.items()).alias("payment_status"),
        _case(k % 6, [(i, s) for i, s in enumerate(DELIVERY_STATUS_BY_MOD6) if s is not None]).alias("delivery_status"),
        ((k % 37) == 0).alias("is_cancelled"),
    )

    first_order = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    ck = F.col("c_custkey")
    parties = (
        c.join(src["nation"].select("n_nationkey", "n_regionkey"), c.c_nationkey == F.col("n_nationkey"), "left")
        .join(first_order, ck == F.col("o_custkey"), "left")
        .select(
            ck.alias("id"),
            F.lit(ORGANIZATION_ID).cast("int").alias("organization_id"),
            F.col("n_regionkey").cast("int").alias("site_id"),
            F.col("c_name").alias("name"),
            F.when(ck % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("+"), ck.cast("string"))).alias("phone"),
            F.when(ck % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("c_nationkey").cast("string")).alias("geo_location"),
            _case(F.col("c_mktsegment"), [(n, i) for i, n in PARTY_GROUP_ROWS]).cast("int").alias("party_group_id"),
            F.when(ck % 7 == 0, F.lit(None)).otherwise(ck % 10).cast("bigint").alias("responsible_party_id"),
            _plus_minutes(_utc_instant(F.col("first_order")), ck % 1440).alias("created_at"),
        )
    )

    doc_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias
    history = li.select(
        doc_id("document_id"),
        _case(F.col("l_returnflag"), HISTORY_STATUS_BY_RETURNFLAG.items()).alias("new_status"),
        _plus_minutes(_utc_instant(F.col("l_shipdate")), F.col("l_suppkey") % 1440).alias("changed_at"),
        F.col("l_suppkey").alias("changed_by"),
    )
    # (l_orderkey, l_linenumber) repeats; one challan per distinct id. The
    # invoice is a function of the id, so de-duplicating on id alone keeps
    # the result hash-partitioned by id for the history join.
    challans = (li.select(doc_id("id")).distinct()
                .select("id", F.expr("id div 10").cast("bigint").alias("related_invoice_voucher_id")))

    frames = {
        "vouchers": vouchers,
        "voucher_types": _literal_table(spark, VOUCHER_TYPE_ROWS, ("id", "code"), ("int", "string")),
        "parties": parties,
        "party_groups": _literal_table(spark, PARTY_GROUP_ROWS, ("id", "name"), ("int", "string")),
        "sites": src["region"].select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "items": src["part"].select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        "voucher_items": li.select(
            F.col("l_orderkey").alias("voucher_id"), F.col("l_partkey").alias("item_id"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("total_amount")),
        "delivery_challans": challans,
        "document_status_history": history,
        "users": src["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name")),
    }
    return Tables.from_frames(frames)
