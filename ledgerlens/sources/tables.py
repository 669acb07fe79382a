"""The ``Tables`` container and the generic loaders.

Reports never read storage themselves: they receive a ``Tables`` whose
DataFrames are conformed to :mod:`ledgerlens.sources.schemas` (declared column
order, declared types, extra columns dropped).  Conforming is a projection
with casts, so Catalyst still pushes filters and column pruning through it
into the Parquet / JDBC scan.
"""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.sources.schemas import STAR_SCHEMAS

def conform(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """Project ``df`` onto ``schema``: declared order and types, nothing else."""
    have = {f.name.lower(): f.name for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name.lower() not in have]
    if missing:
        raise ValueError(f"table {table!r} lacks column(s) {missing}")
    cols = []
    for f in schema.fields:
        src = df.schema[have[f.name.lower()]]
        c = F.col(f"`{src.name}`")
        cols.append((c if src.dataType == f.dataType else c.cast(f.dataType)).alias(f.name))
    return df.select(*cols)


@dataclasses.dataclass
class Tables:
    vouchers: DataFrame
    voucher_types: DataFrame
    parties: DataFrame
    party_groups: DataFrame
    sites: DataFrame
    items: DataFrame
    voucher_items: DataFrame
    delivery_challans: DataFrame
    document_status_history: DataFrame
    users: DataFrame

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Tables:
        missing = [n for n in STAR_SCHEMAS if n not in frames]
        if missing:
            raise ValueError(f"missing table(s): {missing}")
        return cls(**{n: conform(frames[n], s, n) for n, s in STAR_SCHEMAS.items()})

    @property
    def spark(self) -> SparkSession:
        return self.vouchers.sparkSession


# The first partition directory in a file's path: what is before it is the dataset.
_PARTITION_DIR = re.compile(r"/[^/=]+=[^/]*/")

SNAPSHOT_SCHEMA = "table string, base string, schema string, file string"


def _over_files(spark: SparkSession, schema: T.StructType, base: str, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*files)


def _base_of(files: list[str]) -> str:
    if not files:
        return ""
    cut = _PARTITION_DIR.search(files[0])
    return files[0][:cut.start()] if cut else files[0].rsplit("/", 1)[0]


def pinned(df: DataFrame) -> DataFrame:
    """A Parquet dataset or table as the files it has now. Files that come
    later are not seen, however often the frame is scanned; a file that goes
    makes a later scan fail instead of changing its answer. The list is what
    Spark's own file index holds: one path per file. Bucketing is given up, so
    bucketed tables (:func:`write_bucketed_tables`) are better left unpinned."""
    files = sorted(df.inputFiles())
    return _over_files(df.sparkSession, df.schema, _base_of(files), files)


def read_parquet_tables(spark: SparkSession, root: str,
                        names: Mapping[str, str] | None = None) -> Tables:
    """Star schema stored as ``{root}/{table}`` Parquet datasets, pinned: all
    reports over the result read one consistent set of files."""
    names = dict(names or {})
    frames = {t: pinned(spark.read.parquet(f"{root.rstrip('/')}/{names.get(t, t)}")) for t in STAR_SCHEMAS}
    return Tables.from_frames(frames)


def read_catalog_tables(spark: SparkSession, database: str | None = None,
                        names: Mapping[str, str] | None = None, pin: bool = False) -> Tables:
    """Star schema registered in the session catalog (Hive / Unity / views).

    With ``pin`` the Parquet tables are read as the files they have now (see
    :func:`pinned`); an INSERT of this session is then not seen by reports that
    are already built."""
    names = dict(names or {})
    prefix = f"{database}." if database else ""
    frames = {t: spark.table(prefix + names.get(t, t)) for t in STAR_SCHEMAS}
    return Tables.from_frames({t: pinned(f) if pin else f for t, f in frames.items()})


def write_snapshot(spark: SparkSession, root: str, path: str, names: Mapping[str, str] | None = None) -> None:
    """Note the files that the star schema at ``root`` has now as a table at
    ``path`` (table, base, schema, file; one row per file, and one without a
    file for each table), from which :func:`read_snapshot` opens the same
    state in any later session, for as long as no noted file is deleted."""
    names, rows = dict(names or {}), []
    for t in STAR_SCHEMAS:
        df = spark.read.parquet(f"{root.rstrip('/')}/{names.get(t, t)}")
        files = sorted(df.inputFiles())
        rows += [(t, _base_of(files), df.schema.json(), f) for f in [None, *files]]
    spark.createDataFrame(rows, SNAPSHOT_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> Tables:
    """The star schema as :func:`write_snapshot` found it."""
    noted: dict[str, tuple[str, str, list[str]]] = {}
    for r in spark.read.schema(SNAPSHOT_SCHEMA).parquet(path).orderBy("table", "file").collect():
        files = noted.setdefault(r["table"], (r["base"], r["schema"], []))[2]
        if r["file"] is not None:
            files.append(r["file"])
    return Tables.from_frames({
        t: _over_files(spark, T.StructType.fromJson(json.loads(schema)), base, files) for t, (base, schema, files) in noted.items()})


# Column by which each event-sized table is cut into parallel JDBC reads.
JDBC_SLICES = {
    "vouchers": "id",
    "parties": "id",
    "voucher_items": "voucher_id",
    "delivery_challans": "id",
    "document_status_history": "document_id",
}


def jdbc_options(table: str, bounds: Mapping[str, tuple[int, int]], partitions: int) -> dict:
    """Slicing options of one table's read; empty for the small tables."""
    if table not in JDBC_SLICES:
        return {}
    if table not in bounds:
        raise ValueError(f"bounds of {table}.{JDBC_SLICES[table]} are needed to read it in parallel")
    lo, hi = bounds[table]
    return {"column": JDBC_SLICES[table], "lowerBound": lo, "upperBound": hi, "numPartitions": partitions}


def read_jdbc_tables(spark: SparkSession, url: str, properties: Mapping[str, str],
                     bounds: Mapping[str, tuple[int, int]], partitions: int = 64,
                     names: Mapping[str, str] | None = None) -> Tables:
    """Star schema read live from the operational PostgreSQL database.

    The event-sized tables (``JDBC_SLICES``) are read in ``partitions``
    range slices each; ``bounds`` gives the least and greatest value of the
    slicing column per table (rows outside still come, in the end slices).
    The others are small and come in one read. Filters that the reports
    place on the conformed frame are pushed into the JDBC query.
    """
    names = dict(names or {})
    props = dict(properties)
    return Tables.from_frames({
        t: spark.read.jdbc(url, names.get(t, t), properties=props, **jdbc_options(t, bounds, partitions))
        for t in STAR_SCHEMAS})


def write_parquet_tables(tables: Tables, root: str, mode: str = "overwrite",
                         partition_vouchers_by_date: bool = False) -> None:
    """Persist a star schema (e.g. the synthetic one) as Parquet datasets.

    The event-sized tables are range-partitioned and sorted on the column
    reports filter or join on, so a file spans a narrow range and its
    statistics prune it. With ``partition_vouchers_by_date`` the fact is laid
    out in one directory per ``transaction_date`` (the deployment layout:
    every date-windowed report filters on that column, so whole days are
    pruned before any file is opened); days are cut by id as well, so a large
    day is written by several tasks. It is off by default because tiny test
    data would become thousands of tiny files.
    """
    cluster = {"vouchers": "transaction_date", "voucher_items": "voucher_id",
               "document_status_history": "document_id", "delivery_challans": "related_invoice_voucher_id"}
    for t in STAR_SCHEMAS:
        df = getattr(tables, t)
        path = f"{root.rstrip('/')}/{t}"
        if t == "vouchers" and partition_vouchers_by_date:
            (df.repartitionByRange("transaction_date", "id").sortWithinPartitions("transaction_date", "id")
             .write.mode(mode).partitionBy("transaction_date").parquet(path))
            continue
        if t in cluster:
            df = df.repartitionByRange(cluster[t]).sortWithinPartitions(cluster[t])
        df.write.mode(mode).parquet(path)


# Bucket keys of the event-sized tables: both sides of the history ⋈ challan
# join (milestones, agents) and of the line ⋈ invoice join (top products)
# share a key and a bucket count, so those joins need no shuffle.
BUCKET_KEYS = {
    "vouchers": "id",
    "voucher_items": "voucher_id",
    "delivery_challans": "id",
    "document_status_history": "document_id",
    "parties": "id",
}


def write_bucketed_tables(tables: Tables, root: str, database: str | None = None,
                          buckets: int = 64, prefix: str = "", mode: str = "overwrite") -> None:
    """Save the star schema as catalog tables at ``{root}/{table}``, the
    event-sized ones bucketed (and sorted) on their join key with one bucket
    count. Read back with :func:`read_catalog_tables` (same ``database`` and
    ``prefix`` via ``names``). Size ``buckets`` so one bucket of the largest
    table is a few hundred MB."""
    spark = tables.spark
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    qual = f"{database}." if database else ""
    for t in STAR_SCHEMAS:
        w = getattr(tables, t).write.mode(mode).format("parquet").option("path", f"{root.rstrip('/')}/{t}")
        if t in BUCKET_KEYS:
            w = w.bucketBy(buckets, BUCKET_KEYS[t]).sortBy(BUCKET_KEYS[t])
        w.saveAsTable(f"{qual}{prefix}{t}")
