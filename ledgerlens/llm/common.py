"""Helpers shared by the operators: intermediate tables, row-wise Arrow passes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but the six ASCII white-space characters.
#: ``bytes.split()`` splits UTF-8 text in exactly the same places.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session of one process (tests) gets a temporary folder of its own
    where the setting is missing; on a cluster that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI; one without a scheme lies in Hadoop's default file
    system, as it does for Spark's own readers and writers."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs its running tasks only, and the
    reread table has a known size, by which Spark picks its join strategy.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` does not have (any case)."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: int, most_rows: int = 512, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces (no copies) of at most ``most_rows`` rows, each
    ending with the row that brings the texts of column ``text`` to
    ``most_bytes``: what a task makes of a piece stays small."""
    for b in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) if b.num_rows else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        while at < b.num_rows:
            over = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="left")) + 1
            n = max(1, min(most_rows, over - at, b.num_rows - at))
            yield b.slice(at, n)
            at += n


def append_columns(df: DataFrame, inputs: Sequence[str], fields: Sequence[T.StructField],
                   fn: Callable[..., Sequence[pa.Array]], setup: Callable[[], object] | None = None) -> DataFrame:
    """``df`` with further columns computed batch by batch in Python.

    ``fn`` takes the ``inputs`` as Arrow arrays of few rows (after the value of
    ``setup()``, called once per task, if given) and returns one array per
    field. All of ``df``'s columns pass through unchanged.
    """
    names, n = list(df.columns), len(df.columns)
    at = [names.index(c) for c in inputs]
    texts = next((i for i in at if isinstance(df.schema[i].dataType, (T.StringType, T.BinaryType))), None)
    made = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for b in batches if texts is None else slices(batches, texts):
            new = fn(*state, *(b.column(i) for i in at))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)] + list(new), names + made)

    return df.mapInArrow(run, T.StructType(list(df.schema.fields) + list(fields)))


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column; null counts as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def crc32_of(name: str) -> Column:
    """crc32 of a column's text form, as a long (null for null)."""
    return F.crc32(F.encode(F.col(name).cast("string"), "UTF-8"))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
