"""Hard-negative mining by Kronecker-packed products.

A query set of rows (the anchors) meets all rows in blocks; nothing is sampled
and no pair of rows becomes a row of its own.

1. Components become integers, floor(``scale`` * x). Rows are dealt to blocks
   of a bounded number of components by a hash, anchors to blocks of their own;
   every pair of an anchor block and a row block is one unit of work.
2. In a unit the components of several rows are made non-negative by a bias and
   put side by side into fields of one wide integer, each field wide enough for
   a whole inner product. One multiplication per anchor component and packed
   integer then serves all fields at once; the fields are cut apart and the
   bias is taken off again. While the integer stays below 2^53 a double holds
   it exactly and the products are one matrix multiplication; beyond that they
   are Python integers. Scores are exact either way.
3. First pass: every unit returns an anchor's best rows of its own label, the
   best of all units are its positives. Second pass: for the scores of these
   positives every unit returns the best rows of another label inside the
   window; the best of all units, ranked, are the negatives.

A label, a vector or an id that most rows share changes nothing: work is dealt
by block, not by label, and a unit returns at most ``positives`` or
``negatives`` rows per anchor and positive score.

Definitions. Rows without id, label or vector, or with a null or non-finite
component, take no part. Rows alike in id, label and vector are one row; rows
that share only the id are different rows. Only vectors of equal length have an
inner product; the empty vectors among themselves have 0. Components beyond
+-2^53 (scaled) count as that, and scores beyond a long as the nearest long.
Ties go to the smaller id. An empty table gives an empty result; further
columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import shuffle_partitions, stored

#: Components in a block of rows and of anchors (4,096 and 2,048 vectors of 64).
ROW_BLOCK = 2**18
ANCHOR_BLOCK = 2**17
#: Scores held at a time.
_SCORES = 2**20
_EXACT = 53
_LONGEST = 2**63 - 1
_KEY = ("dim", "ab", "cb")


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products of integer vectors (anchors x rows), exact, clipped
    to longs."""
    n, dim = rows.shape
    if not n or not len(anchors) or not dim:
        return np.zeros((len(anchors), n), np.int64)
    bias_a, bias_r = int(np.abs(anchors).max()), int(np.abs(rows).max())
    width = max(1, (dim * 2 * bias_a * 2 * bias_r).bit_length())
    fields = _EXACT // width
    kind = np.int64 if fields else object
    fields = fields or 4
    x = anchors.astype(kind) + bias_a
    y = np.zeros((-(-n // fields) * fields, dim), kind)
    y[:n] = rows.astype(kind) + bias_r
    wide = sum(y[k::fields] * (1 << (width * k)) for k in range(fields))
    made = (x.astype(float) @ wide.T.astype(float)).astype(np.int64) if kind is np.int64 else x.dot(wide.T)
    out = np.empty((len(x), len(y)), kind)
    for k in range(fields):
        out[:, k::fields] = (made >> (width * k)) & ((1 << width) - 1)
    out = out[:, :n] - bias_r * x.sum(axis=1)[:, None] - bias_a * (y[:n] - bias_r).sum(axis=1)[None, :]
    return out if kind is np.int64 else np.clip(out, -_LONGEST, _LONGEST).astype(np.int64)


def _integers(vectors: pa.Array, dim: int, scale: float) -> np.ndarray:
    x = np.asarray(vectors.flatten(), float).reshape(len(vectors), dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -(2.0**_EXACT), 2.0**_EXACT).astype(np.int64)


def _best(scores: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``some`` (in order of id) the first ``k`` by score, then id."""
    s = scores[some]
    if len(some) > k:
        few = s >= np.partition(s, len(s) - k)[len(s) - k]
        some, s = some[few], s[few]
    return some[np.argsort(-s, kind="stable")[:k]]


class _Unit:
    """One anchor block against one row block."""

    def __init__(self, dim: int, anchors: pa.Array, rows: pa.Array, scale: float):
        order = np.argsort(np.asarray(rows.field("id")), kind="stable")
        self.row_ids = np.asarray(rows.field("id"))[order]
        self.row_keys = np.asarray(rows.field("rid"))[order]
        self.row_labels = np.asarray(rows.field("label"))[order]
        self.rows = _integers(rows.field("vector"), dim, scale)[order]
        self.ids, self.keys, self.labels = (np.asarray(anchors.field(c)) for c in ("id", "rid", "label"))
        self.anchors = _integers(anchors.field("vector"), dim, scale)

    def scored(self) -> Iterator[tuple[int, np.ndarray]]:
        """Every anchor's place with its scores against all rows."""
        step = max(1, _SCORES // max(1, len(self.rows)))
        for s in range(0, len(self.anchors), step):
            for i, scores in enumerate(packed_scores(self.anchors[s:s + step], self.rows), s):
                yield i, scores


def _each_unit(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[_Unit, pa.Array]]:
    for batch in batches:
        for i in range(batch.num_rows):
            dim, (anchors, rows) = batch.column(0)[i].as_py(), (batch.column(c).slice(i, 1).flatten() for c in (1, 2))
            yield _Unit(dim, anchors, rows, scale), anchors


def _table(columns: list[list], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names))


_POSITIVE = ("arid", "anchor_id", "positive_id", "positive_score")
_NEGATIVE = ("arid", "positive_score", "negative_id", "negative_score")


def _positives(k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, _ in _each_unit(batches, scale):
            out: list[list] = [[], [], [], []]
            for i, scores in unit.scored():
                best = _best(scores, np.flatnonzero((unit.row_labels == unit.labels[i]) & (unit.row_keys != unit.keys[i])), k)
                for column, values in zip(out, ([int(unit.keys[i])] * len(best), [int(unit.ids[i])] * len(best), unit.row_ids[best].tolist(), scores[best].tolist()), strict=True):
                    column += values
            yield _table(out, _POSITIVE)

    return run


def _negatives(k: int, low: int, high: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, anchors in _each_unit(batches, scale):
            wanted = anchors.field("wanted").to_pylist()
            out: list[list] = [[], [], [], []]
            for i, scores in unit.scored():
                other = unit.row_labels != unit.labels[i]
                for p in wanted[i]:
                    # low * p <= 100 * score <= high * p, in whole numbers
                    best = _best(scores, np.flatnonzero(other & (scores >= min(_LONGEST, -(-low * p // 100))) & (scores <= high * p // 100)), k)
                    for column, values in zip(out, ([int(unit.keys[i])] * len(best), [p] * len(best), unit.row_ids[best].tolist(), scores[best].tolist()), strict=True):
                        column += values
            yield _table(out, _NEGATIVE)

    return run


def _long(names: tuple[str, ...]) -> str:
    return ", ".join(f"{c} long" for c in names)


def mine(rows: DataFrame, anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """The hard negatives of every row for which ``anchor`` holds (a condition
    over ``id``, ``label`` and ``vector``): for each of its best ``positives``
    of the same label the best ``negatives`` of other labels whose score lies
    between ``low`` and ``high`` per cent of the positive's.

    Columns: anchor_id, positive_id, rank (int, from 1), negative_id,
    positive_score, negative_score.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    used = (rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.col(vector_col).cast("array<double>").alias("vector"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite)))
    used = stored(used.distinct().select(
        F.monotonically_increasing_id().alias("rid"), "id", "label", "vector", F.size("vector").alias("dim"),
        F.xxhash64("id", "label", "vector").alias("deal"), F.coalesce(anchor, F.lit(False)).alias("anchor")), "hardneg-rows")
    size = F.col("dim") + 1
    sums = used.agg(F.sum(size).alias("rows"), F.sum(F.when(F.col("anchor"), size)).alias("anchors")).first()
    n_rows, n_anchors = (max(1, -(-(x or 0) // block)) for x, block in ((sums["rows"], ROW_BLOCK), (sums["anchors"], ANCHOR_BLOCK)))

    parts = shuffle_partitions(rows.sparkSession)
    member = ["id", "rid", "label", "vector"]
    row_blocks = stored(used.groupBy("dim", F.pmod("deal", F.lit(n_rows)).cast("int").alias("cb"))
                        .agg(F.collect_list(F.struct(*member)).alias("rows")), "hardneg-blocks")

    def units(anchors: DataFrame, *more: str) -> DataFrame:
        blocks = (anchors.groupBy("dim", F.pmod("deal", F.lit(n_anchors)).cast("int").alias("ab"))
                  .agg(F.collect_list(F.struct(*member, *more)).alias("anchors")))
        left = blocks.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
        right = row_blocks.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))
        return left.repartition(parts, *_KEY).join(right.repartition(parts, *_KEY), list(_KEY)).select("dim", "anchors", "rows")

    anchors = used.filter("anchor")
    found = units(anchors).mapInArrow(_positives(positives, scale), _long(_POSITIVE))
    first = W.partitionBy("arid").orderBy(F.desc("positive_score"), "positive_id")
    best = stored(found.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= positives), "hardneg-positives")

    wanted = best.groupBy("arid").agg(F.collect_set("positive_score").alias("wanted"))
    asked = anchors.join(wanted, F.col("rid") == F.col("arid"))
    near = units(asked, "wanted").mapInArrow(_negatives(negatives, low, high, scale), _long(_NEGATIVE))
    first = W.partitionBy("arid", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return best.drop("k").join(ranked, ["arid", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
