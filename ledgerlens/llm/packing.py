"""Packing by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a remainder; the remainder is
cut again into equal pieces of at most ``PIECE`` ids, small enough for windows
to come out level. Pieces are dealt into groups of about ``GROUP`` by a hash.
Within a group, partial partitions over m windows are merged two at a time, the
two most uneven first, the fullest window of one on the emptiest of the other;
what remains are m nearly equal windows. m starts at the least number that
could hold the group and rises by one whenever a window exceeds the capacity.

Only (document, start, length, checksum) rows are shuffled, never ids, and a
group's size does not depend on any key of the data: rows are dealt by id,
start and their place in the task, so copies spread too.

Definitions: null text is empty, a document of the end id alone. Rows that
share an id, and identical rows, are separate documents. An empty table gives
no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored, texts_of
from ledgerlens.llm.tokens import ByteEncoder, with_ends

CAPACITY = 1024
PIECE = 256
GROUP = 2048
#: Windows that one piece fills need no differencing; their numbers start here.
_FULL = 2**62
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long"


def difference(sizes: np.ndarray, m: int) -> np.ndarray:
    """Window (0 to m - 1) of every item, by multiway differencing."""
    n = len(sizes)
    if m == 1 or n == 0:
        return np.zeros(n, np.int64)
    sums: dict[int, np.ndarray] = {}
    for i in range(n):
        v = np.zeros(m, np.int64)
        v[0] = sizes[i]  # every partition is kept with its fullest window first
        sums[i] = v
    heap = [(-int(sizes[i]), i) for i in range(n)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        merged.append((a, b, order))
        sums[n + len(merged) - 1] = both
        heapq.heappush(heap, (int(both[-1] - both[0]), n + len(merged) - 1))
    window = {heap[0][1]: np.arange(m)}
    out = np.zeros(n, np.int64)
    for k in range(len(merged) - 1, -1, -1):
        a, b, order = merged[k]
        own = window.pop(n + k)
        of_a = np.empty(m, np.int64)
        of_a[order] = own
        for child, slots in ((a, of_a), (b, of_a[::-1])):
            if child < n:
                out[child] = slots[0]
            else:
                window[child] = slots
    if not merged:
        out[0] = 0
    return out


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of every item; no window holds more than ``capacity``."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, m)
        if np.bincount(at, weights=sizes, minlength=1).max(initial=0) <= capacity:
            return at
        m += 1


def cuts(n: int, capacity: int, piece: int) -> np.ndarray:
    """Lengths of the pieces of a document of ``n`` ids."""
    full, rest = divmod(n, capacity)
    k = -(-rest // piece)
    return np.array([capacity] * full + [rest // k + (i < rest % k) for i in range(k)], np.int64)


def _pieces(encoder: Callable[[], ByteEncoder], end: int, capacity: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, place = encoder(), 0
        for batch in batches:
            doc = batch.column(0).to_pylist()
            texts, rows = texts_of(batch.column(1)), []
            for s in range(0, len(texts), 512):
                ids, counts = with_ends(*enc.encode_all(texts[s:s + 512]), end)
                ids, at = ids.astype("<u4"), 0
                for d, n in zip(doc[s:s + 512], counts.tolist(), strict=True):
                    start = 0
                    for length in cuts(n, capacity, piece).tolist():
                        crc = zlib.crc32(ids[at + start:at + start + length].tobytes())
                        rows.append((d, start, length, crc, n, place))
                        start += length
                    at += n
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
         capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    ``tokenizer`` is the path of a byte-level tokenizers file on every machine.
    """
    pieces = stored(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                    .mapInArrow(_pieces(lambda: ByteEncoder(tokenizer, special=True), end_id, capacity, piece), _PIECES), "pack-pieces")
    full = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(_FULL) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = pieces.filter(F.col("length") < capacity)
    groups = max(1, round(pieces.count() / group))
    if groups >= 2**42:
        raise ValueError("too many groups for sequence ids")

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "place"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        size = pdf["length"].to_numpy()
        at = windows(size, capacity)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(size[order])
        first = np.concatenate([[True], at[order][1:] != at[order][:-1]])
        begin = np.maximum.accumulate(np.where(first, ends - size[order], 0))
        offset = np.empty(len(pdf), np.int64)
        offset[order] = ends - size[order] - begin
        return pd.DataFrame({**{c: pdf[c] for c in ("doc_id", "no_id", "start", "length", "ids_crc32", "doc_tokens")},
                             "sequence_id": pdf["group"].to_numpy() * 2**21 + at, "offset": offset})

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "place"), F.lit(groups)))
    dealt = dealt.withColumn("no_id", F.col("doc_id").isNull()).fillna(0, ["doc_id"])  # pandas would make floats of ids with nulls
    packed = dealt.groupBy("group").applyInPandas(
        level, "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id").unionByName(full)
