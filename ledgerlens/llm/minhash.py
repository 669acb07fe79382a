"""Near-dedup by b-bit MinHash over word shingles.

1. One pass over the texts: the set of shingles (64-bit hashes), its size, a
   128-bit digest of the set, 96 minima; of these 24 band keys of 4 minima
   each, and the low 4 bits of all, packed into six longs.
2. Texts with equal sets form one class (an aggregation by digest).
3. Classes that share a band key are candidates. Their similarity is estimated
   from the packed bits by bit counts, corrected for chance collisions.
   Candidates well below the threshold (``MARGIN``, about four standard
   deviations) go; the others are confirmed on the full shingle sets.
4. Confirmed links give components.

A band key that thousands of classes share is never expanded into all pairs.
A star round comes first: every key has a leader, taken at random by a hash,
and every class is compared with the three likeliest leaders of its keys.
Then come all remaining candidate pairs between different components (every
such pair has a member outside the largest component of its key): those
members, in blocks of 256 per key, are compared with all members of the key,
first by sizes and bits, then on the sets, and only confirmed links leave the
task. A pair that shares several keys is confirmed at the first; a pair inside
one component cannot change the result and is not confirmed.

A pair of similarity 0.8 shares no band key with probability 0.59 ** 24, about
3 in a million. Null and empty texts, and texts without words, have an empty
set and link with nothing. A text shorter than a shingle is one shingle. Rows
that share an id each get their class; null ids are ignored when the smallest
id of a component is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import append_columns, fresh, shuffle_partitions, stored
from ledgerlens.llm.components import components

BANDS, ROWS, BITS = 24, 4, 4
HASHES = BANDS * ROWS
MARGIN = 0.17
LEADERS = 3
BLOCK = 256
_WORDS_KEPT = 400_000
_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLIERS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


class WordHashes(dict):
    """Word -> 64-bit hash, computed once per word and forgotten when many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words (A-Z lower-cased)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    span = min(width, n)
    h = np.full(n - span + 1, np.uint64(span))
    for i in range(span):
        h = _mix(h + w[i:n - span + 1 + i] * np.uint64(2 * i + 1))
    return np.unique(h)


def _minima(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(s), 2048):
        np.minimum(out, (s[i:i + 2048, None] * _MULTIPLIERS + _ADDENDS).min(axis=0), out=out)
    return out


def _signature_columns(column: pa.Array, width: int, hashes: WordHashes) -> list[pa.Array]:
    n = len(column)
    size, digest = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
    keys, minima = np.zeros((n, BANDS), np.uint64), np.zeros((n, HASHES), np.uint64)
    for i, text in enumerate(column.to_pylist()):
        s = shingle_set(text, width, hashes)
        size[i] = len(s)
        if len(s):
            digest[0, i], digest[1, i] = s.sum(), _mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum()
            minima[i] = _minima(s)
    minima = _mix(minima)
    for r in range(ROWS):
        keys = _mix(keys + minima[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
    low = (minima & np.uint64(2**BITS - 1)).reshape(n, -1, 64 // BITS)
    packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.view(np.int64).ravel()))
    return [pa.array(size), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
            lists(np.ascontiguousarray(keys)), lists(np.ascontiguousarray(packed))]


_longs = T.ArrayType(T.LongType())
_FIELDS = [T.StructField("size", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
           T.StructField("keys", _longs), T.StructField("bits", _longs)]


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """id, rid, size, cid (the class of equal sets), keys, bits."""
    rows = append_columns(docs.select("id", "rid", "text"), ["text"], _FIELDS,
                          lambda hashes, column: _signature_columns(column, width, hashes), WordHashes)
    return rows.select("id", "rid", "size", F.xxhash64("size", "d1", "d2").alias("cid"), "keys", "bits")


def estimate(a: str, b: str) -> Column:
    """Similarity estimated from two columns of packed bits."""
    differing = F.lit(0)
    lanes = int("1" * 16, 16)
    for i in range(HASHES * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(lanes)))
    chance = 2.0 ** -BITS
    return ((1 - differing / HASHES) - chance) / (1 - chance)


def _likely(a: str, b: str, threshold: float) -> Column:
    """Whether sizes and bits of two sides allow the threshold."""
    small, large = F.least(f"{a}size", f"{b}size"), F.greatest(f"{a}size", f"{b}size")
    return (100 * small >= round(100 * threshold) * large) & (estimate(f"{a}bits", f"{b}bits") >= threshold - MARGIN)


class _Rows:
    """Some rows of one band key, as arrays."""

    def __init__(self, batch: pa.RecordBatch, at: slice):
        get = lambda name: batch.column(name).slice(at.start, at.stop - at.start)
        self.cid, self.root, self.size = (np.asarray(get(c)) for c in ("cid", "root", "size"))
        self.apart = np.array(get("apart").to_pylist(), bool)
        self.keys = np.asarray(get("keys").flatten()).reshape(-1, BANDS)
        self.bits = np.asarray(get("bits").flatten()).reshape(len(self.cid), -1).view(np.uint64)
        self.sets = [np.frombuffer(v.as_buffer(), "<u8") for v in get("shingles")]


def _links_between(a: _Rows, b: _Rows, key: int, percent: int, least: float) -> list[tuple[int, int]]:
    """Confirmed pairs of different components whose first common key is ``key``."""
    x = a.bits[:, None, :] ^ b.bits[None, :, :]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differing = np.bitwise_count(x & np.uint64(int("1" * 16, 16))).sum(axis=2, dtype=np.int64)
    chance = 2.0 ** -BITS
    small, large = np.minimum(a.size[:, None], b.size[None, :]), np.maximum(a.size[:, None], b.size[None, :])
    likely = ((1 - differing / HASHES - chance) / (1 - chance) >= least) & (100 * small >= percent * large)
    likely &= a.root[:, None] != b.root[None, :]
    likely &= ~b.apart[None, :] | (a.cid[:, None] < b.cid[None, :])  # two apart meet in both directions
    i, j = np.nonzero(likely)
    same = a.keys[i] == b.keys[j]
    first = a.keys[i, same.argmax(axis=1)] == key
    return [(int(a.cid[p]), int(b.cid[q])) for p, q in zip(i[first].tolist(), j[first].tolist(), strict=True)
            if _reaches(a.sets[p], b.sets[q], percent)]


def _meet(threshold: float):
    """Rows (key, block, looks, ...) sorted so that the rows that look come first
    in each (key, block): the links between them and all its rows."""
    percent, least = round(100 * threshold), threshold - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lookers = None, []
        for batch in batches:
            key, block = np.asarray(batch.column("key")), np.asarray(batch.column("block"))
            looks, found = np.array(batch.column("looks").to_pylist(), bool), []
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (looks[1:] != looks[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                if group != (key[s], block[s]):
                    group, lookers = (key[s], block[s]), []
                for c in range(s, e, 512):
                    some = _Rows(batch, slice(c, min(c + 512, e)))
                    if looks[s]:
                        lookers.append(some)
                    for own in lookers:
                        found += _links_between(own, some, int(key[s]), percent, least)
                        if looks[s] and own is not some:
                            found += _links_between(some, own, int(key[s]), percent, least)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """cid, shingles (the sorted hashes as bytes) of cid, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, width, hashes).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return texts.select("cid", "text").mapInArrow(run, "cid long, shingles binary")


def _reaches(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach a similarity of ``percent`` per cent."""
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    common = int((right[at] == left).sum())
    return 100 * common >= percent * (len(left) + len(right) - common)


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                ok[i] = _reaches(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(ok)) for x in (batch.column(0), batch.column(1))], ["a", "b"])

    side = lambda x: sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"{x}_set"))
    rows = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_set", "b_set")
    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> tuple[DataFrame, dict[str, str]]:
    """``df``'s ids with the size of the shingle set and the component (its
    smallest id) of every row.

    Returns the frame and the names given to its new columns: size, component,
    root (names the component also where ids are null; null for empty sets),
    and rid, which identifies a row by id and text.
    """
    names = {c: fresh(df, f"near_{c}") for c in ("rid", "size", "component", "root")}
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("rid", F.xxhash64("id", "text"))
    signatures = stored(_signatures(docs, width), "near-signatures")
    classes = stored(signatures.filter("size > 0").groupBy("cid").agg(
        F.min("id").alias("id"), F.min("rid").alias("rid"), F.first("size").alias("size"),
        F.first("keys").alias("keys"), F.first("bits").alias("bits")), "near-classes")

    banded = classes.select("cid", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min_by("cid", F.xxhash64("cid", "key")).alias("leader"), F.count("*").alias("n")).filter("n > 1")
    members = stored(banded.join(stored(shared.select("key", "leader"), "near-keys"), "key"), "near-members")
    active = classes.join(members.select("cid").distinct(), "cid", "left_semi")
    active = stored(active.select("cid", "rid", "size", "keys", "bits"), "near-active")
    texts = docs.select("rid", "text").join(active.select("rid", "cid"), "rid").dropDuplicates(["cid"])  # identical rows share a rid
    sets = stored(_sets(texts, width), "near-sets")

    # the star round: every class with the likeliest leaders of its keys
    star = members.filter("cid <> leader").select(F.col("cid").alias("a_cid"), F.col("leader").alias("b_cid")).distinct()
    star = star.join(_prefixed(active, "a_"), "a_cid").join(_prefixed(active, "b_"), "b_cid").filter(_likely("a_", "b_", threshold))
    best = F.slice(F.sort_array(F.collect_list(F.struct(estimate("a_bits", "b_bits").alias("e"), F.col("b_cid").alias("b"))), False), 1, LEADERS)
    star = star.groupBy(F.col("a_cid").alias("a")).agg(best.alias("x")).select("a", F.explode("x.b").alias("b"))
    links = stored(_confirm(stored(star, "near-star"), sets, threshold), "near-links")
    roots = stored(components(links), "near-roots").withColumnRenamed("node", "cid")

    # what the star round left apart: per key the members outside its largest
    # component, in blocks, look at all members
    placed = stored(members.select("cid", "key").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "near-placed")
    largest = (placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
               .agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("roots")).filter("roots > 1")
               .select("key", F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("blocks")))
    split = placed.join(stored(largest, "near-largest"), "key").withColumn("apart", F.col("root") != F.col("top"))
    split = split.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumn("looks", F.col("apart") & (F.pmod(F.xxhash64("cid"), F.col("blocks")) == F.col("block")))
    split = stored(split.select("key", "block", "looks", "apart", "cid", "root"), "near-split")
    split = split.join(active.select("cid", "size", "keys", "bits").join(sets, "cid"), "cid")
    split = split.repartition(shuffle_partitions(df.sparkSession), "key", "block").sortWithinPartitions("key", "block", F.desc("looks"))
    cross = split.mapInArrow(_meet(threshold), "a long, b long")
    links = stored(links.unionByName(cross), "near-all-links")
    roots = stored(components(links), "near-all-roots").withColumnRenamed("node", "cid")

    least = stored(roots.join(classes.select("cid", "id"), "cid").groupBy("root").agg(F.min("id").alias("component")), "near-least")
    linked = roots.join(least, "root").select("cid", "component", "root")
    placed = stored(classes.select("cid", "id").join(linked, "cid", "left")
                    .select("cid", F.coalesce("component", "id").alias("component"), F.coalesce("root", "cid").alias("root")), "near-components")
    rows = signatures.select("id", "rid", "size", "cid").join(placed, "cid", "left")
    return rows.select(F.col("id").alias(id_col), F.col("rid").alias(names["rid"]), F.col("size").alias(names["size"]),
                       F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias(names["component"]),
                       F.col("root").alias(names["root"])), names


def without_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``df`` with one row of each group of near duplicates (that of the smallest
    id); of rows with the same id and text one stays."""
    rows, names = near_duplicates(df, id_col, text_col, width, threshold)
    rid = fresh(df, "near_row")
    rows = stored(rows, "near-rows")
    key = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.col(names["rid"]).alias("rid"))
    of_groups = rows.filter(F.col(names["size"]) > 0).groupBy(names["root"]).agg(F.min(key).alias("stay")).select("stay.rid")
    alone = rows.filter(F.col(names["size"]) == 0).select(F.col(names["rid"]).alias("rid")).distinct()
    stay = stored(of_groups.unionByName(alone).withColumnRenamed("rid", rid), "near-stay")
    marked = df.withColumn(rid, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    return marked.join(stay, rid, "left_semi").dropDuplicates([rid]).drop(rid)
