"""Language-model scores by context-tree weighting (CTW) over bytes.

A byte is eight binary decisions, most significant bit first. Every decision
has a context tree: its nodes are the last 0 to ``DEPTH`` bytes. A node keeps
how often the bit was 0 and 1; the Krichevsky-Trofimov (KT) estimator turns
that into a probability, and the weighted probability of a node is the mean of
its own KT probability and the product of its children's. A text is scored by
the mixture that these weights give over all depths, bit by bit; an end mark
(byte 255, never part of UTF-8) follows each text and stands before it.

How it runs:

* One pass over the training texts counts byte (DEPTH + 1)-grams and words,
  merged in each task, then summed by key. Nothing else is needed: the counts
  of every node are sums of them.
* The recursion over the tree goes from the leaves up, one group per context
  of two bytes, then per byte, then the root.
* The model that every task gets holds all contexts of up to two bytes and the
  deeper ones with at least 2^-16 of all training bytes, so at most 65,536 for
  each depth, whatever the corpus (1 kB each, and as much again for the way
  there; 2 kB more for those of two bytes).
* Where a text comes to a deeper context that is not held, the task emits
  (row, context and byte, times). The distinct ones meet the stored counts and
  nodes, are predicted just as the held ones and joined back, so the scores are
  those of the whole tree. A context that no training text has is predicted by
  its longest known suffix.

The word baseline needs the count of every word of every text. Words with at
least 2^-22 of all tokens (at most 4,194,304) are given to the tasks; the
others are joined by hash, one row per text and rare word, so neither a
frequent word nor a large vocabulary is a problem.

Definitions: null text is empty; it still has the end token and the end mark.
Rows that share an id are scored each on its own. With no training text every
count is 0 and every bit has probability one half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import slices, stored, texts_of
from ledgerlens.llm.minhash import WordHashes

DEPTH = 4
END = 255
SHARE_BITS = 16
WORD_SHARE_BITS = 22
_CHUNK = 1 << 19
_CONTEXTS = 1024
_END_WORD = np.int64(np.uint64(xxhash.xxh3_64_intdigest(b" end")).view(np.int64))

# incidence of the 255 decisions with the 256 bytes: the bit taken there, or -1
_BYTES = np.arange(256)
_NODE_OF = np.stack([(256 | _BYTES) >> (8 - k) for k in range(8)])  # node (1-255) of decision k
_BIT_OF = np.stack([(_BYTES >> (7 - k)) & 1 for k in range(8)])
_TO = [np.zeros((256, 255)), np.zeros((256, 255))]
for _k in range(8):
    for _bit in (0, 1):
        _which = _BIT_OF[_k] == _bit
        _TO[_bit][_BYTES[_which], _NODE_OF[_k][_which] - 1] = 1


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving the argument above 8."""
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = shift - np.where(low, np.log(np.where(low, x, 1)), 0)
        x = np.where(low, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def weigh(counts: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts with the byte counts ``counts`` (n x 256): the KT probability
    of a 1, the posterior weight of stopping there, and the log weighted
    probability, each n x 255. ``children``: the children's summed log weighted
    probabilities; none at the greatest depth."""
    zero, one = counts @ _TO[0], counts @ _TO[1]
    log_kt = _lgamma(zero + 0.5) + _lgamma(one + 0.5) - _lgamma(zero + one + 1) - math.log(math.pi)
    kt = (one + 0.5) / (zero + one + 1)
    if children is None:
        return kt, np.ones_like(kt), log_kt
    weighted = np.logaddexp(log_kt, children) - math.log(2)
    return kt, np.exp(log_kt - math.log(2) - weighted), weighted


def _grams(buffer: np.ndarray, depth: int) -> np.ndarray:
    """Keys of all (depth + 1)-grams: symbol, then the nearest byte, and so on upwards."""
    key = buffer[depth:].astype(np.int64)
    for d in range(1, depth + 1):
        key |= buffer[depth - d:len(buffer) - d].astype(np.int64) << (8 * d)
    return key


def _marked(texts: list[str], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one byte array, each after ``depth`` marks and before one; where
    each begins."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    mark = bytes([END])
    starts = np.concatenate([[0], np.cumsum([len(r) + depth + 1 for r in raw])])
    return np.frombuffer(b"".join(mark * depth + r + mark for r in raw), np.uint8), starts


def _chunks(texts: list[str]) -> Iterator[list[int]]:
    """Indices of texts, by about half a MB."""
    some, size = [], 0
    for i, t in enumerate(texts):
        some.append(i)
        size += len(t)
        if size > _CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


class _Counter:
    """Counts of 64-bit keys, merged when many have come together."""

    def __init__(self, limit: int = 1_500_000):
        self.keys, self.counts, self.pending, self.limit = np.zeros(0, np.int64), np.zeros(0, np.int64), [], limit

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.pending.append((k, n))
        if sum(len(x[0]) for x in self.pending) > self.limit:
            self.merge()

    def merge(self) -> None:
        parts = [(self.keys, self.counts), *self.pending]
        keys = np.concatenate([k for k, _ in parts])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(self.keys)).astype(np.int64)
        self.pending = []


def _word_hashes(text: str, hashes: WordHashes) -> np.ndarray:
    words = text.encode("utf-8", "replace").lower().split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text column -> (kind, key, n): kind 0 words and the end token, 1 byte grams."""
    words, grams, hashes = _Counter(), _Counter(), WordHashes()

    def emit() -> Iterator[pa.RecordBatch]:
        for kind, c in ((0, words), (1, grams)):
            c.merge()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c.keys), kind, np.int32)), pa.array(c.keys), pa.array(c.counts)], ["kind", "key", "n"])
            c.keys, c.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    for batch in batches:
        texts = texts_of(batch.column(0))
        for some in _chunks(texts):
            own = [texts[i] for i in some]
            words.add(np.concatenate([_word_hashes(t, hashes) for t in own] + [np.full(len(own), _END_WORD)]))
            buffer, starts = _marked(own, DEPTH)
            keys = _grams(buffer, DEPTH)
            inner = np.ones(len(keys), bool)
            inner[(starts[1:-1, None] + np.arange(-DEPTH, 0)).ravel()] = False  # symbols that are the next text's marks
            grams.add(keys[inner])
            if len(words.keys) > 2_000_000 or len(grams.keys) > 2_000_000:
                yield from emit()
    yield from emit()


_NODES = "depth int, context long, held boolean, counts binary, weighted binary, kt binary, stop binary"


def _nodes(depth: int, contexts: np.ndarray, counts: np.ndarray, kt: np.ndarray, stop: np.ndarray, weighted: np.ndarray | None,
           held: np.ndarray | bool = True) -> pd.DataFrame:
    pack = lambda m, kind: [x.astype(kind).tobytes() for x in m] if m is not None else [None] * len(contexts)
    return pd.DataFrame({"depth": depth, "context": contexts, "held": held, "counts": pack(counts if weighted is not None else None, "<f8"),
                         "weighted": pack(weighted, "<f8"), "kt": pack(kt, "<f4"), "stop": pack(stop, "<f4")})


def _subtree(least: int):
    """The nodes from one context of two bytes down, held with ``least`` bytes or
    more; of the greatest depth only those, as the counts tell all of the others."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, times = pdf["key"].to_numpy(), pdf["n"].to_numpy()
        out, below = [], None
        for depth in range(DEPTH, 1, -1):
            contexts, at = np.unique((key >> 8) & (256**depth - 1), return_inverse=True)
            parents = np.unique(contexts & (256 ** (depth - 1) - 1))
            summed = np.zeros((len(parents), 255)) if depth > 2 else None
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(0, len(contexts) + _CONTEXTS, _CONTEXTS))
            for i, c in enumerate(range(0, len(contexts), _CONTEXTS)):  # so many dense rows at a time
                own, rows = contexts[c:c + _CONTEXTS], order[ends[i]:ends[i + 1]]
                counts = np.zeros((len(own), 256))
                np.add.at(counts, (at[rows] - c, key[rows] & 255), times[rows])
                kt, stop, weighted = weigh(counts, None if below is None else below[c:c + _CONTEXTS])
                held = counts.sum(axis=1) >= least if depth > 2 else np.ones(len(own), bool)
                keep = held if depth == DEPTH else np.ones(len(own), bool)
                out.append(_nodes(depth, own[keep], counts[keep], kt[keep], stop[keep], weighted if depth == 2 else None, held[keep]))
                if depth > 2:
                    np.add.at(summed, np.searchsorted(parents, own & (256 ** (depth - 1) - 1)), weighted)
            below = summed
        return pd.concat(out)

    return run


def _parent(pdf: pd.DataFrame) -> pd.DataFrame:
    """The node of one byte from its children of two bytes."""
    arrays = lambda c, n: np.stack([np.frombuffer(x, "<f8") for x in pdf[c]]).reshape(-1, n).sum(axis=0, keepdims=True)
    counts = arrays("counts", 256)
    kt, stop, weighted = weigh(counts, arrays("weighted", 255))
    return _nodes(1, pdf["context"].to_numpy()[:1] & 255, counts, kt, stop, weighted)


@dataclass
class Model:
    """Rows of log10 byte probabilities, and how the last bytes lead to a row:
    ``two`` by the last two bytes, then each of ``deeper`` (first row of the
    depth it starts from, table by row and the next byte back). ``mixed`` and
    ``rest``: what the contexts of up to two bytes give to the prediction below
    one of two, and the weight they leave. Rows from ``first_two`` to ``first_last``
    may have deeper contexts that are not held, unless ``whole``."""

    rows: np.ndarray
    two: np.ndarray
    deeper: list[tuple[int, np.ndarray]]
    words: np.ndarray
    word_counts: np.ndarray
    tokens: int
    vocabulary: int
    mixed: np.ndarray
    rest: np.ndarray
    first_two: int
    first_last: int
    whole: bool


@dataclass
class Stored:
    """What is too large for the tasks: all word counts (key, n), all counts of
    byte grams (key, n), and the nodes between two bytes and the greatest depth."""

    words: DataFrame
    grams: DataFrame
    nodes: DataFrame


def _byte_rows(p: np.ndarray) -> np.ndarray:
    """log10 probability of every byte from the probabilities of a 1 at 255 nodes."""
    p = np.clip(p, 1e-12, 1 - 1e-12)
    one, zero = np.log10(p), np.log10(1 - p)
    out = np.zeros((len(p), 256))
    for k in range(8):
        out += np.where(_BIT_OF[k][None, :] == 1, one[:, _NODE_OF[k] - 1], zero[:, _NODE_OF[k] - 1])
    return out.astype(np.float32)


def fit(train: DataFrame, text_col: str = "text") -> tuple[Model, Stored]:
    """The model of the training texts, and the tables it leaves to be joined."""
    counts = train.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "kind int, key long, n long")
    counts = stored(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")
    words, grams = counts.filter("kind = 0").select("key", "n"), counts.filter("kind = 1").select("key", "n")
    tokens, vocabulary = (x or 0 for x in words.agg(F.sum("n"), F.count("*")).first())
    total = grams.agg(F.sum("n")).first()[0] or 0

    least = max(1, -(-total >> SHARE_BITS))
    two = F.shiftright("key", 8).bitwiseAND(F.lit(65535))
    deep = stored(grams.groupBy(two.alias("two")).applyInPandas(_subtree(least), _NODES), "ctw-deep")
    above = stored(deep.filter("depth = 2").groupBy(F.col("context").bitwiseAND(F.lit(255)).alias("one")).applyInPandas(_parent, _NODES), "ctw-above")
    read = lambda df: df.orderBy("context").toPandas() if total else pd.DataFrame(columns=["context", "kt", "stop", "counts", "weighted"])
    # at most 65,536 contexts of each depth, about 2 kB each
    levels = [read(above)] + [read(deep.filter((F.col("depth") == d) & F.col("held")).select("context", "kt", "stop")) for d in range(2, DEPTH + 1)]
    matrix = lambda pdf, c, kind, n: np.stack([np.frombuffer(x, kind) for x in pdf[c]]).reshape(-1, n) if len(pdf) else np.zeros((0, n))

    root_counts = matrix(levels[0], "counts", "<f8", 256).sum(axis=0, keepdims=True)
    kt, stop, _ = weigh(root_counts, matrix(levels[0], "weighted", "<f8", 255).sum(axis=0, keepdims=True))
    mixed, rest = stop * kt, 1 - stop
    rows, contexts, parents = [_byte_rows(kt)], [np.zeros(1, np.int64)], None
    where = []
    for d, level in enumerate(levels, start=1):
        own = level["context"].to_numpy(np.int64)
        kt, stop = matrix(level, "kt", "<f4", 255).astype(float), matrix(level, "stop", "<f4", 255).astype(float)
        parents = np.searchsorted(contexts[-1], own & (256 ** (d - 1) - 1))
        rows.append(_byte_rows(mixed[parents] + rest[parents] * kt))
        mixed, rest = mixed[parents] + rest[parents] * stop * kt, rest[parents] * (1 - stop)
        if d == 2:
            mixed_two, rest_two = mixed.astype(np.float32), rest.astype(np.float32)
        where.append((parents, own))
        contexts.append(own)
    offsets = np.cumsum([0] + [len(c) for c in contexts])
    one = np.zeros(256, np.int32)
    one[contexts[1]] = offsets[1] + np.arange(len(contexts[1]))
    pairs = np.tile(one, 256).astype(np.int32)  # by nearest byte + 256 * the one before it
    pairs[contexts[2]] = offsets[2] + np.arange(len(contexts[2]))
    deeper = []
    for d in range(3, DEPTH + 1):
        parents, own = where[d - 1]
        step = np.repeat(np.arange(offsets[d - 1], offsets[d], dtype=np.int32)[:, None], 256, axis=1)
        step[parents, own >> (8 * (d - 1))] = offsets[d] + np.arange(len(own))
        deeper.append((int(offsets[d - 1]), step))
    common = words.filter(F.col("n") >= max(1, -(-tokens >> WORD_SHARE_BITS))).orderBy("key").toPandas()
    model = Model(np.concatenate(rows), pairs, deeper, common["key"].to_numpy(np.int64), common["n"].to_numpy(np.int64), int(tokens), int(vocabulary),
                  mixed_two, rest_two, int(offsets[2]), int(offsets[DEPTH]), least == 1)
    return model, Stored(words, grams, deep.filter(F.col("depth") == DEPTH - 1).select("context", "kt", "stop"))


def byte_scores(model: Model, texts: list[str], left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """log10 probability of each text with its end mark. With ``left``, bytes
    whose context may not be held are not scored but added there (index of the
    text, key, times)."""
    out = np.zeros(len(texts))
    for some in _chunks(texts):
        buffer, starts = _marked([texts[i] for i in some], DEPTH)
        wide = buffer.astype(np.int32)
        row = model.two[wide[DEPTH - 1:-1] + 256 * wide[DEPTH - 2:-2]]
        for d, (first, step) in enumerate(model.deeper, start=3):
            if not len(step):
                break
            at = row - first  # below 0: the context was left at a lesser depth
            row = np.where(at >= 0, step[np.maximum(at, 0), wide[DEPTH - d:len(wide) - d]], row)
        value = model.rows[row, wide[DEPTH:]].astype(float)
        if left is not None and not model.whole:
            at = np.flatnonzero((row >= model.first_two) & (row < model.first_last))
            text = np.searchsorted(starts, at, side="right") - 1
            own = at < starts[text + 1] - DEPTH  # others are the next text's marks
            at, text = at[own], text[own]
            value[at] = 0
            found, times = np.unique(text << 40 | _grams(buffer, DEPTH)[at], return_counts=True)
            left.append((np.asarray(some)[found >> 40], found & (2**40 - 1), times))
        total = np.concatenate([[0.0], np.cumsum(value)])
        out[some] = total[starts[1:] - DEPTH] - total[starts[:-1]]
    return out


def _predict(shared):
    """(context, symbols asked for, symbols and counts of the context, kt and
    stop of its parent) -> key, log10 probability."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, _CONTEXTS):
                part = batch.slice(s, _CONTEXTS)
                context, asked, symbols, times, kt, stop = (part.column(i).to_pylist() for i in range(6))
                context, n = np.array(context, np.int64), part.num_rows
                two = m.two[context & 65535]
                mixed, rest = m.mixed[two - m.first_two].astype(float), m.rest[two - m.first_two].astype(float)
                blank = bytes(4 * 255)
                unpack = lambda c: np.frombuffer(b"".join(blank if x is None else x for x in c), "<f4").reshape(n, 255).astype(float)  # noqa: B023, E731
                kt, stop, known = unpack(kt), unpack(stop), np.array([x is not None for x in kt])
                counts, seen = np.zeros((n, 256)), np.array([x is not None for x in symbols])
                for i in np.flatnonzero(seen):
                    counts[i, symbols[i]] = times[i]
                zero, one = counts @ _TO[0], counts @ _TO[1]
                deepest = mixed + rest * (stop * kt + (1 - stop) * (one + 0.5) / (zero + one + 1))
                rows = _byte_rows(np.where(seen[:, None], deepest, mixed + rest * kt))
                rows[~known] = m.rows[two[~known]]
                at, symbol = np.repeat(np.arange(n), [len(x) for x in asked]), np.array([x for own in asked for x in own], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(context[at] << 8 | symbol), pa.array(rows[at, symbol].astype(float))], ["key", "value"])

    return run


def _predicted(keys: DataFrame, tables: Stored, shared) -> DataFrame:
    """key, value: the log10 probability of each distinct key."""
    context, symbol = F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("symbol")
    asked = keys.select("key").distinct().select(context, symbol).groupBy("context").agg(F.collect_list("symbol").alias("asked"))
    asked = stored(asked, "ctw-asked")
    counts = tables.grams.select(context, symbol, "n").join(asked.select("context"), "context", "left_semi")
    counts = counts.groupBy("context").agg(F.collect_list(F.struct("symbol", "n")).alias("own"))  # 256 at most
    above = tables.nodes.withColumnRenamed("context", "parent")
    met = asked.join(counts, "context", "left").withColumn("parent", F.col("context").bitwiseAND(F.lit(256 ** (DEPTH - 1) - 1))).join(above, "parent", "left")
    met = met.select("context", "asked", F.col("own.symbol").alias("symbols"), F.col("own.n").alias("times"), "kt", "stop")
    return stored(met.mapInArrow(_predict(shared), "key long, value double"), "ctw-predicted")


def scored(df: DataFrame, model: Model, tables: Stored, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id, n_tokens, n_known, base_score (words) and score (bytes)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded: see the module's head
    norm = model.tokens + 0.5 * (model.vocabulary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = shared.value, WordHashes()
        for batch in slices(batches, 1):
            texts = texts_of(batch.column(1))
            n = len(texts)
            tokens, known, base, rare, times, ends = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), [], [], np.zeros(n + 1, np.int32)
            for i, t in enumerate(texts):
                h, k = np.unique(np.append(_word_hashes(t, hashes), _END_WORD), return_counts=True)
                tokens[i] = k.sum()
                at = np.minimum(np.searchsorted(m.words, h), max(0, len(m.words) - 1))
                found = m.words[at] == h if len(m.words) else np.zeros(len(h), bool)
                known[i] = k[found].sum()
                base[i] = (k[found] * np.log10((m.word_counts[at[found]] + 0.5) / norm)).sum()
                rare.append(h[~found]), times.append(k[~found])
                ends[i + 1] = ends[i] + int((~found).sum())
            left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            score = byte_scores(m, texts, left)
            deep_ends = np.concatenate([[0], np.cumsum(sum((np.bincount(i, minlength=n) for i, _, _ in left), np.zeros(n, np.int64)))]).astype(np.int32)
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score),
                 pa.ListArray.from_arrays(pa.array(ends), flat(rare)), pa.ListArray.from_arrays(pa.array(ends), flat(times)),
                 pa.ListArray.from_arrays(pa.array(deep_ends), flat([k for _, k, _ in left])), pa.ListArray.from_arrays(pa.array(deep_ends), flat([k for _, _, k in left]))],
                ["id", "n_tokens", "known", "base", "score", "rare", "times", "deep", "deep_times"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n_tokens long, known long, base double, score double, rare array<long>, times array<long>, deep array<long>, deep_times array<long>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "ctw-rows")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("k"))
    rare = rare.join(tables.words, "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more"),
        F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / norm)).alias("add"))
    rare = stored(rare, "ctw-rare")
    deep = rows.select("row", F.explode(F.arrays_zip("deep", "deep_times")).alias("x")).select("row", F.col("x.deep").alias("key"), F.col("x.deep_times").alias("k"))
    if model.whole:
        deep = rows.select("row", F.lit(0.0).alias("deeper")).limit(0)
    else:
        deep = stored(deep.join(_predicted(deep, tables, shared), "key").groupBy("row").agg(F.sum(F.col("k") * F.col("value")).alias("deeper")), "ctw-deeper")
    return rows.join(rare, "row", "left").join(deep, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("add", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("deeper", F.lit(0.0))).alias("score"))
