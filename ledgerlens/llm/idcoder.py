"""Token-id files: an adaptive context-mixing range coder over blocks of ids.

Every block of 4,096 ids starts from the same state and has its own checksum,
so blocks can be decoded alone. Within a block an id is coded by one interval
of a mixture of three adaptive predictions:

* order 2: the id that last followed the two ids before, and how far it can
  be trusted (0-3);
* order 1: the same for the one id before;
* order 0: the frequencies of the ids in the file, which its head holds.

The weights of the mixture are learnt per pair of trust levels while coding. An
id has the sum of what the three give it: the interval of the order-2 prediction
comes first, then that of order 1, then those of all other ids by rank. The
coder is a range coder with 64-bit state and 32-bit output; carries are added
to the words before.

Python is too slow for one symbol at a time, so all blocks of a file advance
together, one numpy lane per block. The coder, which knows all ids, works out
contexts and masses for several steps at once.

Files hold the documents of a range of ids in ascending order. They are written
under a temporary name and renamed; the manifest table, committed by Spark,
says which files count. Definitions: null text is empty; a null id comes
first; rows that share an id are ordered by text.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import new_folder, qualified, shuffle_partitions, slices
from ledgerlens.llm.tokens import column_encoder, with_ends

BLOCK = 4096
#: Blocks that are coded or decoded side by side.
LANES = 1664
#: A file is cut at this many ids; a remainder of fewer joins the file before it.
FILE_IDS = 4 << 20
MAGIC = b"IDMIX2\x00\x00"
_RANKS = 1 << 17  # different ids of a file, at most
_MIX = 12  # bits of the mixture's total
_MOST = 57344  # of 65,536: the greatest weight
_SLOTS = 12
_CHUNK = 32  # steps whose masses the coder works out at once
_KEYS = np.array([[81006], [48271]])
_OLDER, _SHIFT, _MASK = np.array(69621), np.array(5), np.array((1 << _SLOTS) - 1)
#: Operands of the inner loops as arrays, which spares a conversion each time.
_1, _2, _3, _5, _HIGH, _CAP = (np.array(x, np.int32) for x in (1, 2, 3, 5, 65535, _MOST))
_U12, _U32, _LEAST, _FULL, _NONE = (np.array(x, np.uint64) for x in (_MIX, 32, 1 << 32, 2**64 - 1, 0))


class _Mixture:
    """The adaptive state of ``lanes`` lanes, the first ``n`` of which advance;
    coder and decoder drive it alike. Row 0 of a pair is order 1, row 1 order 2."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.table = np.zeros(2 * lanes << _SLOTS, np.int32)  # 4 * predicted rank + trust
        self.weights = np.full(2 * lanes * 32, 6000, np.int32)
        self.last = np.zeros(lanes, np.int64)
        self.older = np.zeros(lanes, np.int64)

    def narrow(self, n: int) -> None:
        """From now on the first ``n`` lanes advance."""
        lane = np.arange(n) + np.array([[0], [self.lanes]])
        self.slots, self.contexts = lane << _SLOTS, lane << 5
        self.last, self.older = self.last[:n].copy(), self.older[:n].copy()
        self.at, self.place = np.empty((2, n), np.int64), np.empty((2, n), np.int64)
        self.entry, self.pred, self.trust, self.q, self.new, self.hit32 = (np.empty((2, n), np.int32) for _ in range(6))
        self.hit, self.same = np.empty((2, n), bool), np.empty(n, bool)
        self.context, self.fresh, self.context64 = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, np.int64)

    def locate(self) -> None:
        """Where the contexts of the next ids are kept."""
        at = np.multiply(self.last, _KEYS, out=self.at)
        at[1] += self.older
        at >>= _SHIFT
        at &= _MASK
        at += self.slots

    def predict(self) -> None:
        """Predictions and weights at ``at``."""
        self.table.take(self.at, out=self.entry, mode="clip")
        np.right_shift(self.entry, _2, out=self.pred)
        trust, context = np.bitwise_and(self.entry, _3, out=self.trust), self.context
        np.left_shift(trust[0], _2, out=context)
        context += trust[1]
        context += context
        np.equal(self.pred[0], self.pred[1], out=self.same)
        context += self.same
        np.copyto(self.context64, context)
        np.add(self.context64, self.contexts, out=self.place)
        self.weights.take(self.place, out=self.q, mode="clip")

    def update(self, rank: np.ndarray) -> None:
        entry, trust, q, new, hit = self.entry, self.trust, self.q, self.new, self.hit32
        np.equal(self.pred, rank, out=self.hit)
        np.copyto(hit, self.hit)
        np.multiply(hit, _HIGH, out=new)
        new -= q
        new >>= _5
        other = np.subtract(hit[1], _1, out=self.fresh)
        new[0] &= other  # order 1 learns where order 2 fails
        new += q
        np.minimum(new, _CAP, out=new)
        self.weights[self.place] = new
        np.bitwise_or(entry, _3, out=new)
        entry += hit
        entry += hit
        entry -= _1
        np.minimum(entry, new, out=entry)  # trust one more or one less
        fresh = np.left_shift(rank, _2, out=self.fresh)
        fresh += _1
        trust >>= _1
        trust |= hit
        trust -= _1  # all bits where a distrusted prediction failed
        np.bitwise_xor(entry, fresh, out=new)
        new &= trust
        entry ^= new
        self.table[self.at] = entry


def _masses(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 2^12: the mass of order 2, and that of order 2 and order 1 together."""
    two = (q[..., 1, :] >> 4) + 1
    one = ((((1 << _MIX) - two) * q[..., 0, :]) >> 16) + 1
    return two, one + two


def _order0(start: np.ndarray) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """Bits of the total, first points and widths of the ranks."""
    width = start.astype(np.uint64)
    ends = np.cumsum(width)
    return np.uint64(int(ends[-1]).bit_length() - 1), ends - width, width


def _segments(lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Steps from, to, and the lanes that take them, of lanes in descending order of length."""
    t = 0
    while len(lengths):
        end = int(lengths[-1])
        if end > t:
            yield t, end, len(lengths)
            t = end
        lengths = lengths[:np.searchsorted(-lengths, -end, side="left")]


def _lanes_by_length(lengths: np.ndarray) -> np.ndarray:
    return np.argsort(-lengths, kind="stable")


def code(blocks: list[np.ndarray], start: np.ndarray) -> list[bytes]:
    """Payloads of blocks of ranks (each of at most ``BLOCK``)."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks], np.int64)
    order = _lanes_by_length(lengths)
    steps, lanes = int(lengths.max()), len(blocks)
    down, first, width = _order0(start)
    grid = np.zeros((steps + 2, lanes), np.int32)  # two steps of zeros before the first
    for lane, b in enumerate(order):
        grid[2:2 + lengths[b], lane] = blocks[b]
    stride = steps + 4
    out = np.zeros(lanes * stride, np.uint64)  # 32-bit words, and what is carried into them
    begin = np.arange(lanes) * stride
    to, low, span = begin.copy(), np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    m = _Mixture(lanes)
    for t0, t1, n in _segments(lengths[order]):
        m.narrow(n)
        lo, sp, at_out = low[:n], span[:n], to[:n]
        unit, part, each, more = (np.empty(n, np.uint64) for _ in range(4))
        for c in range(t0, t1, _CHUNK):
            k = min(_CHUNK, t1 - c)
            known = grid[c:c + k + 2, :n].astype(np.int64)
            at = known[1:-1, None, :] * _KEYS
            at[:, 1] += known[:-2] * _OLDER
            at >>= _SHIFT
            at &= _MASK
            at += m.slots
            q, pred, hit = np.empty((k, 2, n), np.int32), np.empty((k, 2, n), np.int32), np.empty((k, 2, n), bool)
            for i in range(k):
                m.at, m.q, m.pred, m.hit = at[i], q[i], pred[i], hit[i]
                m.predict()
                m.update(grid[c + i + 2, :n])
            two, both = _masses(q)
            own = known[2:]
            wides = width.take(pred, mode="clip")
            wide2, wide1 = wides[:, 1], wides[:, 0]
            wide1 *= pred[:, 0] != pred[:, 1]
            by2, by1 = hit[:, 1], hit[:, 0] > hit[:, 1]
            rest = ((1 << _MIX) - both).astype(np.uint64)
            skip, mass = two * by1, (both - two) * by1
            failed = ~(by1 | by2)
            skip += both * failed
            mass += two * by2
            skip, mass = skip.astype(np.uint64), mass.astype(np.uint64)
            inner = first.take(own, mode="clip")
            inner += wide1 * (pred[:, 0] > own)
            inner -= wide2 * (pred[:, 1] < own)
            inner *= failed
            inner += wide2 * ~by2
            wide = width.take(own, mode="clip")
            for i in range(k):
                np.right_shift(sp, _U12, out=unit)
                np.multiply(unit, rest[i], out=each)
                each >>= down
                np.multiply(each, inner[i], out=part)
                np.multiply(unit, skip[i], out=more)
                part += more
                lo += part
                np.multiply(each, wide[i], out=sp)
                unit *= mass[i]
                sp += unit
                over = np.flatnonzero(lo < part)
                if len(over):
                    out[at_out[over] - 1] += np.uint64(1)
                small = np.flatnonzero(sp < _LEAST)
                if len(small):
                    words, places = lo[small], at_out[small]
                    out[places] = words >> _U32
                    lo[small] = words << _U32
                    sp[small] <<= _U32
                    at_out[small] = places + 1
    out[to], out[to + 1] = low >> _U32, low & np.uint64(0xFFFFFFFF)
    while (carried := np.flatnonzero(out > 0xFFFFFFFF)).size:
        out[carried] &= np.uint64(0xFFFFFFFF)
        out[carried - 1] += np.uint64(1)
    result: list[bytes] = [b""] * lanes
    for lane, b in enumerate(order):
        result[b] = out[begin[lane]:to[lane] + 2].astype("<u4").tobytes()
    return result


def decode(payloads: list[bytes], lengths: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """The ranks of every block."""
    if not payloads:
        return []
    order = _lanes_by_length(lengths)
    steps, lanes = int(lengths.max()), len(payloads)
    down, first, width = _order0(start)
    rank_at = np.repeat(np.arange(len(start), dtype=np.int32), start)
    sizes = np.array([len(payloads[b]) // 4 for b in order])
    words = np.zeros(int(sizes.sum()) + 2, np.uint64)
    words[:-2] = np.frombuffer(b"".join(payloads[b][:4 * k] for b, k in zip(order, sizes, strict=True)), "<u4")
    begin = np.cumsum(sizes) - sizes
    value, span, src = (words[begin] << _U32) | words[begin + 1], np.full(lanes, _FULL), begin + 2
    grid = np.zeros((steps, lanes), np.int32)
    m = _Mixture(lanes)
    for t0, t1, n in _segments(lengths[order]):
        m.narrow(n)
        val, sp, at_in = value[:n], span[:n], src[:n]
        unit, each, part, inner = (np.empty(n, np.uint64) for _ in range(4))
        mass, ends, wide, hole, below = (np.empty((2, n), np.uint64) for _ in range(5))
        under, index = np.empty((2, n), bool), part.view(np.int64)
        for t in range(t0, t1):
            m.locate()
            m.predict()
            mass[0], mass[1] = _masses(m.q)
            np.right_shift(sp, _U12, out=unit)
            np.multiply(unit, mass, out=ends)
            np.subtract(np.uint64(1 << _MIX), mass[1], out=each)
            each *= unit
            each >>= down
            width.take(m.pred, out=wide, mode="clip")
            wide[0] *= ~m.same
            np.multiply(wide, each, out=below)
            below[0] += below[1]
            ends[0] += below[1]
            ends[1] += below[0]
            np.subtract(val, ends[1], out=part)
            part //= each
            first.take(m.pred, out=hole, mode="clip")
            hole -= wide[::-1] * np.less(m.pred[::-1], m.pred, out=under)
            wide *= np.less_equal(hole, part, out=under)
            wide[0] += wide[1]
            part += wide[0]
            np.less(val, ends, out=under)
            own = rank_at.take(index, mode="clip")
            first.take(own, out=inner, mode="clip")
            inner -= wide[0]
            inner *= each
            inner += ends[1]
            width.take(own, out=sp, mode="clip")
            sp *= each
            hits = np.flatnonzero(under[1])
            if len(hits):
                two, end = under[0].take(hits), ends[0].take(hits)
                own[hits] = np.where(two, m.pred[1].take(hits), m.pred[0].take(hits))
                sp[hits] = np.where(two, end, ends[1].take(hits) - end)
                end[two] = 0
                inner[hits] = end
            grid[t, :n] = own
            val -= inner
            small = np.flatnonzero(sp < _LEAST)
            if len(small):
                places = at_in[small]
                sp[small] <<= _U32
                val[small] = (val[small] << _U32) | words.take(places, mode="clip")
                at_in[small] = places + 1
            m.update(own)
            np.multiply(m.last, _OLDER, out=m.older)
            m.last[:] = own
    result: list[np.ndarray] = [np.zeros(0, np.int32)] * lanes
    for lane, b in enumerate(order):
        result[b] = grid[:lengths[b], lane]
    return result


def _groups(blocks: int) -> list[range]:
    """The blocks in as few groups of at most ``LANES`` as will do, of equal size."""
    k = -(-blocks // LANES)
    return [range(blocks * i // k, blocks * (i + 1) // k) for i in range(k)]


def _start_row(ranks: np.ndarray) -> np.ndarray:
    """Widths of the ranks in the order-0 part, from their frequencies; a power of two in all."""
    n = np.bincount(ranks)
    if not len(n):
        return np.zeros(0, np.int32)
    total = 1 << min(19, max(12, len(n).bit_length() + 3))
    width = 1 + n * (total - len(n)) // max(1, int(n.sum()))
    width[0] += total - int(width.sum())
    return width.astype(np.int32)


def pack_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file."""
    freq = np.bincount(ids)
    values = np.flatnonzero(freq)
    ranked = values[np.lexsort((values, -freq[values]))]
    if len(ranked) >= _RANKS:
        raise ValueError("too many different ids for one file")
    to_rank = np.zeros(max(1, len(freq)), np.int32)
    to_rank[ranked] = np.arange(len(ranked))
    ranks = to_rank[ids]
    start = _start_row(ranks)
    blocks = [ranks[i:i + BLOCK] for i in range(0, len(ranks), BLOCK)]
    payloads = [p for g in _groups(len(blocks)) for p in code(blocks[g.start:g.stop], start)]
    checks = np.array([zlib.crc32(ids[i:i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)], "<u4")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), counts.astype("<u8").tobytes(), ranked.astype("<u4").tobytes(),
             start.astype("<i4").tobytes(), checks.tobytes(), np.array([len(p) for p in payloads], "<u4").tobytes()]
    head = zlib.compress(b"".join(struct.pack("<Q", len(p)) + p for p in parts))
    return MAGIC + struct.pack("<QII", len(ids), len(head), zlib.crc32(head)) + head + b"".join(payloads)


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of one file; every block is checked."""
    if data[:8] != MAGIC:
        raise ValueError("not an id file")
    n, size, check = struct.unpack_from("<QII", data, 8)
    head = data[24:24 + size]
    if zlib.crc32(head) != check:
        raise ValueError("the head of an id file is damaged")
    head, parts, at = zlib.decompress(head), [], 0
    while at < len(head):
        (k,) = struct.unpack_from("<Q", head, at)
        parts.append(head[at + 8:at + 8 + k])
        at += 8 + k
    doc_ids, known, counts, ranked, start, checks, sizes = (np.frombuffer(p, kind) for p, kind in zip(parts, ("<i8", "u1", "<u8", "<u4", "<i4", "<u4", "<u4"), strict=True))
    ends = 24 + size + np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    payloads = [data[ends[i]:ends[i + 1]] for i in range(len(sizes))]
    lengths = np.minimum(BLOCK, n - BLOCK * np.arange(len(sizes))).astype(np.int64)
    ids = np.zeros(n, np.uint32)
    decoded = (r for g in _groups(len(sizes)) for r in decode(payloads[g.start:g.stop], lengths[g.start:g.stop], start))
    for i, ranks in enumerate(decoded):
        own = ranked[np.minimum(ranks, len(ranked) - 1)]
        if zlib.crc32(own.astype("<u4").tobytes()) != checks[i]:
            raise ValueError(f"block {i} of an id file is damaged")
        ids[i * BLOCK:i * BLOCK + len(own)] = own
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], counts.astype(np.int64), ids


_MANIFEST = "partition int, part int, file string, docs long, ids long, bytes long"


def _writer(folder: str, tokenizer: str, blank_joins: bool, end: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fs, path = column_encoder(tokenizer, blank_joins), *pafs.FileSystem.from_uri(folder)
        held, size, part, rows = [], 0, 0, []  # (doc_ids, counts, ids) of the slices that are not yet in a file

        def flush(partition: int, n: int) -> None:
            nonlocal size, part
            docs, counts, ids = (list(x) for x in zip(*held[:n], strict=True))
            del held[:n]
            docs, counts, ids = [d for own in docs for d in own], np.concatenate(counts), np.concatenate(ids)
            data = pack_file(docs, counts, ids)
            name = f"ids-{partition:06d}-{part:04d}.bin"
            temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as out:
                out.write(data)
            fs.move(temporary, f"{path}/{name}")
            rows.append((partition, part, name, len(docs), len(ids), len(data)))
            size, part = size - len(ids), part + 1

        partition = 0
        for batch in slices(batches, 1, 2048, 4 << 20):  # large: words are looked up once a slice
            partition = batch.column(2)[0].as_py()
            new, n = with_ends(*encode(batch.column(1)), end)
            held.append((batch.column(0).to_pylist(), n, new))
            size += len(new)
            if size >= 2 * file_ids:  # short files cost as many steps as full ones
                flush(partition, int(np.searchsorted(np.cumsum([len(x[2]) for x in held]), file_ids)) + 1)
        if held:
            flush(partition, len(held))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["partition", "part", "file", "docs", "ids", "bytes"])

    return run


def write_ids(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
              blank_joins: bool = False, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, append ``end_id`` and write files under ``folder`` (a
    URI), in ascending order of id; returns the committed manifest."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text").withColumn("p", F.spark_partition_id())
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    rows.mapInArrow(_writer(folder, tokenizer, blank_joins, end_id, file_ids), _MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            docs, counts, ids = unpack_file(data)
            ends = np.cumsum(counts)
            plain = ids.astype("<u4", copy=False)
            for s in range(0, len(docs), 1000):
                own = range(s, min(s + 1000, len(docs)))
                bounds = pa.array(np.concatenate([[0], np.cumsum(counts[s:s + 1000])]).astype(np.int32))
                first = int(ends[s] - counts[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs[i] for i in own], pa.int64()), pa.array(before + ends[s:s + 1000] - counts[s:s + 1000]), pa.array(counts[s:s + 1000]),
                     pa.array([zlib.crc32(plain[ends[i] - counts[i]:ends[i]].tobytes()) for i in own], pa.int64()),
                     pa.ListArray.from_arrays(bounds, pa.array(plain[first:first + int(bounds[-1].as_py())].astype(np.int32)))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document in the files."""
    files = read_manifest(spark, folder).select("file", "ids").orderBy("partition", "part").collect()  # one short row per file
    rows, before = [], 0
    for r in files:
        rows.append((r["file"], before))
        before += r["ids"]
    offsets = spark.createDataFrame(rows, "file string, before long")
    data = (spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))
    return data.join(F.broadcast(offsets), "file").select("content", "before").mapInArrow(
        _reader, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def round_trip(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``df``'s ids to a new folder of the shared store and read them back."""
    folder = qualified(df.sparkSession, new_folder(df.sparkSession, "ids"))
    write_ids(df, folder, tokenizer, **options)
    return read_ids(df.sparkSession, folder)
