"""Alignment of two tokenizers' ids by the bytes they cover.

Byte offsets where a token of A and a token of B both end cut a text into
groups; two tokens are linked when their bytes overlap.

1. Texts are cut at single blanks between characters that are no white space:
   both vocabularies have a token border there, whatever stands around
   (checked for the piece vocabulary when it is read). A stretch met before in
   the task keeps its ids, groups and links; the new stretches of a slice of
   texts are laid end to end and aligned at once.
2. Diagonal run skipping (:func:`group_bounds`): the end offsets of A and B lie
   in two arrays. While token i of A ends where token i + shift of B does, the
   two go one to one; probes of doubling length compare whole pieces of the
   arrays at the current shift and jump such a stretch. Where they differ, the
   tokens of the irregular group are walked until two ends agree; the shift is
   then the new difference of the two places.
3. The texts of a slice are kept as numbers of its distinct stretches, in one
   row per slice, with the distinct id pairs of the slice and the number of
   its documents that hold each. Only these rows are counted corpus-wide, so a
   pair that every document holds costs a row per slice.
4. The counts come back to the slices; every document sums the links of its
   stretches.

Definitions. A null or empty text, and one whose tokens of A or B do not join
to a blank and the text, has no tokens: zeros, and '' for the groups. Texts of
any length count whole; repeated rows are documents of their own. Strings of
special tokens inside a text are plain text. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored, texts_of
from ledgerlens.llm.tokens import ByteEncoder

MARK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"^ | $| \s|\s ")
#: Stretches kept by a task (in number and in bytes of their groups), and the
#: longest one that is kept.
_KEPT = 250_000
_KEPT_BYTES = 32_000_000
_KEPT_CHARS = 64
#: A slice of texts ends with the text that reaches either.
SLICE_TEXTS = 400
SLICE_CHARS = 1_500_000


def group_bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the ends of A's and B's tokens (rising, with the same last end): how
    many tokens of A, and of B, lie up to the end of each group."""
    out_a: list[np.ndarray] = []
    out_b: list[np.ndarray] = []
    single_a: list[int] = []
    single_b: list[int] = []
    ends_a, ends_b = a.tolist(), b.tolist()
    i, j, n, m = 0, 0, len(ends_a), len(ends_b)
    while i < n and j < m:
        if ends_a[i] == ends_b[j]:
            # one to one at shift j - i: probe 1, 2, 4, ... further tokens
            run, probe = 1, 1
            while True:
                k = min(probe, n - i - run, m - j - run)
                if not k:
                    break
                if k <= 8:
                    same = 0
                    while same < k and ends_a[i + run + same] == ends_b[j + run + same]:
                        same += 1
                else:
                    differ = np.flatnonzero(a[i + run:i + run + k] != b[j + run:j + run + k])
                    same = int(differ[0]) if len(differ) else k
                run += same
                if same < k:
                    break
                probe *= 2
            if run > 8:
                out_a += [np.array(single_a, np.int64), np.arange(i + 1, i + run + 1)]
                out_b += [np.array(single_b, np.int64), np.arange(j + 1, j + run + 1)]
                single_a, single_b = [], []
            else:
                single_a.extend(range(i + 1, i + run + 1))
                single_b.extend(range(j + 1, j + run + 1))
            i, j = i + run, j + run
            continue
        # irregular: walk whichever ends first until both end together
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        i, j = i + 1, j + 1
        single_a.append(i)
        single_b.append(j)
    return (np.concatenate([*out_a, np.array(single_a, np.int64)]), np.concatenate([*out_b, np.array(single_b, np.int64)]))


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (in A, in B) of all tokens that share a byte; ends as above."""
    first = np.searchsorted(b, np.concatenate([[0], a[:-1]]), side="right")
    last = np.searchsorted(b, a, side="left")
    n = last - first + 1
    begin = np.cumsum(n) - n
    at = np.repeat(np.arange(len(a)), n)
    return at, first[at] + np.arange(len(at)) - begin[at]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Numbers(dict):
    """Stretch -> its number; a new one gets the next number and waits."""

    def __init__(self) -> None:
        super().__init__()
        self.next, self.new, self.once = 0, [], []

    def __missing__(self, stretch: str) -> int:
        at = self[stretch] = self.next
        self.next += 1
        self.new.append(stretch)
        if len(stretch) > _KEPT_CHARS:
            self.once.append(stretch)
        return at


class Aligner:
    """Ids, groups and links of stretches of text."""

    def __init__(self, byte_file: str, piece_file: str):
        self.a = ByteEncoder(byte_file)
        self.a_size = np.array([len(t) for t in self.a.token_bytes], np.int64)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.n_b = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.n_b))]
        if any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.n_b)):
            raise ValueError("a piece of this model crosses words")
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        # what a token adds to the text of its group: followed by another of its
        # side, or the last of A, or the last of B
        n_a = len(self.a_size)
        self.texts = ([f"{i}," for i in range(n_a)] + [f"{i}|" for i in range(n_a)]
                      + [f"{i}," for i in range(self.n_b)] + [f"{i};" for i in range(self.n_b)])
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.bytes = 0
        self.groups: list[bytes | None] = []  # every group followed by ";"
        self.sizes: list[np.ndarray] = [np.zeros((0, 4), np.int64)]  # n_a, n_b, n_groups, n_links
        self.pairs: list[np.ndarray] = []

    def _ids_a(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of every new stretch with a blank before it. Those without
        white space at their ends are encoded in one text and cut where a
        stretch ends."""
        plain = [s for s in new if s and not s[0].isspace() and not s[-1].isspace()]
        ids, _ = self.a.encode_all(["".join([" " + s for s in plain])])
        ends = np.cumsum(self.a_size[ids])
        own = np.cumsum(np.fromiter((len(s.encode()) + 1 for s in plain), np.int64, len(plain)))
        upto = np.searchsorted(ends, own, side="right")
        if len(plain) == len(new):
            return ids, np.diff(upto, prepend=0)
        rest = [s for s in new if not s or s[0].isspace() or s[-1].isspace()]
        other, counts = self.a.encode_all([" " + s for s in rest])
        pieces, others = iter(np.split(ids, upto[:-1])), iter(np.split(other, np.cumsum(counts)[:-1]))
        each = [next(pieces) if s and not s[0].isspace() and not s[-1].isspace() else next(others) for s in new]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def _texts(self, ids_a: np.ndarray, ids_b: np.ndarray, up_a: np.ndarray, up_b: np.ndarray) -> list[str]:
        """The texts of all tokens, group by group, A before B."""
        n_a = len(self.a_size)
        before_a, before_b = np.diff(up_a, prepend=0), np.diff(up_b, prepend=0)
        code_a, code_b = ids_a.astype(np.int64), ids_b + 2 * n_a
        code_a[up_a - 1] += n_a
        code_b[up_b - 1] += self.n_b
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + np.repeat(up_b - before_b, before_a)] = code_a
        out[np.arange(len(ids_b)) + np.repeat(up_a, before_b)] = code_b
        return list(map(self.texts.__getitem__, out.tolist()))

    def _learn(self, new: list[str]) -> None:
        """Align new stretches, all end to end."""
        ids_a, n_a = self._ids_a(new)
        lists = self.b.encode(new, num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        ids_b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
        raw = [b" " + s.encode() for s in new]
        at_a, at_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        joined_b = map(self.b_bytes.__getitem__, ids_b.tolist())
        joined_a = map(self.a.token_bytes.__getitem__, ids_a.tolist())
        good = np.ones(len(new), bool)
        if b"".join(raw) != (all_b := b"".join(joined_b)) or all_b != b"".join(joined_a):
            for k, r in enumerate(raw):
                good[k] = (r == b"".join(self.b_bytes[x] for x in lists[k])
                           and r == b"".join(self.a.token_bytes[x] for x in ids_a[at_a[k]:at_a[k + 1]].tolist()))
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
            at_a, at_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        up_a, up_b = group_bounds(ends_a, ends_b)
        in_a, in_b = overlaps(ends_a, ends_b) if len(ends_a) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        codes = (ids_a[in_a].astype(np.int64) * self.n_b + ids_b[in_b]).astype(np.int64)
        # ends of stretches are ends of groups
        at_group = np.searchsorted(up_a, at_a, side="right")
        at_group[0] = 0
        at_link = np.searchsorted(in_a, at_a, side="left")
        texts = self._texts(ids_a, ids_b, up_a, up_b)
        first = at_a + at_b
        edges, links = first.tolist(), at_link.tolist()
        for k, ok in enumerate(good.tolist()):
            self.groups.append("".join(texts[edges[k]:edges[k + 1]]).encode() if ok else None)
            self.pairs.append(codes[links[k]:links[k + 1]])
        self.bytes += sum(len(x) for x in self.groups[-len(new):] if x)
        self.sizes.append(np.stack([n_a, n_b, np.diff(at_group), np.diff(at_link)], axis=1))

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """Every text as the numbers of its stretches; an empty text has none."""
        if len(self.groups) > _KEPT or self.bytes > _KEPT_BYTES:
            self._clear()
        known = self.known
        number = known.__getitem__
        rows = [list(map(number, _CUT.split(t) if _ODD.search(t) else t.split(" "))) if t else [] for t in texts]
        if known.new:
            self._learn(known.new)
            for s in known.once:
                del known[s]
            known.new, known.once = [], []
        return rows


_SLICE = ("part int, slice int, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
          "sha array<string>, n_stretches binary, stretches binary, n_pairs binary, pair_at binary, pair array<bigint>, docs array<int>")
_NAMES = [c.split(" ")[0] for c in _SLICE.split(", ")]


def _slice(aligner: Aligner, ids: list, texts: list[str]) -> dict:
    """One slice of documents as a row; see the module."""
    rows = aligner.numbers(texts)
    tables, groups = np.concatenate(aligner.sizes), aligner.groups
    aligner.sizes = [tables]
    sha, whole = [], []
    for row in rows:
        parts = [groups[k] for k in row]
        ok = bool(parts) and None not in parts
        whole.append(row if ok else [])
        sha.append(hashlib.sha256(b"".join(parts)[:-1]).hexdigest() if ok else "")
    lengths = np.fromiter(map(len, whole), np.int64, len(whole))
    flat = np.fromiter(chain.from_iterable(whole), np.int64, int(lengths.sum()))
    used, at = np.unique(flat, return_inverse=True)
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(tables[flat], axis=0)])
    edges = np.concatenate([[0], np.cumsum(lengths)])
    n_a, n_b, n_groups, n_links = (sums[edges[1:]] - sums[edges[:-1]]).T
    # the distinct pairs of the slice, of its stretches, and its documents that hold each
    per = tables[used, 3]
    pair, pair_at = np.unique(np.concatenate([aligner.pairs[k] for k in used.tolist()]) if len(used) else np.zeros(0, np.int64), return_inverse=True)
    doc = np.repeat(np.arange(len(whole)), lengths)
    seen = np.unique(doc * (len(used) or 1) + at)  # distinct (document, stretch)
    stretch = seen % (len(used) or 1)
    held = np.repeat(seen // (len(used) or 1), per[stretch]) * (len(pair) or 1) + pair_at[_spans((np.cumsum(per) - per)[stretch], per[stretch])]
    docs = np.bincount(np.unique(held) % (len(pair) or 1), minlength=len(pair))
    return dict(zip(_NAMES[2:], (ids, n_a, n_b, n_groups, n_links, sha, *map(_packed, (lengths, at, per, pair_at)), pair, docs), strict=True))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest wants; the first byte says how many."""
    width = next(w for w in (1, 2, 4) if not len(values) or values.max() < 256**w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _sliced(byte_file: str, piece_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, number = Aligner(byte_file, piece_file), TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[str] = []
        chars = 0

        def row() -> pa.RecordBatch:
            nonlocal number, chars
            made = _slice(aligner, list(ids), texts) | {"part": part, "slice": number}
            number, chars = number + 1, 0
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([_list(made[c], kind) if kind.startswith("array") else pa.array([made[c]], pa.int32() if kind == "int" else pa.binary())
                                               for c, kind in (x.split(" ") for x in _SLICE.split(", "))], _NAMES)

        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                some = batch.slice(s, 256)
                for i, t in zip(some.column(0).to_pylist(), texts_of(some.column(1)), strict=True):
                    ids.append(i)
                    texts.append(t)
                    chars += len(t)
                    if len(ids) == SLICE_TEXTS or chars >= SLICE_CHARS:
                        yield row()
        if ids:
            yield row()

    return run


def _list(values, kind: str) -> pa.Array:
    """A one-row list column."""
    of = {"array<bigint>": pa.int64(), "array<int>": pa.int32(), "array<string>": pa.string()}[kind]
    flat = pa.array(values, of) if isinstance(values, list) else pa.array(np.asarray(values).astype(of.to_pandas_dtype()))
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with the counts of their pairs (by place) -> documents."""
    for batch in batches:
        c = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i in range(batch.num_rows):
            ids = c["doc_id"].slice(i, 1).flatten()
            pair_at, per, at, lengths = (_unpacked(c[x][i].as_py()) for x in ("pair_at", "n_pairs", "stretches", "n_stretches"))
            n = int(pair_at.max()) + 1 if len(pair_at) else 0
            count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            found = c["counted"].slice(i, 1).flatten()
            if len(found):
                place = np.asarray(found.field("at"))
                count[place], best[place] = np.asarray(found.field("n")), np.asarray(found.field("best"))
            edges_p, edges_d = np.concatenate([[0], np.cumsum(per)]), np.concatenate([[0], np.cumsum(lengths)])

            def sums(x: np.ndarray) -> np.ndarray:
                of_stretch = np.diff(np.concatenate([[0], np.cumsum(x[pair_at])])[edges_p])  # noqa: B023
                return np.diff(np.concatenate([[0], np.cumsum(of_stretch[at])])[edges_d])  # noqa: B023

            out = [ids, *(c[x].slice(i, 1).flatten() for x in ("n_a", "n_b", "n_groups", "n_links")),
                   pa.array(sums(best)), pa.array(sums(count)), c["sha"].slice(i, 1).flatten()]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, byte_file: str, piece_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links
    whose pair is held by as many documents as any pair of that A id),
    count_sum (documents that hold the pair, over the links), groups_sha256
    (of ``a1,a2|b1;a3|b2,b3``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slices = stored(rows.mapInArrow(_sliced(byte_file, piece_file), _SLICE), "align-slices")
    n_b = sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
    held = slices.select("part", "slice", F.posexplode(F.arrays_zip("pair", "docs")).alias("at", "x")).select("part", "slice", "at", "x.pair", "x.docs")
    counts = stored(held.groupBy("pair").agg(F.sum("docs").alias("n")), "align-counts")
    a_id = F.floor(F.col("pair") / n_b).cast("int").alias("a_id")
    highest = counts.groupBy(a_id).agg(F.max("n").alias("top"))
    ranked = counts.withColumn("a_id", a_id).join(highest, "a_id").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    back = (held.select("part", "slice", "at", "pair").join(ranked, "pair")
            .groupBy("part", "slice").agg(F.collect_list(F.struct("at", "n", "best")).alias("counted")))
    joined = slices.drop("docs", "pair").join(back, ["part", "slice"], "left").withColumn(
        "counted", F.coalesce("counted", F.array().cast("array<struct<at:int,n:bigint,best:bigint>>")))
    return joined.mapInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
