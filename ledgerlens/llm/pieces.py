"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is escaped (blanks become U+2581, one is put before) and cut into words
before every run of that mark; no piece of the model has it behind another
character, so no merge crosses a cut (checked when the model is read). The
words of a batch that are new are laid out as one flat array of symbols. In
every round each word finds the best-ranked pair of neighbours it has and
merges that pair wherever it stands, from the left, all words at once; the array
is then compacted. Words without a pair leave; the rounds end when none is left.

Merging all places of a pair at once equals the library's order, one best pair
at a time, unless a merge makes a better pair that takes a symbol of a later
place. Pairs for which the vocabulary allows that are found when the model is
read; of those only the leftmost place is merged in a round.

Symbols that are no piece become their bytes. Decoding joins the pieces' bytes
and drops the blank put before. Definitions: null text is empty: begin and end
ids only, decoded to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import texts_of

MARK = "▁"
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")
_WORDS_KEPT = 250_000
_NONE = np.int64(2**62)


class PieceEncoder:
    """Encodes texts exactly as the model's own library does (no sampling)."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece of this model crosses words")
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # merges: (left, right) -> piece; best score first, the library's order
        score = {i: sp.get_score(i) for i in plain}
        self.rank = np.full(n + 1, _NONE)
        for r, i in enumerate(sorted(plain, key=lambda i: (-score[i], i))):
            self.rank[i] = r
        pairs = {}
        for p, i in self.pieces.items():
            for k in range(1, len(p)):
                if p[:k] in self.pieces and p[k:] in self.pieces:
                    pairs[self.pieces[p[:k]] * (n + 1) + self.pieces[p[k:]]] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.single = self._taking(pairs, n)
        self.n = n
        self.bytes_of = [b""] * n
        for p, i in self.pieces.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([b])
        self._forget()

    def _taking(self, pairs: dict[int, int], n: int) -> np.ndarray:
        """Per piece: may merging it at one place make better pairs that take a
        symbol of a later place? True if a better-ranked piece holds it and,
        behind it, the first part of one of its splits."""
        parts: dict[int, set[str]] = {}
        text = {i: p for p, i in self.pieces.items()}
        for key, i in pairs.items():
            parts.setdefault(i, set()).add(text[key // (n + 1)])
        out = np.zeros(n + 1, bool)
        for longer, i in self.pieces.items():
            for a in range(len(longer)):
                for b in range(a + 2, len(longer)):
                    inner = self.pieces.get(longer[a:b])
                    if inner is not None and self.rank[inner] > self.rank[i] and any(x in longer[b:] for x in parts.get(inner, ())):
                        out[inner] = True
        return out

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.raw: list[bytes] = []

    def _merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words (escaped, uncut)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = "".join(words)
        symbol_of = {c: self.pieces.get(c, -1) for c in set(chars)}
        unknown: dict[str, int] = {}
        for c, s in symbol_of.items():  # symbols that are no piece: numbers from n + 1 on
            if s < 0:
                symbol_of[c] = self.n + 1 + len(unknown)
                unknown[c] = symbol_of[c]
        symbols = np.fromiter(map(symbol_of.__getitem__, chars), np.int64, len(chars))
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            left, right = symbols[:-1], symbols[1:]
            known = (left < self.n) & (right < self.n) & (word[:-1] == word[1:])
            key = np.where(known, left * (self.n + 1) + right, -1)
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            found = known & (self.pair_keys[at] == key)
            made = np.where(found, self.pair_ids[at], self.n)
            rank = np.append(self.rank[made], _NONE)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            over = np.repeat(best == _NONE, sizes)
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                symbols, word, rank = symbols[~over], word[~over], rank[~over]
                made = np.append(made, self.n)[~over]
                best, sizes = best[best != _NONE], sizes[best != _NONE]
                if not len(symbols):
                    break
            else:
                made = np.append(made, self.n)
            hit = rank == np.repeat(best, sizes)
            hit = self._leftmost(hit, made, sizes)
            symbols = np.where(hit, made, symbols)
            stay = np.concatenate([[True], ~hit[:-1]])
            symbols, word = symbols[stay], word[stay]
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        word = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
        strange = symbols > self.n
        if strange.any():
            names = {v: c for c, v in unknown.items()}
            filled = [self.byte_ids[list(names[s].encode())] if x else np.array([s]) for s, x in zip(symbols.tolist(), strange.tolist(), strict=True)]
            word = np.repeat(word, [len(f) for f in filled])
            symbols = np.concatenate(filled)
        return np.split(symbols, np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def _leftmost(self, hit: np.ndarray, made: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of places that overlap (runs such as a a a) every second, from the
        left; of pairs that must go one at a time the first per word."""
        at = np.flatnonzero(hit)
        new_run = np.concatenate([[True], np.diff(at) > 1]) if len(at) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        owner = np.repeat(np.arange(len(sizes)), sizes)[at]
        first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(at) else np.zeros(0, bool)
        at = at[first | ~self.single[made[at]]]
        out = np.zeros(len(hit), bool)
        out[at] = True
        return out

    def encode_all(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """Ids with begin and end, and the decoded bytes, of every text."""
        if len(self.known) > _WORDS_KEPT:
            self._forget()
        known, new, rows = self.known, [], []
        for t in texts:
            if not t:
                rows.append([])
                continue
            row = []
            for w in self._cut(MARK + t.replace(" ", MARK)):
                k = known.get(w)
                if k is None:
                    k = known[w] = len(self.ids) + len(new)
                    new.append(w)
                row.append(k)
            rows.append(row)
        if new:
            for ids in self._merge(new):
                self.ids.append(ids)
                self.raw.append(b"".join(map(self.bytes_of.__getitem__, ids.tolist())))
        begin, end = np.array([self.begin]), np.array([self.end])
        out, decoded = [], []
        for row in rows:
            out.append(np.concatenate([begin, *map(self.ids.__getitem__, row), end]))
            decoded.append(b"".join(map(self.raw.__getitem__, row))[1:])
        return out, decoded

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Words: each a run of marks with what follows up to the next mark."""
        if MARK + MARK in text:
            return _CUT.split(text)
        return [MARK + w for w in text.split(MARK)[1:]]


def _run(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model_file)
        for batch in batches:
            texts = texts_of(batch.column(1))
            n, ids_hash, text_hash = [], [], []
            for s in range(0, len(texts), 512):
                ids, decoded = encoder.encode_all(texts[s:s + 512])
                n += [len(x) for x in ids]
                ids_hash += [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
                text_hash += [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in decoded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and digests of the ids and of the decoded text."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run(model_file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
