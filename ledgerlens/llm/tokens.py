"""Token ids of whole texts by public tokenizer files.

``WordEncoder`` makes one library call per new word. Both tokenizer files used
here split a text at white space before any merge, so a text whose single
blanks stand between other characters can be encoded word by word, and a word
met before need not be encoded again. Texts with runs of blanks, or blanks
beside other white space or at an end, go to the library whole.
``LetterEncoder`` does the same for whole Arrow columns and vocabularies with
word ends, cuts finer, and makes one call for many new words. ``ByteEncoder`` reads a byte-level file as a table of ranks. The ids are
the tokenizers library's either way (tested on arbitrary text).
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from ledgerlens.llm.common import texts_of

_IRREGULAR = re.compile(r"^ | $| \s|\s ")
_WORDS_KEPT = 250_000


class _Index(dict):
    """Word -> row of the store; unknown words get the next row and wait."""

    def __init__(self, owner: WordEncoder, prefix: str):
        super().__init__()
        self.owner, self.prefix = owner, prefix

    def __missing__(self, word: str) -> int:
        at = self[word] = self.owner.rows + len(self.owner.waiting)
        self.owner.waiting.append(self.prefix + word)
        return at


class WordEncoder:
    """``encode_all(texts)`` gives the ids of every text as one flat array.

    ``blank_joins`` says whether a blank belongs to the word after it
    (byte-level vocabularies) or vanishes (vocabularies with word ends). The
    strings of special tokens in a text become their ids, as the library does
    unless told otherwise.
    """

    def __init__(self, path: str, blank_joins: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = special_marks(self.tokenizer)
        self.blank_joins = blank_joins
        self._forget()

    def _forget(self) -> None:
        self.rows, self.waiting = 0, []
        self.first = _Index(self, "")
        self.later = _Index(self, " ") if self.blank_joins else self.first
        self.starts, self.lengths, self.flat, self.filled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        ids = self._ids(self.waiting)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter((x for row in ids for x in row), np.uint32, int(lengths.sum()))
        if self.filled + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.filled], np.zeros(max(len(new), len(self.flat)) + 1024, np.uint32)])
        self.flat[self.filled:self.filled + len(new)] = new
        self.starts = np.concatenate([self.starts, self.filled + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.filled += len(new)
        self.rows += len(ids)
        self.waiting = []

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and each text's number of ids."""
        if self.rows > _WORDS_KEPT:
            self._forget()
        rows, words, whole = [], np.zeros(len(texts), np.int64), []
        first, later = self.first, self.later
        for i, t in enumerate(texts):
            if not t:
                continue
            if _IRREGULAR.search(t) or any(s in t for s in self.special):
                whole.append(i)
                continue
            parts = t.split(" ")
            words[i] = len(parts)
            rows.append(np.array([first[parts[0]]], np.int64))
            if len(parts) > 1:
                rows.append(np.fromiter(map(later.__getitem__, parts[1:]), np.int64, len(parts) - 1))
        if self.waiting:
            self._learn()
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        n = self.lengths[at]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
        counts = np.diff(bounds)
        if whole:
            pieces = dict(zip(whole, self._ids([texts[i] for i in whole]), strict=True))
            parts = [np.array(pieces[i], np.uint32) if i in pieces else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
            counts = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, counts


#: How vocabularies with word ends normalise and cut a text before merging.
LETTER_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
LETTER_CUTS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_WORD_END = "</w>"
#: Between a Latin letter and an ASCII sign that is no apostrophe such a file
#: cuts anyway. (Other letters may become a letter and a mark, and a mark is a sign.)
_LETTER_THEN_SIGN = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-&(-/:-@\[-`{-~])"
#: Words that stay as they are: small letters, none of them a letter and a mark.
_SMALL_LATIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
_WORDS_A_CALL = 500
_LETTER_WORDS_KEPT = 500_000


class _Rows(dict):
    """Word -> row of the store. Unknown words get the next row and wait; ASCII
    words in capitals share the row of their small letters."""

    def __init__(self):
        super().__init__({"": 0})
        self.rows, self.waiting = 1, []

    def __missing__(self, word: str) -> int:
        if word.isascii() and (small := word.lower()) != word:
            at = self[small]
        else:
            at = self.rows
            self.rows += 1
            self.waiting.append(word)
        self[word] = at
        return at


class LetterEncoder:
    """``encode_column(texts)`` gives the ids of every text of an Arrow column
    as one flat array, for a tokenizers file that folds case and white space,
    cuts between letters, digits and signs and marks word ends. Texts with the
    strings of special tokens go to the library whole."""

    def __init__(self, path: str):
        if not letter_file(path):
            raise ValueError("not a vocabulary of letters with word ends")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.special = self.tokenizer.model, special_marks(self.tokenizer)
        byte = {b: c for c, b in _byte_alphabet().items()}
        self.as_bytes = {c: "".join(byte[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith(_WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.index = _Rows()
        self.starts, self.lengths, self.flat, self.filled = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32), 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self) -> None:
        words, parts, lengths, order = self.index.waiting, [], np.zeros(len(self.index.waiting), np.int64), []
        letters, others, alone, tokenize = [], [], [], self.model.tokenize
        for j, w in enumerate(words):
            (letters if _SMALL_LATIN(w) else alone if w.isalpha() else others).append(j)
        if letters:  # nothing to normalise or to cut: bytes and merges alone
            plain = (w if w.isascii() else w.translate(self.as_bytes) for w in map(words.__getitem__, letters))
            found = [[t.id for t in tokenize(w)] for w in plain]
            lengths[letters] = np.fromiter(map(len, found), np.int64, len(found))
            parts.append(np.fromiter(chain.from_iterable(found), np.uint32))
            order += letters
        for i in range(0, len(alone), _WORDS_A_CALL):
            own = alone[i:i + _WORDS_A_CALL]
            ids = np.array(self._ids(" ".join([words[j] for j in own])), np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(own) and ends[-1] == len(ids):  # every word is one run of letters
                lengths[own] = np.diff(ends, prepend=0)
                parts.append(ids)
                order += own
            else:
                others += own
        for j in others:
            ids = self._ids(words[j])
            lengths[j] = len(ids)
            parts.append(np.array(ids, np.uint32))
        order += others
        new = np.concatenate(parts)
        if self.filled + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.filled], np.zeros(max(len(new), len(self.flat)) + 1024, np.uint32)])
        self.flat[self.filled:self.filled + len(new)] = new
        starts = np.zeros(len(words), np.int64)
        starts[order] = self.filled + np.cumsum(lengths[order]) - lengths[order]
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.filled += len(new)
        self.index.waiting = []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and each text's number of ids; null is empty."""
        if self.index.rows > _LETTER_WORDS_KEPT:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = np.zeros(len(texts), bool)
        for mark in self.special:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        whole = {int(i): np.array(self._ids(texts[i].as_py()), np.uint32) for i in np.flatnonzero(marked)}
        plain = pc.if_else(pa.array(marked), "", texts) if whole else texts
        for blank in "\n\t\r":
            plain = pc.replace_substring(plain, blank, " ")
        plain = pc.replace_substring_regex(plain, _LETTER_THEN_SIGN, r"\1 \2")
        split = pc.split_pattern(plain, " ")
        coded = split.flatten().dictionary_encode()
        rows = np.fromiter(map(self.index.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(coded.dictionary))
        if self.index.waiting:
            self._learn()
        at = rows[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)]
        if not whole:
            return ids, np.diff(bounds)
        parts = [whole[i] if i in whole else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def letter_file(path: str) -> bool:
    """Whether a tokenizers file is one that ``LetterEncoder`` can read: every
    byte is known within a word and at its end, so that no character is lost."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, byte = spec["model"], _byte_alphabet()
    return (spec["normalizer"] == LETTER_NORMALIZER and spec["pre_tokenizer"] == LETTER_CUTS and model.get("end_of_word_suffix") == _WORD_END
            and all(not t.get("lstrip") and not t.get("rstrip") for t in spec["added_tokens"])
            and all(c in model["vocab"] and c + _WORD_END in model["vocab"] for c in byte))


@functools.lru_cache(2)
def column_encoder(path: str, blank_joins: bool) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """``encode_column`` for a tokenizers file; a worker's tasks share one and its words."""
    if not blank_joins and letter_file(path):
        return LetterEncoder(path).encode_column
    encoder = WordEncoder(path, blank_joins)
    return lambda column: encoder.encode_all(texts_of(column))


def special_marks(tokenizer: Tokenizer) -> set[str]:
    """How the special tokens' strings begin; texts without these hold none."""
    return {t.content[:2] for t in tokenizer.get_added_tokens_decoder().values()}


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with id ``end`` after every text."""
    ends = np.cumsum(counts + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    out[ends - 1] = end
    return out, counts + 1


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: bytes that print stand
    for themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Fixed value: how byte-level vocabularies of this family cut a text before merging.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class ByteEncoder:
    """``encode_all`` like ``WordEncoder``'s, for a byte-level tokenizers file
    whose ids follow the order of its merges: such a file is a table of ranks,
    which tiktoken encodes several times faster, to the same ids. The strings
    of special tokens in a text are plain text, or, with ``special``, become
    their ids (those texts go to the library)."""

    def __init__(self, path: str, special: bool = False):
        self.library = Tokenizer.from_file(path) if special else None
        self.special = special_marks(self.library) if special else set()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], _byte_alphabet()
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level tokenizer")
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.token_bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.token_bytes[i] = token
        last = -1
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            i = model["vocab"][left + right]
            if i <= last:
                raise ValueError("the ids of this file do not follow its merges")
            last = i
        self.encoding = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]
        for i in [i for i, t in enumerate(texts) if any(s in t for s in self.special)]:
            parts[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)), counts
