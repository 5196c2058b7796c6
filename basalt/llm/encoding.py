"""Token ids of whole texts with a public tokenizer file; each piece of a text is encoded by the library once and remembered.

Both tokenizers cut a text into pieces before they merge inside each. This module cuts
only where they always do: before a white-space sign, and between a letter or digit
and an ASCII sign. A text in which that isn't certain (two white-space signs in a row, other
white space than blanks and line ends, special tokens; where letters are folded, combining marks and U+0130, whose small form is two signs)
goes to the library whole. A remembered piece counts as found only if its bytes are the same, not just its hash.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from basalt.llm.words import Spans, flat, lower, per_row, runs, same_bytes

#: Pieces that a Python worker remembers, beyond which it starts anew, and pieces compared at once.
REMEMBERED, PIECES = 700_000, 100_000
_BYTES = np.arange(256)
_SPACE, _LINE, _OTHER_SPACE = _BYTES == 32, _BYTES == 10, np.isin(_BYTES, [9, 11, 12, 13, 28, 29, 30, 31])
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) != "'" for b in range(256)])
_known: dict[str, Encoder] = {}


class Encoder:
    """encode(column): the ids of each text as an array of unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.folds = "Lowercase" in str(self.library.normalizer)
        #: What stands for a blank before a word in the model's alphabet ("" where blanks are dropped).
        self.blank = self.library.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]
        self._forget()

    @staticmethod
    def of(path: str) -> Encoder:
        """One for each path in a Python worker."""
        if path not in _known:
            _known[path] = Encoder(path)
        return _known[path]

    def _forget(self) -> None:
        #: By hash: the piece's number. By number: where its ids and its bytes are.
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.from_ = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.size, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bytes, self.held = np.zeros(1 << 18, np.uint8), 0

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _piece(self, piece: str) -> list[int]:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isascii() and word.isalpha():
            return [t.id for t in self.library.model.tokenize((self.blank if word is not piece else "") + (word.lower() if self.folds else word))]
        if self.library.normalizer:
            piece = self.library.normalizer.normalize_str(piece)
        tokenize = self.library.model.tokenize
        return [t.id for part, _ in self.library.pre_tokenizer.pre_tokenize_str(piece) for t in tokenize(part)]

    @staticmethod
    def _append(store: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
        if used + len(new) > len(store):
            store = np.concatenate([store[:used], np.zeros(2 * len(store) + len(new), store.dtype)])
        store[used : used + len(new)] = new
        return store

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """data: with letters folded where the tokenizer folds them, so equal bytes have equal ids."""
        got = [self._piece(data[s:e].tobytes().decode("utf-8", "replace")) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        size, length = np.array([len(x) for x in got], np.int64), end - start
        self.ids = self._append(self.ids, self.used, np.array([i for x in got for i in x], np.uint32))
        self.bytes = self._append(self.bytes, self.held, data[runs(start, length)])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.number = np.insert(self.keys, where, keys), np.insert(self.number, where, len(self.at) + np.arange(len(keys)))
        self.at, self.from_ = np.append(self.at, self.used + np.cumsum(size) - size), np.append(self.from_, self.held + np.cumsum(length) - length)
        self.size, self.length = np.append(self.size, size.astype(np.int32)), np.append(self.length, length.astype(np.int32))
        self.used, self.held = self.used + int(size.sum()), self.held + int(length.sum())

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        data, first = flat(column)
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(column)
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        space, line, sign = _SPACE[data], _LINE[data], _SIGN[data]
        # Latin letters beyond ASCII take two bytes in UTF-8, U+00C0 to U+024F but for the two signs among them.
        lead = (data >= 0xC3) & (data <= 0xC9)
        lead[:-1] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        letter = _ALNUM[data] | lead
        letter[1:] |= lead[:-1]
        white = space | line
        odd = _OTHER_SPACE[data]
        if self.folds:
            # A mark may join a small letter and not the capital.
            odd |= (data == 0xCC) | (data == 0xCD)
            odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        odd[1:] |= (white[1:] & white[:-1] | (data[:-1] == 60) & (data[1:] == 124)) & ~edge[1:-1]
        cut = edge[:-1] | white
        cut[1:] |= line[:-1] & (letter[1:] | sign[1:]) | letter[:-1] & sign[1:] | sign[:-1] & letter[1:]
        plain = per_row(odd, first) == 0
        counts = per_row(cut, first)
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        raw, data = data, lower(data) if self.folds else data
        keys = Spans(data).spans(start, end)
        unique, one, place = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > REMEMBERED:
            self._forget()
        found = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        missing = self.keys[found] != unique if len(self.keys) else np.ones(len(unique), bool)
        if missing.any():
            which = one[missing]
            self._learn(unique[missing], data, start[which], end[which])
        slot = self.number[np.searchsorted(self.keys, unique)][place]
        length = end - start
        alike = self.length[slot] == length
        for i in range(0, len(start), PIECES):
            part = np.flatnonzero(alike[i : i + PIECES]) + i
            alike[part] = same_bytes(data, start[part], self.bytes, self.from_[slot[part]], length[part])
        plain[np.repeat(np.arange(len(counts)), counts)[~alike]] = False
        size = self.size[slot].astype(np.int64)
        stop = np.cumsum(size)
        ids = self.ids[runs(self.at[slot], size)]
        bounds = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero(~plain):
            out[i] = self.whole(raw[first[i] : first[i + 1]].tobytes().decode("utf-8", "replace"))
        return out
