"""Words of whole Arrow text columns as numpy arrays: positions and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Two primes below 2**31 and a base for each. No sums modulo a power of two: there texts of two signs collide for every base.
_PRIMES = (2_147_483_629, 2_147_483_587)
_BASES = (1_180_591_620, 1_917_512_473)
#: Bytes of a span that is hashed in one piece.
STRETCH = 1 << 24
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits and all non-ASCII bytes belong to a term; the rest parts terms.
NOT_ALNUM = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The first n powers, a power of two, of each base and of its inverse."""
    out = []
    for prime, base in zip(_PRIMES, _BASES, strict=True):
        pair = []
        for b in (base, pow(base, -1, prime)):
            table, step = np.ones(1, np.uint32), b
            while len(table) < n:
                table = np.concatenate([table, (table * np.uint64(step) % np.uint64(prime)).astype(np.uint32)])
                step = step * step % prime
            pair.append(table)
        out.append((pair[0], pair[1]))
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit hash over all its bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows on end, and where each row begins (and the last one ends); null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for size[i] places, one run after the other."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of equal sizes hold the same bytes."""
    unlike = a[runs(a_start, size)] != b[runs(b_start, size)]
    total = np.zeros(len(unlike) + 1, np.int64)
    np.cumsum(unlike, out=total[1:])
    stop = np.cumsum(size)
    return total[stop] == total[stop - size]


class Spans:
    """Hashes of any byte spans of data: equal bytes, equal hash. Unequal bytes rarely meet, and callers that must be exact compare them."""

    def __init__(self, data: np.ndarray):
        self._tables = _powers(1 << max(20, int(len(data) + 1).bit_length()))
        values = data.astype(np.uint64) + np.uint64(1)
        self._sums = []
        with np.errstate(over="ignore"):
            for up, _ in self._tables:
                total = np.zeros(len(data) + 1, np.uint64)
                # Differences are exact for spans up to 2**25 bytes; longer ones are hashed by stretches.
                np.cumsum(values * up[: len(data)], out=total[1:])
                self._sums.append(total)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if (end - start).max(initial=0) <= STRETCH:
            return self._short(start, end)
        out = self._short(start, np.minimum(end, start + STRETCH))
        for i in np.flatnonzero(end - start > STRETCH).tolist():
            edges = np.append(np.arange(start[i], end[i], STRETCH), end[i])
            total = np.zeros(1, np.uint64)
            for part in self._short(edges[:-1], edges[1:]):
                total = mix(total + part)
            out[i] = total[0]
        return out

    def _short(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            got = [(total[end] - total[start]) % np.uint64(p) * down[start] % np.uint64(p) for p, total, (_, down) in zip(_PRIMES, self._sums, self._tables, strict=True)]
            return mix((got[0] << np.uint64(32) | got[1]) + np.uint64(0x9E3779B97F4A7C15) * (end - start).astype(np.uint64))


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def per_row(marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many marks each row has."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class Words(Spans):
    """Words of a column slice. data: bytes with A-Z lower-cased, raw: as they were; start, end, doc: of each word; counts: of each row."""

    def __init__(self, column: pa.Array, apart: np.ndarray = SPACES):
        self.raw, self.first = flat(column)
        self.data, self.rows = _LOWER[self.raw], len(column)
        super().__init__(self.data)
        inside = ~apart[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.first] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.counts = per_row(begins, self.first)
        self.doc = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(one, place): a word of each kind and each word's kind. Exact: words that share a hash are compared."""
        _, one, place = np.unique(self.hashes(), return_index=True, return_inverse=True)
        size = self.end - self.start
        other = one[place]
        alike = size[other] == size
        some = np.flatnonzero(alike & (other != np.arange(len(other))))
        alike[some] = same_bytes(self.data, self.start[some], self.data, self.start[other[some]], size[some])
        apart: dict[bytes, int] = {}
        for i in np.flatnonzero(~alike).tolist():
            kind = apart.setdefault(self.text(i), len(one))
            if kind == len(one):
                one = np.append(one, i)
            place[i] = kind
        return one, place
