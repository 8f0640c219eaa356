"""Vectorised text kernels over the bytes of many documents at once (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every output bit depends on every input bit."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_CODE = mix64(np.arange(256, dtype=_U))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, extended as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, b in (("up", _BASE), ("down", _INVERSE)):
                    p = np.full(size, b, _U)
                    p[0] = 1
                    setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class PrefixHash:
    """64-bit hashes of any short slice of a sequence of codes, in constant time each.

    Long slices (of a thousand codes and more) can be built that collide in it; whole
    words and pre-tokens go by ``slice_hashes``.
    """

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = _POWERS.upto(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, _U)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint slices: the sum of a number drawn for each (place in the slice, code)."""
    n = ends - starts
    before = np.cumsum(n) - n
    total = int(n.sum())
    place = np.arange(total)
    place -= np.repeat(before, n)
    tiled = total == len(codes)  # the slices are all there is
    own = codes if tiled else codes[place + np.repeat(starts, n)]
    sums = np.zeros(total + 1, _U)
    np.cumsum(mix64(own.astype(_U) + place.astype(_U) * _U(0xD1342543DE82EF95)), out=sums[1:])
    return mix64(sums[before + n] - sums[before] + n.astype(_U) * _U(0xA0761D6478BD642F))


#: Bytes of a document that a kernel takes at a time, where it is longer.
PART_BYTES = 4 << 20
_PRINTED = np.zeros(256, bool)
_PRINTED[33:127] = True


def parts(data: np.ndarray, limit: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about ``limit`` bytes, cut before white space that follows a printed ASCII character.

    No word, run of letters or pre-token goes across such a place.  Where there is none, a
    part goes on to the next.
    """
    a, n = 0, len(data)
    while n - a > limit:
        b = a + limit
        while b < n:
            end = min(n, b + (1 << 16))
            found = np.flatnonzero(SPACE[data[b:end]] & _PRINTED[data[b - 1 : end - 1]])
            if len(found):
                b += int(found[0])
                break
            b = end
        if b >= n:
            break
        yield a, b
        a = b
    yield a, n


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a document's end."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words ``[^\\x20\\x09-\\x0D]+`` and the number of words before each document's end.

    Returns (hashes, bounds): document i has the words bounds[i]:bounds[i + 1].
    """
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    if len(offsets) == 2 and len(data) > 2 * PART_BYTES:
        found = np.concatenate([_words(data[a:b], np.array([0, b - a]))[0] for a, b in parts(data)])
        return found, np.array([0, len(found)])
    return _words(data, offsets)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends = runs(~SPACE[low], offsets)
    return slice_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed ``k``-word shingles of each document, sorted within it, and their bounds.

    A document with 1 to k - 1 words has its whole sequence as the one shingle; one without words has none.
    """
    n = np.diff(bounds)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), many)
    if not len(doc):
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + bounds[:-1][doc]
    width = np.minimum(n, k)[doc]
    h = width.astype(_U)
    for i in range(k):
        more = mix64(h * _U(_BASE) ^ words[np.minimum(at + i, len(words) - 1)])
        h = more if int(width.min()) > i else np.where(width > i, more, h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s:s + n] for each (s, n), joined."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.arange(total) + np.repeat(starts - before, lengths)]


#: Bytes of words for models of letters: ASCII letters, and all bytes of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


class WordTable:
    """Rows of numbers for words, computed once for each distinct word that a worker meets.

    ``compute`` takes a list of words as bytes and returns an array with a row for each.
    At most ``keep`` words (and those of one step) are remembered, by default as many as
    take ``HELD_BYTES``.
    """

    HELD_BYTES = 32 << 20

    def __init__(self, compute, width: int, keep: int | None = None) -> None:
        self.compute, self.width = compute, width
        self.keep = self.HELD_BYTES // (8 * width + 16) if keep is None else keep
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots, self.rows, self.n = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros((1024, self.width)), 0

    def look_up(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """A row for each word data[s:e]."""
        if self.n > self.keep:
            self._forget()
        found, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, found)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == found[known]
        if not known.all():
            new, raw = where[~known], data.tobytes()
            rows = self.compute([raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            while self.n + len(rows) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.n : self.n + len(rows)] = rows
            put = at[~known]
            self.keys = np.insert(self.keys, put, found[~known])
            self.slots = np.insert(self.slots, put, np.arange(self.n, self.n + len(rows)))
            self.n += len(rows)
            at = np.searchsorted(self.keys, found)
        return self.rows[self.slots[at]][back]

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each document of a step the sum of its words' rows; words are runs of LETTERS, in lower case (A-Z)."""
        if len(offsets) == 2 and len(data) > 2 * PART_BYTES:
            return sum(self._sums(data[a:b], np.array([0, b - a])) for a, b in parts(data))
        return self._sums(data, offsets)

    def _sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, self.width))
        if len(data):
            low = LOWER[data]
            starts, ends = runs(LETTERS[low], offsets)
            if len(starts):
                rows = self.look_up(slice_hashes(low, starts, ends), starts, ends, low)
                doc = np.searchsorted(offsets, starts, "right") - 1
                for k in range(self.width):
                    out[:, k] = np.bincount(doc, rows[:, k], len(out))
        return out
