"""Words and word n-grams of Arrow string columns as numpy arrays, without a Python object per word.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudorandom 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    if len(column) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """The words of some rows.

    data, offs: bytes and row offsets; starts, ends: byte spans of the words; row_off: index of each
    row's first word (and the number of words last); hashes: word hashes.
    """

    def __init__(self, hasher: "Hasher", data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, n = data, offs, len(data)
        starts, ends, hashes = [], [], []
        # by slices, so that the arrays of a number a byte stay small; a word at a slice's end is left to the next one
        lo = 0
        while lo < n:
            hi = min(n, lo + CHUNK_BYTES)
            solid = hasher.solid[data[lo:hi]]
            cut = np.zeros(hi - lo + 1, bool)
            cut[offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi, "right")] - lo] = True
            cut[0] = True
            before, after = np.ones(hi - lo, bool), np.ones(hi - lo, bool)
            before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
            s = np.flatnonzero(solid & (before | cut[:-1]))
            e = np.flatnonzero(solid & (after | cut[1:])) + 1
            if hi < n and len(s) and e[-1] == hi - lo and not cut[-1]:
                s, e, hi = s[:-1], e[:-1], lo + int(s[-1])
                if hi == lo:  # a word of a whole slice or more
                    ends_at = [n, *(lo + np.flatnonzero(~hasher.solid[data[lo:]])[:1]), *offs[np.searchsorted(offs, lo, "right") :][:1]]
                    hi = int(min(ends_at))
                    starts.append(np.array([lo]))
                    ends.append(np.array([hi]))
                    hashes.append(hasher.whole(data[lo:hi]))
                    lo = hi
                    continue
            starts.append(s + lo)
            ends.append(e + lo)
            hashes.append(hasher.spans(data[lo:hi], s, e))
            lo = hi
        none = np.zeros(0, np.int64)
        self.starts, self.ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.hashes = np.concatenate([np.zeros(0, U64), *hashes])
        self.row_off = np.searchsorted(self.starts, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_off)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)


def _powers(base: int, p: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo p."""
    out = np.ones(n, U64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U64(pow(base, have, p)) % U64(p)
        have += more
    return out


class Hasher:
    """Hashes of byte spans: polynomials in two bases, each modulo a prime below 2**31, side by side in 62 bits, then scrambled.

    Modulo a prime no two byte strings of n bytes share a value in more than n of the bases, so none collide by their
    make, as they would modulo a power of two; unlike strings of n bytes collide with probability (n / 2**31) ** 2 at most.
    """

    FIELDS = ((2**31 - 1, 1_226_874_159), (2**31 - 19, 892_745_528))  # primes and bases

    def __init__(self):
        self.solid = np.ones(256, bool)
        self.solid[[0x20, *range(0x09, 0x0E)]] = False
        self.codes = np.arange(1, 257, dtype=U64)  # no byte is 0, so lengths tell
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        if not self.powers or len(self.powers[0][0]) <= n:
            self.powers = [(_powers(base, p, n + 1), _powers(pow(base, -1, p), p, n + 1)) for p, base in self.FIELDS]

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of spans of at most 2**22 bytes of data: the sums stay below 2**64."""
        self._grow(len(data))
        codes, parts = self.codes[data], []
        for (p, _), (up, down) in zip(self.FIELDS, self.powers, strict=True):
            sums = np.zeros(len(data) + 1, U64)
            np.cumsum(codes * up[: len(data)], out=sums[1:])
            parts.append((sums[ends] - sums[starts]) % U64(p) * down[starts] % U64(p))
        return self._joined(parts, ends - starts)

    @staticmethod
    def _joined(parts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        return mix((sizes.astype(U64) << U64(62)) | (parts[0] << U64(31)) | parts[1])

    def whole(self, data: np.ndarray) -> np.ndarray:
        """The hash of all of ``data`` as one span, taken by slices."""
        self._grow(CHUNK_BYTES)
        parts = []
        for (p, base), (up, _) in zip(self.FIELDS, self.powers, strict=True):
            total = 0
            for lo in range(0, len(data), CHUNK_BYTES):
                codes = self.codes[data[lo : lo + CHUNK_BYTES]]
                total += int((codes * up[: len(codes)]).sum(dtype=U64)) % p * pow(base, lo, p)
            parts.append(np.array([total % p], U64))
        return self._joined(parts, np.array([len(data)]))

    def long_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``spans`` of spans in order, by slices of the data."""
        out, i = [np.zeros(0, U64)], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
            lo, hi = starts[i], ends[j - 1]
            out.append(self.whole(data[lo:hi]) if hi - lo > CHUNK_BYTES else self.spans(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo))
            i = j
        return np.concatenate(out)

    def chunks(self, column: pa.Array) -> Iterator[tuple[int, int, Words]]:
        """(first row, end row, words) for runs of rows of some megabytes; a longer row stands alone."""
        data, offs = utf8(column)
        lo, n = 0, len(offs) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1)
            yield lo, hi, Words(self, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            lo = hi


def ngrams(words: Words, n: int, salt: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of n words within a row; another hash for each ``salt``."""
    h = words.hashes
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    mult = seeded(salt + n, n) | U64(1)
    out = h[: len(h) - n + 1] * mult[0]
    for j in range(1, n):
        out += h[j : len(h) - n + 1 + j] * mult[j]
    row = words.rows()
    at = np.flatnonzero(row[: len(out)] == row[n - 1 :])
    return at, mix(out[at])
