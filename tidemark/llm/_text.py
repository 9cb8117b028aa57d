"""Vectorised word splitting and rolling hashes over UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09-0x0D; ``bytes.split()`` cuts at the same
places.  Everything here works on whole texts, a bounded slice of a batch at a time, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text that are hashed at a time; bounds the temporaries, not what is read.
SLICE_BYTES = 1 << 20

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of hashes have no visible structure."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.factors, self.up, self.down = (base, inverse), np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            grown = []
            for f in self.factors:
                a = np.full(size, f, U64)
                a[0] = 1
                grown.append(np.multiply.accumulate(a))
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


_BYTES_POW = _Powers(_BASE, _BASE_INV)
_WORDS_POW = _Powers(U64(0xD1342543DE82EF95), U64(pow(0xD1342543DE82EF95, -1, 1 << 64)))


class Words:
    """The words of some texts: byte bounds in ``buf``, and per text the first word's number."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.raw, np.uint8)
        ws = _WS[self.buf]
        before = np.empty_like(ws)
        before[0], before[1:] = True, ws[:-1]
        self.starts = np.flatnonzero(before & ~ws)
        self.ends = np.flatnonzero(ws & ~before)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, self.text_at)
        self.per_text = np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text's number of each word."""
        return np.repeat(np.arange(len(self.per_text)), self.per_text)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.starts), U64)
        i, n = 0, len(self.starts)
        while i < n:
            at = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, at + SLICE_BYTES, "right")))
            up, down = _BYTES_POW.get(int(self.ends[j - 1]) - at + 1)
            sums = np.zeros(len(up), U64)
            np.cumsum(_BYTE[self.buf[at : at + len(up) - 1]] * up[:-1], out=sums[1:])
            s, e = self.starts[i:j] - at, self.ends[i:j] - at
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
            i = j
        return out


def slices(texts, limit: int = 2 * SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts (a list or an Arrow array) with about ``limit`` bytes together; a longer text stands alone."""
    i = size = 0
    for j, t in enumerate(texts):
        n = len(t) if isinstance(t, bytes) else t.as_buffer().size
        if j > i and size + n > limit:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, those that cross a text's end included."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, U64)
    for k in range(n):
        out = out * U64(0xD1342543DE82EF95) + words[k : k + m]
    return mix(out + U64(n))


def inside(first: np.ndarray, per_text: np.ndarray, n: int) -> np.ndarray:
    """The starts of the n-word runs that stay in one text."""
    total = int(first[-1])
    ok = np.ones(max(0, total - n + 1), dtype=bool)
    for k in range(1, n):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return np.flatnonzero(ok)


class Runs:
    """Hashes of any run [i, j) of a word-hash sequence, from prefix sums."""

    def __init__(self, words: np.ndarray):
        up, self.down = _WORDS_POW.get(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, U64)
        np.cumsum(words * up[:-1], out=self.sums[1:])

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((self.sums[j] - self.sums[i]) * self.down[i] + (j - i).astype(U64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)
