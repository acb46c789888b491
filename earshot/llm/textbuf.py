"""Vectorised access to the UTF-8 bytes of an Arrow string column.

Texts are handled as one byte buffer with offsets, in chunks of about a MB, so that memory in a task does
not depend on the number of rows in a batch (one text is never cut).

Stretches of bytes are known by a polynomial in a fixed large base modulo 2**61 - 1: two different stretches of n bytes
have equal hashes for n of the 2**61 bases at most, also where words modulo 2**64 collide (Thue-Morse strings).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = {False: np.arange(1, 257, dtype=np.uint64), True: (_LOWER + 1).astype(np.uint64)}  # of a byte
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_BASE = 0x1B7E151628AED2A7 % PRIME
_BLOCK = CHUNK_BYTES + 4096
_S30, _S31, _S61 = np.uint64(30), np.uint64(31), np.uint64(61)
_M30, _M31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_powers: list[np.ndarray] = []


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for reduced numbers, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> _S31, a & _M31, b >> _S31, b & _M31
    mid = a1 * b0 + a0 * b1
    return reduced(reduced(a1 * b1 * np.uint64(2) + a0 * b0) + (mid >> _S30) + ((mid & _M30) << _S31))


def _tables() -> list[np.ndarray]:
    """Halves of the powers of the base, and the powers of its inverse, for places in a block."""
    if not _powers:
        out = []
        for base in (_BASE, pow(_BASE, -1, PRIME)):
            x = np.ones(1, np.uint64)
            while len(x) <= _BLOCK:
                x = np.append(x, times(x, np.uint64(pow(base, len(x), PRIME))))
            out.append(x[: _BLOCK + 1])
        _powers.extend([out[0] & _M31, out[0] >> _S31, out[1]])
    return _powers


class Prefix:
    """Prefix sums over the values (1 to 256) of bytes, from which the hash of any stretch follows."""

    def __init__(self, values: np.ndarray):
        low, high, _ = _tables()
        n = len(values)
        self.whole = None
        if n <= _BLOCK:  # sums of halves stay below 2**61
            self.low, self.high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
            np.cumsum(values * low[:n], out=self.low[1:])
            np.cumsum(values * high[:n], out=self.high[1:])
            return
        self.whole, carry = np.zeros(n + 1, np.uint64), np.uint64(0)
        for k, at in enumerate(range(0, n, _BLOCK)):
            part = Prefix(values[at : at + _BLOCK])
            m = len(part.low) - 1
            end = np.arange(1, m + 1)
            x = times(part.sum(np.zeros(m, np.int64), end), np.uint64(pow(_BASE, k * _BLOCK, PRIME)))
            self.whole[at + 1 : at + m + 1] = reduced(x + carry)
            carry = self.whole[at + m]

    def sum(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The sum over [s, e), with the powers of its place."""
        if self.whole is not None:
            return reduced(self.whole[e] + _P - self.whole[s])
        high = reduced(self.high[e] - self.high[s])
        return reduced(self.low[e] - self.low[s] + (high >> _S30) + ((high & _M30) << _S31))

    @staticmethod
    def moved(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """x as if it stood n places further left."""
        inverse = _tables()[2]
        if not np.size(n) or np.max(n) < _BLOCK:
            return times(x, inverse[n])
        far = n // _BLOCK
        jumps = np.array([pow(_BASE, -k * _BLOCK, PRIME) for k in range(int(np.max(far)) + 1)], np.uint64)
        return times(times(x, inverse[n % _BLOCK]), jumps[far])

    def raw(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The polynomial of [s, e) as if it stood at 0."""
        return self.moved(self.sum(s, e), s)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Buf:
    """Bytes of some texts and their offsets."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1
        self._words = None
        self._prefix: dict[bool, Prefix] = {}

    def prefix(self, lower: bool = False) -> Prefix:
        if lower not in self._prefix:
            self._prefix[lower] = Prefix(_VALUE[lower][self.data])
        return self._prefix[lower]

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off[1:], pos, side="right")

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the words, runs of bytes other than ASCII white space."""
        if self._words is None:
            inside = ~_WS[self.data]
            heads = self.off[:-1][self.off[:-1] < len(self.data)]
            start = inside.copy()
            start[1:] &= ~inside[:-1]
            start[heads] |= inside[heads]
            end = inside.copy()
            end[:-1] &= ~inside[1:] | start[1:]
            s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
            self._words = s, e, self.doc_of(s)
        return self._words

    def hashes(self, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of the byte ranges [s, e), spread over 64 bits."""
        return mix(self.prefix(lower).raw(s, e))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the lines split at newlines; a text of n newlines has n + 1 lines."""
        nl = np.flatnonzero(self.data == 10)
        d = self.doc_of(nl)
        order = np.argsort(np.concatenate([self.off[:-1] * 2, nl * 2 + 2]), kind="stable")
        s = np.concatenate([self.off[:-1], nl + 1])
        doc = np.concatenate([np.arange(self.n), d])
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        last = np.append(doc[1:] != doc[:-1], True)
        e = np.where(last, self.off[1:][doc], np.append(s[1:], 0) - 1)
        return s, e, doc


def chunks(texts: pa.Array, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Buf]]:
    """(first row, row after the last, bytes) for consecutive rows of about target bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + target, side="right")) - 1)
        hi = min(hi, n, lo + 20_000)
        yield lo, hi, Buf(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive word hashes that stay in one text, and the number of each window's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = np.zeros(m, np.uint64)
    for k in range(n):
        x = x * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(x[at]), at


def twice(key: np.ndarray) -> np.ndarray:
    """Marks the values that occur more than once."""
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
