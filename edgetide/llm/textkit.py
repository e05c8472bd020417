"""Words, shingles and MinHash over the raw UTF-8 of Arrow string columns, in numpy.

No Python object is made per word: a word's hash comes from prefix sums of byte values times powers of an odd
number modulo 2**64. Texts are handled in pieces of bounded size, cut between words, so a text of any length
costs memory in proportion to its words only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 64, size=n, dtype=np.uint64, endpoint=False)


_VALUE = _random(256, 11) | _U(1)
_STEP = _random(64, 12) | _U(1)
_powers: dict[str, np.ndarray] = {}

#: Whitespace is space and the bytes 9 to 13; all else is part of a word.
SOLID = np.ones(256, bool)
SOLID[[32, *range(9, 14)]] = False
#: Letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Letters and everything outside ASCII.
ALPHA = ALNUM.copy()
ALPHA[48:58] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        n = max(n, PIECE + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, _U(base))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and where each row's text starts and ends in them. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        ends[gone] = starts[gone]
    return data, starts, ends


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, solid: np.ndarray, piece: int = PIECE) -> list[int]:
    """Bounds of pieces: where a text starts, or within a long one after a byte that ends no word."""
    first, last = int(starts[0]), int(ends.max())
    out, at = [first], first
    while last - at > piece:
        k = int(np.searchsorted(starts, at + piece, side="right")) - 1
        to = int(starts[k])
        if to <= at:
            window = np.flatnonzero(~solid[data[at + 1 : at + piece]])
            if len(window):
                to = at + 2 + int(window[-1])
            else:
                to = at + piece
                while to < last and solid[data[to]]:
                    ahead = np.flatnonzero(~solid[data[to : to + piece]])
                    to = to + int(ahead[0]) if len(ahead) else min(last, to + piece)
                to = min(to, last)
        at = to
        out.append(at)
    if at < last:
        out.append(last)
    return out


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, solid: np.ndarray = SOLID, fold: bool = True, places: bool = False):
    """Hashes of all words in order, and the range of each row's words in them.

    ``fold`` lower-cases A-Z. With ``places``, also where each word starts and ends in ``data``.
    """
    empty = np.zeros(len(starts), np.int64)
    if not len(starts) or int(ends.max()) <= int(starts[0]):
        none = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), empty, empty) + ((none, none) if places else ())
    bounds = cuts(data, starts, ends, solid)
    hashes, begins, stops = [], [], []
    edges = np.unique(np.concatenate([starts, ends]))
    for a, b in zip(bounds[:-1], bounds[1:]):
        x = data[a:b]
        if fold:
            x = LOWER[x]
        on = solid[x]
        head, tail = on.copy(), on.copy()
        head[1:] &= ~on[:-1]
        tail[:-1] &= ~on[1:]
        e = edges[np.searchsorted(edges, a) : np.searchsorted(edges, b)] - a
        head[e] = on[e]
        tail[e[e > 0] - 1] = on[e[e > 0] - 1]
        s, t = np.flatnonzero(head), np.flatnonzero(tail) + 1
        up, down = powers(b - a + 1)
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUE[x] * up[: b - a], out=total[1:])
        hashes.append(mix((total[t] - total[s]) * down[s]))
        begins.append(s + a)
        if places:
            stops.append(t + a)
    h, s = np.concatenate(hashes), np.concatenate(begins)
    low, high = np.searchsorted(s, starts), np.searchsorted(s, ends)
    return (h, low, high) + ((s, np.concatenate(stops)) if places else ())


def runs(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes low[i] .. low[i] + count[i] - 1 for all i in one array, and where each i begins in it."""
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    return np.repeat(low - at[:-1], count) + np.arange(at[-1]), at


def shingles(h: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every row, repeats kept, and where each row begins.

    A row of fewer than k words, but one at least, has its whole sequence as its only shingle.
    """
    n = high - low
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    index, at = runs(low, count)
    width = max(0, len(h) - k + 1)
    s = np.zeros(len(h), np.uint64)
    for j in range(k):
        s[:width] += h[j : j + width] * _STEP[j]
    s = mix(s)
    out = s[index]
    for i in np.flatnonzero((n > 0) & (n < k)):
        m = int(n[i])
        whole = (h[low[i] : high[i]] * _STEP[:m]).sum(dtype=np.uint64, keepdims=True) + _STEP[32 + m % 32]
        out[at[i]] = mix(whole)[0]
    return out, at


def distinct(flat: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Each row's shingles sorted, without repeats."""
    return [np.unique(flat[a:b]) for a, b in zip(at[:-1], at[1:])]


def multipliers(t: int, seed: int = 21) -> np.ndarray:
    return _random(t, seed) | _U(1)


def minhash(flat: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Rows x len(factors) minwise tokens of 32 bits; rows without shingles get zeros."""
    out = np.zeros((len(at) - 1, len(factors)), np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        for j, f in enumerate(factors):
            out[full, j] = np.minimum.reduceat(flat * f, at[:-1][full]) >> _U(32)
    return out
