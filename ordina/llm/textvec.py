"""Vectorised text primitives on Arrow string buffers.

Everything here works on the raw UTF-8 bytes of a whole column slice: words are found with a byte table,
and a run of bytes is hashed with a prefix sum of ``T[byte] * B**position`` (mod 2**64), so the hash of any
run is two look-ups and one multiplication, however long the run is.  Texts are processed in pieces of at
most ``PIECE`` bytes that end between words, so memory does not follow the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 3  # odd, 3 mod 4
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Bytes of the class [\x20\x09-\x0D] end words; every other byte belongs to one.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Of ASCII, letters and digits belong to a plain word; bytes of other characters do.
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240611)
_T = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_T_LOWER = _T[_LOWER]
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` for i below n at least (kept up to 2 * PIECE)."""
    have = _pow.get("p")
    if have is None or len(have) < n:
        size = max(n, PIECE + 4096)
        p, q = np.full(size, _BASE, dtype=np.uint64), np.full(size, _BASE_INV, dtype=np.uint64)
        p[0] = q[0] = 1
        p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
        if size > 2 * PIECE:
            return p, q
        _pow["p"], _pow["q"] = p, q
    return _pow["p"], _pow["q"]


def fold(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in UTF-8 as small letters."""
    out = _LOWER[buf]
    if len(buf) > 1:
        high = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[high] += 0x20
    return out


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _pieces(buf: np.ndarray, off: np.ndarray):
    """Cut points that lie at text starts or white space, at most about PIECE bytes apart."""
    a, end = 0, len(buf)
    while a < end:
        b = min(end, a + PIECE)
        if b < end:
            at = int(off[np.searchsorted(off, b, side="right") - 1])
            if at > a:
                b = at
            else:
                while b < end and not _SPACE[buf[b]] and b not in (at := off[np.searchsorted(off, b)],):
                    step = np.flatnonzero(_SPACE[buf[b : b + PIECE]])
                    b = min(int(at), b + (int(step[0]) if len(step) else PIECE), end)
                    if len(step):
                        break
        yield a, b
        a = b


def words(
    buf: np.ndarray, off: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """(hash of each word, offsets of each text's words, hashes of the words' first bytes for each of ``prefixes``).

    A word is a run of bytes outside ``space``, by default of the class ``[^\\x20\\x09-\\x0D]+``; ``lower``
    folds A-Z only.  The hash depends on the word's bytes alone.
    """
    table, out, at = (_T_LOWER if lower else _T), [[] for _ in range(1 + len(prefixes))], []
    for a, b in _pieces(buf, off):
        part = buf[a:b]
        inside = ~space[part]
        edge = off[np.searchsorted(off, a) : np.searchsorted(off, b)] - a
        before = np.empty(len(part), bool)
        before[0], before[1:] = False, inside[:-1]
        before[edge] = False
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = False, inside[1:]
        after[edge[edge > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        values = table[part]
        for have, n in zip(out, (len(part), *prefixes)):
            have.append(run_hashes(values, starts, np.minimum(ends, starts + n)))
        at.append(starts + a)
    none = np.zeros(0, np.uint64)
    found = [np.concatenate([*x, none]) for x in out]
    return found[0], np.searchsorted(np.concatenate([*at, np.zeros(0, np.int64)]), off).astype(np.int64), *found[1:]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; values: random 64-bit numbers standing for the symbols."""
    p, q = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(hashes: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, offsets).  A text of fewer words, but one at least, has one run: all of it."""
    n = np.diff(off)
    runs = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    new = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(new[-1]), np.uint64)
    if len(hashes) >= k:
        acc = hashes[: len(hashes) - k + 1].copy()
        for j in range(1, k):
            acc = mix(acc * np.uint64(0xD1342543DE82EF95) + hashes[j : len(hashes) - k + 1 + j])
        full = np.flatnonzero(n >= k)
        take = ranges(off[full], n[full] - k + 1)
        out[ranges(new[full], runs[full])] = acc[take]
    for w in range(1, k):
        short = np.flatnonzero(n == w)
        if len(short):
            acc = hashes[off[short]] + np.uint64(0x632BE59BD9B4E019)
            for j in range(1, w):
                acc = mix(acc * np.uint64(0xD1342543DE82EF95) + hashes[off[short] + j])
            out[new[short]] = mix(acc)
    return out, new


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each length, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def slices(off: np.ndarray, most: int = PIECE):
    """(i, j) of consecutive texts with at most ``most`` bytes together, or one longer text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
