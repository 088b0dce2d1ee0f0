"""Vectorised views of whole texts as bytes: words and their hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer text makes a chunk of its own.
CHUNK = 3_000_000
#: Symbols whose sums are taken together; a longer span makes a stretch of its own.
STRETCH = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing hash, on uint64 with wrap-around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The field of the spans' hashes: a Mersenne prime, so that a product of two elements fits 64 bits and is reduced by shifts.
PRIME = np.uint64((1 << 31) - 1)
#: A base for each of the two hashes that make one of 62 bits.
BASES = (1_103_515_245, 1_812_433_253 % ((1 << 31) - 1))
_powers: dict[int, np.ndarray] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, not fully: below 2**33 for any x below 2**64."""
    return (x & PRIME) + (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo PRIME; kept for the next call."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, STRETCH + 1)
        out = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = out[:more] * np.uint64(step) % PRIME
            done, step = done + more, step * step % int(PRIME)
        _powers[base] = out
    return _powers[base][:n]


def symbols_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of symbols[start:end]; equal strings have equal hashes wherever they lie.

    Two polynomials over a prime field, with a random value for each symbol (``table`` has those of small alphabets), mixed with
    the length. Over a field two strings of n symbols agree for at most n - 1 bases, so no family of strings collides
    for every base, as it does modulo a power of two. Spans are taken a stretch of symbols at a time.
    """
    out = np.empty(len(starts), np.uint64)
    if len(symbols) <= STRETCH:
        return _stretch_hash(symbols, starts, ends, table)
    order = np.argsort(starts, kind="stable")
    starts, ends, lo = starts[order], ends[order], 0
    while lo < len(starts):
        base = starts[lo]
        hi = int(np.searchsorted(starts, base + STRETCH // 2, side="right"))
        out[order[lo:hi]] = _stretch_hash(symbols[base : ends[lo:hi].max()], starts[lo:hi] - base, ends[lo:hi] - base, table)
        lo = hi
    return out


def _stretch_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None) -> np.ndarray:
    n, out = len(symbols), (ends - starts).astype(np.uint64) * GOLD
    value = table[symbols] if table is not None else mix(symbols.astype(np.uint64) + GOLD)
    for k, base in enumerate(BASES):
        v = (value >> np.uint64(32 * k + 1)) & PRIME
        v *= powers(base, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_folded(v), dtype=np.uint64, out=sums[1:])  # below 2**64 for 2**31 symbols
        at = _folded(sums[ends] - sums[starts]) % PRIME
        out = mix(out + at * powers(pow(base, -1, int(PRIME)), n + 1)[starts] % PRIME)
    return out


#: A random 64-bit value for each byte.
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLD)


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], bytes; see ``symbols_hash``."""
    return symbols_hash(buf, starts, ends, BYTE)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets into them); null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the number of its first word (one more entry than rows)."""
    n = len(buf)
    dark = np.zeros(n + 2, bool)
    dark[1:-1] = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(dark[1:] & (~dark[:-1] | edge))
    ends = np.flatnonzero(dark[:-1] & (~dark[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def window_hash(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` words in a row of one text, and each text's count; a text of fewer words has one window of all of them, if any."""
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = ranges(first[:-1], n)
    last = np.repeat(first[1:], n)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        i = at + k
        out = mix(out * np.uint64(0xD1342543DE82EF95) + np.where(i < last, h[np.minimum(i, len(h) - 1)], np.uint64(k + 1)) if len(h) else out)
    return out, n
