"""Word shingles of whole texts as sorted arrays of 64-bit hashes.

Bytes are hashed by columns, many texts at a time: a word's hash is a
polynomial over its bytes, taken from prefix sums, and a shingle's hash mixes
those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of a shingle.
WORDS = 5
#: Bytes hashed at a time; a longer text is cut where a word ends.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_FOLD += np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(31)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, both modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, PIECE + 1)
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                factors = np.full(n, b, np.uint64)
                factors[0] = 1
                _POWERS[k : k + 1] = [np.cumprod(factors, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def _hash_words(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw`` and where they start; texts begin at ``begins``."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[begins[begins <= n]] = True
    starts = letter.copy()
    starts[1:] &= ~letter[:-1] | edge[1:-1]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_FOLD[raw] * power[:n], out=sums[1:])
        h = (sums[last] - sums[first]) * inverse[first]
        return mix(h + (last - first).astype(np.uint64)), first


def _sets(h: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of texts whose words are ``h[bounds[k]:bounds[k+1]]``."""
    with np.errstate(over="ignore"):
        n = max(len(h) - WORDS + 1, 0)
        s = np.zeros(n, np.uint64)
        for k in range(WORDS):
            s = mix(s + h[k : k + n] * np.uint64(2 * k + 3))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= WORDS:
                x = np.sort(s[lo : hi - WORDS + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif hi > lo:
                one = np.full(1, hi - lo, np.uint64)
                for k in range(lo, hi):
                    one = mix(one * np.uint64(0x2545F4914F6CDD1D) + h[k : k + 1])
                yield one
            else:
                yield np.zeros(0, np.uint64)


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its set of shingles; fewer words make one shingle, no words none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.asarray(texts.is_valid())
    k = 0
    while k < len(texts):
        end = int(np.searchsorted(offsets, offsets[k] + PIECE, side="right")) - 1
        end = min(max(end, k), len(texts))
        if end > k:
            part = offsets[k : end + 1] - offsets[k]
            h, first = _hash_words(raw[offsets[k] : offsets[end]], part)
            found = _sets(h, np.searchsorted(first, part))
            for j, s in enumerate(found):
                yield s if valid[k + j] else s[:0]
            k = end
            continue
        words, at, stop = [], int(offsets[k]), int(offsets[k + 1])
        while at < stop:
            to = min(at + PIECE, stop)
            while to < stop and not _SPACE[raw[to]]:
                to += 1
            words.append(_hash_words(raw[at:to], np.zeros(1, np.int64))[0])
            at = to
        h = np.concatenate(words)
        yield from _sets(h, np.array([0, len(h)]))
        k += 1


def digest(s: np.ndarray) -> int:
    """A signed 64-bit number that depends on the set alone."""
    with np.errstate(over="ignore"):
        total = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([total]))[0].astype(np.int64))


#: Bits of the parity map of a set: four a shingle, within these bounds.
LEAST_BITS, MOST_BITS = 256, 8192


def parity(s: np.ndarray) -> bytes:
    """For each bit the parity of the shingles that fall on it.

    Two sets differ in at least as many shingles as their maps do in bits.
    """
    bits = min(max(LEAST_BITS, 1 << max(4 * len(s) - 1, 1).bit_length()), MOST_BITS)
    counts = np.bincount(((s >> np.uint64(21)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def fold(maps: np.ndarray) -> np.ndarray:
    """Parity maps [n, bytes] of half as many bits."""
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]
