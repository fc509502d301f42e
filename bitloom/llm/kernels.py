"""Numpy kernels over one text: word bounds, word and shingle hashes, MinHash signatures.

They run inside Spark tasks on Arrow batches and never see more than one text at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in pieces of about so many bytes, cut between words; their arrays stay in a core's cache.
PIECE = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that any bits of the result may be used."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words (runs of non-space bytes)."""
    edge = np.diff(np.concatenate(([False], ~_SPACE[data], [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pieces(data: bytes):
    at = 0
    while len(data) - at > PIECE:
        cut = at + PIECE
        while cut < len(data) and not _SPACE[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text, in order: a polynomial over its bytes from prefix sums."""
    return words_at(data)[1]


def words_at(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, hashes) of every word of a text, in order."""
    found, places, at = [], [], 0
    for piece in _pieces(data):
        codes = np.frombuffer(piece, np.uint8)
        starts, ends = bounds(codes)
        if len(starts):
            up, down = _power_tables(len(codes) + 1)
            prefix = np.zeros(len(codes) + 1, U64)
            np.cumsum((codes.astype(U64) + U64(1)) * up[: len(codes)], out=prefix[1:])
            found.append(mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64)))
            places.append(starts + at)
        at += len(piece)
    if not found:
        return np.empty(0, np.int64), np.empty(0, U64)
    return np.concatenate(places), np.concatenate(found)


def stems(data: bytes, lengths: tuple[int, ...]):
    """Hashes of the words' beginnings, piece by piece: (number of words, [(which words, hashes), ...]).

    One entry for each of ``lengths`` (in bytes, for words that are longer) and at last the whole words.
    """
    for piece in _pieces(data):
        codes = np.frombuffer(piece, np.uint8)
        starts, ends = bounds(codes)
        if len(starts):
            up, down = _power_tables(len(codes) + 1)
            prefix = np.zeros(len(codes) + 1, U64)
            np.cumsum((codes.astype(U64) + U64(1)) * up[: len(codes)], out=prefix[1:])
            found = []
            for n in lengths:
                which = np.flatnonzero(ends - starts > n)
                at = starts[which]
                found.append((which, mix((prefix[at + n] - prefix[at]) * down[at] + U64(n))))
            whole = mix((prefix[ends] - prefix[starts]) * down[starts] ^ U64(0x5851F42D4C957F2D))
            yield len(starts), [*found, (np.arange(len(starts)), whole)]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, in order; a shorter non-empty text is one window."""
    n = len(words)
    if not n:
        return words
    span = min(width, n)
    total = np.full(n - span + 1, (span * 0x632BE59BD9B4E019) & (2**64 - 1), U64)
    for i in range(span):
        total = (total ^ words[i : n - span + 1 + i]) * U64(0xD6E8FEB86659FD93) + U64(i + 1)
        total ^= total >> U64(29)
    return mix(total)


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text that is lower-cased already."""
    return np.unique(shingles(word_hashes(data), width))


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a sorted set, as two signed 64-bit numbers."""
    raw = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return tuple(int(x) for x in np.frombuffer(raw, np.int64))


class MinHash:
    """``n`` min-wise hash functions x -> a*x + b mod 2**32 over the upper halves of 64-bit hashes."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.n = n
        self.a = (rng.integers(0, 2**32, n, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, n, np.uint32)[:, None]

    def minima(self, values: np.ndarray) -> np.ndarray:
        x = (values >> U64(32)).astype(np.uint32)
        best = np.full(self.n, 2**32 - 1, np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(best, (self.a * x[None, at : at + 1024] + self.b).min(axis=1), out=best)
        return best


    def each(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Minima of many sets at once, a row each; set i is values[bounds[i] : bounds[i + 1]] and not empty."""
        x = (values >> U64(32)).astype(np.uint32)
        out = np.empty((len(bounds) - 1, self.n), np.uint32)
        for k in range(self.n if len(out) else 0):
            out[:, k] = np.minimum.reduceat(self.a[k] * x + self.b[k], bounds[:-1])
        return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` minima (of one set, or of a set a row); the band's number is part of it."""
    grid = minima[..., : bands * rows].reshape(*minima.shape[:-1], bands, rows).astype(U64)
    key = np.arange(1, bands + 1, dtype=U64) * U64(0xA0761D6478BD642F)
    for i in range(rows):
        key = mix(key ^ (grid[..., i] + U64((i + 1) * 0xE7037ED1A0B428DB & (2**64 - 1))))
    return key.view(np.int64)


def pack_two_bits(minima: np.ndarray) -> np.ndarray:
    """The lowest two bits of every (scrambled) minimum, 32 to a 64-bit word."""
    h = minima ^ (minima >> np.uint32(15))
    h = (h * np.uint32(0x2C1B3C6D)) ^ (h >> np.uint32(12))
    lanes = (h & np.uint32(3)).astype(U64).reshape(-1, 32)
    return np.bitwise_or.reduce(lanes << (U64(2) * np.arange(32, dtype=U64)), axis=1).view(np.int64)
