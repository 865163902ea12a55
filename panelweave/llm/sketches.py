"""Word shingles of one text and their HyperMinHash registers (numpy; used inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import xxhash

BUCKETS = 256  # the top 8 bits of a shingle's hash choose the bucket
MANTISSA_BITS = 10
EMPTY = np.uint16(0xFFFF)
COLLISION_RATE = 0.169919487159739  # fixed value: published constant of the expected accidental register collisions


class WordHashes:
    """64-bit hashes of words, remembered up to a bound and the words of one text."""

    LIMIT = 300_000

    def __init__(self):
        self.known: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        try:
            found = b"".join(map(self.known.__getitem__, words))
        except KeyError:  # some are not known yet
            if len(self.known) > self.LIMIT:
                self.known.clear()
            self.known.update({w: xxhash.xxh3_64_digest(w) for w in set(words) if w not in self.known})
            found = b"".join(map(self.known.__getitem__, words))
        return np.frombuffer(found, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=None)
def _factor(place: int) -> np.uint64:
    """An odd number for each place of a word in a shingle."""
    return np.uint64(xxhash.xxh3_64_intdigest(b"place", seed=place) | 1)


def shingle_set(text: bytes | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z are lower-cased; words are runs of bytes other than space and 0x09-0x0D. A text with fewer words than ``size``
    has its whole sequence as its one shingle; null, empty and blank texts have none.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    h = words.of(tokens)
    span = min(size, len(h))
    # the words' hashes are random already: every place has its own odd factor, and the sum is scrambled once
    total = h[: len(h) - span + 1] * _factor(0)
    for i in range(1, span):
        total += h[i : i + len(total)] * _factor(i)
    total = mix(total + np.uint64(span))
    total.sort()
    new = np.empty(len(total), dtype=bool)
    new[0], new[1:] = True, total[1:] != total[:-1]
    return total[new]


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def registers(shingles: np.ndarray) -> np.ndarray:
    """Per bucket the smallest remaining hash as leading-zero count (6 bits) and the next mantissa bits (10); EMPTY without one."""
    out = np.full(BUCKETS, EMPTY, dtype=np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the first of a bucket is its smallest
        rest = (shingles[first] << np.uint64(8)) >> np.uint64(11)  # 53 bits, exact as a double
        zeros = np.where(rest > 0, 53 - np.frexp(rest.astype(np.float64))[1], 53).astype(np.uint64)
        shifted = (rest << (zeros + np.uint64(11) + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
        out[bucket[first]] = ((zeros << np.uint64(MANTISSA_BITS)) | np.where(rest > 0, shifted, 0)).astype(np.uint16)
    return out


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For every bucket a fixed random order of all buckets, from which an empty one borrows."""
    generator = np.random.Generator(np.random.PCG64(20240501))
    return np.stack([generator.permutation(BUCKETS) for _ in range(BUCKETS)])


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with every empty one replaced by the first occupied one in its own fixed order."""
    holes = np.flatnonzero(regs == EMPTY)
    if not len(holes) or len(holes) == BUCKETS:
        return regs
    out = regs.copy()
    order = _probes()[holes]
    out[holes] = regs[order[np.arange(len(holes)), (regs != EMPTY)[order].argmax(axis=1)]]
    return out


def band_keys(regs: np.ndarray, rows: int, bands: int) -> list[int]:
    """One signed 64-bit key per band of ``rows`` registers; equal bands have equal keys. None for an empty set."""
    full = filled(regs)
    if full[0] == EMPTY:
        return []
    raw = full[: rows * bands].tobytes()
    step = 2 * rows
    return [xxhash.xxh3_64_intdigest(raw[i * step : (i + 1) * step], seed=i) - (1 << 63) for i in range(bands)]


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of rows of registers (the last axis)."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    load = 4.0 * n_a * n_b / np.maximum((n_a + n_b) ** 2.0, 1.0)
    chance = COLLISION_RATE * load / (1 << MANTISSA_BITS)
    return np.clip((same / np.maximum(used, 1) - chance) / (1 - chance), 0.0, 1.0)


def overlap_linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a ∩ b| >= percent * |a ∪ b| of two sorted distinct arrays; empty sets are linked with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= percent * (len(a) + len(b) - common)


def digests(texts: Iterable[bytes | None], size: int, words: WordHashes):
    for text in texts:
        shingles = shingle_set(text, size, words)
        yield len(shingles), set_digest(shingles), registers(shingles)
