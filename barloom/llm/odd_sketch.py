"""Odd sketches of MinHash samples.

A set's MinHash sample is the least value of each of SAMPLES hash functions over its members. The sample folds into a bitmap
whose bits hold parities: each (function, value) flips one bit. Common values cancel when two bitmaps are XORed, so the number
of set bits tells how many functions differ - most precisely where few do - and so how alike the sets are.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash

WORDS, SAMPLES, BITS = 3, 256, 1024
#: Hashes of members that are minimised together: they stay in a core's cache.
CHUNK = 1 << 14

_SEEDS = np.random.default_rng(13).integers(0, 1 << 64, (2, 4096), dtype=np.uint64)
_SEEDS[1] |= np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of all shingles of ``words`` words; of the whole sequence if it is shorter.

    Words are runs of anything but ASCII white space, A-Z in lower case, joined by one blank. Empty without words.
    """
    parts = text.encode().lower().split() if text else []
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    first = [0, *(ends[: n - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(first, ends[words - 1 :].tolist())), np.uint64, n - words + 1))


def minhashes(sets: list[np.ndarray], samples: int = SAMPLES) -> np.ndarray:
    """(set, function): the least hash of each set's members; sets that are empty have the largest value."""
    out = np.full((len(sets), samples), ~np.uint64(0))
    full = [k for k, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        end, size = at, 0
        while end < len(full) and (end == at or size + len(sets[full[end]]) <= CHUNK):
            size += len(sets[full[end]])
            end += 1
        own = [sets[k] for k in full[at:end]]
        for x, starts in _chunks(own):
            y = np.empty_like(x)
            least = np.empty((samples, len(starts)), np.uint64)
            for f in range(samples):
                np.bitwise_xor(x, _SEEDS[0, f], out=y)
                np.multiply(y, _SEEDS[1, f], out=y)
                np.minimum.reduceat(y, starts, out=least[f])
            out[full[at:end]] = np.minimum(out[full[at:end]], least.T)
        at = end
    return out


def _chunks(own: list[np.ndarray]):
    """Members of the sets together, with where each starts; a single large set comes in several pieces."""
    if len(own) > 1:
        yield np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])
    else:
        for k in range(0, len(own[0]), CHUNK):
            yield own[0][k : k + CHUNK], np.zeros(1, np.int64)


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(set, band): a hash of the band's values. Sets whose values agree throughout a band share its key."""
    out = np.empty((len(least), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(least), _SEEDS[1, 4000 + b % 96] + np.uint64(b))
        for r in range(rows):
            h = (h ^ least[:, b * rows + r]) * _SEEDS[1, 1000 + r]
            h ^= h >> np.uint64(29)
        out[:, b] = h
    return out


def odd_sketches(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(set, word): the parity bitmap of each sample, as 64-bit words."""
    n, samples = least.shape
    mixed = (least ^ _SEEDS[0, 2000 : 2000 + samples]) * _SEEDS[1, 2000 : 2000 + samples]
    place = (mixed >> np.uint64(64 - int(math.log2(bits)))).astype(np.int64) + np.arange(n)[:, None] * bits
    odd = np.bincount(place.ravel(), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which sketches a (.., word) and b (.., word) differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def similarity(bits_set: float, samples: int = SAMPLES, bits: int = BITS) -> float:
    """Estimate of the Jaccard similarity of two sets whose sketches differ in so many bits.

    Each function that differs flips two bits of the XOR at random: d of them leave bits / 2 * (1 - (1 - 2 / bits) ** (2 d)).
    """
    room = 1 - 2 * bits_set / bits
    if room <= 0:
        return 0.0
    return max(0.0, 1 - math.log(room) / math.log1p(-2 / bits) / 2 / samples)


def most_bits(least_similarity: float, miss: float = 1e-10, samples: int = SAMPLES) -> int:
    """Most bits in which the sketches of sets at least so similar differ, but for one pair in 1 / miss.

    Functions differ independently with probability 1 - similarity; the tail of their number is bounded by Chernoff. A
    function that differs changes two bits at most, so the bound needs nothing about where they fall.
    """
    p = 1 - least_similarity
    for d in range(math.ceil(samples * p), samples):
        q = d / samples
        tail = samples * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p))) if q > p else 0
        if math.exp(-tail) <= miss:
            return 2 * d
    return 2 * samples
