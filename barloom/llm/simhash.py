"""SimHash fingerprints of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS, SEED, BITS = 4, 42, 64


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the XXH64 hashes of all shingles of ``words`` words, repeats included; 0 without words.

    Words are runs of anything but ASCII white space, A-Z in lower case, joined by one blank; fewer words than a shingle
    holds are one shingle. A bit is 1 if it is set in over half of the hashes.
    """
    if not text:
        return 0
    parts = text.encode().lower().split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    first = [0, *(ends[: n - words] + 1).tolist()]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(first, ends[words - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big")
