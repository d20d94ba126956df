"""Shingles of words, their hashes and what fingerprints take from them."""

from __future__ import annotations

import numpy as np
import xxhash

BITS, SLICE = 64, 1 << 16
SEED = 42


def shingles(text: bytes, words: int) -> list[bytes]:
    """Runs of ``words`` words of an ASCII-lower-cased text, repeats included; the whole sequence if it is shorter."""
    w = text.lower().split()  # on bytes: A-Z only, and at space and 09-0D only
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included."""
    found = shingles(text or b"", words)
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))


def majority(found: np.ndarray) -> int:
    """A signed long whose bits are 1 if set in over half of the hashes; 0 for none."""
    if not len(found):
        return 0
    seen = np.zeros(BITS, np.int64)
    for at in range(0, len(found), SLICE):
        seen += np.unpackbits(found[at : at + SLICE].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(seen * 2 > len(found)).tobytes(), "big", signed=True)
