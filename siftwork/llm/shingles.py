"""Words of a text and hashes of their runs."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def words_of(text: str | None) -> list[bytes]:
    """Runs of non-blank characters (ASCII blanks), A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of all space-joined runs of `size` words; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1:].tolist())),
                       np.uint64, len(words) - size + 1)
