"""Word shingles of whole slabs of text, hashed without a Python loop.

Defined results: a text without words (empty, null or white space alone) has no
shingle and the key 0; one with fewer words than a shingle has a single one;
equal texts have equal sets, and so do texts that differ in A-Z and white space only.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import NOT_SPACE, Slab, lowered, mix, runs, span_hash

WORDS = 5
#: Words of more bytes are hashed by themselves: sums of powers modulo 2^64, as
#: ``span_hash`` takes them, are the same for some long words of two letters.
LONG = 64
_WEIGHTS = mix(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(slab: Slab, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and each text's borders.

    A text with fewer words than a shingle has its whole sequence as one; one
    without words has none.
    """
    data = lowered(slab.data)
    starts, ends, first = runs(NOT_SPACE[data], slab.offs)
    h = span_hash(data, starts, ends)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(memoryview(data)[starts[k] : ends[k]])
    n_words = np.diff(first)
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(n)), n)
    borders = np.concatenate([[0], np.cumsum(n)])
    at = first[:-1][doc] + (np.arange(len(doc)) - borders[doc])
    short = n_words[doc] < words
    with np.errstate(over="ignore"):
        padded = np.concatenate([h, np.zeros(words, np.uint64)])
        total = np.zeros(len(doc), np.uint64)
        for k in range(words):
            part = padded[at + k] * _WEIGHTS[k]
            if k:
                part[short & (n_words[doc] <= k)] = 0
            total += part
        total += np.minimum(n_words[doc], words).astype(np.uint64) * _WEIGHTS[-1]
    total = mix(total)
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    total, doc = total[keep], doc[keep]
    return total, np.searchsorted(doc, np.arange(len(n) + 1))


def set_keys(sets: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set; 0 for the empty set."""
    out = []
    for salt in (0x51ED270B7F3A9D11, 0x2545F4914F6CDD1D):
        with np.errstate(over="ignore"):
            cum = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(salt)))])
            out.append((cum[borders[1:]] - cum[borders[:-1]]).view(np.int64))
    return out[0], out[1]
