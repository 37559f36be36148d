"""Sets of hashed word shingles of a batch of texts, without a Python step per word."""

from __future__ import annotations

import numpy as np

GOLDEN, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each text of an Arrow array: uint64 hashes, ascending within each text, and offsets.

    A-Z are lowered; words are split at ASCII blanks. A text with fewer words
    gives its whole sequence as one shingle; without words or null, none.
    """
    import pyarrow.compute as pc
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    by_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    filled = np.fromiter((bool(w) for w in words), bool, len(words))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = filled[codes] if len(codes) else np.zeros(0, bool)
    doc, w = doc[real], by_word[codes[real]] if len(codes) else np.zeros(0, np.uint64)
    n_words = np.bincount(doc, minlength=len(texts))
    if len(w) >= k:
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h = mix(h + w[j : len(w) - k + 1 + j])
        inside = doc[: len(h)] == doc[k - 1 :]
        h, d = h[inside], doc[: len(h)][inside]
    else:
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        starts = np.cumsum(n_words) - n_words
        extra = []
        for i in short:
            x = np.full(1, n_words[i], np.uint64)
            for v in w[starts[i] : starts[i] + n_words[i]]:
                x = mix(x ^ v)
            extra.append(x[0])
        h, d = np.concatenate((h, np.array(extra, np.uint64))), np.concatenate((d, short))
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[first], d[first]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=len(texts)))))
    return h, offsets
