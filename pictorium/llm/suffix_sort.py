"""Suffix arrays by two-stage sorting, a whole array operation at a time, and repeated windows from them."""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as a big-endian number; ``text`` ends in padding."""
    t = text.astype(np.uint64)
    pad = np.concatenate((t, np.zeros(8, np.uint64)))
    out = np.zeros(len(t), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | pad[k : k + len(t)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than the one after it."""
    step = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return np.concatenate((np.append(step, -1)[nearest] > 0, [False]))


def direct_sort(starts: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` by their first ``depth`` bytes; only ties are looked at again."""
    order = starts[np.argsort(words[starts], kind="stable")]
    edge = words[order[1:]] != words[order[:-1]]
    for d in range(8, depth, 8):
        group = np.concatenate(([0], np.cumsum(edge)))
        tied = np.zeros(len(order), bool)
        tied[1:] |= ~edge
        tied[:-1] |= ~edge
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = words[np.minimum(order[at] + d, len(words) - 1)]
        sub = np.lexsort((key, group[at]))
        order[at] = order[at][sub]
        key, g = key[sub], group[at]
        new = np.flatnonzero((at[1:] == at[:-1] + 1) & (g[1:] == g[:-1]) & (key[1:] != key[:-1]))
        edge[at[new]] = True
    return order


def suffix_array(text: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` by the first ``depth`` bytes of their suffixes.

    Suffixes smaller than their successors are sorted directly. Every other one follows its
    first byte's bucket in the order of its successor, which stands before it: buckets are
    scanned upwards, and in a bucket shorter runs of its byte come first.
    """
    n = len(text)
    small = smaller_than_next(text)
    direct = direct_sort(np.flatnonzero(small), words, depth) if small.any() else np.zeros(0, np.int64)
    rank = np.full(n + 1, -1, np.int64)
    large = np.flatnonzero(~small)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    run = change[np.searchsorted(change, large)] - large
    by = np.lexsort((run, text[large]))
    large, run = large[by], run[by]
    edges = np.append(np.flatnonzero((text[large[1:]] != text[large[:-1]]) | (run[1:] != run[:-1])) + 1, len(large))
    ends = np.searchsorted(text[direct], np.arange(257))
    sa, at, k, byte = np.empty(n, np.int64), 0, 0, 0
    for e in edges:
        group = large[k:e]
        while byte < text[group[0]]:
            own = direct[ends[byte] : ends[byte + 1]]
            sa[at : at + len(own)], rank[own] = own, np.arange(at, at + len(own))
            at, byte = at + len(own), byte + 1
        group = group[np.argsort(rank[group + 1], kind="stable")]
        sa[at : at + len(group)], rank[group] = group, np.arange(at, at + len(group))
        at, k = at + len(group), e
    own = direct[ends[byte] :]
    sa[at : at + len(own)] = own
    return sa


def common_prefixes(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that neighbours of ``order`` share from their start, in eights and, at the end, ``depth`` at most."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for d in range(0, depth, 8):
        unused = np.uint64(8 * max(0, d + 8 - depth))  # bits of the last word beyond depth
        live = live[words[a[live] + d] >> unused == words[b[live] + d] >> unused]
        out[live] = min(d + 8, depth)
    return out


def repeated_windows(contents: list[bytes], owned: list[int], window: int) -> list[np.ndarray]:
    """For each content, which of its first ``owned`` starts has its ``window`` bytes at another owned start of any content."""
    sizes = np.array([len(c) for c in contents])
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join(contents) + b"\0" * (window + 16), np.uint8)
    words = words_at(text)
    order = suffix_array(text, words, window)
    own = np.zeros(len(text), bool)
    for s, n in zip(starts, owned, strict=True):
        own[s : s + n] = True
    order = order[own[order]]
    same = common_prefixes(order, words, window) >= window
    twice = np.zeros(len(text), bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    return [twice[s : s + n] for s, n in zip(starts, owned, strict=True)]
