"""Suffix ranks of one string by the difference cover {1, 2} mod 3, as array operations."""

from __future__ import annotations

import numpy as np


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys without gaps, equal keys alike, from 0 on."""
    return np.unique(keys, return_inverse=True)[1].reshape(-1).astype(np.int64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integers in the order of (a, b)."""
    span = int(b.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * span >= 1 << 62:
        a = _dense(a)
    return a * span + b


class _Sorted:
    """Keys with their order, so that counts run over sorted keys on both sides."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def before(self, other: _Sorted | None = None) -> np.ndarray:
        """For each key the number of smaller ones among the others (or its own)."""
        out = np.empty(len(self.keys), dtype=np.int64)
        out[self.order] = np.searchsorted((other or self).keys, self.keys, side="left")
        return out


def suffix_ranks(symbols: np.ndarray, width: int, depth: int = 1) -> np.ndarray:
    """For each position the number of suffixes before it, as far as ``width`` first symbols tell.

    symbols are whole numbers from 0 on, 0 marking ends; one symbol stands for ``depth`` first ones.
    Sampled positions (1 and 2 mod 3) are named by their triples; if names repeat and triples do not
    cover the width yet, the string of names is ranked by recursion.  The other positions follow from
    their first symbol and the rank behind it, and all are merged by counting.
    """
    n = len(symbols)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(3, dtype=np.int64)])
    triple = lambda at: _pair(_pair(s[at], s[at + 1]), s[at + 2])
    if depth * 3 >= width or n < 3:
        return _Sorted(triple(np.arange(n))).before()
    zero, one, two = (np.arange(k, n, 3) for k in range(3))
    names = _dense(triple(np.concatenate([one, two]))) + 1
    if int(names.max()) < len(names):
        gap = np.zeros(3, dtype=np.int64)
        below = suffix_ranks(np.concatenate([names[: len(one)], gap, names[len(one) :]]), width, depth * 3)
        sample = _dense(np.concatenate([below[: len(one)], below[len(one) + 3 :]])) + 1
    else:
        sample = names
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[one], rank[two] = sample[: len(one)], sample[len(one) :]
    # At 0 and 1 mod 3 the rank behind the first symbol is known, at 0 and 2 mod 3 that behind the second.
    by_one = _pair(np.concatenate([s[zero], s[one]]), np.concatenate([rank[zero + 1], rank[one + 1]]))
    heads = _pair(np.concatenate([s[zero], s[two]]), np.concatenate([s[zero + 1], s[two + 1]]))
    by_two = _pair(heads, np.concatenate([rank[zero + 2], rank[two + 2]]))
    zero_one, one_one, zero_two, two_two = (_Sorted(k) for k in (by_one[: len(zero)], by_one[len(zero) :], by_two[: len(zero)], by_two[len(zero) :]))
    by_sample = _Sorted(sample).before()
    out = np.empty(n, dtype=np.int64)
    out[zero] = zero_one.before() + zero_one.before(one_one) + zero_two.before(two_two)
    out[one] = by_sample[: len(one)] + one_one.before(zero_one)
    out[two] = by_sample[len(one) :] + two_two.before(zero_two)
    return out
