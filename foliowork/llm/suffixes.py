"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

Suffixes are classified; the leftmost-smaller (LMS) substrings are sorted by inducing; if two are equal, the string of their
names is sorted recursively; and the order of the LMS suffixes induces that of all. Inducing goes bucket by bucket,
and in a bucket wave by wave, so that each step moves an array. To keep buckets few, names above the alphabet's
limit are written as two digits, which keeps their order.
"""

from __future__ import annotations

import numpy as np

#: Buckets at most; a name beyond it becomes two digits.
LIMIT = 2048


def _induce(s: np.ndarray, larger: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of LMS suffixes induces. `larger`: suffix i is above i + 1."""
    sa = np.full(len(s), -1, dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    letters = s[lms]
    by_letter = np.argsort(letters, kind="stable")
    counts = np.bincount(letters, minlength=len(ends))
    seeds, first = lms[by_letter], np.cumsum(counts) - counts
    head = starts.copy()

    def push(found: np.ndarray) -> None:
        found = found[found > 0] - 1
        found = found[larger[found]]
        if len(found):
            c = s[found]
            order = np.argsort(c, kind="stable")
            found, c = found[order], c[order]
            cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            size = np.diff(np.append(cut, len(c)))
            sa[np.repeat(head[c[cut]] - cut, size) + np.arange(len(c))] = found
            head[c[cut]] += size

    used = np.flatnonzero(ends > starts)
    for c in used:
        at = starts[c]
        while at < head[c]:
            at, wave = head[c], sa[at : head[c]]
            push(wave)
        if counts[c]:
            push(seeds[first[c] : first[c] + counts[c]])

    tail = ends.copy()

    def pull(found: np.ndarray) -> None:
        found = found[found > 0] - 1
        found = found[~larger[found]]
        if len(found):
            c = s[found]
            order = np.argsort(c, kind="stable")
            found, c = found[order], c[order]
            cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            size = np.diff(np.append(cut, len(c)))
            sa[np.repeat(tail[c[cut]] - 1 + cut, size) - np.arange(len(c))] = found
            tail[c[cut]] -= size

    last = len(s) - 1  # the end mark is the one suffix that nothing induces
    sa[0], tail[s[last]] = last, tail[s[last]] - 1
    for c in used[::-1]:
        at = ends[c]
        while tail[c] < at:
            at, wave = tail[c], sa[tail[c] : at]
            pull(wave[::-1])
        pull(sa[starts[c] : head[c]][::-1])
    return sa


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string that would not get shorter by recursion. Only suffixes that are still tied are sorted again."""
    n, step = len(names), 1
    order = np.argsort(names, kind="stable")
    rank, tied, key = np.empty(n, dtype=np.int64), np.arange(n), names[order]
    while True:
        # `key` orders the suffixes at the places `tied` of the order; equal keys share the rank of the first place.
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        alone = first & np.append(first[1:], True)
        tied = tied[~alone]
        if not len(tied):
            return order
        own = order[tied]
        second = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + second
        sorted_ = np.argsort(key, kind="stable")
        order[tied], key, step = own[sorted_], key[sorted_], step * 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `s` in order. `s` holds small numbers and ends with its only 0."""
    s = s.astype(np.uint16)
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    ends = np.cumsum(np.bincount(s)).astype(np.int64)
    # Suffix i is larger than i + 1 if its first letter that differs from the next is; runs of one letter decide together.
    change = s[:-1] != s[1:]
    ends_run = np.flatnonzero(change)
    larger = np.zeros(n, dtype=bool)
    larger[:-1] = np.repeat(s[ends_run] > s[ends_run + 1], np.diff(ends_run, prepend=-1))
    is_lms = np.zeros(n, dtype=bool)
    is_lms[1:] = larger[:-1] & ~larger[1:]
    lms = np.flatnonzero(is_lms)
    sa = _induce(s, larger, lms, ends)
    if len(lms) < 2:
        return sa
    ordered = sa[is_lms[sa]]
    length = np.diff(np.append(lms, n))  # to the next one, whose first letter belongs to both
    place = np.zeros(n, dtype=np.int64)
    place[lms] = np.arange(len(lms))
    own = length[place[ordered]] + 1
    own[ordered == n - 1] = 1
    differ = np.ones(len(ordered), dtype=bool)
    pair = np.flatnonzero(own[1:] == own[:-1]) + 1
    differ[pair] = False
    at, left = 0, pair
    while len(left):
        left = left[own[left] > at]
        a, b = ordered[left] + at, ordered[left - 1] + at
        unequal = (s[a] != s[b]) | (larger[a] != larger[b])
        differ[left[unequal]] = True
        left, at = left[~unequal], at + 1
    names = np.empty(len(lms), dtype=np.int64)
    names[place[ordered]] = np.cumsum(differ) - 1
    top = int(names.max()) + 1
    if top < len(lms):
        if top <= LIMIT:
            order = suffix_array(names)
        elif top <= LIMIT * LIMIT and 2 * len(lms) < 0.9 * n:
            digits = np.stack((names // LIMIT + 1, names % LIMIT + 1), axis=1).ravel()
            deeper = suffix_array(np.append(digits, 0))
            deeper = deeper[(deeper % 2 == 0) & (deeper < len(digits))]
            order = deeper // 2
        else:
            order = _by_doubling(names)
        ordered = lms[order]
    return _induce(s, larger, ordered, ends)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start in text order: the start before it in `sa` (-1 for the first), and the bytes that both share.

    Prefixes are counted up to `most`, where both starts are `valid`: have as many bytes before them. Others count as 0. Eight
    bytes are compared at a time, and starts whose bytes have differed drop out.
    """
    before = np.full(len(text), -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(len(text), dtype=np.int64)
    here = np.flatnonzero(valid & (before >= 0))
    here = here[valid[before[here]]]
    other = before[here]
    words = np.ndarray(len(text) + 1, dtype="<u8", buffer=np.concatenate((text, np.zeros(8, dtype=np.uint8))), strides=(1,))
    for at in range(0, most, 8):
        differ = words[here + at] ^ words[other + at]
        alike = differ == 0
        bits = differ[~alike]
        lowest = np.frexp((bits & (~bits + np.uint64(1))).astype(np.float64))[1] - 1  # the first bit in which they differ
        plcp[here[~alike]] = at + lowest // 8
        here, other = here[alike], other[alike]
    plcp[here] = most
    return before, np.minimum(plcp, most)


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of its strings of `length` bytes that occur at another place in these texts too."""
    sizes = np.array([len(x) for x in texts])
    # Every text is closed by a mark of its own kind, and the last by the end mark; both are below all bytes.
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    letters = data.astype(np.uint16) + 2
    stops = np.cumsum(sizes + 1) - 1
    letters[stops] = 1
    sa = suffix_array(np.append(letters, 0))[1:]
    starts = stops - sizes
    valid = np.zeros(len(data) + 1, dtype=np.int64)
    fits = sizes >= length
    np.add.at(valid, starts[fits], 1)
    np.add.at(valid, (stops - length + 1)[fits], -1)
    valid = np.cumsum(valid[:-1]) > 0
    before, shared = permuted_common_prefixes(data, sa, length, valid)
    same = np.flatnonzero(shared >= length)
    found = np.zeros(len(data), dtype=bool)
    found[same] = found[before[same]] = True
    return [np.flatnonzero(found[a:b]) for a, b in zip(starts, stops, strict=True)]
