"""Simple-8b: varying counts of small numbers in 64-bit words."""

from __future__ import annotations

import numpy as np

#: Fixed values: (numbers, bits each) of selectors 1 to 15; selector 0 is an escape.
SELECTORS = (
    (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
_TOP = np.uint64(60)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped): each word takes as many of the next values as fit one selector.

    Values of more than 60 bits go whole into escaped; their word holds their
    place there.
    """
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    bits = np.zeros(n, np.uint8)
    top = int(values.max()).bit_length()
    for b in range(top):
        bits += values >= np.uint64(1 << b)
    # most[w][i]: the widest among the w values from i; beyond the end nothing fits
    most = {1: np.r_[bits, np.full(128, 255, np.uint8)]}
    for w in (1, 2, 4, 8, 16, 32):
        a = most[w]
        most[2 * w] = np.maximum(a[:-w], a[w:])
    choice = np.zeros(n, np.uint8)
    for s in range(len(SELECTORS), 0, -1):
        count, wide = SELECTORS[s - 1]
        half = 1 << (count.bit_length() - 1)
        a = most[half]
        fits = np.maximum(a[:n], a[count - half : count - half + n]) <= wide if count > half else a[:n] <= wide
        choice[fits] = s
    step = np.array([1, *(c for c, _ in SELECTORS)])[choice].tolist()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << _TOP
    for s, (count, wide) in enumerate(SELECTORS, 1):
        mine = np.flatnonzero(chosen == s)
        if len(mine) and wide:
            for k in range(count):
                words[mine] |= values[starts[mine] + k] << np.uint64(k * wide)
    mine = np.flatnonzero(chosen == 0)
    words[mine] = np.arange(len(mine), dtype=np.uint64)
    return words, values[starts[mine]]


def unpack(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The values of packed words, all words of a selector at once."""
    chosen = (words >> _TOP).astype(np.int64)
    counts = np.array([1, *(c for c, _ in SELECTORS)])[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = ends - counts
    for s, (count, wide) in enumerate(SELECTORS, 1):
        mine = np.flatnonzero(chosen == s)
        if len(mine) and wide:
            mask = np.uint64((1 << wide) - 1)
            for k in range(count):
                out[begins[mine] + k] = (words[mine] >> np.uint64(k * wide)) & mask
    mine = np.flatnonzero(chosen == 0)
    if len(mine):
        out[begins[mine]] = escaped[words[mine].astype(np.int64)]
    return out
