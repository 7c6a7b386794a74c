"""Word-aligned coding of token ids: Simple-8b with escapes.

A 64-bit little-endian word has a selector in its top 4 bits and, by selector, so
many ids of equal width in the other 60.  Selector 15 is an escape: the next word
is one raw 64-bit id.  Ids are cut into blocks of BLOCK; no word crosses a block,
and the first word of every block is listed, so blocks are decoded alone and all
words of one selector at once.
"""

from __future__ import annotations

import numpy as np

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE, BLOCK = 15, 4096
_TOP, _DATA = np.uint64(60), np.uint64((1 << 60) - 1)


def _choose(ids: np.ndarray) -> np.ndarray:
    """For every position the selector of a word that starts there: the first, and so
    the fullest, whose next ids all fit and lie in the same block."""
    n = len(ids)
    chosen = np.full(n, ESCAPE, np.uint8)
    left = (BLOCK - np.arange(n, dtype=np.int32) % BLOCK).astype(np.int32)
    left[n - n % BLOCK :] = np.arange(n % BLOCK, 0, -1)
    top = int(ids.max()) if n else 0
    for s in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[s]
        if count > n:
            continue
        if top < 1 << WIDTHS[s]:
            chosen[left >= count] = s
            continue
        fits = ids < (1 << WIDTHS[s])
        if np.count_nonzero(fits) < count:
            continue
        bad = np.concatenate(([0], np.cumsum(~fits, dtype=np.int32)))
        ok = np.flatnonzero((bad[count:] == bad[: n - count + 1]) & (left[: n - count + 1] >= count))
        chosen[ok] = s
    return chosen


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) for ids of any unsigned 64-bit size."""
    n = len(ids)
    if not n:
        return np.empty(0, "<u8"), np.empty(0, np.int32)
    chosen = _choose(ids)
    ids = np.ascontiguousarray(ids, np.uint64)
    steps = np.array((*COUNTS, 1, 1), np.uint8)[chosen].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    selector = chosen[starts]
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(selector == ESCAPE)[:-1]))
    out = np.zeros(len(starts) + int(np.count_nonzero(selector == ESCAPE)), "<u8")
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        if len(at := np.flatnonzero(selector == s)):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            word = np.bitwise_or.reduce(ids[starts[at][:, None] + np.arange(count)] << shifts, axis=1)
            out[place[at]] = word | np.uint64(s) << _TOP
    if len(at := np.flatnonzero(selector == ESCAPE)):
        out[place[at]] = np.uint64(ESCAPE) << _TOP
        out[place[at] + 1] = ids[starts[at]]
    return out, place[np.searchsorted(starts, np.arange(0, n, BLOCK))].astype(np.int32)


def decode(words: np.ndarray) -> np.ndarray:
    """All ids of the words, which may be those of any whole blocks."""
    words = np.ascontiguousarray(words, "<u8")
    selector = (words >> _TOP).astype(np.uint8)
    if (selector == ESCAPE).any():  # the word after an escape is data, whatever its top bits
        raw, i = np.zeros(len(words), np.bool_), 0
        for i in np.flatnonzero(selector == ESCAPE):
            if not raw[i]:
                raw[i + 1] = True
        head = np.flatnonzero(~raw)
    else:
        head = np.arange(len(words))
    selector = selector[head]
    counts = np.array((*COUNTS, 1, 1), np.int64)[selector]
    ends = np.cumsum(counts)
    starts, out = ends - counts, np.empty(ends[-1] if len(ends) else 0, np.uint64)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        if len(at := np.flatnonzero(selector == s)):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            out[starts[at][:, None] + np.arange(count)] = ((words[head[at]] & _DATA)[:, None] >> shifts) & np.uint64((1 << width) - 1)
    if len(at := np.flatnonzero(selector == ESCAPE)):
        out[starts[at]] = words[head[at] + 1]
    return out


def decode_range(words: np.ndarray, first: np.ndarray, start: int, n: int) -> np.ndarray:
    """The n ids from start on, by the words of the blocks that hold them alone."""
    if not n:
        return np.empty(0, np.uint64)
    low, high = start // BLOCK, (start + n - 1) // BLOCK + 1
    ids = decode(words[first[low] : first[high] if high < len(first) else len(words)])
    return ids[start - low * BLOCK : start - low * BLOCK + n]
