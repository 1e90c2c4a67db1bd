"""Anchors: a content-chosen subset of places that every window of a given length can be found by.

Each window takes the least of the hashes of its k-grams (the leftmost of equal ones).  Equal
windows take equal k-grams at equal places, so only windows of one anchor need to be compared, and
windows that follow one another mostly share their anchor: about 2/(window - k + 2) of the places
of a text are anchors.
"""

from __future__ import annotations

import numpy as np

LOW = 7  # bits that hold a place within two blocks
#: The most places that an anchor can have in its window; longer windows take longer anchors.
PLACES = 63


def anchor_length(window: int, least: int) -> int:
    """The length of anchors for a window: ``least``, or what leaves ``PLACES`` places."""
    if window <= least:
        raise ValueError(f"a window is longer than {least}")
    return max(least, window - PLACES + 1)


def anchored_runs(hashes: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of all runs of windows with one anchor.

    ``hashes[i]`` is of the k-gram that starts at i (what stands for k-grams that leave their text
    doesn't matter); text t covers places bounds[t]:bounds[t+1]; no window leaves its text.
    """
    w, n = window - k + 1, int(bounds[-1])
    if not 0 < w <= PLACES:
        raise ValueError(f"an anchor has 1 to {PLACES} places in its window, not {w}")
    if n < window:
        return (np.zeros(0, np.int64),) * 3
    rows = -(-n // w) + 1
    padded = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    m = min(n, len(hashes))
    padded[:m] = hashes[:m]
    padded = ((padded >> np.uint64(LOW)) << np.uint64(LOW)).reshape(rows, w)
    place = np.arange(w, dtype=np.uint64)
    tail = np.minimum.accumulate((padded | place)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    head = np.minimum.accumulate(padded | (place + np.uint64(w)), axis=1).reshape(-1)
    last = n - window + 1
    least = np.minimum(tail[:last], head[w - 1 : w - 1 + last])
    valid = np.ones(last, bool)
    for b in bounds[1:-1].tolist():
        valid[max(0, b - window + 1) : b] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    anchor = (at // w) * w + (least[at] & np.uint64((1 << LOW) - 1)).astype(np.int64)
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    begin, end = np.concatenate([[0], change]), np.concatenate([change, [len(at)]]) - 1
    return at[begin], at[end], anchor[begin]
