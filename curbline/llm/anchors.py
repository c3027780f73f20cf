"""Windows of a sequence grouped by locally chosen anchors.

The anchor of a window is the place of the least hash among the short grams inside it.
It depends on the window's content alone, so equal windows have equal anchors at equal
offsets, and a window can only recur where its anchor's gram recurs. Windows in a row with
the same anchor place form a run. Equal runs hold equal windows, and different runs with the
same anchor gram may share some. So whole runs are compared first, and single windows only
where runs differ. Every window belongs to exactly one run: the thinning loses nothing.
"""

from __future__ import annotations

import secrets

import numpy as np

from .buffers import Rolling, least_in_windows


def drawn_seed() -> int:
    """A seed of 64 bits for the hashes of one job, so that no text can be built to collide."""
    return secrets.randbits(64)


def runs(values: np.ndarray, bounds: np.ndarray, window: int, gram: int, base: int):
    """(text, first, count, anchor, at) arrays, one entry per run.

    ``values`` are the texts' elements one after the other, ``bounds`` where texts begin and
    end. ``first`` is the first window's place in ``values``, ``count`` the number of windows,
    ``anchor`` the hash of the anchor's gram, ``at`` its place in ``values``.
    """
    none = np.zeros(0, np.int64)
    if len(values) < window:
        return none, none, none, none.astype(np.uint64), none
    grams = Rolling(values, base).windows(gram)
    place = least_in_windows(grams, window - gram + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(text[: len(place)] == text[window - 1 : window - 1 + len(place)])
    if not len(inside):
        return none, none, none, none.astype(np.uint64), none
    anchor = place[inside]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1))))
    count = np.diff(np.concatenate((new, [len(inside)])))
    first = inside[new]
    return text[first], first, count, grams[anchor[new]], anchor[new]
