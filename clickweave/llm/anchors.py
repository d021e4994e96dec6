"""Anchors: content-chosen places through which equal windows of two texts can be found.

A window is ``length`` units (bytes or words) in a row. Of the ``gram``-unit stretches inside a window the one with the least hash (the
first of equals) is its anchor. Equal windows have equal anchors at the same place, so windows need only be compared where anchors are
equal. Neighbouring windows share an anchor for a while: an anchor stands for the span of all windows that it belongs to.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from clickweave.llm.bytescan import Hashes

_PLACE = 24  # bits for the place in a chunk


class Anchors(NamedTuple):
    """One entry per anchor: its text, its place, the first window and the last one that it belongs to (places in the chunk)."""

    text: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gram_hash: np.ndarray
    span_hash: np.ndarray


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.int64).max)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def find_anchors(units: Hashes, bounds: np.ndarray, length: int, gram: int) -> Anchors:
    """Anchors of texts laid end to end, of which text i has the units ``bounds[i]`` to ``bounds[i + 1]``."""
    n, width = int(bounds[-1]), length - gram + 1
    if n < length or n >= 1 << _PLACE:
        if n >= 1 << _PLACE:
            raise ValueError("a text is too long for anchors")
        empty = np.zeros(0, np.int64)
        return Anchors(empty, empty, empty, empty, empty, empty)
    places = np.arange(n - gram + 1)
    ranked = (units.of(places, places + gram) >> np.uint64(_PLACE + 1)).astype(np.int64) << _PLACE | places
    anchor = _sliding_least(ranked, width) & ((1 << _PLACE) - 1)
    starts = np.arange(len(anchor))
    text = np.searchsorted(bounds, starts, "right") - 1
    whole = starts + length <= bounds[text + 1]
    starts, text, anchor = starts[whole], text[whole], anchor[whole]
    if not len(starts):
        return Anchors(*[np.zeros(0, np.int64)] * 6)
    turn = np.ones(len(starts), bool)
    turn[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(turn)
    low, high, at = starts[first], starts[np.append(first[1:], len(starts)) - 1], anchor[first]
    return Anchors(text[first], at, low, high, units.of(at, at + gram).astype(np.int64), units.of(low, high + length).astype(np.int64))
