"""Content-chosen pieces of texts, for finding long repeats without shuffling every window.

A window is a fixed number of consecutive units (words or bytes). Each window has an anchor: of
the short runs in it, the one with the least code, the leftmost of equals. The anchor depends on the
window's content alone, so equal windows have equal anchors at equal places. Neighbouring windows
mostly share their anchor; the windows with one anchor are a segment. Two windows can be
equal only if their segments' anchors are equal, and if two segments are equal all their windows are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from harborline.llm.texts import WINDOW_BASE, inverse, mix, powers, prefix

PLACE_BITS = 28  # of a unit's place within a stretch, below the leading bits of its code


@dataclass
class Segments:
    anchor: np.ndarray  # code of the anchor's run
    content: np.ndarray  # code of all units of the segment's windows, and of the anchor's place in them
    begin: np.ndarray  # place of the first window
    windows: np.ndarray  # number of windows


class Codes:
    """Codes of runs of units; equal runs have equal codes."""

    def __init__(self, codes: np.ndarray, base: int = WINDOW_BASE):
        self.total = prefix(codes, base)
        self.undo = powers(inverse(base), len(self.total))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[begin]) * self.undo[begin])


def window_places(first: np.ndarray, window: int) -> np.ndarray:
    """Begins of all windows that lie in one text; `first`: begin of each text, one more at the end."""
    size = np.maximum(np.diff(first) - window + 1, 0)
    shift = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first[:-1] - shift, size)


def segments(
    codes: Codes, places: np.ndarray, window: int, run: int, apart: np.ndarray | None = None, most: int = 1 << PLACE_BITS
) -> Segments:
    """Segments of the windows that begin at `places` (rising).

    Windows that do not follow each other directly, or differ in `apart`, are in different segments. So are those
    that more than `most` units, all that a place has bits for, keep apart: longer stretches are cut there. A segment that such a
    cut shortens may differ from its copies; its windows are then compared in the next rounds, so nothing is lost.
    """
    if most < window:
        raise ValueError(f"a stretch of {most} units holds no window of {window}")
    parts, a = [], 0
    while a < len(places):
        b = int(np.searchsorted(places, places[a] + most - window, "right"))
        parts.append(_stretch(codes, places[a:b], window, run, None if apart is None else apart[a:b]))
        a = b
    if not parts:
        none = np.zeros(0, np.int64)
        return Segments(none.view(np.uint64), none.view(np.uint64), none, none)
    if len(parts) == 1:
        return parts[0]
    return Segments(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("anchor", "content", "begin", "windows")])


def _stretch(codes: Codes, places: np.ndarray, window: int, run: int, apart: np.ndarray | None) -> Segments:
    low_at = int(places[0])
    at = np.arange(low_at, int(places[-1]) + window - run + 1)
    value = codes.of(at, at + run)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (value & ~low) | (at - low_at).astype(np.uint64)
    width, reach = window - run + 1, 1
    while reach * 2 <= width:
        least[: len(least) - reach] = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    # Two overlapping stretches of `reach` cover the whole width.
    first = places - low_at
    anchor = (np.minimum(least[first], least[first + width - reach]) & low).astype(np.int64)
    new = np.ones(len(places), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(places) != 1)
    if apart is not None:
        new[1:] |= apart[1:] != apart[:-1]
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(places)))
    begin, place = places[head], anchor[head]
    content = codes.of(begin, begin + count + window - 1)
    content = mix(content ^ ((place + low_at - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return Segments(value[place], content, begin, count)
