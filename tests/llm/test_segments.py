import numpy as np
import pytest

from harborline.llm.segments import Codes, segments, window_places
from harborline.llm.texts import BYTE_CODE


def by_window(found):
    """Anchor of each window, by its place; each window is in one segment."""
    anchors = {}
    for anchor, begin, windows in zip(found.anchor.tolist(), found.begin.tolist(), found.windows.tolist()):
        for place in range(begin, begin + windows):
            assert place not in anchors
            anchors[place] = anchor
    return anchors


def test_long_stretches_are_cut_and_windows_keep_their_anchors():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    data[2000:2600] = data[100:700]
    codes = Codes(BYTE_CODE[data])
    places = window_places(np.array([0, 1200, 1210, 3000]), 40)
    apart = rng.random(len(places)) < 0.02
    for run in (20, 40):
        for flags in (None, apart):
            whole = segments(codes, places, 40, run, flags)
            for most in (40, 41, 64, 1000):
                cut = segments(codes, places, 40, run, flags, most)
                assert by_window(cut) == by_window(whole) and set(by_window(cut)) == set(places.tolist())
                assert (cut.windows + 39 <= most).all()
                same = {(b, w): c for b, w, c in zip(whole.begin, whole.windows, whole.content)}
                kept = [(b, w, c) for b, w, c in zip(cut.begin, cut.windows, cut.content) if (b, w) in same]
                assert all(same[b, w] == c for b, w, c in kept) and (most < 1000 or kept)
            # In the last round a segment is one window, wherever the cuts are.
            if run == 40:
                assert (whole.windows == 1).all() and (cut.content == whole.content).all()


def test_no_windows_and_stretches_too_short():
    codes = Codes(BYTE_CODE[np.zeros(100, np.uint8)])
    assert len(segments(codes, np.zeros(0, np.int64), 40, 20).begin) == 0
    with pytest.raises(ValueError):
        segments(codes, np.arange(10), 40, 20, most=39)
