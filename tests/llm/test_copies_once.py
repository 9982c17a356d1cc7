"""Copies of a context are verified once, not at each of their windows; removal digests only anchors whose gram repeats in the row."""

import numpy as np

from ledgerline.llm import suffix_dedup, suffix_sort


def test_copies_are_not_compared_window_by_window(monkeypatch):
    """300 copies of one context, some cut short, and others that share a part with it; fails where every window of a copy is verified."""
    rng = np.random.default_rng(3)
    window, gram, reach = 100, 40, 60
    base = rng.integers(0, 256, 160, np.uint8)
    parts, groups, anchors = [], [], []
    for k in range(320):
        body = base.copy()
        if k % 16 == 7:
            body[rng.integers(0, 60)] ^= 1
        if k % 16 == 9:
            body[rng.integers(100, 160)] ^= 1
        low, high = (rng.integers(0, 30), 160 - rng.integers(0, 30)) if k % 16 == 11 else (0, 160)
        parts.append(body[low:high])
        anchors.append(reach - low)
        groups.append(k // 160)
    ends = np.cumsum([len(p) for p in parts])
    begins = ends - [len(p) for p in parts]
    buffer, groups, anchors = np.concatenate(parts), np.array(groups), begins + anchors
    seen = []
    verify = suffix_sort._same_bytes
    monkeypatch.setattr(suffix_sort, "_same_bytes", lambda data, a, b, length: seen.append(len(a)) or verify(data, a, b, length))
    found = suffix_sort.repeated_windows(buffer, anchors, begins, ends, groups, window, gram)
    known, want = set(), np.zeros_like(found)
    for i in range(len(anchors)):
        for o in range(reach + 1):
            if anchors[i] - o >= begins[i] and anchors[i] - o + window <= ends[i]:
                key = (groups[i], o, buffer[anchors[i] - o : anchors[i] - o + window].tobytes())
                want[i, o] = key in known
                known.add(key)
    assert (found == want).all() and found.any() and not found[0].any()
    assert sum(seen) < 0.3 * found.sum()


def test_colliding_copies_are_compared_as_others(monkeypatch):
    """Keys that agree for different contexts give up the short way, not the result."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 256, 160, np.uint8) for _ in range(4)]
    buffer = np.concatenate([texts[0], texts[1], texts[0], texts[2], texts[3], texts[1]])
    begins = np.arange(6) * 160
    arguments = (buffer, begins + 60, begins, begins + 160, np.zeros(6, np.int64), 100, 40)
    plain = suffix_sort.repeated_windows(*arguments)
    monkeypatch.setattr(suffix_sort, "_copies", lambda suffixes, begins, groups: np.zeros(len(begins), bool))
    assert (suffix_sort.repeated_windows(*arguments) == plain).all() and plain.sum() == 2 * 61


def test_anchors_within_a_row():
    rng = np.random.default_rng(5)
    once, twice = rng.integers(0, 256, 3000, np.uint8), rng.integers(0, 256, 400, np.uint8)
    data = np.concatenate([once, twice, once[:900], twice, rng.integers(0, 256, 500, np.uint8)])
    offsets = np.array([0, 3000, 3400, len(data)])  # the second row stands once in itself, and so does the third
    all_of, some = suffix_dedup.Anchors(data, offsets, 100), suffix_dedup.Anchors(data, offsets, 100, within=True)
    repeats = lambda x: sorted(zip(x.row[x.repeats(x.row)].tolist(), x.place[x.repeats(x.row)].tolist()))
    assert repeats(some) == repeats(all_of) == [] and len(some.row) < len(all_of.row)
    offsets = np.array([0, len(data)])
    all_of, some = suffix_dedup.Anchors(data, offsets, 100), suffix_dedup.Anchors(data, offsets, 100, within=True)
    assert repeats(some) == repeats(all_of) != [] and len(some.row) < len(all_of.row)
