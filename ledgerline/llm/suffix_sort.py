"""Suffix order by hash comparisons: prefix polynomial hashes, binary search for common extensions, mergesort.

Works on one buffer of many suffixes that belong to groups; only suffixes of a group are compared, all groups at once.
"""

from __future__ import annotations

import copy

import numpy as np

from ledgerline.llm.common import Polynomial, byte_table, same_spans

POLY = Polynomial(0x2D358DCCAA6C78A5)
TABLE = byte_table(9)


class Suffixes:
    """Suffix i is ``buffer[starts[i]:ends[i]]``."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.buffer, self.starts, self.lengths = buffer, starts, ends - starts
        self.prefix = POLY.prefix(TABLE[buffer])

    def only(self, chosen: np.ndarray) -> Suffixes:
        """Some of the suffixes, over the same buffer."""
        out = copy.copy(self)
        out.starts, out.lengths = self.starts[chosen], self.lengths[chosen]
        return out

    def hashes(self, starts: np.ndarray, lengths) -> np.ndarray:
        return POLY.spans(self.prefix, starts, starts + lengths)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes i and j: the largest length at which their prefix hashes agree."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.lengths[i], self.lengths[j])
        a, b = self.starts[i], self.starts[j]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.hashes(a, middle) == self.hashes(b, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Suffix i before suffix j; a proper prefix comes first, equals are not less."""
        n = self.common(i, j)
        ended_i, ended_j = n == self.lengths[i], n == self.lengths[j]
        last = len(self.buffer) - 1
        byte_i = self.buffer[np.minimum(self.starts[i] + n, last)]
        byte_j = self.buffer[np.minimum(self.starts[j] + n, last)]
        return ~ended_j & (ended_i | (byte_i < byte_j))

    def order(self, group_starts: np.ndarray, group_sizes: np.ndarray) -> np.ndarray:
        """A stable mergesort of each group (a run of suffix numbers), all groups level by level.

        At each level an element's place is its rank in its own run plus its rank in the neighbouring run, which a binary
        search finds with comparisons that cost the logarithm of the suffix length.
        """
        order = np.arange(len(self.starts))
        begin, size = np.repeat(group_starts, group_sizes), np.repeat(group_sizes, group_sizes)
        width = 1
        while (active := np.flatnonzero(size > width)).size:
            first, n = begin[active], size[active]
            rank = active - first
            run = rank // width
            other = (run ^ 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            base, left = low.copy(), run % 2 == 0
            own = order[active]
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                theirs = order[first[open_] + middle]
                # Of equals, those of the left run come first.
                ahead = np.where(left[open_], self.less(theirs, own[open_]), ~self.less(own[open_], theirs))
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            place = np.minimum(run, run ^ 1) * width + rank % width + (low - base)
            order[first + place] = own
            width *= 2
        return order


def repeated_windows(buffer: np.ndarray, anchors: np.ndarray, begins: np.ndarray, ends: np.ndarray, groups: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Which windows around the anchors repeat an earlier context of their group.

    Context i is ``buffer[begins[i]:ends[i]]`` with its anchor gram at ``anchors[i]``; contexts come by group, and within a
    group from the earliest on. Returns a table: row i, column o: the window that starts o before the anchor lies in the
    context and equals an earlier context's window at o.
    """
    n, offsets = len(anchors), np.arange(window - gram + 1)
    suffixes = Suffixes(buffer, anchors, ends)
    # Copies of an earlier context repeat it in all their windows, and what else repeats these repeats the first of the copies too.
    copied = _copies(suffixes, begins, groups)
    out = copied[:, None] & ((anchors - begins)[:, None] >= offsets) & ((ends - anchors)[:, None] >= window - offsets)
    own = np.flatnonzero(~copied)
    out[own] = _repeated(suffixes.only(own), anchors[own], begins[own], ends[own], groups[own], window, gram)
    return out


def _copies(suffixes: Suffixes, begins: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which contexts equal an earlier one of their group, with the anchor in the same place; equal by bytes."""
    reach, lengths = suffixes.starts - begins, suffixes.lengths
    keys = POLY.spans(suffixes.prefix, begins, suffixes.starts + lengths) ^ (groups.astype(np.uint64) + (reach * 1024 + lengths).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    first = _first_of(keys)
    again = np.flatnonzero(first != np.arange(len(keys)))
    old = first[again]
    same = (groups[again] == groups[old]) & (reach[again] == reach[old]) & (lengths[again] == lengths[old])
    out = np.zeros(len(keys), bool)
    if same.all() and same_spans(suffixes.buffer, begins[again], begins[old], (reach + lengths)[again]):
        out[again] = True  # otherwise hashes collide: all are compared as different ones
    return out


def _repeated(suffixes: Suffixes, anchors: np.ndarray, begins: np.ndarray, ends: np.ndarray, groups: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The same by suffix order, for contexts of which none equals another."""
    n, reach, buffer = len(anchors), window - gram, suffixes.buffer
    edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    order = suffixes.order(edge, np.diff(np.r_[edge, n]))
    # Common extension with the next smaller suffix of the group.
    shared = np.zeros(n + 1, np.int64)
    later = np.flatnonzero(np.r_[False, groups[1:] == groups[:-1]])
    shared[later] = suffixes.common(order[later - 1], order[later])
    out = np.zeros((n, reach + 1), bool)
    for o in range(reach + 1):
        depth = window - o
        family = np.empty(n, np.int64)
        family[order] = np.cumsum(shared[:-1] < depth)
        several = np.zeros(n, bool)
        several[order] = (shared[:-1] >= depth) | (shared[1:] >= depth)
        at = np.flatnonzero(several & (anchors - begins >= o) & (ends - anchors >= depth))
        if len(at) < 2:
            continue
        # Same right side by suffix order, same left side by hash; the first of equals is the earliest.
        left = suffixes.hashes(anchors[at] - o, o)
        keys = left ^ (family[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = _first_of(keys)
        again = np.flatnonzero(first != np.arange(len(at)))
        if not len(again):
            continue
        starts = anchors[at] - o
        if not _same_bytes(buffer, starts[again], starts[first[again]], window):
            # A collision: decide by the bytes themselves.
            exact = np.ascontiguousarray(buffer[starts[:, None] + np.arange(window)]).view(f"V{window}").ravel()
            first = _first_of(np.unique(exact, return_inverse=True)[1] + (groups[at].astype(np.int64) << 32))
            again = np.flatnonzero(first != np.arange(len(at)))
        out[at[again], o] = True
    return out


def _first_of(keys: np.ndarray) -> np.ndarray:
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return first[inverse]


def _same_bytes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> bool:
    spans = np.ndarray(len(buffer) - length + 1, f"V{length}", np.ascontiguousarray(buffer), strides=(1,))
    return all(spans[a[k : k + 20_000]].tobytes() == spans[b[k : k + 20_000]].tobytes() for k in range(0, len(a), 20_000))
