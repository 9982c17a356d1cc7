"""The join of one shard of operator 11: sets of token hashes, all pairs that reach the similarity, by set-relation skipping.

Index-level skipping: the lists of an inverted index over prefixes are cut into blocks in the order of position, and a probe passes over a block whose
first position, or whose sizes, leave no room for the overlap that is needed. Answer-level skipping: a set reached over a link is highly similar
to the set it was reached from, so its overlaps with all others are derived from that set's, by the lists of the few tokens in which the two
differ. As links are wanted up to connection, sets that are connected already are asked no more.

Similarity is ``100 * intersection >= percent * union``, in integers throughout.
"""

from __future__ import annotations

import numpy as np

from ledgerline.llm.common import ranges, runs_of

BLOCK = 32
#: Members whose answers are kept at a time, a number for each set.
KEPT = 64


def needed(a, b, percent: int):
    """The smallest intersection of sets of these sizes that reaches the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size, percent: int):
    """So many first tokens, in any order common to all sets, that two similar sets share one of them."""
    return size - -(-percent * size // 100) + 1


class SetIndex:
    """Sets of one shard: whole lists (token to members), and lists of prefixes in blocks by position."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, len(sets)
        self.sizes = np.fromiter(map(len, sets), np.int64, self.n)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        member = np.repeat(np.arange(self.n), self.sizes)
        # Tokens by number, rare ones first; each set's numbers in ascending order.
        _, number, often = np.unique(tokens, return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        number = rank[number]
        order = np.lexsort((number, member))
        self.tokens, self.cuts = number[order], np.r_[0, np.cumsum(self.sizes)]
        by_token = np.lexsort((member, number))
        self.members, self.lists = member[by_token], np.searchsorted(number[by_token], np.arange(len(often) + 1))
        self._prefixes()

    def own(self, i: int) -> np.ndarray:
        return self.tokens[self.cuts[i] : self.cuts[i + 1]]

    def _prefixes(self) -> None:
        lengths = np.where(self.sizes > 0, prefix_length(self.sizes, self.percent), 0)
        at = ranges(self.cuts[:-1], lengths)
        member = np.repeat(np.arange(self.n), lengths)
        position, token = at - self.cuts[:-1][member], self.tokens[at]
        order = np.lexsort((self.sizes[member], position, token))
        self.p_member, self.p_position, token = member[order], position[order], token[order]
        self.p_lists = np.searchsorted(token, np.arange(len(self.lists)))
        # Blocks of a list: its entries stand by position, so a block's first one bounds it.
        heads, tails = runs_of(token)
        counts = -(-(tails - heads) // BLOCK)
        self.b_start = np.repeat(heads, counts) + BLOCK * (ranges(np.zeros(len(counts), np.int64), counts))
        self.b_stop = np.minimum(self.b_start + BLOCK, np.repeat(tails, counts))
        size = self.sizes[self.p_member]
        self.b_least, self.b_most = (f.reduceat(size, self.b_start) if len(self.b_start) else size for f in (np.minimum, np.maximum))
        self.b_first = self.p_position[self.b_start] if len(self.b_start) else size
        self.b_lists = np.searchsorted(self.b_start, self.p_lists)

    def candidates(self, i: int) -> np.ndarray:
        """Members that may be similar to member i: the blocks of its prefix's lists that position and size leave open."""
        size = int(self.sizes[i])
        if not size:
            return np.empty(0, np.int64)
        prefix = self.own(i)[: prefix_length(size, self.percent)]
        low, high = self.b_lists[prefix], self.b_lists[prefix + 1]
        block, place = ranges(low, high - low), np.repeat(np.arange(len(prefix)), high - low)
        room = 1 + np.minimum(size - place - 1, self.b_most[block] - self.b_first[block] - 1)
        open_ = (100 * self.b_most[block] >= self.percent * size) & (100 * size >= self.percent * self.b_least[block]) & (room >= needed(size, self.b_least[block], self.percent))
        block, place = block[open_], place[open_]
        lengths = self.b_stop[block] - self.b_start[block]
        entry, place = ranges(self.b_start[block], lengths), np.repeat(place, lengths)
        other = self.p_member[entry]
        theirs = self.sizes[other]
        room = 1 + np.minimum(size - place - 1, theirs - self.p_position[entry] - 1)
        return np.unique(other[room >= needed(size, theirs, self.percent)])

    def similar(self, i: int, overlaps: np.ndarray, others: np.ndarray) -> np.ndarray:
        return others[overlaps >= needed(self.sizes[i], self.sizes[others], self.percent)]

    def overlap(self, i: int, others: np.ndarray) -> np.ndarray:
        """Exact overlaps with some members."""
        mark = np.zeros(len(self.lists) - 1, bool)
        mark[self.own(i)] = True
        lengths = self.sizes[others]
        hits = np.r_[0, np.cumsum(mark[self.tokens[ranges(self.cuts[others], lengths)]])]
        ends = np.cumsum(lengths)
        return hits[ends] - hits[ends - lengths]

    def _count(self, tokens: np.ndarray) -> np.ndarray:
        return np.bincount(self.members[ranges(self.lists[tokens], self.lists[tokens + 1] - self.lists[tokens])], minlength=self.n)

    def answers(self, i: int) -> np.ndarray:
        """Overlaps with every member, from the whole lists."""
        return self._count(self.own(i))

    def derived(self, i: int, other: int, answers: np.ndarray) -> np.ndarray:
        """Overlaps of member i with every member, from those of another one: only the tokens in which the two differ are looked up."""
        own, theirs = self.own(i), self.own(other)
        return answers + self._count(np.setdiff1d(own, theirs, assume_unique=True)) - self._count(np.setdiff1d(theirs, own, assume_unique=True))


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Similar pairs, fewer than there are sets, that connect what all similar pairs connect. Equal sets are similar, empty ones are not."""
    index, out = SetIndex(sets, percent), []
    fresh = index.sizes > 0
    for seed in range(index.n):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        others = index.candidates(seed)
        others = others[fresh[others]]
        if not len(others) or not len(index.similar(seed, index.overlap(seed, others), others)):
            continue
        # From here on by answers: those of the seed are counted, the others derived along the links (or counted, where the member's before are not kept).
        stack: list[tuple[list[int], int, np.ndarray | None]] = [([seed], seed, None)]
        while stack:
            waiting, before, answers = stack[-1]
            at = waiting.pop()
            if not waiting:
                stack.pop()
            left = np.flatnonzero(fresh)
            if not len(left):
                break
            answers = index.answers(at) if answers is None else index.derived(at, before, answers)
            near = index.similar(at, answers[left], left)
            fresh[near] = False
            out += [(at, x) for x in near.tolist()]
            if len(near):
                stack.append((near.tolist(), at, answers if len(stack) < KEPT else None))
    return out
