"""Operator 9, benchmark decontamination: greedy string tiling with running Karp-Rabin hashes.

Words are runs of letters and digits, A-Z lower-cased. Rolling hashes of every ``least`` words of a document are joined with
those of the benchmark. An item counts as leaked if tiles cover ``coverage`` of its words, and words are covered by shared seeds
only; so of each item only its rarest seeds are listed, as many as it takes that the others alone cannot cover enough. A shared
listed seed makes the pair of document and item a candidate: a phrase that many items share makes none by itself.

A candidate's matches are found from their first words on: places with equal seeds but different words before them. So a
word repeated n times does not make n * n pairs. How far each match goes is a binary search over running Karp-Rabin hashes. The tiling
marks the longest unmarked match again and again (what a mark cuts goes back as its unmarked parts, down to ``least``). Tiles
never overlap and may come in any order, so passages whose parts were moved are still covered.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text (or one item), one at a time: each block is a pass over the
documents, which are never shuffled, and is destroyed before the next one is made. One block is the usual case.

Nulls: a null text has no words; a null document id is returned as null. Items with fewer than ``least`` words are never
reported. Repeated rows are reported each. An empty table on either side gives no rows, or every document kept. ``clean``
keeps all columns, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Polynomial, cut, mix, ranges, remove_path, shared_path, text_bytes, text_slices, word_digests, word_spans

LEAST, COVERAGE = 5, 0.6
BLOCK_BYTES = 16 << 20
POLY = Polynomial(0xE7037ED1A0B428DB)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and where each row's words start (one entry more than rows)."""
    data, offsets = text_bytes(column)
    data = FOLD[data]
    starts, ends, rows = word_spans(data, offsets, NOT_WORD)
    return word_digests(data, starts, ends)[:, 0].copy(), np.searchsorted(rows, np.arange(len(offsets)))


def _seeds(words: np.ndarray, bounds: np.ndarray, least: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ``least`` words lie in one row, and the rolling hash of these words."""
    if len(words) < least:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(row[: len(words) - least + 1] == row[least - 1 :])
    return at, mix(POLY.spans(prefix, at, at + least))


class Texts:
    """The words of several texts with the seeds of each."""

    def __init__(self, column: pa.Array, least: int):
        self.least = least
        self.words, self.bounds = _tokens(column)
        self.prefix = POLY.prefix(self.words)
        self.at, self.hashes = _seeds(self.words, self.bounds, least, self.prefix)
        self.row = np.searchsorted(self.bounds, self.at, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(self.bounds)))  # of each row's seeds

    def seeds(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of a row's seeds, and the word before each (0 at the row's start)."""
        at, hashes = (x[self.first[row] : self.first[row + 1]] for x in (self.at, self.hashes))
        before = self.words[at - 1]
        if len(at):
            before[0] = 0
        return at, hashes, before


class Block(Texts):
    """Items of the benchmark with their listed seeds in the order of the hashes."""

    def __init__(self, ids: list, texts: list, least: int, coverage: float):
        super().__init__(pa.array(texts, pa.string()), least)
        self.ids, self.sizes = ids, np.diff(self.bounds)
        listed = self._rarest(coverage)
        pairs = np.unique(np.stack([self.hashes[listed], self.row[listed].astype(np.uint64)], 1), axis=0)
        self.listed, self.item = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.listed & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def _rarest(self, coverage: float) -> np.ndarray:
        """Which seeds are listed: those up to a number of items (a power of two), by item the least that leaves too little for the others."""
        own = np.unique(np.stack([self.hashes, self.row.astype(np.uint64)], 1), axis=0)[:, 0]
        kinds, count = np.unique(own, return_counts=True)
        rarity = count[np.searchsorted(kinds, self.hashes)]
        most = np.full(len(self.ids), np.iinfo(np.int64).max)
        limit = 1 << int(rarity.max(initial=1) - 1).bit_length()
        while limit:
            steps = np.zeros(len(self.words) + 1, np.int64)
            others = self.at[rarity > limit]
            np.add.at(steps, others, 1)
            np.add.at(steps, others + self.least, -1)
            covered = np.r_[0, np.cumsum(np.cumsum(steps[:-1]) > 0)]
            enough = covered[self.bounds[1:]] - covered[self.bounds[:-1]] < coverage * self.sizes
            most[enough] = limit
            limit >>= 1
        return rarity <= most[self.row]

    def pairs(self, texts: Texts) -> Iterator[tuple[int, int, int, int]]:
        """Row, item (number), words covered and tiles of each candidate."""
        maybe = np.flatnonzero(self.likely[(texts.hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(maybe) or not len(self.listed):
            return
        known = np.unique(np.stack([texts.row[maybe].astype(np.uint64), texts.hashes[maybe]], 1), axis=0)
        low, high = np.searchsorted(self.listed, known[:, 1]), np.searchsorted(self.listed, known[:, 1], side="right")
        found = np.unique(np.stack([np.repeat(known[:, 0].astype(np.int64), high - low), self.item[ranges(low, high - low)]], 1), axis=0)
        for row, item in found.tolist():
            covered, tiles = tile(self, item, texts, row)
            if tiles:
                yield row, item, covered, tiles


def _ordered(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return places[order], keys[order]


def matches(items: Texts, item: int, texts: Texts, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in the item and in the text and lengths of all matches that cannot be extended to either side."""
    i, seed_i, before_i = items.seeds(item)
    j, seed_j, before_j = texts.seeds(row)
    shared = np.isin(seed_j, seed_i)
    j, seed_j, before_j = j[shared], seed_j[shared], before_j[shared]
    kinds, words = np.unique(seed_j), np.unique(np.r_[before_i, before_j])
    some = np.isin(seed_i, kinds)
    i, seed_i, before_i = i[some], seed_i[some], before_i[some]
    key = lambda seed, before: np.searchsorted(kinds, seed) * len(words) + np.searchsorted(words, before)
    j, keys = _ordered(j, key(seed_j, before_j))
    group, own = np.searchsorted(kinds, seed_i) * len(words), key(seed_i, before_i)
    # Of the text's places with the seed, those with another word before it (at a text's start: all).
    low, high = np.searchsorted(keys, group), np.searchsorted(keys, group + len(words))
    inner_low, inner_high = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
    free = before_i == 0
    inner_low, inner_high = np.where(free, low, inner_low), np.where(free, low, inner_high)
    here = np.r_[np.repeat(i, inner_low - low), np.repeat(i, high - inner_high)]
    there = np.r_[j[ranges(low, inner_low - low)], j[ranges(inner_high, high - inner_high)]]
    least, most = np.full(len(here), items.least), np.minimum(items.bounds[item + 1] - here, texts.bounds[row + 1] - there)
    while (least < most).any():
        middle = (least + most + 1) >> 1
        same = POLY.spans(items.prefix, here, here + middle) == POLY.spans(texts.prefix, there, there + middle)
        least, most = np.where(same, middle, least), np.where(same, most, middle - 1)
    return here, there, least


def tile(items: Texts, item: int, texts: Texts, row: int) -> tuple[int, int]:
    """Words covered and number of tiles."""
    least, begin, start = items.least, items.bounds[item], texts.bounds[row]
    words, text = items.words[begin : items.bounds[item + 1]], texts.words[start : texts.bounds[row + 1]]
    here, there, lengths = matches(items, item, texts, row)
    queue = list(zip((-lengths).tolist(), (here - begin).tolist(), (there - start).tolist(), strict=True))
    heapq.heapify(queue)
    used_item, used_text = np.zeros(len(words), bool), np.zeros(len(text), bool)
    covered = tiles = 0
    while queue and len(words) - covered >= least:
        n, i, j = heapq.heappop(queue)
        n = -n
        # The words themselves, not only their rolling hash: a match that holds others is cut there.
        used = used_item[i : i + n] | used_text[j : j + n] | (words[i : i + n] != text[j : j + n])
        if not used.any():
            used_item[i : i + n] = used_text[j : j + n] = True
            covered, tiles = covered + n, tiles + 1
            continue
        edges = np.diff(np.r_[True, used, True].astype(np.int8))
        for a, b in zip(np.flatnonzero(edges == -1).tolist(), np.flatnonzero(edges == 1).tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(queue, (a - b, i + a, j + a))
    return covered, tiles


def _blocks(benchmark: DataFrame, least: int, coverage: float) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast blocks of the benchmark, each of bounded size and made when the one before it is done with; and whether it is the last."""
    sc = benchmark.sparkSession.sparkContext
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if texts and size + len(row[1] or "") > BLOCK_BYTES:
            yield sc.broadcast(Block(ids, texts, least, coverage)), False
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "")
    yield sc.broadcast(Block(ids, texts, least, coverage)), True


def leaks(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST, coverage: float = COVERAGE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, item_id, n_tiles, covered_words, item_words, coverage``: a row per document and leaked item."""
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def found(handle: Broadcast) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = handle.value
            for batch in text_slices(batches):
                ids, rows = batch.column("doc_id").to_pylist(), []
                for row, item, covered, tiles in block.pairs(Texts(batch.column("text"), least)):
                    if covered >= coverage * (size := int(block.sizes[item])):
                        rows.append((ids[row], block.ids[item], tiles, covered, size, covered / size))
                if rows:
                    types = [pa.int64()] * 5 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage"])

        return plain.mapInArrow(work, "doc_id long, item_id long, n_tiles long, covered_words long, item_words long, coverage double")

    parts = []
    for handle, last in _blocks(benchmark, least, coverage):
        parts.append(found(handle) if last else cut(found(handle)))
        if not last:
            handle.destroy()
    return reduce(DataFrame.union, parts)


def clean(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST, coverage: float = COVERAGE, text_column: str = "text") -> DataFrame:
    """The documents without a leaked item, all columns."""

    def kept(rows: DataFrame, handle: Broadcast) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = handle.value
            for batch in text_slices(batches, text_column):
                keep = np.ones(batch.num_rows, bool)
                for row, item, covered, _ in block.pairs(Texts(batch.column(text_column), least)):
                    if covered >= coverage * block.sizes[item]:
                        keep[row] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))

        return rows.mapInArrow(work, docs.schema)

    spark, left, before = docs.sparkSession, docs, None
    for handle, last in _blocks(benchmark, least, coverage):
        left = kept(left, handle)
        if not last:
            path = shared_path(spark, "decontaminated")
            left.write.parquet(path)
            left = spark.read.schema(docs.schema).parquet(path)
            handle.destroy()
            if before:
                remove_path(spark, before)
            before = path
    return left
