"""Operator 13, hard-negative mining: a vector-approximation file.

Components are integers, ``floor(scale * x)``. Each dimension has ``CELLS`` cells: equal steps within three deviations of its mean, open up to its
smallest and largest value, all measured on every row. A vector's approximation is one byte for two dimensions. For an anchor, two tables give each byte the smallest and the
largest amount it can add to the inner product, so a sum of look-ups bounds a row's score from both sides. Only rows whose bounds can enter
an anchor's best of its label, or one of its windows of other labels, are scored exactly; within a block the bounds of what is
already sure to enter raise the mark.

Rows lie in blocks by a hash of their id, whatever their label, so a label with a third of all rows is spread like any other. Each block meets the
anchors (a stated query set) in blocks of theirs, and returns at most ``positives`` rows for an anchor, or ``negatives`` for an anchor and positive; groupings
by anchor merge these. Nothing of a size that follows the data is broadcast or sent to the driver: only four numbers for each dimension are.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Of rows that repeat an id the one with the smallest
(label, vector) counts. A shorter vector is taken to end in zeros. Ties go to the smaller id. No rows or anchors: no rows. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, tidy_shuffles

CELLS = 16
ROWS, ANCHORS = 16384, 16384
KNOWN = "vec_id long, label long, vector binary"


def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as integers, padded with zeros, and which rows are whole and finite."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    good = np.ones(len(column), bool)
    good[row[~np.isfinite(values)]] = False  # a null component reads as NaN
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    fits = np.isfinite(values)
    out[row[fits], (np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[fits]] = np.floor(scale * values[fits]).astype(np.int64)
    return out, good


def integer_vectors(rows: DataFrame, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``vec_id, label, vector``: the vector's components as 64-bit integers, one row for each id that takes part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, good = _integers(batch.column("vector"), scale)
            packed = pa.array([v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], ["vec_id", "label", "vector"]).filter(pa.array(good))

    taken = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    found = taken.dropna().mapInArrow(work, KNOWN)
    one = F.min(F.struct("label", "vector"))
    return found.groupBy("vec_id").agg(one.alias("one")).select("vec_id", "one.label", "one.vector")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        own = np.frombuffer(v.as_buffer(), np.int64)
        out[i, : len(own)] = own
    return out


def cell_bounds(known: DataFrame) -> np.ndarray:
    """``[dimension, CELLS + 1]``: cell c of a dimension holds the values from edge c up to, without it, edge c + 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for v in batch.column("vector"):
                for d, x in enumerate(np.frombuffer(v.as_buffer(), np.int64).tolist()):
                    own = held.setdefault(d, [0, 0.0, 0.0, x, x])
                    own[:] = own[0] + 1, own[1] + x, own[2] + float(x) * x, min(own[3], x), max(own[4], x)
        if held:
            columns = [pa.array(list(held), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*held.values(), strict=True), (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["d", "n", "s", "q", "low", "high"])

    sums = known.select("vector").mapInArrow(work, "d int, n long, s double, q double, low long, high long")
    found = sums.groupBy("d").agg(*(F.sum(c).alias(c) for c in "nsq"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()  # a row for each dimension
    edges = np.zeros((len(found) + len(found) % 2, CELLS + 1), np.int64)
    edges[:, 1:] = 1
    for r in found:
        mean = r.s / r.n
        spread = 3 * max(0.0, r.q / r.n - mean * mean) ** 0.5
        inner = np.clip(np.linspace(mean - spread, mean + spread, CELLS + 1)[1:-1], r.low, r.high).astype(np.int64)
        # A vector that is shorter than others counts as zero here.
        edges[r.d] = np.r_[min(r.low, 0), inner, max(r.high, 0) + 1]
    return edges


class Approximation:
    """The approximation of a block of vectors."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray):
        self.edges = edges
        codes = np.stack([np.clip(np.searchsorted(edges[d], vectors[:, d], side="right") - 1, 0, CELLS - 1) for d in range(len(edges))]) if len(edges) else np.zeros((0, len(vectors)), np.int64)
        self.codes = codes[::2] * CELLS + codes[1::2]

    def tables(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and largest share of each pair of dimensions, by byte."""
        ends = anchor[:, None] * self.edges[:, :-1], anchor[:, None] * (self.edges[:, 1:] - 1)
        low, high = np.minimum(*ends), np.maximum(*ends)
        return tuple((t[::2, :, None] + t[1::2, None, :]).reshape(len(t) // 2, CELLS * CELLS) for t in (low, high))

    def bounds(self, anchor: np.ndarray, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        codes = self.codes[:, rows]
        low, high = np.zeros((2, codes.shape[1]), np.int64)
        for own, less, more in zip(codes, *self.tables(anchor), strict=True):
            low += less[own]
            high += more[own]
        return low, high


def _mark(values: np.ndarray, k: int) -> int | None:
    """The k-th largest."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Block:
    """Rows of one block: ids, labels, vectors and their approximation."""

    def __init__(self, table: pa.Table, edges: np.ndarray):
        table = table.combine_chunks()
        self.ids, self.labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        vectors = table.column("vector").combine_chunks()
        self.vectors = _matrix(vectors, len(edges))
        self.approximation = Approximation(self.vectors, edges)
        order = np.argsort(self.labels, kind="stable")
        self.of_label = {int(self.labels[x[0]]): x for x in np.split(order, np.flatnonzero(np.diff(self.labels[order])) + 1) if len(x)}

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
        """The block's best rows of the anchor's label: id and score."""
        rows = self.of_label.get(label, np.zeros(0, np.int64))
        rows = rows[self.ids[rows] != anchor_id]
        low, high = self.approximation.bounds(anchor, rows)
        mark = _mark(low, k)
        rows = rows if mark is None else rows[high >= mark]
        scores = self.vectors[rows] @ anchor
        best = _best(self.ids[rows], scores, k)
        return zip(self.ids[rows[best]].tolist(), scores[best].tolist(), strict=True)

    def negatives(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int, int]], k: int) -> Iterator[tuple[int, int, int]]:
        """For each window ``(name, low, high)`` the block's best rows of other labels in it: name, id, score."""
        windows = [w for w in windows if w[1] <= w[2]]
        if not windows:
            return
        low, high = self.approximation.bounds(anchor)
        other = self.labels != label
        exact: dict[int, int] = {}
        for name, least, most in windows:
            may = np.flatnonzero(other & (high >= least) & (low <= most))
            sure = low[may][(low[may] >= least) & (high[may] <= most)]
            if (mark := _mark(sure, k)) is not None:
                may = may[high[may] >= mark]
            fresh = [i for i in may.tolist() if i not in exact]
            exact.update(zip(fresh, (self.vectors[fresh] @ anchor).tolist(), strict=True))
            scores = np.array([exact[i] for i in may.tolist()], np.int64)
            inside = (scores >= least) & (scores <= most)
            may, scores = may[inside], scores[inside]
            for i in _best(self.ids[may], scores, k):
                yield name, int(self.ids[may[i]]), int(scores[i])


def _grid(known: DataFrame, asked: DataFrame, rows: int, anchors: int) -> tuple:
    """Blocks of the known rows and of the asking ones, each pair a group of its own."""
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n, m = blocks(known, rows), blocks(asked, anchors)
    here = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    there = F.pmod(F.xxhash64("anchor_id"), F.lit(m)).cast("int")
    left = known.withColumn("block", here).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = asked.withColumn("part", there).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.groupBy("block", "part"), right.groupBy("block", "part")


def _top(found: DataFrame, keys: list[str], score: str, name: str, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), name))).filter(F.col("rank") <= k)


def mine(
    known: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), block_rows: int = ROWS, block_anchors: int = ANCHORS
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``known``: ``vec_id, label, vector`` of ``integer_vectors``; ``anchors``: the ``vec_id`` of those rows to mine for. A positive's window is all scores
    from ``window[0]`` to ``window[1]`` percent of its own score.
    """
    with tidy_shuffles(known.sparkSession):
        known = cut(known)
        edges = cell_bounds(known)
        asked = cut(known.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("own_label"), F.col("vector").alias("anchor")))

        def near(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                block = Block(left, edges)
                for anchor, label, vector in zip(right.column("anchor_id").to_pylist(), right.column("own_label").to_pylist(), _matrix(right.column("anchor").combine_chunks(), len(edges)), strict=True):
                    found += [(anchor, i, s) for i, s in block.positives(anchor, label, vector, positives)]
            return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))], ["anchor_id", "positive_id", "positive_score"])

        left, right = _grid(known, asked, block_rows, block_anchors)
        pairs = left.cogroup(right).applyInArrow(near, "anchor_id long, positive_id long, positive_score long")
        pairs = cut(_top(pairs, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"))
        wanted = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("pairs"))  # at most as many as positives are asked for
        a, b = window

        def hard(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                block = Block(left, edges)
                columns = [right.column(c).to_pylist() for c in ("anchor_id", "own_label", "pairs")]
                for anchor, label, own, vector in zip(*columns, _matrix(right.column("anchor").combine_chunks(), len(edges)), strict=True):
                    windows = [(p["positive_id"], -(-a * p["positive_score"] // 100), b * p["positive_score"] // 100) for p in own]
                    scores = {p["positive_id"]: p["positive_score"] for p in own}
                    found += [(anchor, p, i, scores[p], s) for p, i, s in block.negatives(label, vector, windows, negatives)]
            return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([],) * 5)], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

        left, right = _grid(known, asked.join(wanted, "anchor_id"), block_rows, block_anchors)
        found = left.cogroup(right).applyInArrow(hard, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
        found = cut(_top(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
