"""Operator 10, SimHash near-dedup: BK-trees over 64-bit fingerprints.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles. Copies
share a fingerprint, so only distinct ones are searched. Two fingerprints within ``radius`` bits agree on at least two
of ``radius + 2`` blocks of bits, so each pair of blocks with its value names a shard, and every link lies in at least
one shard. A shard's fingerprints form a BK-tree (children keyed by their Hamming distance to the parent); a lookup
follows only the edges within ``radius`` of the distance to the node. A shard beyond ``tree_size`` is cut into
several trees, each sent to all of the shard's query chunks: bounded memory, no link lost. Within a task, links are
merged at once, so a shard of n fingerprints returns at most n links; stars over all shards give the components.

A tree of the whole corpus would grow with it, so trees travel to the tasks of their shard by shuffle rather than by
a driver-held broadcast.

``keep_one`` is for near copies by similarity of shingle sets, which few bits cannot tell: texts with a Jaccard similarity of 0.8 differ in some
ten bits. There the links are those of the exact join of operator 11 (``set_join``), on sets of longer shingles: large lists and shards are cut into chunks of
which every pair meets, so no link is lost.

Nulls: a null text has no words (fingerprint 0, linked like any other); a null id is never the smallest. Ties and
repeated rows share a fingerprint. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, text_slices, tidy_shuffles, unused
from ledgerline.llm.components import connected_components

TREE_SIZE = 4096
#: Fingerprints are signed longs in tables; their differing bits are those of the 64-bit patterns.
MASK = (1 << 64) - 1


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return np.array(found, np.uint64)


def simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype("<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [simhash(shingle_hashes(t or b"", shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text")).mapInArrow(work, "doc_id long, fp long")


class BKTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != new:
            at = self.children[at].setdefault(((value ^ self.values[at]) & MASK).bit_count(), new)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Indices of the values within the radius."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = ((value ^ self.values[at]) & MASK).bit_count()
            if d <= radius:
                yield at
            edges = self.children[at]
            if len(edges) <= 2 * radius:
                stack += [child for edge, child in edges.items() if -radius <= edge - d <= radius]
            else:
                stack += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]


def shard_links(members: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius: among the members, or (queries given) from them to the members."""
    values = members + queries
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = BKTree()
    for i, value in enumerate(values):
        if i < len(members) and queries:
            tree.add(value)
            continue
        own = i
        for j in tree.within(value, radius):
            a, b = root(own), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if not queries:
            tree.add(value)
    return [(values[i], values[root(i)]) for i in range(len(values)) if parent[i] != i]


def fingerprint_links(distinct: DataFrame, radius: int, tree_size: int = TREE_SIZE) -> DataFrame:
    """``a, b``: links whose components are those of all pairs within the radius. ``distinct`` has each ``fp`` once."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1)) for i in range(blocks)]
    width = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    keys = [F.lit(k << 2 * width) + F.shiftleft(part[i], width) + part[j] for k, (i, j) in enumerate(combinations(range(blocks), 2))]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    placed = keyed.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / tree_size).cast("int"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # A chunk's tree (the smaller number) meets each later chunk; a chunk also meets itself.
    placed = placed.select("key", "fp", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    placed = placed.select("key", F.least("chunk", "other").alias("tree"), F.greatest("chunk", "other").alias("query"), (F.col("chunk") > F.col("other")).alias("asks"), "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, queries, links = None, [], [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for key, tree, query, asks, fp in zip(*columns, strict=True):
                if (key, tree, query) != now:
                    links += shard_links(members, queries, radius) if now and (queries or now[1] == now[2]) else []
                    now, members, queries = (key, tree, query), [], []
                (queries if asks else members).append(fp)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])
                links = []
        links += shard_links(members, queries, radius) if now and (queries or now[1] == now[2]) else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    grouped = placed.repartition("key", "tree", "query").sortWithinPartitions("key", "tree", "query")
    return grouped.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 3, tree_size: int = TREE_SIZE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` (the smallest id of the documents reachable over links), one row per document."""
    with tidy_shuffles(docs.sparkSession):
        fps = cut(fingerprints(docs, shingle, id_column, text_column))
        distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
        links = fingerprint_links(distinct.select("fp"), radius, tree_size)
        roots = connected_components(links, "a", "b")
        of_fp = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        names = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
        of_fp = cut(of_fp.join(names, "root").select("fp", "component_id"))
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


# --- near copies by similarity ------------------------------------------------------------------------------------


def keep_one(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, shard_size: int = 2 * TREE_SIZE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, less those linked, over whatever steps, to one with a smaller id; of rows with one id, one stays.

    Documents are linked if the Jaccard similarity of their sets of word shingles is ``similarity`` (whole percents) or more; those without a word
    are alike. Rows without an id are told apart by their text and come after all others; rows that repeat an id must repeat its text.
    ``shard_size``: entries of a list that are looked at together.
    """
    from ledgerline.llm.set_join import similar_documents  # which takes its shingles from here

    row = unused("row", docs.columns)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    surrogate = F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(3 << 61)
    all_columns = docs.withColumn(row, F.coalesce(F.col(id_column).cast("long"), surrogate))
    named = all_columns.select(F.col(row).alias("row"), text.alias("text"))
    found = cut(similar_documents(named, shingle=shingle, percent=round(100 * similarity), list_size=shard_size, id_column="row"))
    with tidy_shuffles(docs.sparkSession):
        wordless = found.filter("n_shingles = 0").agg(F.min("doc_id").alias("doc_id")).na.drop()
        stay = cut(found.filter("n_shingles > 0 and doc_id = component_id").select("doc_id").union(wordless).distinct())
    return all_columns.join(stay.withColumnRenamed("doc_id", row), row, "left_semi").dropDuplicates([row]).drop(row)
