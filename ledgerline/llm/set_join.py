"""Operator 11, n-gram Jaccard join: documents as sets of word shingles, linked at a similarity, with set-relation skipping.

Equal sets are one class. Every class lists the tokens of its prefix (with the similarity asked for, two linked sets share one of them);
tokens come in the order of a counting sketch of all texts, frequent ones last, so that lists stay short. A list's entries stand by size and position,
a probe sees only the range that these leave open, and a signature (counters of the set's tokens, together at most as far apart as the sets
are) puts off what is too far away; both tests lose no link. Every row has one of 32 counters, which tells small sets apart (up to 1,000 tokens at 90 percent, 224 at 80: the
less similar links may be, the more of a set a counter must not hold); larger sets that it leaves together meet once more with as many counters as their size needs, of which the
larger set's are added up to the smaller one's number. What a list leaves connected travels on as at most one link an entry. Their components are shards: the whole sets of a shard meet, and ``set_relations`` joins them exactly. So all pairs of a group are looked at in one place, by skipping, and
none of them is ever a row.

Hot groups: copies are one class before any shuffle of lists (each task names a class once). A list of more than ``list_size`` entries is handed on as it
streams by and dealt to a grid of shorter ones, and so is a shard of n classes, to ``GRID`` chunks or, beyond ``GRID * shard_tokens`` tokens, chunks of ``shard_tokens``: every pair of chunks meets once, memory is bounded,
and no link is lost.
The sketch has a fixed size whatever the corpus (``CELLS`` counters); it alone is broadcast, and only the order of tokens depends on it.

Nulls: a null text has no words, so an empty set, linked with nothing; a null id is never the smallest. Rows that repeat an id or a text share a class. An empty
table gives no rows; further columns are not looked at. Sets are compared by 64-bit XXH64 values of their shingles, classes named by BLAKE2b of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, key_runs, mix, runs_of, signed, text_slices, tidy_shuffles
from ledgerline.llm.components import connected_components
from ledgerline.llm.set_relations import links, needed, prefix_length
from ledgerline.llm.simhash import shingle_hashes

CELLS, SEGMENT = 1 << 20, 1 << 14
BUCKETS = 32
LIST_SIZE, GRID, LEAST_CHUNK = 8192, 16, 128
#: Tokens of a shard's chunk. Two chunks that meet take some 180 bytes for each of their tokens.
SHARD_TOKENS = 1 << 19
#: Counters of wide signatures that are compared at a time.
COMPARED = 4 << 20
#: Lists of so few entries are looked at many at a time.
SHORT = 6
#: Ids of texts to look at once more, eight bytes each: broadcast up to so many, joined by shuffle beyond.
BROADCAST_ROWS = 200_000


def token_sets(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    for text in batch.column("text").to_pylist():
        yield np.unique(shingle_hashes(text or b"", shingle))


def class_name(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens.copy()) >> np.uint64(64 - (CELLS - 1).bit_length())).astype(np.int64)


def classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, row, class, size, wide, segment, counts``: a row per document, large sets with their wide signature, and each task's share of the sketch as rows of its own (``segment`` not null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        names = ["doc_id", "row", "class", "size", "wide", "segment", "counts"]
        for batch in text_slices(batches):
            sets = list(token_sets(batch, shingle))
            counts += np.bincount(_cells(np.concatenate(sets)), minlength=CELLS).astype(np.uint32)
            columns = [batch.column("doc_id"), batch.column("row"), pa.array([class_name(s) for s in sets], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([_signature(s, _width(len(s), percent)).tobytes() if _large(len(s), percent) else None for s in sets], pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        codec, some = pa.Codec("zstd"), [k for k in range(CELLS // SEGMENT) if counts[k * SEGMENT : (k + 1) * SEGMENT].any()]
        packed = [codec.compress(counts[k * SEGMENT : (k + 1) * SEGMENT].tobytes(), asbytes=True) for k in some]
        if some:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), pa.int64()) for _ in range(4)), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names)

    return docs.mapInArrow(work, "doc_id long, row long, class long, size long, wide binary, segment int, counts binary")


def sketch(found: DataFrame) -> np.ndarray:
    """The whole corpus's counts. The result has a fixed size, each task adds up its segments as they come."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        codec = pa.Codec("zstd")
        for batch in batches:
            for k, packed in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(codec.decompress(packed, 4 * SEGMENT, asbytes=True), np.uint32)
                sums[k] = sums[k] + own if k in sums else own.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["segment", "counts"])

    parts = found.filter("segment is not null").select("segment", "counts").repartition("segment").mapInArrow(work, "segment int, counts binary")
    out = np.zeros(CELLS, np.uint64)
    for r in parts.toLocalIterator():  # CELLS numbers in all, whatever the corpus
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(bytes(r.counts), np.uint64)
    return out


def _levels(counts: np.ndarray) -> np.ndarray:
    """Frequent tokens' rank by powers of two; 0 for all that the sketch can't tell from its mean load."""
    load = counts // np.uint64(max(32, 2 * int(counts.mean())))
    return np.ceil(np.log2(load.astype(np.float64) + 1)).astype(np.uint8)


def _signature(tokens: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The set's tokens counted in ``buckets`` (a power of two) counters modulo 256."""
    return np.bincount((tokens >> np.uint64(65 - buckets.bit_length())).astype(np.int64), minlength=buckets).astype(np.uint8)


def _long(percent: int) -> int:
    """The tokens up to which ``BUCKETS`` counters tell sets apart.

    Unlike sets of s tokens differ by some ``sqrt(s * counters)`` in their counters, similar ones by ``2 * s * (100 - percent) / (100 + percent)`` at most.
    """
    return min(1 << 31, 1000 * BUCKETS * (100 + percent) ** 2 // max(1, 32 * 361 * (100 - percent) ** 2))


def _width(size: int, percent: int) -> int:
    """The counters that tell sets of this size apart, a power of two."""
    return 1 << (max(BUCKETS, -(-BUCKETS * size // _long(percent))) - 1).bit_length()


def _large(size, percent: int):
    """Whether a set of this size can be similar to one that needs a wide signature."""
    return 100 * size > percent * _long(percent)


def _apart(theirs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """At least so many tokens differ: the sum over the counters, whose differences are those modulo 256."""
    return np.abs((theirs - own).view(np.int8).astype(np.int16)).sum(1, dtype=np.int64)


def _folded(marks: np.ndarray, buckets: int) -> np.ndarray:
    """The same signatures with fewer counters."""
    return marks if marks.shape[1] == buckets else marks.reshape(len(marks), buckets, -1).sum(2, dtype=np.uint8)


def _wide_apart(wide: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """The distance of a member from others, in the smaller number of counters of the two."""
    widths = np.array(list(map(len, wide)))
    held = {int(w): np.stack([wide[i] for i in np.flatnonzero(widths == w)]) for w in np.unique(widths)}
    place = np.empty(len(wide), np.int64)
    for w in held:
        place[widths == w] = np.arange(len(held[w]))

    def apart(at: int, others: np.ndarray) -> np.ndarray:
        out = np.empty(len(others), np.int64)
        for w in np.unique(widths[others]).tolist():
            few, step = min(w, int(widths[at])), max(1, COMPARED // w)
            own, here = _folded(wide[at][None], few), np.flatnonzero(widths[others] == w)
            for k in range(0, len(here), step):
                part = here[k : k + step]
                out[part] = _apart(_folded(held[w][place[others[part]]], few), own)
        return out

    return apart


PREFIX = "list long, place long, class long, s0 long, s1 long, s2 long, s3 long"
COLUMNS = [c.split()[0] for c in PREFIX.split(", ")]


def prefixes(docs: DataFrame, shingle: int, percent: int, counts: np.ndarray) -> DataFrame:
    """A row for each token of each class's prefix: the list's name, size and position in one number, the class and its signature."""
    shared = docs.sparkSession.sparkContext.broadcast(_levels(counts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        seen: set[int] = set()  # classes of this task, so a group of copies counts once
        for batch in text_slices(batches):
            names, marks, parts, places = [], [], [], []
            for tokens in token_sets(batch, shingle):
                name, size = class_name(tokens), len(tokens)
                if not size or name in seen:
                    continue
                seen.add(name)
                first = tokens[np.argsort(levels[_cells(tokens)], kind="stable")[: prefix_length(size, percent)]]  # within a level by value, as the set is sorted
                names.append(name)
                marks.append(_signature(tokens).view(np.int64))
                parts.append(first)
                places.append((size << 32) + np.arange(len(first)))
            if names:
                lengths = [len(p) for p in parts]
                columns = [signed(mix(np.concatenate(parts))), np.concatenate(places), np.repeat(np.array(names), lengths), *np.repeat(np.array(marks), lengths, axis=0).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], COLUMNS)

    return docs.select("text").mapInArrow(work, PREFIX)


def list_links(size: np.ndarray, position: np.ndarray, apart: Callable[[int, np.ndarray], np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one list's entries, in ascending order of size, pairs of indices that connect all those that sizes, positions and signatures (how far ``apart``) don't rule out."""
    n, a, b = len(size), [], []
    fresh = np.ones(n, bool)
    for seed in range(n - 1):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            own, place = int(size[at]), int(position[at])
            low, high = np.searchsorted(size, -(-percent * own // 100)), np.searchsorted(size, 100 * own // percent, side="right")
            others = np.flatnonzero(fresh[low:high]) + low
            theirs = size[others]
            most = own + theirs - 2 * needed(own, theirs, percent)  # tokens in which the two may differ
            open_ = 1 + np.minimum(own - place - 1, theirs - position[others] - 1) >= needed(own, theirs, percent)
            others, most = others[open_], most[open_]
            near = others[apart(at, others) <= most]
            fresh[near] = False
            queue += near.tolist()
            a += [at] * len(near)
            b += near.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _short_links(heads: np.ndarray, n: int, size: np.ndarray, position: np.ndarray, signature: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many lists of n entries at once, pair by pair."""
    i, j = np.triu_indices(n, 1)
    a, b = ((heads[:, None] + x[None, :]).ravel() for x in (i, j))
    least = needed(size[a], size[b], percent)
    open_ = 1 + np.minimum(size[a] - position[a], size[b] - position[b]) - 1 >= least
    open_ &= 100 * size[a] >= percent * size[b]
    a, b, least = a[open_], b[open_], least[open_]
    apart = np.abs((signature[a] - signature[b]).view(np.int8).astype(np.int16)).sum(1)
    near = apart <= size[a] + size[b] - 2 * least
    return a[near], b[near]


def _connected(name: np.ndarray, size: np.ndarray, position: np.ndarray, marks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices that connect, list by list, what isn't ruled out."""
    heads, tails = runs_of(name)
    lengths = tails - heads
    found = [_short_links(heads[lengths == n], n, size, position, marks, percent) for n in range(2, SHORT + 1)]
    some = lengths > SHORT
    for x, y in zip(heads[some].tolist(), tails[some].tolist(), strict=True):
        own = marks[x:y]
        a, b = list_links(size[x:y], position[x:y], lambda at, others, own=own: _apart(own[others], own[at]), percent)
        found.append((x + a, x + b))
    a, b = (np.concatenate(side) for side in zip(*found, strict=True))
    return a, b


def _scan(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """The links of whole lists, and the rows of large sets that must meet once more."""
    name, place, of = (table.column(c).to_numpy() for c in ("list", "place", "class"))
    keep = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (of[1:] != of[:-1])][: len(name)])  # other tasks may have named the class too
    marks = np.stack([table.column(f"s{i}").to_numpy() for i in range(4)], 1).view(np.uint8)
    size, position = place >> 32, place & 0xFFFFFFFF

    def pairs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = _connected(name[rows], size[rows], position[rows], marks[rows], percent)
        return rows[a], rows[b]

    a, b = pairs(keep[size[keep] <= _long(percent)])
    again = np.unique(np.concatenate(pairs(keep[_large(size[keep], percent)])))
    return of[a], of[b], table.take(pa.array(again))


def _lists(rows: DataFrame, percent: int, list_size: int | None) -> DataFrame:
    """``a, b`` for each link; rows of large sets to meet once more (``again``), and those of longer lists, as they came."""
    names = ["a", "b", "again", *COLUMNS]

    def passed(table: pa.Table | pa.RecordBatch, again: bool) -> Iterator[pa.RecordBatch]:
        for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, again)), *batch.columns], names)

    def linked(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, again = _scan(pa.Table.from_batches(batches), percent)
        if n := len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.bool_()), *(pa.nulls(n, pa.int64()) for _ in COLUMNS)], names)
        if again.num_rows:
            yield from passed(again, True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n, long = None, [], 0, False  # the list that the last batch ended in
        for batch in batches:
            lists = batch.column("list").to_numpy()
            if not len(lists):
                continue
            more = int(np.searchsorted(lists, now, side="right")) if now is not None else 0
            if more:
                held.append(batch.slice(0, more))
                n += more
                long = long or (list_size is not None and n > list_size)
                if long:
                    for part in held:
                        yield from passed(part, False)
                    held = []
            if more == len(lists):
                continue
            if held:
                yield from linked(held)
            last = int(np.searchsorted(lists, lists[-1]))
            if last > more:
                yield from linked([batch.slice(more, last - more)])
            now, held, n, long = lists[-1], [batch.slice(last)], len(lists) - last, False
        if held:
            yield from linked(held)

    dealt = rows.select(*COLUMNS).repartition("list").sortWithinPartitions("list", "place", "class")
    return dealt.mapInArrow(work, f"a long, b long, again boolean, {PREFIX}")


def _wide_links(rows: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the same for large sets, by their wide signatures."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in key_runs(batches, "list"):
            place, of = table.column("place").to_numpy(), table.column("class").to_numpy()
            wide = [np.frombuffer(w.as_buffer(), np.uint8) for w in table.column("wide")]
            a, b = list_links(place >> 32, place & 0xFFFFFFFF, _wide_apart(wide), percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(of[a]), pa.array(of[b])], ["a", "b"])

    wide = found.filter("wide is not null").groupBy("class").agg(F.first("wide").alias("wide"))
    dealt = rows.select("list", "place", "class").join(wide, "class").repartition("list").sortWithinPartitions("list", "place", "class")
    return dealt.select("list", "place", "class", "wide").mapInArrow(work, "a long, b long")


def candidate_links(rows: DataFrame, found: DataFrame, percent: int, list_size: int) -> DataFrame:
    """``a, b``: at most one link for each entry of a list."""
    met = cut(_lists(rows, percent, list_size))
    long = met.filter("not again").select(*COLUMNS)
    if not long.isEmpty():
        parts = F.ceil(F.col("n") / list_size).cast("int")
        placed = long.join(long.groupBy("list").agg(F.count("*").alias("n")).select("list", parts.alias("parts")), "list")
        placed = placed.withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        placed = placed.withColumn("list", F.xxhash64("list", F.least("chunk", "other"), F.greatest("chunk", "other")))
        met = met.union(cut(_lists(placed, percent, None)))
    links = met.filter("a is not null").select("a", "b")
    return links.union(_wide_links(met.filter("again"), found, percent)).distinct()


def _chunks(components: DataFrame, found: DataFrame, shard_tokens: int) -> DataFrame:
    """``class, shard, chunk, parts``: each class's component, and its chunk where the component has many tokens or classes."""
    sized = components.join(found.groupBy(F.col("class").alias("node")).agg(F.min("size").alias("size")), "node")
    sums = sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    parts = F.greatest(F.ceil(F.col("tokens") / shard_tokens), F.least(F.lit(GRID), F.ceil(F.col("n") / LEAST_CHUNK))).cast("int")
    placed = sized.join(sums.select("root", parts.alias("parts")), "root")
    return placed.select(F.col("node").alias("class"), F.col("root").alias("shard"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("chunk"), "parts")


def _packed(placed: DataFrame) -> DataFrame:
    """``shard, chunk, parts, tokens, bytes, classes, sizes``: a row for each chunk. Sets that are alike compress well next to each other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets = None, [], []
        codec = pa.Codec("zstd")

        def packed() -> pa.RecordBatch:
            raw = b"".join(sets)
            row = {"shard": now[0], "chunk": now[1], "parts": now[2], "tokens": codec.compress(raw, asbytes=True), "bytes": len(raw), "classes": names, "sizes": [len(s) // 8 for s in sets]}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int32()), ("parts", pa.int32()), ("tokens", pa.binary()), ("bytes", pa.int64()), ("classes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk", "parts")), strict=True)
            for key, name, tokens in zip(keys, batch.column("class").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if key != now:
                    if names:
                        yield packed()
                    now, names, sets = key, [], []
                names.append(name)
                sets.append(tokens)
        if names:
            yield packed()

    dealt = placed.repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "class")
    return dealt.select("shard", "chunk", "parts", "class", "tokens").mapInArrow(work, "shard long, chunk int, parts int, tokens binary, bytes long, classes array<long>, sizes array<long>")


def exact_links(docs: DataFrame, found: DataFrame, candidates: DataFrame, shingle: int, percent: int, shard_tokens: int) -> DataFrame:
    """``a, b``: linked classes, as ``set_relations`` finds them in each shard."""
    components = cut(connected_components(candidates, "a", "b"))
    wanted = found.join(components.select(F.col("node").alias("class")), "class", "left_semi").groupBy("class").agg(F.min("row").alias("row")).select("row").distinct()
    wanted = cut(wanted)
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            own = list(token_sets(batch, shingle))
            yield pa.RecordBatch.from_arrays([pa.array([class_name(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["class", "tokens"])

    known = docs.join(wanted, "row", "left_semi").select("text").mapInArrow(sets, "class long, tokens binary")
    known = known.groupBy("class").agg(F.first("tokens").alias("tokens"))

    chunks = cut(_packed(_chunks(components, found, shard_tokens).join(known, "class")))
    # Each pair of a shard's chunks, a chunk and itself included, is a place.
    placed = chunks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, held = None, [], []
        codec = pa.Codec("zstd")

        def joined() -> Iterator[pa.RecordBatch]:
            if pairs := links(held, percent):
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in side], pa.int64()) for side in zip(*pairs, strict=True)], ["a", "b"])

        for batch in batches:
            for shard, low, high, tokens, size, own, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, low, high) != now:
                    yield from joined()
                    now, names, held = (shard, low, high), [], []
                names += own
                held += np.split(np.frombuffer(codec.decompress(tokens, size, asbytes=True), np.uint64), np.cumsum(sizes)[:-1])
        yield from joined()

    placed = placed.repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high", "chunk")
    return placed.select("shard", "low", "high", "tokens", "bytes", "classes", "sizes").mapInArrow(work, "a long, b long")


def similar_documents(
    docs: DataFrame, *, shingle: int = 3, percent: int = 90, list_size: int = LIST_SIZE, shard_tokens: int = SHARD_TOKENS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each document: the size of its set and the smallest id it reaches over links."""
    text, doc_id = F.coalesce(F.col(text_column).cast("string"), F.lit("")), F.col(id_column).cast("long")
    plain = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("row"), text.cast("binary").alias("text"))
    with tidy_shuffles(docs.sparkSession):
        both = cut(classes(plain, shingle, percent))
        found = both.filter("segment is null").drop("segment", "counts")
        candidates = cut(candidate_links(prefixes(plain, shingle, percent, sketch(both)), found, percent, list_size))
        roots = connected_components(cut(exact_links(plain, found, candidates, shingle, percent, shard_tokens)), "a", "b").withColumnRenamed("node", "class")
        of_class = found.filter("size > 0").groupBy("class").agg(F.min("doc_id").alias("least")).join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        names = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
        of_class = cut(of_class.join(names, "root").select("class", "component_id"))
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.join(of_class, "class", "left").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
