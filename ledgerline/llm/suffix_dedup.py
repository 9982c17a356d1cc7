"""Operator 3, suffix-array dedup: every byte inside a string of ``window`` bytes that also starts earlier is removed.

Anchors. Of the grams (``GRAM`` bytes) inside a window, the one with the smallest hash is the window's anchor. The choice depends on
the window alone, so equal windows have equal anchors, and only some three in a hundred places are anchors. An anchor's context is
all that windows around it can hold: up to ``window - GRAM`` bytes before it and ``window`` bytes from it on.

Comparing. Anchors are shuffled by gram, with hashes of the gram and half of a window's other bytes before it, and after it: equal windows agree in one of
these at least, so anchors that share neither with another one of their gram end there. The contexts of the others, copies included, are
compared as suffixes: each task sorts the suffixes that start at its grams' anchors (mergesort; a comparison is a binary search over
prefix polynomial hashes), takes neighbours' common extensions, and so knows for each window around an anchor whether an earlier
context holds it; equal windows are verified byte by byte.

Copies inside a slice or a document are found there, by digests of the contexts and then by their bytes, and travel by document. Grams with more than
``GROUP`` rows do not meet in one task's memory: as a stream, sorted by the 128-bit BLAKE2 digests of the contexts, copies are told by these, and the windows
of the different contexts are compared in a grouping by such digests, which spreads over all tasks.

Removal. The spans of each document meet its text once more, and repeats inside one document are added there.

Nulls: a null text is empty; null ids come last and, by text, stand for documents of their own. Rows that repeat an id must
repeat its text; they get the same result. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Polynomial, byte_table, cut, minimizers, mix, ranges, remove_path, runs_of, same_spans, shared_path, signed, text_bytes, text_slices, tidy_shuffles
from ledgerline.llm.suffix_sort import repeated_windows

GRAM = 40
GROUP = 20_000
#: Contexts that are sorted together, at least.
SORTED = 4_000
POLY, TABLE = Polynomial(0x9E3779B97F4A7C15), byte_table(3)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of two 64-bit halves for each span: BLAKE2 of its bytes."""
    raw, blake = data.tobytes(), hashlib.blake2b
    return np.frombuffer(b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<u8").reshape(-1, 2)


class Anchors:
    """The anchors of a slice: row, place in the row, gram hash, both halves of the context's digest, the context's reach to both sides, if asked for hashes of either side.
    ``within``: only those whose gram stands at another anchor of the row too, as equal contexts of a row do."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, sided: bool = False, within: bool = False):
        self.data = data
        self.row = self.place = self.left = self.right = self.start = np.empty(0, np.int64)
        self.gram = self.context = self.context_b = self.sides = np.empty(0, np.uint64)
        n = len(data) - window + 1
        if n <= 0:
            return
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        prefix = POLY.prefix(TABLE[data])
        places = np.arange(len(data) - GRAM + 1)
        grams = mix(POLY.spans(prefix, places, places + GRAM))
        chosen = minimizers(grams, window - GRAM + 1)
        chosen = chosen[rows[:n] == rows[window - 1 :]]
        at = chosen[runs_of(chosen)[0]]
        if within:
            order = np.lexsort((grams[at], rows[at]))
            again = ~_changes(rows[at[order]], grams[at[order]])
            at = at[np.sort(np.r_[order[again], np.setdiff1d(order[:-1][again[1:]], order[again])])]
        self.row = rows[at]
        begin, end = offsets[self.row], offsets[self.row + 1]
        self.place = at - begin
        self.left, self.right = np.minimum(window - GRAM, self.place), np.minimum(window, end - at)
        self.start = at - self.left
        found = digests(data, self.start, at + self.right)
        # Where in the context the gram stands is a part of it.
        self.context, self.context_b = found[:, 0] + (self.left * 1024 + self.right).astype(np.uint64) * np.uint64(0xA0761D6478BD642F), found[:, 1].copy()
        self.gram = grams[at]
        if not sided:
            return
        half = (window - GRAM) // 2
        before = np.where(self.left >= half, _short(POLY.spans(prefix, at - np.minimum(half, self.left), at + GRAM)), 0)
        after = np.where(self.right >= GRAM + half, _short(POLY.spans(prefix, at, at + np.minimum(GRAM + half, self.right))), 0)
        self.sides = before.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)

    def repeats(self, keys: np.ndarray) -> np.ndarray:
        """For each anchor whether one before it has its gram, context and key (keys in ascending order)."""
        order = np.lexsort((np.arange(len(keys)), keys, self.context_b, self.context))
        same = np.zeros(len(keys), bool)
        same[order[1:]] = ~_changes(self.context[order], self.context_b[order], keys[order])[1:]
        again = np.flatnonzero(same[order])
        same[order[again]] = self.equal(order[again], order[again - 1])
        return same

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the bytes of anchors' contexts are the same."""
        lengths = (self.left + self.right)[i]
        if (lengths == (self.left + self.right)[j]).all() and same_spans(self.data, self.start[i], self.start[j], lengths):
            return np.ones(len(i), bool)
        body = lambda k: self.data[self.start[k] : self.start[k] + self.left[k] + self.right[k]].tobytes()
        return np.array([body(a) == body(b) for a, b in zip(i, j, strict=True)], bool)


def _short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of hashes, never 0, which stands for a side that is not there."""
    return np.maximum(mix(hashes) >> np.uint64(32), np.uint64(1))


def _shared(gram: np.ndarray, sides: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which rows, of those marked, have a side in common with another one of their gram."""
    out = np.zeros(len(gram), bool)
    for side in (sides >> np.uint64(32), sides & np.uint64(0xFFFFFFFF)):
        i = np.flatnonzero(among & (side != 0))
        i = i[np.lexsort((side[i], gram[i]))]
        again = ~_changes(gram[i], side[i])
        out[i[again]] = True
        out[i[:-1][again[1:]]] = True
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """``gram, context, context_b, sides, id, place, covered``: each document's first anchor of each context."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            ids = batch.column("id").to_numpy()
            found = Anchors(*text_bytes(batch.column("text")), window, sided=True)
            if not len(found.row):
                continue
            keep = ~found.repeats(found.row)
            doc, gram, context, context_b, place = ids[found.row[keep]], found.gram[keep], found.context[keep], found.context_b[keep], found.place[keep]
            # In the slice's later documents the context is known to repeat; its gram is not needed any more.
            order = np.lexsort((doc, context_b, context))
            new = _changes(context[order], context_b[order])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            covered = np.zeros(len(order), bool)
            covered[order] = doc[order] > doc[first]
            later, where = np.flatnonzero(covered[order]), np.flatnonzero(keep)
            covered[order[later]] = found.equal(where[order[later]], where[first[later]])
            gram = np.where(covered, mix(doc.astype(np.uint64)), gram)
            columns = [signed(gram), signed(context), signed(context_b), signed(found.sides[keep]), doc, place.astype(np.int32), covered]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "context", "context_b", "sides", "id", "place", "covered"])

    return docs.mapInArrow(work, "gram long, context long, context_b long, sides long, id long, place int, covered boolean")


FULL, EDGE, HOT = 0, 1, 2


def _judge_contexts(rows: DataFrame, group: int) -> DataFrame:
    """``id, place, gram, kind``: the rows that may share a window with another one of their gram, to be compared, and copies that are known."""

    def judged(columns: list[np.ndarray], hot: bool, before: tuple) -> tuple[pa.RecordBatch | None, tuple]:
        gram, context, context_b, sides, doc, place, covered = columns
        if not len(gram):
            return None, before
        new = _changes(gram, context, context_b)
        least = doc[np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))]
        if before[:3] == (gram[0], context[0], context_b[0]):
            head = np.cumsum(new) == 1
            least[head] = before[3]
            new[0] = False
        if hot:
            full = covered | (doc > least)
            kind, keep = np.where(full, FULL, HOT).astype(np.int8), np.ones(len(gram), bool)
        else:
            kind, keep = np.where(covered, FULL, EDGE).astype(np.int8), covered | _shared(gram, sides.view(np.uint64), ~covered)
        after = (gram[-1], context[-1], context_b[-1], least[-1])
        if not keep.any():
            return None, after
        return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(place[keep]), pa.array(gram[keep]), pa.array(kind[keep])], ["id", "place", "gram", "kind"]), after

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot_gram, before = None, None, (None,) * 4
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "context", "context_b", "sides", "id", "place", "covered")]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            while held is not None and len(held[0]):
                gram = held[0]
                if hot_gram is not None:
                    n = len(gram) if gram[-1] == hot_gram else int(np.argmax(gram != hot_gram))
                    out, before = judged([c[:n] for c in held], True, before)
                    if n < len(gram):
                        hot_gram, before = None, (None,) * 4
                else:
                    n = len(gram) if gram[0] == gram[-1] else 0
                    if n > group:
                        hot_gram, n = gram[0], 0
                        continue
                    n = 0 if n else int(np.flatnonzero(gram != gram[-1])[-1]) + 1
                    if not n:
                        break
                    out, _ = judged([c[:n] for c in held], False, before)
                if out is not None:
                    yield out
                held = [c[n:] for c in held]
        if held is not None and len(held[0]):
            out, _ = judged(held, hot_gram is not None, before)
            if out is not None:
                yield out

    ordered = rows.repartition("gram").sortWithinPartitions("gram", "context", "context_b", "id")
    return ordered.mapInArrow(work, "id long, place int, gram long, kind byte")


def _contexts(docs: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """``gram, id, place, reach, bytes, kind``: the contexts of the given anchors."""
    wanted = firsts.groupBy("id").agg(F.collect_list("place").alias("places"), F.collect_list("gram").alias("grams"), F.collect_list("kind").alias("kinds"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            lists = {c: batch.column(c) for c in ("places", "grams", "kinds")}
            counts = pc.list_value_length(lists["places"]).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), counts)
            place = lists["places"].flatten().to_numpy().astype(np.int64)
            at = np.minimum(offsets[row] + place, offsets[row + 1])
            reach = np.minimum(window - GRAM, at - offsets[row])
            end = np.minimum(at + window, offsets[row + 1])
            lengths = end - at + reach
            bounds = np.r_[0, np.cumsum(lengths)]
            body = data[ranges(at - reach, lengths)]
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]).cast(pa.binary())
            columns = [lists["grams"].flatten(), batch.column("id").take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(reach.astype(np.int32)), texts, lists["kinds"].flatten()]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "id", "place", "reach", "bytes", "kind"])

    return docs.join(wanted, "id").select("id", "text", "places", "grams", "kinds").mapInArrow(work, "gram long, id long, place int, reach int, bytes binary, kind byte")


def _edge_spans(contexts: DataFrame, window: int) -> DataFrame:
    """``id, start, stop``: the repeated windows around the anchors, by suffix order."""

    def compared(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(parts).combine_chunks()
        gram, doc = (table.column(c).to_numpy() for c in ("gram", "id"))
        place, reach = (table.column(c).to_numpy().astype(np.int64) for c in ("place", "reach"))
        data, offsets = _bytes_of(table.column("bytes"))
        order = np.lexsort((place, doc, gram))
        gram, doc, place, reach = gram[order], doc[order], place[order], reach[order]
        begins, ends = offsets[:-1][order], offsets[1:][order]
        found = repeated_windows(data, begins + reach, begins, ends, gram, window, GRAM)
        # Neighbouring windows make one span.
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, nearest = np.nonzero(edge == 1)
        _, beyond = np.nonzero(edge == -1)
        if not len(i):
            return None
        return pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(place[i] - beyond + 1), pa.array(place[i] - nearest + window)], ["id", "start", "stop"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < SORTED:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            gram = table.column("gram").to_numpy()
            whole = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
            if not whole:
                continue
            if out := compared(table.slice(0, whole).to_batches()):
                yield out
            held, n = table.slice(whole).to_batches(), len(gram) - whole
        if held and (out := compared(held)):
            yield out

    ordered = contexts.select("gram", "id", "place", "reach", "bytes").repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(work, "id long, start long, stop long")


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    whole = column.cast(pa.large_binary()).combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hot_spans(contexts: DataFrame, window: int) -> DataFrame:
    """The same for grams with very many contexts: a row per window, grouped by its digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "bytes", 256 << 10):
            data, offsets = _bytes_of(pa.chunked_array([batch.column("bytes")]))
            reach, place = (batch.column(c).to_numpy().astype(np.int64) for c in ("reach", "place"))
            anchors = offsets[:-1] + reach
            low = np.maximum(0, anchors + window - offsets[1:])  # the least distance before the anchor that fits
            n = np.maximum(0, reach - low + 1)
            row, back = np.repeat(np.arange(len(n)), n), ranges(low, n)
            starts = anchors[row] - back
            halves = digests(data, starts, starts + window)
            yield pa.RecordBatch.from_arrays([pa.array(signed(halves[:, i].copy())) for i in (0, 1)] + [batch.column("id").take(pa.array(row)), pa.array(place[row] - back)], ["a", "b", "id", "start"])

    windows = contexts.select("id", "place", "reach", "bytes").mapInArrow(work, "a long, b long, id long, start long")
    first = windows.groupBy("a", "b").agg(F.min("id").alias("first_id"), F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = windows.join(first, ["a", "b"]).filter(F.struct("id", "start") > F.col("first"))
    return again.select("id", "start", (F.col("start") + window).alias("stop"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(docs: DataFrame, spans: DataFrame, window: int, keep_text: bool) -> DataFrame:
    packed = spans.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            steps = np.zeros(len(data) + 1, np.int32)

            def mark(row, start, stop):
                at, end = offsets[row] + np.maximum(0, start), np.minimum(offsets[row] + stop, offsets[row + 1])
                good = at < end
                np.add.at(steps, at[good], 1)
                np.add.at(steps, end[good], -1)

            lists = {c: batch.column(c) for c in ("starts", "stops")}
            counts = pc.fill_null(pc.list_value_length(lists["starts"]), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), counts)
            mark(row, *(lists[c].flatten().to_numpy().astype(np.int64) for c in ("starts", "stops")))
            found = Anchors(data, offsets, window, within=True)
            again = found.repeats(found.row)  # repeats inside the document
            mark(found.row[again], found.place[again] - found.left[again], found.place[again] + found.right[again])
            gone = np.cumsum(steps[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offsets[(offsets < len(data))]
            begins[inner] |= gone[inner]
            total, runs = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(begins)]
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [np.diff(offsets), np.diff(total[offsets]), np.diff(runs[offsets])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in columns), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept if keep_text else [None] * len(kept), pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return docs.join(packed, "id", "left").select("doc_id", "text", "starts", "stops").mapInArrow(work, RESULT)


def remove_repeats(docs: DataFrame, *, window: int = 100, group: int = GROUP, keep_text: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if wanted, the kept bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # Ids of documents without one: above all others, by text.
    own = F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(3 << 61)
    plain = docs.select(F.coalesce(F.col(id_column).cast("long"), own).alias("id"), F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    path = shared_path(spark, "suffix-contexts")
    with tidy_shuffles(spark):
        _judge_contexts(_anchor_rows(plain.select("id", "text"), window), group).write.parquet(path)
        judged = spark.read.parquet(path)
        contexts = _contexts(plain.select("id", "text"), judged.filter(f"kind <> {FULL}"), window)
        edges = cut(_edge_spans(contexts.filter(f"kind = {EDGE}"), window))
        whole = judged.filter(f"kind = {FULL}").select("id", (F.col("place") - (window - GRAM)).cast("long").alias("start"), (F.col("place") + window).cast("long").alias("stop"))
        spans = whole.union(edges)
        if not judged.filter(f"kind = {HOT}").isEmpty():
            spans = spans.union(cut(_hot_spans(contexts.filter(f"kind = {HOT}"), window)))
        out = cut(_remove(plain, spans, window, keep_text))
    remove_path(spark, path)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))
