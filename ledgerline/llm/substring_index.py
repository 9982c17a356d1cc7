"""Operator 1, substring dedup: a log-structured index of window hashes.

A window is ``WINDOW`` consecutive words. Of the grams (``GRAM`` words) inside it, the one with the smallest hash names the window:
equal windows have equal names, and neighbouring windows mostly share one, so an index entry stands for about a dozen windows. An
entry is the gram's hash, the hash of its whole context (all words that windows around it can hold) and a 64-bit digest
of each window that the gram names. Gram hashes are made of one half of the words' 128-bit XXH3 digests, context and window digests of the other half.

Batches arrive in the order of ids. A batch's entries are sorted by gram and written as one immutable run, a table bucketed and
sorted by gram, after its own repeats have been found. Runs of earlier batches are merge-joined with it, bucket by bucket and
without a shuffle: an entry with the same gram and context means that all windows around it are known; where only the
gram is the same, the digests verify window by window. When a level has ``FANOUT`` runs, they are merged (a full outer merge join
by gram and context, again bucket by bucket) into one run of the next level, and the old ones are dropped.

The index lives in a folder: its runs, and a manifest for each state (levels and settings), written whole before it takes its name. A
later session opens the folder, appends batches and compacts; a batch that fails leaves the last state as it was.

A gram that very many rows share is judged as a stream and its windows in a Spark grouping, so nothing is held whole. Repeats
inside one slice of a task are found before the shuffle and travel by document, so copies of one text do not meet in one task.

Nulls: a null text has no words; null ids come last and, by text, stand for documents of their own. Rows that repeat an id must
repeat its text; they get the same result. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import (
    Polynomial,
    cut,
    minimizers,
    mix,
    ranges,
    remove_path,
    runs_of,
    shared_path,
    shuffle_width,
    signed,
    text_bytes,
    text_slices,
    tidy_shuffles,
    word_digests,
    word_spans,
)
from ledgerline.llm.contexts import FULL, ONLY, judge_stream

WINDOW, GRAM = 50, 25
DIGEST = 8
GROUP = 50_000
FANOUT = 2
POLY_A, POLY_B = Polynomial(0x9E3779B97F4A7C15), Polynomial(0xD6E8FEB86659FD93)


def _entries(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``gram, context, id, place, first, covered, digests``: a row per named gram of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, rows = word_spans(data, offsets)
            n = len(rows) - window + 1
            if n <= 0:
                continue
            ids = batch.column("id").to_numpy()
            a, b = (p.prefix(w) for p, w in zip((POLY_A, POLY_B), word_digests(data, starts, ends).T, strict=True))
            places = np.arange(len(rows) - gram + 1)
            grams = mix(POLY_A.spans(a, places, places + gram))
            good = np.flatnonzero(rows[:n] == rows[window - 1 :])
            if not len(good):
                continue
            chosen = minimizers(grams, window - gram + 1)[good]
            head, tail = runs_of(chosen)
            at = chosen[head]
            row = rows[at]
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            begin, end = bounds[row], bounds[row + 1]
            left, right = np.minimum(window - gram, at - begin), np.minimum(window, end - at)
            shape = (left * 1024 + right).astype(np.uint64)
            context = mix(POLY_B.spans(b, at - left, at + right) + shape * np.uint64(0xA0761D6478BD642F))
            digests = mix(POLY_B.spans(b, good, good + window))
            bits = np.ascontiguousarray(digests.view(np.uint8).reshape(-1, 8)[:, :DIGEST])
            cuts = np.r_[head, tail[-1]].astype(np.int64) * DIGEST
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(bits)]).cast(pa.binary())
            doc, name = ids[row], grams[at]
            order = np.lexsort((doc, context, name))
            new = np.r_[True, (name[order[1:]] != name[order[:-1]]) | (context[order[1:]] != context[order[:-1]])]
            least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            covered = np.zeros(len(order), bool)
            covered[order] = doc[order] > least
            name = np.where(covered, mix(doc.astype(np.uint64)), name)
            packed = pc.if_else(pa.array(covered), pa.scalar(None, pa.binary()), packed)
            columns = [pa.array(signed(name)), pa.array(signed(context)), pa.array(doc), pa.array((at - begin).astype(np.int32)), pa.array((good[head] - begin).astype(np.int32)), pa.array(covered), packed]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "context", "id", "place", "first", "covered", "digests"])

    return docs.mapInArrow(work, "gram long, context long, id long, place int, first int, covered boolean, digests binary")


RUN = "gram long, context long, id long, place int, first int, kind byte, again boolean, digests binary"


def _judge(entries: DataFrame, buckets: int, group: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, kind, again in judge_stream(batches, group):
            table = table.select(["gram", "context", "id", "place", "first", "digests"])
            table = table.add_column(5, "kind", pa.array(kind)).add_column(6, "again", pa.array(again))
            known, full = table.filter(pa.array(kind != FULL)), table.filter(pa.array(kind == FULL))
            yield from known.to_batches()
            # What repeats an earlier document's context needs no digests.
            yield from full.set_column(7, "digests", pa.nulls(full.num_rows, pa.binary())).to_batches()

    return entries.repartition(buckets, "gram").sortWithinPartitions("gram", "context", "id").mapInArrow(work, RUN)


def _windows(rows: DataFrame) -> DataFrame:
    """``gram, digest, id, start``: a row per window of the entries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "digests", 512 << 10):
            data, offsets = text_bytes_binary(batch.column("digests"))
            n = np.diff(offsets) // DIGEST
            wide = np.zeros((int(n.sum()), 8), np.uint8)
            wide[:, :DIGEST] = data.reshape(-1, DIGEST)
            row = np.repeat(np.arange(batch.num_rows), n)
            start = ranges(batch.column("first").to_numpy().astype(np.int64), n)
            yield pa.RecordBatch.from_arrays([batch.column("gram").take(pa.array(row)), pa.array(wide.view(np.int64).ravel()), batch.column("id").take(pa.array(row)), pa.array(start)], ["gram", "digest", "id", "start"])

    return rows.select("gram", "id", "first", "digests").mapInArrow(work, "gram long, digest long, id long, start long")


def text_bytes_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)), offsets - offsets[0]


class FingerprintIndex:
    """The index: levels of runs, each a bucketed and sorted table in the index's folder."""

    def __init__(self, spark: SparkSession, root: str | None = None, *, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, fanout: int = FANOUT, buckets: int | None = None):
        """Opens the index in the folder ``root`` with the settings it was made with, or makes one there (None: in the shared folder)."""
        self.spark, self.root = spark, root or shared_path(spark, "fingerprint-index")
        self.settings = {"window": window, "gram": gram, "group": group, "fanout": fanout, "buckets": buckets or shuffle_width(spark)}
        self.levels: list[list[str]] = [[]]
        self.state = 0
        if found := self._states():
            self.state = max(found)
            stored = json.loads(self._read(found[self.state]))
            self.settings, self.levels = stored["settings"], stored["levels"]
            for name in self._runs():
                self._register(name)
        self.window, self.gram, self.group, self.fanout, self.buckets = (self.settings[k] for k in ("window", "gram", "group", "fanout", "buckets"))

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # --- the manifest ---

    def _store(self):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _states(self) -> dict[int, str]:
        store, path = self._store()
        if not store.exists(path(self.root)):
            return {}
        names = [f.getPath().getName() for f in store.listStatus(path(self.root))]
        return {int(n[9:-5]): n for n in names if re.fullmatch(r"manifest-\d+\.json", n)}

    def _read(self, name: str) -> str:
        return "".join(r.value for r in self.spark.read.text(self._path(name), wholetext=True).collect())  # one small file

    def _commit(self) -> None:
        """Names the state; the one before it goes afterwards."""
        store, path = self._store()
        self.state += 1
        draft = self._path(f"draft-{uuid.uuid4().hex}")
        out = store.create(path(draft))
        out.write(bytearray(json.dumps({"settings": self.settings, "levels": self.levels}).encode()))
        out.close()
        if not store.rename(path(draft), path(self._path(f"manifest-{self.state:08d}.json"))):
            raise RuntimeError(f"state {self.state} of the index exists: another session writes to it")
        for k, name in self._states().items():
            if k < self.state:
                store.delete(path(self._path(name)), False)

    @contextlib.contextmanager
    def _settings(self) -> Iterator[None]:
        """Runs are partitioned by gram alone; joins by gram and context may use that, and only merge joins keep memory bounded."""
        wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.join.preferSortMergeJoin": "true"}
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            with tidy_shuffles(self.spark):
                yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", self._path(name)).bucketBy(self.buckets, "gram").sortBy("gram").saveAsTable(name)
        return name

    def _register(self, name: str) -> None:
        """A table over a run's files, where this catalog has none yet."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (gram) SORTED BY (gram) INTO {self.settings['buckets']} BUCKETS LOCATION '{self._path(name)}'")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, self._path(name))

    def close(self) -> None:
        """Leaves the folder as it is and takes the tables out of this session's catalog."""
        for name in self._runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = [[]]

    def drop(self) -> None:
        """Removes the index."""
        self.close()
        remove_path(self.spark, self.root)

    def _known(self, name: str) -> DataFrame:
        return self.spark.table(name).filter(f"kind <> {FULL} and not again").select("gram", "context", "digests")

    def add(self, docs: DataFrame) -> DataFrame:
        """Matches a batch (``id, text``, ids above all earlier ones) with the index and itself, then takes it in.

        Returns ``id, start, stop``: spans of words whose windows start in a document with a smaller id.
        """
        run = None
        try:
            with self._settings():
                run = self._write(_judge(_entries(docs, self.window, self.gram), self.buckets, self.group))
                found = self._matches(run)
                self._take(run)
            return found
        except BaseException:
            if run and run not in self._runs():
                self._drop(run)
            raise

    def _matches(self, run: str) -> DataFrame:
        """The repeats that a new run holds of itself and of the runs before."""
        rows = self.spark.table(run)
        fresh = rows.filter(f"kind <> {FULL}")
        for name in [n for level in self.levels for n in level]:
            old = self._known(name)
            same = old.select("gram", "context", F.lit(True).alias("hit")).hint("merge")
            fresh = fresh.withColumnsRenamed({"hit": "hit_before", "seen": "seen_before"}).join(same, ["gram", "context"], "left")
            fresh = fresh.join(old.select("gram").distinct().withColumn("seen", F.lit(True)).hint("merge"), "gram", "left")
            if "hit_before" in fresh.columns:
                fresh = fresh.withColumns({"hit": F.coalesce("hit", "hit_before"), "seen": F.coalesce("seen", "seen_before")}).drop("hit_before", "seen_before")
        if "hit" not in fresh.columns:
            fresh = fresh.withColumns({"hit": F.lit(None).cast("boolean"), "seen": F.lit(None).cast("boolean")})
        around = [(F.col("place") - (self.window - self.gram)).cast("long").alias("start"), (F.col("place") + self.window).cast("long").alias("stop")]
        spans = [rows.filter(f"kind = {FULL}").select("id", *around), fresh.filter("hit").select("id", *around)]
        edges = fresh.filter(f"hit is null and (kind <> {ONLY} or seen)")
        windows = _windows(edges)
        least = windows.groupBy("gram", "digest").agg(F.min("id").alias("least"))
        for name in [n for level in self.levels for n in level]:
            old = self._known(name).join(edges.select("gram").distinct().hint("merge"), "gram", "left_semi")
            older = _windows(old.select("gram", F.lit(None).cast("long").alias("id"), F.lit(0).alias("first"), "digests"))
            least = least.union(older.select("gram", "digest", F.lit(-(1 << 63)).alias("least")))
        if self._runs():
            least = least.groupBy("gram", "digest").agg(F.min("least").alias("least"))
        spans.append(windows.join(least, ["gram", "digest"]).filter("id > least").select("id", "start", (F.col("start") + self.window).alias("stop")))
        return cut(reduce(DataFrame.union, spans))

    def _take(self, run: str) -> None:
        level, replaced = 0, []
        levels = [list(x) for x in self.levels]
        levels[0].append(run)
        while len(levels[level]) >= self.fanout:
            merged = self._merge(levels[level])
            replaced += levels[level]
            levels[level] = []
            level += 1
            if level == len(levels):
                levels.append([])
            levels[level].append(merged)
        self.levels = levels
        self._commit()
        for name in replaced:
            self._drop(name)

    def _merge(self, names: list[str]) -> str:
        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            right = b.withColumnRenamed("digests", "others").hint("merge")
            return a.join(right, ["gram", "context"], "full").select("gram", "context", F.coalesce("digests", "others").alias("digests"))

        merged = reduce(both, map(self._known, names))
        return self._write(merged.withColumns({"kind": F.lit(ONLY).cast("byte"), "again": F.lit(False)}))


def _remove(docs: DataFrame, spans: DataFrame, keep_text: bool) -> DataFrame:
    packed = spans.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            begins, ends, rows = word_spans(data, offsets)
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            counts = pc.fill_null(pc.list_value_length(batch.column("starts")), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), counts)
            start, stop = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("starts", "stops"))
            at, end = bounds[row] + np.maximum(0, start), np.minimum(bounds[row] + stop, bounds[row + 1])
            good = at < end
            steps = np.zeros(len(rows) + 1, np.int32)
            np.add.at(steps, at[good], 1)
            np.add.at(steps, end[good], -1)
            gone = np.cumsum(steps[:-1]) > 0
            total = np.r_[0, np.cumsum(gone)]
            # The kept words, each followed by a space, in one array; a text's words are a slice of it.
            left = np.flatnonzero(~gone)
            lengths = ends[left] - begins[left] + 1
            body = np.append(data, np.uint8(32))[ranges(begins[left], lengths)] if len(left) else np.empty(0, np.uint8)
            closing = np.cumsum(lengths)
            body[closing - 1] = 32
            closing = np.r_[0, closing]
            kept_before = np.r_[0, np.cumsum(~gone)][bounds]
            raw = body.tobytes()
            kept = [raw[a : max(a, b - 1)] for a, b in zip(closing[kept_before[:-1]].tolist(), closing[kept_before[1:]].tolist(), strict=True)]
            columns = [pa.array(np.diff(bounds)), pa.array(np.diff(total[bounds])), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array([k.decode() if keep_text else None for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return docs.join(packed, "id", "left").select("doc_id", "text", "starts", "stops").mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, *, batches: int = 3, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, keep_text: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_sha256`` and, if wanted, the kept words joined by spaces."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # Ids of documents without one: above all others, by text.
    own = F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(3 << 61)
    plain = docs.select(F.coalesce(F.col(id_column).cast("long"), own).alias("id"), F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    cuts = plain.stat.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({max(-(1 << 63), min(int(c), (1 << 63) - 2)) for c in cuts})  # quantiles are doubles
    index = FingerprintIndex(spark, window=window, gram=gram, group=group)
    spans = []
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            part = plain if low is None else plain.filter(F.col("id") > low)
            part = part if high is None else part.filter(F.col("id") <= high)
            spans.append(index.add(part.select("id", "text")))
    finally:
        index.drop()
    with tidy_shuffles(spark):
        out = _remove(plain, reduce(DataFrame.union, spans), keep_text)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else []))
