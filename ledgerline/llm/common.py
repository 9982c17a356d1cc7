"""What several operators share: shared folders, slices of Arrow text columns, vectorised hashing.

Text never crosses a task as a whole column: ``text_slices`` cuts each Arrow batch to a few megabytes, and the
numpy helpers below work on one such slice at a time, so a task's memory does not follow its partition's size.
A single text longer than the limit is one slice of its own.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 512 << 10
#: Rows and bytes of an Arrow batch on its way to a Python worker: texts are long, so the defaults would be tens of megabytes a task.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A folder of this machine's own serves a local session only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="llm-checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Workers import this package: it is sent to them once, unless their search path has it already."""
    root = Path(__file__).resolve().parents[2]
    near = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(Path(p).resolve() == root for p in near):
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "ledgerline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted((root / "ledgerline").rglob("*.py")):
            z.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def prepare(spark: SparkSession) -> None:
    """Sends the package to the workers, and bounds the Arrow batches of this session where it has larger ones."""
    ship_package(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).lower().rstrip("b")
        if not now.isdigit() or int(now) == 0 or int(now) > most:
            spark.conf.set(key, str(most))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a table this library has written, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each finished step go at once: later steps read checkpoints or tables only."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unused(name: str, columns: list[str]) -> str:
    """A name like this one that no column has, so that a caller's columns stay theirs whatever their names."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- slices of text columns ---------------------------------------------------------------------------------------


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            used = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, used + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker lives on, idle, beside the next stage's


def key_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[object, pa.Table]]:
    """Each key with its rows, from a stream sorted by the key."""
    now, held = None, []
    for batch in batches:
        values = batch.column(column).to_numpy()
        for a, b in zip(*runs_of(values), strict=True):
            if held and values[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and each text's start in it (one entry more than texts); null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _separators() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SEPARATOR = _separators()


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, by default ``[^\\x20\\x09-\\x0D]+``; words do not cross rows."""
    n = len(data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separator[data], out=inside[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


# --- hashing ------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Polynomial:
    """Prefix polynomial hashes modulo 2**64 with an odd base, so that a span's hash is one subtraction and one product."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            for name, factor in (("_powers", self.base), ("_inverses", self.inverse)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._powers[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts, ends) -> np.ndarray:
        self._grow(len(prefix))
        return (prefix[ends] - prefix[starts]) * self._inverses[starts]


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, poly: Polynomial, table: np.ndarray) -> np.ndarray:
    prefix = poly.prefix(table[data])
    return mix(poly.spans(prefix, starts, ends) + (ends - starts).astype(np.uint64))


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 of each word's bytes: 128 bits in two columns. Unlike a polynomial modulo 2**64, for which some words of 1,024 letters agree whatever the base, it is sound for words of any length."""
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    found = b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, np.uint64).reshape(-1, 2)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out[:n]


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbouring grams the index of its smallest, the first one of equals.

    The choice depends on the run's content alone, so equal runs choose equal places wherever they stand.
    """
    bits = np.uint64(max(20, int(len(grams)).bit_length()))
    packed = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(packed, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts, np.r_[starts[1:], len(values)]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether all pairs of spans, from a and from b on, hold the same values; a few million of them at a time."""
    ends = np.cumsum(lengths)
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (4 << 20), side="right")))
        if not (data[ranges(a[low:high], lengths[low:high])] == data[ranges(b[low:high], lengths[low:high])]).all():
            return False
        low = high
    return True


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
