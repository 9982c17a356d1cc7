"""Operator 5, LM scoring: a log-frequency Bloom filter of quantised n-gram counts.

Slices. Texts are gathered to slices of about ``SLICE`` bytes, once, in the shared folder; a slice's distinct n-grams travel together.

Counting. N-grams are dealt out by their hashes to buckets, as many as the corpus needs for buckets of one size. The slices of
training texts send each bucket its words and bigrams with their counts, a row per slice and bucket. A bucket adds them up, and a
count becomes a level: counts up to ``EXACT`` are their own levels, above that each level's counts begin at ``BASE`` times the last
one's. Every word and every bigram is kept. Inside a bucket the next 32 bits of its hash name a bigram (a bucket has about a million
of them, so one in some thousands shares its name, far fewer than the filter's false hits).

Filter. A bucket has a Bloom filter of ``bits`` bits for each insertion: an n-gram of level q is inserted q times, as (n-gram, 1)
... (n-gram, q). Beside the filter lie the exact counts of the bucket's words, for the base score and as the counts of contexts.

Probing. Slices ask each bucket about their distinct n-grams; the bucket probes (n-gram, 1), (n-gram, 2), ... until the first miss, and
the last hit is the level. With q() for the least count of a level, bigrams are smoothed with words, these with one unknown word:
p(w | v) = WEIGHT q(v w) / c(v) + (1 - WEIGHT) p(w) and p(w) = (q(w) + 0.5) / (N + 0.5 (V + 1)), where p(w | v) = p(w) after an unknown v.
q() never exceeds the count, so over all words and the unknown one these sum to at most 1; what is missing is what quantising
takes off, and the model gives it to no word. Only a false hit of the filter can add to it.

The filter grows with the corpus, so no broadcast of it has a size bound: its buckets meet the probes by shuffle. Each text is read
three times (gathered, asked for, scored), whatever the size of the corpus.

Nulls: a null text has no words, only the end token; a null id counts as training. Repeated rows count each. Empty
tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, key_runs, mix, runs_of, text_bytes, text_slices, tidy_shuffles, word_digests, word_spans

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
END, BEGIN = np.uint64(0x1234567), np.uint64(0x89ABCDE)
#: Levels are exact up to the first; later ones begin at multiples by the second.
EXACT, BASE, WEIGHT = 8, 1.25, 0.3
LEAST = np.array([*range(1, EXACT + 1), *(math.ceil(EXACT * BASE**k) for k in range(1, 160))], np.int64)
#: Bits for each insertion, hash functions.
BITS, PROBES = 12, 6
#: Bytes of text of a slice, and for each bucket.
SLICE, BUCKET = 1 << 20, 8 << 20
#: Tokens (or sums) that a task combines before it sends them.
COMBINED = 1_000_000
CODEC = pa.Codec("zstd", 3)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's word hashes and the end token, and where each row's tokens start (one entry more than rows)."""
    n = len(offsets) - 1
    data = FOLD[data]
    starts, ends, rows = word_spans(data, offsets)
    bounds = np.r_[0, np.cumsum(np.bincount(rows, minlength=n) + 1)]
    tokens = np.full(bounds[-1], END, np.uint64)
    tokens[np.arange(len(rows)) + rows] = word_digests(data, starts, ends)[:, 0]
    return tokens, bounds


def bigrams(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it."""
    before = np.r_[BEGIN, tokens[:-1]]
    before[bounds[:-1]] = BEGIN
    return mix(before * np.uint64(0xE7037ED1A0B428DB) + tokens)


# --- slices and buckets -------------------------------------------------------------------------------------------


def slices_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out: Column | None = None) -> DataFrame:
    """``slice, ids, held, ends, body``: texts one after another, compressed, with the place where each ends; written, as slices are named by their task."""
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_column).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in text_slices(batches, limit=SLICE):
            data, offsets = text_bytes(batch.column("text"))
            whole = pa.array([0, batch.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, c) for c in (batch.column("id"), batch.column("held"), pa.array(offsets[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([_compressed(data)], pa.binary())], ["slice", "ids", "held", "ends", "body"])
            number += 1

    return cut(rows.mapInArrow(work, "slice long, ids array<long>, held array<boolean>, ends array<long>, body binary"))


def _compressed(data: np.ndarray) -> bytes:
    return CODEC.compress(data.tobytes(), asbytes=True)


def _tokens(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the first row, a slice, and where each text's tokens start."""
    offsets = np.r_[0, row.column("ends")[0].values.to_numpy()]
    body = CODEC.decompress(row.column("body")[0].as_buffer(), int(offsets[-1])) if offsets[-1] else b""
    return token_hashes(np.frombuffer(body, np.uint8), offsets)


def placed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit name of each key; both ascend with the keys."""
    low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
    whole = high * np.uint64(buckets) + (low * np.uint64(buckets) >> np.uint64(32))
    return (whole >> np.uint64(32)).astype(np.int64), whole.astype(np.uint32)


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values between the cuts, as bytes."""
    values = np.ascontiguousarray(values)
    places = (cuts * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(places), pa.py_buffer(values)]).cast(pa.binary())


def _names(names: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Ascending names between the cuts: their differences, first all lowest bytes, last all highest ones (mostly zero)."""
    parts = [np.diff(names[a:b], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.array(parts, pa.binary())


def _named(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The names of all rows, and their cuts."""
    parts = [np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32) for x in column.to_pylist() if x is not None]
    return np.concatenate([np.empty(0, np.uint32), *parts]).astype(np.uint64), np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)


def _values(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), kind)


def _dealt(words: np.ndarray, pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The buckets of two sorted arrays of keys, the cuts of each by these, and the names of the second."""
    of_words, (of_pairs, names) = placed(words, buckets)[0], placed(pairs, buckets)
    there = np.union1d(of_words, of_pairs)
    by_pairs = np.r_[np.searchsorted(of_pairs, there), len(pairs)]
    return there, np.r_[np.searchsorted(of_words, there), len(words)], by_pairs, _names(names, by_pairs)


# --- counting -----------------------------------------------------------------------------------------------------


def quantised(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, side="right").astype(np.uint8)


def level_value(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for what the filter does not hold."""
    return np.r_[0, LEAST][levels].astype(np.float64)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(keys[order]) > 0]) if len(keys) else np.empty(0, np.int64)
    return keys[order[starts]], np.add.reduceat(values[order], starts) if len(keys) else values


def count_ngrams(slices: DataFrame, buckets: int) -> DataFrame:
    """``bucket, words, word_counts, pairs, pair_counts`` of the training texts."""

    def sent(tokens: list[np.ndarray], twos: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(tokens), return_counts=True)
        pairs, m = np.unique(np.concatenate(twos), return_counts=True)
        there, a, b, names = _dealt(words, pairs, buckets)
        columns = [_blobs(words, a), _blobs(n.astype(np.uint32), a), names, _blobs(m.astype(np.uint32), b)]
        return pa.RecordBatch.from_arrays([pa.array(there), *columns], ["bucket", "words", "word_counts", "pairs", "pair_counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos, held = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                tokens, bounds = _tokens(row)
                training = np.repeat(~row.column("held")[0].values.to_numpy(zero_copy_only=False), np.diff(bounds))
                ones.append(tokens[training])
                twos.append(bigrams(tokens, bounds)[training])
                held += len(ones[-1])
                if held >= COMBINED:
                    yield sent(ones, twos)
                    ones, twos, held = [], [], 0
        if held:
            yield sent(ones, twos)

    return slices.select("held", "ends", "body").mapInArrow(work, "bucket long, words binary, word_counts binary, pairs binary, pair_counts binary")


# --- the filter ---------------------------------------------------------------------------------------------------


def bit_places(keys: np.ndarray, levels, n_bits: int) -> Iterator[np.ndarray]:
    """For each hash function the bit of (key, level)."""
    h = mix(keys + np.asarray(levels).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (((low + np.uint64(i) * step & np.uint64(0xFFFFFFFF)) * np.uint64(n_bits)) >> np.uint64(32)).astype(np.int64)


def filled(keys: np.ndarray, levels: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """A Bloom filter with each key inserted as often as its level says, and its number of bits."""
    n_bits = max(8, int(levels.sum(dtype=np.int64)) * bits)
    flags = np.zeros(n_bits, bool)
    level = 1
    while len(keys):
        for place in bit_places(keys, np.uint64(level), n_bits):
            flags[place] = True
        more = levels > level
        keys, levels, level = keys[more], levels[more], level + 1
    return np.packbits(flags, bitorder="little"), n_bits


def probed(keys: np.ndarray, flags: np.ndarray, n_bits: int) -> np.ndarray:
    """Levels of the keys: of (key, 1), (key, 2), ... the last one before the first miss."""
    out, alive, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
    while len(alive) and level < 255:
        level += 1
        hit = np.ones(len(alive), bool)
        for place in bit_places(keys[alive], np.uint64(level), n_bits):
            hit &= (flags[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        alive = alive[hit]
        out[alive] = level
    return out


MODEL = "bucket long, of long, tokens long, types long, n_bits long, bits binary, words binary, counts binary"


def build(counts: DataFrame, buckets: int, bits: int) -> DataFrame:
    """The model: for each bucket its filter and its words with their counts."""
    names = [field.split()[0] for field in MODEL.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in key_runs(batches, "bucket"):
            words, n = summed(_values(rows.column("words"), np.uint64), _values(rows.column("word_counts"), np.uint32).astype(np.int64))
            pairs, m = summed(_named(rows.column("pairs"))[0], _values(rows.column("pair_counts"), np.uint32).astype(np.int64))
            flags, n_bits = filled(np.r_[words, pairs], np.r_[quantised(n), quantised(m)], bits)
            sums = [[bucket], [buckets], [int(n.sum())], [len(words)], [n_bits]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in sums), *(pa.array([x.tobytes()], pa.binary()) for x in (flags, words, n))], names)

    return counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, MODEL)


def train(slices: DataFrame, *, bits: int = BITS, bucket_bytes: int = BUCKET) -> DataFrame:
    """The model of the slices' texts that are not held out."""
    size = slices.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    return cut(build(count_ngrams(slices, buckets), buckets, bits))


# --- scoring ------------------------------------------------------------------------------------------------------


def answers(slices: DataFrame, model: DataFrame, buckets: int) -> DataFrame:
    """``slice, bucket, word_levels, counts, pair_levels``: what the buckets know of a slice's distinct n-grams, in their order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, bounds = _tokens(batch.slice(i, 1))
                words, pairs = np.unique(tokens), np.unique(bigrams(tokens, bounds))
                there, a, _, names = _dealt(words, pairs, buckets)
                where = pa.array(np.full(len(there), batch.column("slice")[i].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(there), where, _blobs(words, a), names], ["bucket", "slice", "words", "pairs"])

    asked = slices.select("slice", "ends", "body").mapInArrow(ask, "bucket long, slice long, words binary, pairs binary")
    nothing = F.lit(None).cast("binary")
    known = model.select("bucket", F.lit(-1).cast("long").alias("slice"), "words", nothing.alias("pairs"), "n_bits", "bits", "counts")
    asked = asked.select("bucket", "slice", "words", "pairs", F.lit(None).cast("long").alias("n_bits"), *(nothing.alias(c) for c in ("bits", "counts")))

    def reply(rows: pa.RecordBatch, table: dict) -> pa.RecordBatch:
        """The rows of one bucket."""
        words, (pairs, by_pairs) = _values(rows.column("words"), np.uint64), _named(rows.column("pairs"))
        by_words = np.r_[0, np.cumsum([len(x) // 8 for x in rows.column("words").to_pylist()])]
        place = np.minimum(np.searchsorted(table["words"], words), len(table["words"]) - 1)
        exact = np.where(table["words"][place] == words, table["counts"][place], 0)
        levels = [probed(keys, table["bits"], table["n_bits"]) for keys in (words, pairs)]
        columns = [_blobs(levels[0], by_words), _blobs(exact, by_words), _blobs(levels[1], by_pairs)]
        return pa.RecordBatch.from_arrays([rows.column("slice"), rows.column("bucket"), *columns], ["slice", "bucket", "word_levels", "counts", "pair_levels"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"words": np.uint64, "counts": np.int64, "bits": np.uint8}
        nobody = {c: np.zeros(1, t) for c, t in kinds.items()} | {"n_bits": 8}
        of, table = None, nobody
        for batch in batches:
            here = batch.column("bucket").to_numpy()
            for a, b in zip(*runs_of(here), strict=True):
                if here[a] != of:
                    of, table = here[a], nobody
                if batch.column("slice")[a].as_py() < 0:
                    table = {c: np.frombuffer(batch.column(c)[a].as_py(), t) for c, t in kinds.items()} | {"n_bits": batch.column("n_bits")[a].as_py()}
                    a += 1
                if a < b:
                    yield reply(batch.slice(a, b - a), table)

    met = known.union(asked).repartition("bucket").sortWithinPartitions("bucket", "slice")
    return cut(met.mapInArrow(answer, "slice long, bucket long, word_levels binary, counts binary, pair_levels binary"))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(slices: DataFrame, model: DataFrame) -> DataFrame:
    """Per text of the slices: tokens, known tokens, the exact unigram base score and the filter model's log10 probability.

    The texts of a model are as many as its end tokens.
    """
    buckets, total, distinct = (x or 0 for x in model.agg(F.max("of"), F.sum("tokens"), F.sum("types")).first())
    whole = total + 0.5 * (distinct + 1)
    lists, replies, nothing = ["ids", "held", "ends", "body"], ["word_levels", "counts", "pair_levels"], F.lit(None).cast("binary")
    said = answers(slices, model, max(1, buckets))
    said = said.select("slice", "bucket", *(F.lit(None).cast(slices.schema[c].dataType).alias(c) for c in lists), *replies)
    texts = slices.select("slice", F.lit(-1).cast("long").alias("bucket"), *lists, *(nothing.alias(c) for c in replies))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in key_runs(batches, "slice"):
            head, rest = rows.slice(0, 1).combine_chunks().to_batches()[0], rows.slice(1)
            tokens, bounds = _tokens(head)
            word_levels, counts, pair_levels = (_values(rest.column(c), t) for c, t in zip(replies, (np.uint8, np.int64, np.uint8), strict=True))
            words, places = np.unique(tokens, return_inverse=True)
            exact = counts[places]
            one = (level_value(word_levels)[places] + 0.5) / whole
            two = level_value(pair_levels)[np.unique(bigrams(tokens, bounds), return_inverse=True)[1]]
            context = np.r_[0, exact[:-1]]
            context[bounds[:-1]] = counts[np.searchsorted(words, END)]  # every text has its end token, and its start
            smooth = np.where(context > 0, WEIGHT * np.minimum(two, context) / np.maximum(context, 1) + (1 - WEIGHT) * one, one)
            sums = lambda x: np.add.reduceat(x, bounds[:-1])
            columns = [np.diff(bounds), sums((exact > 0).astype(np.int64)), np.full(len(bounds) - 1, total), sums(np.log10((exact + 0.5) / whole)), sums(np.log10(smooth))]
            yield pa.RecordBatch.from_arrays([head.column("ids")[0].values, head.column("held")[0].values, *map(pa.array, columns)], RESULT_NAMES)

    return texts.union(said).repartition("slice").sortWithinPartitions("slice", "bucket").mapInArrow(work, RESULT)


RESULT_NAMES = [field.split()[0] for field in RESULT.split(", ")]


def score_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS, bucket_bytes: int = BUCKET) -> DataFrame:
    """Scores of all documents by the model of those whose CRC-32 of the id leaves another remainder than 1 by 5."""
    held = F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 1
    with tidy_shuffles(docs.sparkSession):
        slices = slices_of(docs, id_column, text_column, held)
        return score(slices, train(slices, bits=bits, bucket_bytes=bucket_bytes))
