"""Operator 8, PII: fixed base matchers, and bootstrapped contextual extraction for what they miss.

Base matches (email, ip, card, phone) and long hexadecimal strings are the seed entities. Each seed, and each other
candidate, stands in a lexical pattern: the two words before it and the punctuation that opens it; a second, shorter pattern has
the last word only. Candidates are words with a digit, groups of digits joined by blanks, brackets, dots or hyphens, and, where
punctuation announces a value (a colon, an equals sign, a quote, a bracket), any word; all of at least ``SHORTEST`` characters and of any length.

Spark scores the graph of patterns and instances in rounds: a pattern's confidence for a kind is the share of its distinct
instances known to be of the kind (with two failures added, so that a pattern needs at least eight instances); an instance's is
the noisy-or of its accepted patterns; accepted instances count as known in the next round, until a round adds none. Confident
patterns then mark the candidates in their place as further spans; base spans always stay.

Documents are scanned twice, once to gather the graph and once to mark; no text is shuffled. The accepted patterns travel to the
second scan as 64-bit hashes, in blocks of at most about ``PATTERN_BLOCK``, one at a time: each is a pass over the rows and is destroyed
before the next one is made. One block is the usual case.

Nulls: a null text is empty (no spans). Ties and repeated rows are marked alike. An empty table gives no rows. Other
columns are kept by ``mask`` and ignored by ``find``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import cut, remove_path, shared_path, text_slices, tidy_shuffles, unused

KINDS = ("email", "ip", "card", "phone")
#: Found by patterns only.
LEARNED = (*KINDS, "secret")
PATTERN_BLOCK = 2_000_000
SHORTEST = 4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
# A match never starts inside a run of digits, and saying so spares the scan of each of its suffixes.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD_WITH_DIGIT = re.compile(r"(?<![^\x20\t-\r])[^\x20\t-\r0-9]*+[0-9][^\x20\t-\r]*+")
_DIGIT_GROUPS = re.compile(r"(?<![^\x20\t-\r])\(?[0-9]++(?:[\x20().-]{1,2}[0-9]++)++")
_AFTER_GROUPS = set(" \t\n\x0b\x0c\r.,;:!?)]}>\"'*#$%&|")
_ANNOUNCED = re.compile(r"[:=][\x20\t-\r]++([^\x20\t-\r]++)|(?<![^\x20\t-\r])[\"'`(\[{<:=]++([^\x20\t-\r]++)")
_FIELD = re.compile(r"[A-Za-z][A-Za-z_-]*[:=]+(?=[^/])")
_EDGES = "\"'`()[]{}<>.,;:!?#$%&*|="
_SECRET = re.compile(r"(?=.*[a-fA-F])(?=.*[0-9])[0-9a-fA-F]{32,}")
_DECORATION = re.compile(r"[#$%&*|!.,;]+$")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    if at < 0:
        return
    back, done = text[::-1], 0
    while at >= 0:
        begin = max(done, at - len(_LOCAL_BACK.match(back, len(text) - at).group()))
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    doubled = str.maketrans("0123456789", "0246813579")
    total = sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(doubled)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """The base matches by kind, then start."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Candidates as they stand, groups of digits first, then by start; they may overlap."""
    if _DIGIT.search(text):
        for m in _DIGIT_GROUPS.finditer(text):
            if len(_digits(m.group())) >= 7 and (m.end() == len(text) or text[m.end()] in _AFTER_GROUPS):
                yield m.span()
        for m in _WORD_WITH_DIGIT.finditer(text):
            yield m.span()
    for m in _ANNOUNCED.finditer(text):
        yield m.span(m.lastindex)


def identifiers(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """The candidates outside the spans, without the punctuation around them, in order; of overlapping ones the first kind counts."""
    out: dict[int, int] = {}
    for begin, end in _candidates(text):
        if field := _FIELD.match(text, begin, end):
            begin = field.end()
        while begin < end and text[begin] in _EDGES:
            begin += 1
        while begin < end and text[end - 1] in _EDGES:
            end -= 1
        if end - begin >= SHORTEST:
            out.setdefault(begin, end)
    free, busy, k, at = [], sorted((a, b) for _, a, b in taken), 0, 0
    for begin, end in sorted(out.items()):
        while k < len(busy) and busy[k][1] <= begin:
            k += 1
        if begin >= at and not (k < len(busy) and busy[k][0] < end):
            free.append((begin, end))
            at = end
    return free


def _words_before(text: str, at: int) -> list[str]:
    """The last two words, whole, however long."""
    reach = 96
    while True:
        words = text[max(0, at - reach) : at].split()
        if len(words) > 2 or reach >= at:
            return words[-2:]
        reach *= 2


def patterns(text: str, begin: int) -> list[str]:
    """The contexts of what starts at ``begin``: two words and the opening punctuation, and one word with it."""
    start = begin
    while start and text[start - 1] in "\"'`([{<:=":
        start -= 1
    opening = text[start:begin]
    words = [_DECORATION.sub("", w).lower() for w in _words_before(text, start)]
    if not words or not words[-1]:
        return []
    return [f"{words[-1]} {opening}", *([f"{words[0]} {words[1]} {opening}"] if len(words) == 2 and words[0] else [])]


def _hash(x: str) -> int:
    h = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


# --- the graph ----------------------------------------------------------------------------------------------------


def occurrences(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``pattern, value, kind``: an instance in its context; kind is null unless it is a seed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                for kind, a, b in [*base, *((None, a, b) for a, b in identifiers(text, base))]:
                    value = text[a:b]
                    if kind is None and _SECRET.fullmatch(value):
                        kind = "secret"
                    rows += [(_hash(p), _hash(value), kind) for p in patterns(text, a)]
            if rows:
                p, v, k = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(v, pa.int64()), pa.array(k, pa.string())], ["pattern", "value", "kind"])

    return docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(work, "pattern long, value long, kind string")


def learn_patterns(docs: DataFrame, *, confidence: float = 0.8, text_column: str = "text") -> DataFrame:
    """``pattern, kind``: the accepted patterns. What is known only grows, so the rounds end."""
    graph = cut(occurrences(docs, text_column).groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    known = cut(graph.filter("kind is not null").groupBy("value").agg(F.max("kind").alias("kind")))
    edges = graph.select("pattern", "value")
    while True:
        counted = edges.join(known, "value", "left").groupBy("pattern").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k) for k in LEARNED])
        best = F.greatest(*LEARNED)
        scored = counted.withColumn("score", best / (F.col("n") + 2)).filter(F.col("score") >= confidence)
        which = F.coalesce(*[F.when(F.col(k) == best, F.lit(k)) for k in LEARNED])
        accepted = cut(scored.select("pattern", which.alias("kind"), "score"))
        believed = edges.join(accepted, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))).alias("belief"))
        believed = believed.filter(F.col("belief") >= confidence).groupBy("value").agg(F.max_by("kind", F.struct("belief", "kind")).alias("kind"))
        found = cut(believed.join(known, "value", "left_anti"))
        if found.isEmpty():
            return accepted.select("pattern", "kind")
        known = cut(known.union(found))


class Patterns:
    """Some accepted patterns: hashes in order, and their kinds."""

    def __init__(self, hashes: np.ndarray, kinds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.kinds = hashes[order], kinds[order]

    def __len__(self) -> int:
        return len(self.hashes)

    def get(self, h: int) -> str | None:
        place = int(np.searchsorted(self.hashes, h))
        return LEARNED[self.kinds[place]] if place < len(self.hashes) and self.hashes[place] == h else None


def _blocks(accepted: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast blocks of the accepted patterns, each made when the one before it is done with; and whether it is the last."""
    parts = max(1, -(-accepted.count() // PATTERN_BLOCK))
    number = F.array_position(F.array(*map(F.lit, LEARNED)), F.col("kind")) - 1
    for i in range(parts):
        found = accepted.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == i).select("pattern", number.cast("byte").alias("kind")).toArrow()  # about PATTERN_BLOCK rows of nine bytes
        yield accepted.sparkSession.sparkContext.broadcast(Patterns(found.column("pattern").to_numpy(), found.column("kind").to_numpy())), i == parts - 1


# --- marking ------------------------------------------------------------------------------------------------------


#: By its start: the kind and end of an added span, and whether the longer context gave it.
Marks = dict[int, tuple[str, int, bool]]


def mark(text: str, base: list[Span], known: Patterns, marks: Marks) -> Marks:
    """Adds what these patterns say to the marks; the longer context wins, in whatever block it is."""
    for a, b in identifiers(text, base) if len(known) else ():
        for long, p in reversed(list(enumerate(patterns(text, a)))):
            if (kind := known.get(_hash(p))) and (a not in marks or long and not marks[a][2]):
                marks[a] = (kind, b, bool(long))
                break
    return marks


def _written(marks: Marks) -> str:
    return ",".join(f"{a}:{kind}:{b}:{int(long)}" for a, (kind, b, long) in marks.items())


def _read(written: str) -> Marks:
    return {int(a): (kind, int(b), long == "1") for a, kind, b, long in (x.split(":") for x in written.split(",") if x)}


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


Finish = Callable[[pa.RecordBatch, list[list[Span]], list[list[Span]]], pa.RecordBatch]


def with_spans(docs: DataFrame, finish: Finish, schema: str | T.StructType, text_column: str = "text", **options) -> DataFrame:
    """What ``finish`` makes of each slice of rows with its base spans and its added ones.

    One block of patterns is one pass. Between passes the rows lie in the shared folder, with the spans found so far.
    """
    spark, width = docs.sparkSession, len(docs.columns)
    with tidy_shuffles(spark):
        accepted = learn_patterns(docs, text_column=text_column, **options)
    marked = unused("pii_marks", docs.columns)
    carried = T.StructType([*docs.schema.fields, T.StructField(marked, T.StringType())])

    def passed(handle: Broadcast, first: bool, last: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = handle.value
            for batch in text_slices(batches, text_column):
                texts = [t or "" for t in batch.column(text_column).to_pylist()]
                base = list(map(base_spans, texts))
                marks = [{} for _ in texts] if first else map(_read, batch.column(marked).to_pylist())
                marks = [mark(text, own, known, old) for text, own, old in zip(texts, base, marks, strict=True)]
                rows = pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width])
                if last:
                    yield finish(rows, base, [[(kind, a, b) for a, (kind, b, _) in sorted(own.items())] for own in marks])
                else:
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(map(_written, marks), pa.string())], carried.names)

        return work

    out, written = docs, None
    for handle, last in _blocks(accepted):
        out = out.mapInArrow(passed(handle, written is None, last), schema if last else carried)
        if not last:
            path = shared_path(spark, "pii-pass")
            out.write.parquet(path)
            out = spark.read.schema(carried).parquet(path)
            handle.destroy()
            if written:
                remove_path(spark, written)
            written = path
    return out


_ORDER = {k: i for i, k in enumerate(LEARNED)}
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Per document: the counts and digest of its base spans, and all spans."""

    def finish(batch: pa.RecordBatch, base: list[list[Span]], added: list[list[Span]]) -> pa.RecordBatch:
        counts = [pa.array([sum(k == kind for k, _, _ in spans) for spans in base], pa.int64()) for kind in KINDS]
        digests = pa.array([hashlib.sha256(_listed(spans).encode()).hexdigest() for spans in base], pa.string())
        spans = pa.array([_listed(sorted(x + y, key=lambda s: (_ORDER[s[0]], s[1]))) for x, y in zip(base, added, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, spans], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return with_spans(plain, finish, FOUND, **options)


def masked(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the first one names the whole."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, *, text_column: str = "text", **options) -> DataFrame:
    """The documents, all columns, with every span in the text replaced by its kind."""
    place, names = docs.columns.index(text_column), docs.columns
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == text_column else f for f in docs.schema.fields])

    def finish(batch: pa.RecordBatch, base: list[list[Span]], added: list[list[Span]]) -> pa.RecordBatch:
        texts = [masked(t, x + y) if x or y else t for t, x, y in zip(batch.column(place).to_pylist(), base, added, strict=True)]
        columns = list(batch.columns)
        columns[place] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    return with_spans(docs, finish, schema, text_column, **options)
