"""Operator 12, fill-in-middle: texts cut in three by a sparse checkpoint index.

A unit is a run of ASCII letters or one other character. Units are counted in blocks of bytes; each ``step``-th unit leaves a checkpoint with its
byte and code-point offset, so the index of a text of any length is a ``step``-th of its units. A cut is found by binary search
among the checkpoints and a rescan of at most ``step`` units from there. Where to cut, and the form of the output, follow from a hash of the
document's id, so a rerun of a lost task gives the same rows.

Nulls: a null text is empty, and a null id hashes as no digits. An empty text, and one that holds a sentinel, stays plain. Rows that repeat
an id are cut alike; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_bytes, text_slices

STEP, BLOCK = 512, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = True
    return table


LETTER = _letters()


def _starts(data: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of ``data[a:b]`` begin a unit, and which a code point."""
    part = data[a:b]
    letter = LETTER[part]
    before = np.r_[a > 0 and LETTER[data[a - 1]], letter[:-1]]
    point = (part & 0xC0) != 0x80
    return point & ~(letter & before), point


class Checkpoints:
    """Byte and code-point offsets of every ``step``-th unit of one UTF-8 text, noted while its units are counted."""

    def __init__(self, data: np.ndarray, step: int = STEP, block: int = BLOCK):
        self.data, self.step = data, step
        self.units, self.points = 0, 0
        places, points = [], []
        for a in range(0, len(data), block):
            unit, point = _starts(data, a, min(a + block, len(data)))
            at = np.flatnonzero(unit)
            chosen = at[-self.units % step :: step]
            places.append(chosen + a)
            points.append(self.points + np.cumsum(point)[chosen] - 1)
            self.units += len(at)
            self.points += int(point.sum())
        self.places, self.chars = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, points))
        self.numbers = np.arange(len(self.places)) * step

    def locate(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which the unit begins; the text's end for the unit after the last."""
        if unit >= self.units:
            return len(self.data), self.points
        k = int(np.searchsorted(self.numbers, unit, side="right")) - 1
        at, left = int(self.places[k]), unit - int(self.numbers[k])
        chars, width = int(self.chars[k]), 4 * self.step
        while True:
            starts, point = _starts(self.data, at, min(at + width, len(self.data)))
            found = np.flatnonzero(starts)
            if left < len(found):
                return at + int(found[left]), chars + int(np.count_nonzero(point[: found[left]]))
            left -= len(found)
            chars += int(np.count_nonzero(point))
            at += len(starts)


def split(doc_id: int | None, text: bytes, *, plain_percent: int = 10, spm_percent: int = 20, step: int = STEP) -> tuple[int, str, int | None, int | None, bytes]:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    index = Checkpoints(np.frombuffer(text, np.uint8), step)
    n = index.units
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or h3 % 100 >= 100 - plain_percent or any(m in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, chars_a), (b, chars_b) = index.locate(low), index.locate(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", chars_a, chars_b - chars_a, b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle))
    return n, "psm", chars_a, chars_b - chars_a, b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle))


def transform(docs: DataFrame, *, plain_percent: int = 10, spm_percent: int = 20, step: int = STEP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document ``doc_id, n, form, prefix_chars, middle_chars, output``; the two lengths are null where the form is plain."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            raw, cuts = data.tobytes(), offsets.tolist()
            ids = batch.column("doc_id").to_pylist()
            found = [split(i, raw[a:b], plain_percent=plain_percent, spm_percent=spm_percent, step=step) for i, a, b in zip(ids, cuts[:-1], cuts[1:], strict=True)]
            n, form, prefix, middle, output = zip(*found, strict=True)
            columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(work, OUTPUT)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text from output and form. A text with a sentinel stays plain, so the sentinels of the other forms are its only ones."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
