"""Operator 7, packing: order-preserving dynamic programming over document and sentence boundaries.

Each task packs its own partition in the order of its rows, so nothing is shuffled. A partition's token stream has
cut candidates: after each document (no penalty), after each sentence (``sentence_penalty``), and, where no boundary
comes for a while, inside a sentence (``inside_penalty``). The cheapest cover by sequences of at most ``length`` tokens
costs padding plus penalties:

    cost[j] = penalty[j] + min over i with position[j] - position[i] <= length of
              cost[i] + length - (position[j] - position[i])

The minimum slides, so a monotone queue gives each transition in constant time. The stream is solved in blocks; the
last sequences of a block are taken up again in the next one, so memory is bounded and block ends leave no padding.
The tail of a partition is laid out in sequences whose lengths are powers of two, which need no padding.

Nulls: a null text is empty (its document is the end token alone); a null id is returned as null. Repeated rows are
packed each on its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
#: Words whose ids a worker keeps; beyond that it starts afresh.
CACHED_WORDS = 300_000
#: Every so many tokens a cut inside a sentence is possible.
INSIDE_STEP = 48
BLOCK_SEQUENCES = 64
KEPT_SEQUENCES = 8

_encoders: dict[str, "Encoder"] = {}


class Encoder(dict):
    """Ids of texts, by words between ASCII white space: a dictionary from a word to its little-endian 32-bit ids.

    The tokenizer lower-cases, drops white space and never joins over it, so a text's ids are its words' ids one after
    another; ASCII punctuation at a word's end is a token run of its own after a letter or digit, so it is set apart
    first. Words repeat, and each is encoded once. A word of lower-case Latin letters alone is one run for the model,
    which then needs neither normaliser nor splitter; all others go through the whole tokenizer. The tokenizer looks for its
    special tokens before it lower-cases, so words that may hold one keep their case. Tests hold all this against the
    tokenizer itself.
    """

    TAIL = re.compile(rb"(?:(?<=[a-z0-9])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([.,!?;:|$%&*#]+)(?=[\x20\t-\r]|$)")
    LETTERS = re.compile("[a-zß-öø-ÿ]+")
    WORD = re.compile(rb"[^\x20\t-\r]+")
    SPECIAL = b"<|"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        assert all(self.SPECIAL.decode() in t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.normalized)
        self.model = self.tokenizer.model
        # The printable stand-in of each byte, as the tokenizer's own byte-level splitter gives it.
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.stand_in = {}
        for c in [*map(chr, range(97, 123)), *map(chr, range(0xDF, 0x100))]:
            self.stand_in[ord(c)] = byte_level.pre_tokenize_str(c)[0][0]
        self.stops = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.stops[[self.tokenizer.encode(f"a{x}", add_special_tokens=False).ids[-1] for x in ".!?"]] = True

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.LETTERS.fullmatch(text):
            ids = [t.id for t in self.model.tokenize(text.translate(self.stand_in))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = found = np.asarray(ids, "<u4").tobytes()
        return found

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        lowered = text.lower() if self.SPECIAL not in text else self.WORD.sub(lambda m: m.group() if self.SPECIAL in m.group() else m.group().lower(), text)
        return b"".join(map(self.__getitem__, self.TAIL.sub(rb" \1 ", lowered).split()))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_cuts(positions: list[int], penalties: list[int], length: int) -> list[int]:
    """Indices of the cheapest cuts; positions start with 0, no two neighbours lie further apart than ``length``.

    What follows the last cut is less than a sequence and costs nothing: it opens the next block, or is the tail.
    """
    cost, before = [0] * len(positions), [0] * len(positions)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(positions)):
        at = positions[j]
        least = at - length
        while positions[queue[0][1]] < least:
            queue.popleft()
        key, i = queue[0]
        key += length + penalties[j]
        cost[j], before[j] = key - at, i
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = []
    j = min((i for i in range(len(positions)) if positions[-1] - positions[i] < length), key=cost.__getitem__)
    while j:
        cuts.append(j)
        j = before[j]
    return cuts[::-1]


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


class Packer:
    def __init__(self, length: int, sentence_penalty: int, inside_penalty: int, first_sequence: int):
        self.length, self.sentence_penalty, self.inside_penalty = length, sentence_penalty, inside_penalty
        self.sequence = first_sequence
        self.documents: deque[tuple[object, bytes, int, int]] = deque()  # id, ids, place of the first id, count
        self.done = self.end = 0  # tokens laid out, tokens seen
        self.positions: list[int] = []
        self.penalties: list[int] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes, sentence_ends: np.ndarray) -> None:
        """``sentence_ends``: for each id, whether a sentence ends after it."""
        n = len(ids) // 4
        cuts = sentence_ends.copy()
        cuts[INSIDE_STEP - 1 :: INSIDE_STEP] = cuts[-1] = True
        places = np.flatnonzero(cuts)
        penalties = np.where(sentence_ends[places], self.sentence_penalty, self.inside_penalty)
        penalties[-1] = 0
        places += 1
        self.positions += (places + self.end).tolist()
        self.penalties += penalties.tolist()
        self.documents.append((doc_id, ids, self.end, n))
        self.end += n
        if self.end - self.done >= BLOCK_SEQUENCES * self.length:
            self.solve(last=False)

    def solve(self, last: bool) -> None:
        if self.end == self.done:
            return
        cuts = best_cuts([0, *(p - self.done for p in self.positions)], [0, *self.penalties], self.length)
        ends = [self.positions[j - 1] for j in cuts]
        if not last:
            cuts, ends = cuts[:-KEPT_SEQUENCES], ends[:-KEPT_SEQUENCES]
        for end in ends:
            self.lay_out(end)
        if last:
            for part in powers_of_two(self.end - self.done):
                self.lay_out(self.done + part)
        if cuts:
            del self.positions[: cuts[-1]], self.penalties[: cuts[-1]]

    def lay_out(self, end: int) -> None:
        begin = at = self.done
        while at < end:
            doc_id, ids, first, n = self.documents[0]
            stop = min(end, first + n)
            self.rows.append((doc_id, at - first, stop - at, zlib.crc32(ids[4 * (at - first) : 4 * (stop - first)]), n, self.sequence, at - begin))
            if stop == first + n:
                self.documents.popleft()
            at = stop
        self.done = end
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=ARROW)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, length: int = 4096, sentence_penalty: int = 4, inside_penalty: int = 24, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per piece: document, start and length in its ids, their CRC-32, the document's count, sequence, offset there."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_path)
        packer = Packer(length, sentence_penalty, inside_penalty, TaskContext.get().partitionId() << 40)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = known.ids(text.as_buffer().to_pybytes() if text.is_valid else b"") + end
                packer.add(doc_id, ids, known.stops[np.frombuffer(ids, "<u4")])
                if len(packer.rows) >= 10_000:
                    yield packer.batch()
        packer.solve(last=True)
        if packer.rows:
            yield packer.batch()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text")).mapInArrow(pack, SCHEMA)
