"""Vectorised counts over slices of texts, for the quality rules.

Equal lines and words are found by 64-bit hashes and compared byte by byte; a slice with a collision is counted anew, text by text.
"""

from __future__ import annotations

import numpy as np

from ledgerline.llm.common import SEPARATOR, Polynomial, byte_table, mix, runs_of, same_spans, word_hashes, word_spans

POLY = Polynomial(0x9E3779B97F4A7C15)
WINDOW_POLY = Polynomial(0xC2B2AE3D27D4EB4F)
TABLE = byte_table(1)
#: The symbols that the rules count.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8


def _marked(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


IS_SYMBOL = _marked(SYMBOLS)
IS_UPPER = _marked(bytes(range(65, 91)))
IS_BANG = _marked(b"!?")
IS_DIGIT = _marked(b"0123456789")
#: Bytes that open a code point.
OPENS = np.array([b & 0xC0 != 0x80 for b in range(256)])


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: its lines with a word that equal an earlier line of the row."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))[: len(starts)]
    ends = ends - (data[ends - 1] == 10)
    words = np.r_[0, np.cumsum(~SEPARATOR[data], dtype=np.int64)]
    good = words[ends] > words[starts]
    starts, ends = starts[good], ends[good]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    keys = mix(POLY.spans(POLY.prefix(TABLE[data]), starts, ends) + (ends - starts).astype(np.uint64))
    keys = mix(keys + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[which] != np.arange(len(keys)))
    before, lengths = first[which[again]], ends - starts
    if not (rows[again] == rows[before]).all() or not (lengths[again] == lengths[before]).all() or not same_spans(data, starts[again], starts[before], lengths[again]):
        return plain_duplicate_lines(data, offsets)
    return np.bincount(rows[again], minlength=len(offsets) - 1)


def plain_duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The same without hashes."""
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        lines = [x for x in data[a:b].tobytes().split(b"\n") if x.split()]
        out.append(len(lines) - len(set(lines)))
    return np.array(out, np.int64)


def repeated_words(hashes: np.ndarray, rows: np.ndarray, n_rows: int, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Per row: the words that lie in a window of words which the row holds twice or more."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    at = np.flatnonzero(rows[:n] == rows[window - 1 :])
    keys = mix(WINDOW_POLY.spans(WINDOW_POLY.prefix(hashes), at, at + window) + rows[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    a, b = runs_of(keys[order])
    many = np.repeat(b - a > 1, b - a)
    steps = np.zeros(len(hashes) + 1, np.int64)
    found = at[order[many]]
    firsts = at[order[np.repeat(a, b - a)[many]]]
    if not (rows[found] == rows[firsts]).all() or not same_spans(hashes, found, firsts, np.full(len(found), window)):
        windows = np.c_[rows[at].astype(np.uint64), hashes[at[:, None] + np.arange(window)]]
        _, which, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        found = at[count[which.ravel()] > 1]
    np.add.at(steps, found, 1)
    np.add.at(steps, found + window, -1)
    return np.bincount(rows[np.cumsum(steps)[:-1] > 0], minlength=n_rows)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts per row, and the hash and row of each word."""
    starts, ends, rows = word_spans(data, offsets)
    n = len(offsets) - 1
    hashes = exact_words(data, starts, ends, word_hashes(data, starts, ends, POLY, TABLE))
    counts = {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": per_row(OPENS[data] & ~SEPARATOR[data], offsets),
        "n_symbols": per_row(IS_SYMBOL[data], offsets),
        "n_dup_lines": duplicate_lines(data, offsets),
        "n_repeat_words": repeated_words(hashes, rows, n),
        "n_upper": per_row(IS_UPPER[data], offsets),
        "n_bangs": per_row(IS_BANG[data], offsets),
        "n_digits": per_row(IS_DIGIT[data], offsets),
        "n_lines": per_row(data == 10, offsets) + 1,
    }
    return counts, hashes, rows


def exact_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The hashes, if equal ones are of equal words; otherwise numbers that are."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    before, lengths = first[which], ends - starts
    if (lengths == lengths[before]).all() and same_spans(data, starts, starts[before], lengths):
        return hashes
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return mix(np.array([numbers[w] for w in words], np.uint64))


def stutters(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row: the words equal to the word before them."""
    same = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    return np.bincount(rows[1:][same], minlength=n_rows)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
UNIT_TABLE = byte_table(2)
#: Lengths in bytes of the word prefixes that count as lexical units beside whole words.
PREFIXES = (4, 5, 6, 7)


def lexical_units(data: np.ndarray, offsets: np.ndarray):
    """For whole words and each prefix length: the indices of the words that have it, and its hash (A-Z lower-cased)."""
    starts, ends, rows = word_spans(data, offsets)
    prefix = POLY.prefix(UNIT_TABLE[_FOLD[data]])
    yield rows, np.arange(len(rows)), mix(POLY.spans(prefix, starts, ends))
    for k in PREFIXES:
        at = np.flatnonzero(ends - starts > k)
        yield rows, at, mix(POLY.spans(prefix, starts[at], starts[at] + k) + np.uint64(k))


def lexicon_hits(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Per row: the words with a unit of the sorted lexicon."""
    n = len(offsets) - 1
    if not len(lexicon):
        return np.zeros(n, np.int64)
    likely = np.zeros(1 << 16, bool)
    likely[(lexicon & np.uint64(0xFFFF)).astype(np.int64)] = True
    hit = None
    for rows, at, units in lexical_units(data, offsets):
        hit = np.zeros(len(rows), bool) if hit is None else hit
        maybe = np.flatnonzero(likely[(units & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(lexicon, units[maybe]), len(lexicon) - 1)
        hit[at[maybe[lexicon[place] == units[maybe]]]] = True
    return np.bincount(rows[hit], minlength=n)
