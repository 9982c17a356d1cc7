"""Judging contexts of sampled grams in a stream sorted by gram, context and document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An earlier document has the context; the gram has several contexts; it has more rows than fit a group; it has one context.
FULL, EDGE, HOT, ONLY = 0, 1, 2, 3


def _judged(table: pa.Table, hot: bool, before: tuple) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Kind of each row, whether it repeats its document's context, and the state for rows to come."""
    gram, context, doc = (table.column(c).to_numpy() for c in ("gram", "context", "id"))
    covered = table.column("covered").to_numpy()
    new = np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])]
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))]
    first = new
    if before[:2] == (gram[0], context[0]):
        least[np.cumsum(new) == 1] = before[2]
        first = new.copy()
        first[0] = False
    full = covered | (doc > least)
    which = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
    several = np.bincount(which, weights=new & ~covered) > 1
    kind = np.where(full, FULL, HOT if hot else np.where(several[which], EDGE, ONLY)).astype(np.int8)
    return kind, ~first & ~full, (gram[-1], context[-1], least[-1])


def judge_stream(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of rows (``gram, context, id, covered`` and more) with their kinds and repeat marks.

    A gram's rows are judged together up to ``group`` of them; beyond that they pass through as they come, marked HOT.
    """
    held: pa.Table | None = None
    hot_gram, before = None, (None, None, None)
    for batch in batches:
        fresh = pa.Table.from_batches([batch])
        held = fresh if held is None or not held.num_rows else pa.concat_tables([held, fresh]).combine_chunks()
        while held.num_rows:
            gram = held.column("gram").to_numpy()
            if hot_gram is not None:
                n = len(gram) if gram[-1] == hot_gram else int(np.argmax(gram != hot_gram))
                if n:
                    part = held.slice(0, n)
                    kind, again, before = _judged(part, True, before)
                    yield part, kind, again
                if n < len(gram):
                    hot_gram, before = None, (None, None, None)
            elif gram[0] == gram[-1]:
                if len(gram) <= group:
                    break
                hot_gram, n = gram[0], 0
            else:
                n = int(np.flatnonzero(gram != gram[-1])[-1]) + 1
                part = held.slice(0, n)
                kind, again, _ = _judged(part, False, before)
                yield part, kind, again
            held = held.slice(n)
    if held is not None and held.num_rows:
        kind, again, _ = _judged(held, hot_gram is not None, before)
        yield held, kind, again
