import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, vector string"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        known[i] = min(known.get(i, own), own, key=lambda o: (o[0], np.array(o[1], np.int64).tobytes()))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in sorted(set(anchors) & set(known)):
        label, v = known[a]
        ranked = sorted((-score(v, w), i) for i, (k, w) in known.items() if i != a and k == label)[:positives]
        rest = sorted((-score(v, w), i) for i, (k, w) in known.items() if k != label)
        for minus, p in ranked:
            inside = [(i, -s) for s, i in rest if low * -minus <= -100 * s <= high * -minus][:negatives]
            out += [(a, p, k + 1, i, -minus, s) for k, (i, s) in enumerate(inside)]
    return out


def found(spark, rows, anchors, **settings):
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    ids = spark.createDataFrame([(a,) for a in anchors], "vec_id long")
    return sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.integer_vectors(table), ids, **settings).collect())


def draws(seed, n, width, labels, hot=0.35):
    rng = np.random.default_rng(seed)
    label = np.where(rng.random(n) < hot, 0, rng.integers(0, labels, n))
    centres = rng.normal(size=(labels, width)) * 0.4
    vectors = centres[label] + rng.normal(size=(n, width)) * 0.6 + 0.2
    return [(int(i), [float(x) for x in v.astype(np.float32)], int(k)) for i, v, k in zip(rng.permutation(n), vectors, label, strict=True)]


@pytest.mark.parametrize("settings", [{}, {"block_rows": 40, "block_anchors": 3}])
def test_equals_brute_force(spark, settings):
    rows = draws(1, 400, 9, 4)
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(12)]  # one very common vector: ties
    anchors = [r[0] for r in rows[::13]]
    assert found(spark, rows, anchors, **settings) == sorted(brute(rows, anchors))


def test_odd_rows(spark):
    rows = draws(2, 60, 6, 2)
    rows += [(None, [0.5] * 6, 0), (200, None, 1), (201, [0.5] * 6, None), (202, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1), (203, [float("nan")] * 6, 1), (204, [float("inf")] + [0.0] * 5, 0)]
    rows += [(205, [0.7, 0.4], 1), (206, [], 0), (207, [0.0] * 6, 1), rows[3], rows[3], (rows[4][0], [9.0] * 6, 1), (208, [1000.0] * 6, 0)]
    anchors = [r[0] for r in rows if r[0] is not None]
    assert found(spark, rows, anchors, block_rows=16, block_anchors=16) == sorted(brute(rows, anchors))


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1.0, 0.9], 0), (2, [0.8, 0.6], 1), (3, [-1.0, -1.0], 1)]
    assert found(spark, rows, [0, 1, 2, 3]) == sorted(brute(rows, [0, 1, 2, 3]))
    assert found(spark, rows, []) == [] and found(spark, [], [1]) == []
    assert found(spark, [(5, [1.0], 3)], [5]) == []


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 10)).__mul__(200).astype(np.int64)
    edges = np.stack([np.r_[v.min(), np.linspace(-400, 400, hard_negatives.CELLS - 1).astype(np.int64).clip(v.min(), v.max()), v.max() + 1] for v in vectors.T])
    block = hard_negatives.Approximation(vectors, edges)
    for anchor in vectors[:20]:
        low, high = block.bounds(anchor)
        exact = vectors @ anchor
        assert (low <= exact).all() and (exact <= high).all()
        assert (high >= np.sort(low)[-5]).mean() < 0.2
