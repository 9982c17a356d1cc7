import numpy as np
import pytest
from ledgerline.operators import vector_index
from ledgerline.operators.vector_index import VectorIndex
from pyspark.sql import functions as F

SCHEMA = "id long, kind int, vector array<float>"


def brute(rows, queries, k, keep=lambda kind: True):
    length = lambda v: np.sqrt(sum(float(x) ** 2 for x in v))
    usable = [(i, np.array(v, float) / length(v)) for i, kind, v in rows if v is not None and None not in v and np.isfinite(v).all() and length(v) > 0 and keep(kind)]
    want = {}
    for q, vector in queries:
        scores = [(-round(float(u @ (np.array(vector, float) / length(vector))), 9), i) for i, u in usable]
        want |= {(q, r): i for r, (_, i) in enumerate(sorted(s for s in scores if s[0] < 0)[:k], 1)}
    return want


def answered(found):
    return {(r["query"], r["rank"]): r["id"] for r in found.collect()}


def test_search_equals_a_scan(spark, tmp_path):
    """Clusters with copies and ties, one of them a third of all rows; vectors without a direction; filters that leave cells empty."""
    rng = np.random.default_rng(5)
    middles = np.float32(rng.normal(size=(12, 8)))
    rows = [(i, i % 3, [float(x) for x in np.float32(middles[0 if i % 3 == 0 else i % 12] + 0.05 * rng.normal(size=8))]) for i in range(600)]
    rows += [(1000 + i, 1, rows[7][2]) for i in range(15)]  # ties
    odd = [(2000, 0, None), (2001, 0, [0.0] * 8), (2002, 0, [None] + [1.0] * 7), (2003, 0, [float("nan")] * 8), (2004, 0, [float("inf")] + [0.0] * 7)]
    table = spark.createDataFrame(rows + odd, SCHEMA)
    index = VectorIndex.build(table, str(tmp_path / "a"), id_column="id", vector_column="vector", centres=12)
    assert index.rows.count() == len(rows) and index.cells.agg(F.sum("n")).first()[0] == len(rows)
    queries = [(i, rows[i][2]) for i in range(0, 600, 29)] + [(-1, [1.0] + [0.0] * 7)]
    asked = spark.createDataFrame([*queries, (-2, [0.0] * 8), (-3, None)], "query long, vector array<float>")
    found, looked = index.search(asked, id_column="id", k=7)
    assert answered(found) == brute(rows, queries, 7)
    cells, scored = looked.first()
    assert cells == 12 * len(queries) and scored < cells / 2  # clusters are told apart
    for wanted in (1, 5):
        found, _ = index.search(asked, id_column="id", k=7, predicate=F.col("kind") == wanted)
        assert answered(found) == brute(rows, queries, 7, lambda kind, wanted=wanted: kind == wanted)
    with pytest.raises(ValueError):
        index.search(asked, id_column="id", floor=-0.5)
    fresh = [(i, 9, [-x for x in v]) for i, _, v in rows[::4]] + [(5000, 9, rows[3][2])]
    changed = index.upserted(spark.createDataFrame(fresh, SCHEMA), str(tmp_path / "b"), id_column="id", vector_column="vector")
    now = [r for r in rows if r[0] not in {f[0] for f in fresh}] + fresh
    assert answered(changed.search(asked, id_column="id", k=7)[0]) == brute(now, queries, 7)


def test_empty(spark, tmp_path):
    index = VectorIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"), id_column="id", vector_column="vector")
    assert index.search(spark.createDataFrame([(1, [1.0])], "query long, vector array<float>"), id_column="id")[0].count() == 0


def test_large_cells_and_many_queries_meet_in_blocks(spark, tmp_path, monkeypatch):
    """One cell, cut into blocks of rows and of queries, with more ties than wanted in every block."""
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(i, 0, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(60)]
    rows += [(100 + i, 0, rows[3][2]) for i in range(60)]
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"), id_column="id", vector_column="vector", centres=1)
    queries = [(i, v) for i, _, v in rows[:50]]
    found, looked = index.search(spark.createDataFrame(queries, "query long, vector array<float>"), id_column="id", k=5)
    assert answered(found) == brute(rows, queries, 5) and tuple(looked.first()) == (50, 50)
