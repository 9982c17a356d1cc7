"""A stored index for exact cosine search: cells around centres, skipped by the triangle inequality.

Vectors are scaled to length one, where a cosine is ``1 - d * d / 2`` of the distance ``d``. A row lies in the cell of its nearest centre, and a cell
knows the distance of its farthest row. A query at distance ``d`` of the centre has no row nearer than ``d`` less this radius, so no better score than the
cosine of that. A search first scores the rows of the nearest cells that hold ``k`` rows together; the k-th score found is one that every answer reaches, and
only cells that may reach it are scored as well. Answers are those of a full scan, whatever the centres; good centres make it cheap.

Centres are fitted on at most ``SAMPLE`` rows (those with the smallest hashes of their ids); every row is indexed. Rows without a vector, with a null or
infinite component or of length zero score 0 against everything and are not indexed, so floors below 0 are refused. An empty table makes an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.plans.session import checkpointed

#: Rows that centres are fitted on, most centres, rounds of fitting.
SAMPLE, MOST_CENTRES, ROUNDS = 20_000, 1024, 12
SLACK = 1e-6
#: Rows, and queries, of a cell that meet in one block.
BLOCK = 2048


def unit(vector: Column) -> Column:
    """The vector as doubles of length one; null if it has no direction."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    usable = norm.isNotNull() & ~F.isnan(norm) & (norm > 0) & (norm < float("inf"))
    return F.when(usable, F.transform(wide, lambda x: x / norm))


def fit_centres(rows: DataFrame, id_column: str, centres: int | None) -> np.ndarray:
    """Rounds of nearest-centre means over the sample; a centre that loses all its rows stays where it is."""
    sample = rows.select("_unit", F.xxhash64(id_column).alias("_h")).orderBy("_h").limit(SAMPLE).toPandas()
    if sample.empty:
        return np.zeros((0, 0))
    points = np.stack(sample["_unit"].to_numpy())
    count = min(len(points), centres or min(MOST_CENTRES, max(1, round(rows.count() ** 0.5))))
    found = points[:count].copy()
    for _ in range(ROUNDS):
        near = (points @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), found)
    return found


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with ``_cell`` and ``_distance`` to its centre."""
    held = rows.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CENTRES vectors

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = np.stack(batch["_unit"].to_numpy()) if len(batch) else np.zeros((0, held.value.shape[1]))
            scores = points @ held.value.T
            near = scores.argmax(axis=1) if len(batch) else np.zeros(0, int)
            gaps = np.linalg.norm(points - held.value[near], axis=1)
            yield batch.assign(_cell=near.astype("int32"), _distance=gaps)

    return rows.mapInPandas(work, T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_distance", T.DoubleType())]))


class VectorIndex:
    """Two tables in a folder: ``rows`` (the given columns without the vector, unit vector, distance; a folder a cell) and ``cells``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows, self.cells = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells")

    @classmethod
    def build(cls, docs: DataFrame, path: str, *, id_column: str, vector_column: str, centres: int | None = None, fitted: np.ndarray | None = None) -> VectorIndex:
        """Indexes every row with a usable vector. ``fitted``: centres of an earlier index."""
        others = [c for c in docs.columns if c != vector_column]
        usable = docs.select(*others, unit(F.col(vector_column)).alias("_unit")).filter("_unit is not null")
        spark = docs.sparkSession
        found = fit_centres(usable, id_column, centres) if fitted is None else fitted
        placed = _placed(usable, found) if len(found) else usable.withColumns({"_cell": F.lit(0), "_distance": F.lit(0.0)})
        # A cell is written by several tasks, as one may hold most rows; each writes a file.
        spread = F.pmod(F.xxhash64(id_column), F.lit(8))
        placed.repartition("_cell", spread).write.partitionBy("_cell").parquet(f"{path}/rows")
        if not len(found):
            placed.limit(0).write.mode("append").parquet(f"{path}/rows")  # no row, no folder of a cell: the columns at least
        rows = spark.read.schema(T.StructType([f for f in placed.schema.fields if f.name != "_cell"] + [T.StructField("_cell", T.IntegerType())])).parquet(f"{path}/rows")
        sizes = rows.groupBy("_cell").agg(F.max("_distance").alias("radius"), F.count("*").alias("n"))
        known = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "_cell int, centre array<double>")
        sizes.join(F.broadcast(known), "_cell").write.parquet(f"{path}/cells")
        return cls(spark, path)

    def upserted(self, fresh: DataFrame, path: str, *, id_column: str, vector_column: str) -> VectorIndex:
        """A new index in which the fresh rows replace those with their ids; the centres stay, the radii follow."""
        centres = {r["_cell"]: r["centre"] for r in self.cells.select("_cell", "centre").collect()}  # at most MOST_CENTRES
        kept = self.rows.join(fresh.select(id_column), id_column, "left_anti").withColumnRenamed("_unit", vector_column).drop("_cell", "_distance")
        fitted = np.array([centres[c] for c in sorted(centres)]) if centres else None
        return self.build(kept.unionByName(fresh.select(*kept.columns)), path, id_column=id_column, vector_column=vector_column, fitted=fitted)

    def _pairs(self, queries: DataFrame, sizes: DataFrame) -> DataFrame:
        """``query, _unit, _cell, near, n``: each query with each cell (at most MOST_CENTRES a query), and the nearest distance that a row of it can have."""
        cells = self.cells.drop("n").join(sizes, "_cell").toPandas()
        held = self.spark.sparkContext.broadcast((cells["_cell"].to_numpy(), np.stack(cells["centre"].to_numpy()) if len(cells) else None, cells["radius"].to_numpy(), cells["n"].to_numpy()))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            numbers, centres, radii, counts = held.value
            for batch in batches:
                for query, vector in zip(batch["query"], batch["_unit"], strict=True) if len(numbers) else ():
                    gap = np.linalg.norm(centres - vector, axis=1)
                    yield pd.DataFrame({"query": query, "_cell": numbers, "gap": gap, "near": np.maximum(gap - radii, 0.0), "n": counts})

        return queries.mapInPandas(work, f"query {queries.schema['query'].dataType.simpleString()}, _cell int, gap double, near double, n long")

    def _best(self, rows: DataFrame, queries: DataFrame, wanted: DataFrame, sizes: DataFrame, id_column: str, k: int) -> DataFrame:
        """``query, id, score, nine``: of each wanted pair of a query and a cell the best rows, at most ``k`` of each block.

        A block is at most about ``BLOCK`` rows of a cell and as many of its queries, scored as one product of matrices.
        """
        parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
        cells = wanted.groupBy("_cell").agg(F.count("*").alias("asked")).join(sizes, "_cell")
        cells = cells.select("_cell", parts.alias("parts"), F.greatest(F.ceil(F.col("asked") / BLOCK), F.lit(1)).cast("int").alias("turns"))  # at most MOST_CENTRES rows
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        held = rows.join(F.broadcast(cells), "_cell").select("_cell", dealt(id_column, "parts").alias("part"), each("turns").alias("turn"), F.col(id_column).alias("id"), "_unit")
        asking = wanted.join(F.broadcast(cells), "_cell").select("_cell", dealt("query", "turns").alias("turn"), each("parts").alias("part"), "query").join(queries, "query")
        key = ["_cell", "part", "turn"]

        def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query": right["query"][:0], "id": left["id"][:0], "score": [], "nine": []})
            left = left.sort_values("id", ignore_index=True)
            scores = np.stack(right["_asked"].to_numpy()) @ np.stack(left["_unit"].to_numpy()).T
            nine = np.round(scores, 9)
            few = min(k, nine.shape[1])
            last = np.partition(nine, nine.shape[1] - few, axis=1)[:, nine.shape[1] - few]
            at, of = np.nonzero(nine >= last[:, None])
            order = np.lexsort((of, -nine[at, of], at))
            at, of = at[order], of[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            at, of = at[place < k], of[place < k]
            return pd.DataFrame({"query": right["query"].to_numpy()[at], "id": left["id"].to_numpy()[of], "score": scores[at, of], "nine": nine[at, of]})

        kind = lambda df, c: df.schema[c].dataType.simpleString()
        return held.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(work, f"query {kind(wanted, 'query')}, id {kind(rows, id_column)}, score double, nine double")

    def search(self, queries: DataFrame, *, id_column: str, k: int = 10, floor: float = 0.0, predicate: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """The best ``k`` rows of each query (``query, vector``; the predicate is on the rows), as ``query, id, score, rank``, and what was looked at.

        Scores above the floor only; by score (nine digits), then id. Second table: ``cells, scored`` (pairs of a query and a cell, of all and of those
        scored). The queries' pairs with the cells are a table of queries times cells; rows meet only the pairs of their cell.
        """
        if floor < 0:
            raise ValueError("rows without a direction are not indexed, so a floor below 0 cannot be searched")
        queries = checkpointed(queries.select("query", unit(F.col("vector")).alias("_unit")).filter("_unit is not null"))
        rows = self.rows if predicate is None else self.rows.filter(predicate)
        sizes = checkpointed(rows.groupBy("_cell").agg(F.count("*").alias("n")))
        pairs = checkpointed(self._pairs(queries, sizes))
        asked = queries.withColumnRenamed("_unit", "_asked")
        by_gap = Window.partitionBy("query").orderBy("gap", "_cell")
        before = F.coalesce(F.sum("n").over(by_gap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nearest = pairs.withColumn("_before", before).filter(F.col("_before") < k).select("query", "_cell")
        best = Window.partitionBy("query").orderBy(F.desc("nine"), "id")
        first = checkpointed(self._best(rows, asked, nearest, sizes, id_column, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
        least = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
        reach = 1 - F.col("near") ** 2 / 2 + SLACK
        more = pairs.join(least, "query", "left").filter((reach >= F.coalesce("least", F.lit(-2.0))) & (reach > floor)).select("query", "_cell")
        more = checkpointed(more.join(nearest, ["query", "_cell"], "left_anti"))
        found = first.drop("rank").unionByName(self._best(rows, asked, more, sizes, id_column, k)).filter(F.col("score") > floor)
        looked = pairs.agg(F.count("*").alias("cells")).join(nearest.union(more).agg(F.count("*").alias("scored")))  # a row each
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "id", "score", "rank"), looked
