"""An optional approximate index: vectors in cells around centroids, each cell a partition of files.

Search is exact by default.  The index reads the cells whose centroids are nearest to
the query and leaves the other files alone; what it returns has exact distances and the
exact search's order.  Centroids are fitted on at most ``SAMPLE`` rows, those whose keys
have the least hashes; every row is in a cell.  How many cells a search reads is measured
when the index is made, so that it finds ``RECALL`` of the sample's nearest rows (which
lie farther off than those of the whole table, so of these it finds more): few cells
where vectors lie in groups, most of them where they lie anywhere.

Vectors that are null, zero, not finite or of another length than most have no direction
and are in no cell: only the exact search returns them, last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tessera.functions.vectors import cosine_distance, norm
from tessera.operators.retrieval import query_vector, top_by_group

#: Rows that centroids are fitted on, and the most centroids.
SAMPLE = 16384
CELLS = 1024
#: The share of the nearest rows that searches are to find.
RECALL = 0.95
_STEPS = 12


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-300)


def centroids(units: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Directions around which the vectors lie: k-means by cosine."""
    rng = np.random.default_rng(seed)
    at = units[rng.choice(len(units), min(cells, len(units)), replace=False)]
    for _ in range(_STEPS):
        own = (units @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, units)
        full = np.linalg.norm(sums, axis=1) > 0
        at[full] = _units(sums[full])
    return at


def probes_for(units: np.ndarray, cells: np.ndarray, recall: float = RECALL, k: int = 10, queries: int = 256) -> int:
    """The least number of cells that hold the share of the ``k`` nearest others, over some of the vectors."""
    k = min(k, len(units) - 1)
    if k < 1:
        return 1
    asked = np.unique(np.linspace(0, len(units) - 1, min(queries, len(units))).astype(int))
    close = units[asked] @ units.T
    close[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-close, k - 1, axis=1)[:, :k]
    own = (units @ cells.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(units[asked] @ cells.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel()) + 1
    return int(ranks[int(np.ceil(recall * len(ranks))) - 1])


def probed(vectors: np.ndarray, cells: np.ndarray, counts: np.ndarray, probes: int, least: int) -> list[list[int]]:
    """Each vector's nearest cells: ``probes``, and more until they hold ``least`` rows."""
    if not len(cells):
        return [[] for _ in vectors]
    order = np.argsort(-(vectors @ cells.T), axis=1, kind="stable")
    enough = [max(probes, int(np.searchsorted(np.cumsum(counts[o]), least)) + 1) for o in order]
    return [o[:n].tolist() for o, n in zip(order, enough, strict=True)]


@dataclass
class Index:
    rows: DataFrame  # the key, the vector and ``_cell``
    column: str
    cells: np.ndarray  # a centroid for each cell
    counts: np.ndarray  # a cell's rows
    probes: int = 1  # cells that a search reads

    def search(self, vector: list[float], k: int, key: list[str], probes: int | None = None, least: int = 0) -> DataFrame:
        """Key and distance of about the ``k`` nearest rows."""
        (near,) = probed(np.array([vector], dtype=float), self.cells, self.counts, probes or self.probes, max(k, least))
        distance = cosine_distance(F.col(self.column), query_vector(vector))
        return self.rows.filter(F.col("_cell").isin(near)).select(*key, distance.alias("distance")).orderBy(F.col("distance").asc_nulls_last(), *key).limit(k)

    def batch(self, queries: DataFrame, k: int, key: list[str], probes: int | None = None, least: int = 0) -> DataFrame:
        """The same for every query (``query_id``, ``vector``), with ``rank`` from 1."""
        at, counts, probes = self.cells, self.counts, probes or self.probes

        @pandas_udf("array<int>")
        def cells(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in parts:
                yield pd.Series(probed(np.stack(vectors).astype(float), at, counts, probes, max(k, least)) if len(vectors) else [], dtype=object)

        asked = queries.select("query_id", "vector", F.explode(cells("vector")).alias("_cell"))
        pairs = asked.join(self.rows, "_cell")
        scored = pairs.select("query_id", *key, cosine_distance(F.col(self.column), F.col("vector")).alias("distance"))
        return top_by_group(scored, ["query_id"], ["distance", *key], k)


def _cell(vector: Column, at: np.ndarray) -> Column:
    near = at.astype(np.float32)

    @pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            yield pd.Series((np.stack(vectors).astype(np.float32) @ near.T).argmax(axis=1).astype(np.int32) if len(vectors) else [], dtype="int32")

    return run(vector)


def build(rows: DataFrame, key: list[str], column: str, at: str, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> Index:
    """Writes the index of every row with a direction to the folder ``at``; about a cell for each root of their number by default."""
    spark = rows.sparkSession
    known = rows.select(*key, column).filter(F.col(column).isNotNull())
    sizes = known.groupBy(F.size(column).alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    length = norm(F.col(column))
    sound = known.filter((F.size(column) == (sizes["size"] if sizes else 0)) & (length > 0) & (length < float("inf")))
    n = sound.count()
    wanted = min(CELLS, max(1, round(n**0.5))) if cells is None else cells
    some = sound.orderBy(F.xxhash64(*key), *key).limit(sample).select(column).collect()  # bounded by ``sample``
    units = _units(np.array([r[0] for r in some], dtype=float)) if some else np.zeros((0, 0))
    found = centroids(units, wanted) if some else units
    probes = probes_for(units, found, recall) if some else 1
    dealt = sound.withColumn("_cell", _cell(F.col(column), found)) if some else sound.withColumn("_cell", F.lit(0))
    # files by cell; a cell of many rows is split by the engine
    dealt.hint("rebalance", "_cell").write.mode("overwrite").partitionBy("_cell").parquet(f"{at}/rows")
    held = spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(found)], "cell int, centroid array<double>, probes int")
    held.coalesce(1).write.mode("overwrite").parquet(f"{at}/cells")
    return load(spark, at, column, dealt)


def load(spark: SparkSession, at: str, column: str, like: DataFrame | None = None) -> Index:
    """The index in a folder; its centroids, at most ``CELLS`` by default, are read to the driver."""
    found = spark.read.parquet(f"{at}/cells").orderBy("cell").collect()
    if not found:
        return Index(like if like is not None else spark.createDataFrame([], f"_cell int, {column} array<float>"), column, np.zeros((0, 0)), np.zeros(0, int))
    rows = spark.read.parquet(f"{at}/rows")
    counts = np.zeros(len(found), int)
    for r in rows.groupBy("_cell").count().collect():  # a row for each cell
        counts[r["_cell"]] = r["count"]
    return Index(rows, column, np.array([r["centroid"] for r in found]), counts, found[0]["probes"])
