"""Retrieval: top-k search, rank fusion, section-tree expansion, merging and reranking.

Result rows have ``RESULT`` columns.  All steps are lazy DataFrame plans; ties
are broken by the row's key, so that results are the same in every run.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions.frontmatter import Filter, where
from tessera.functions.vectors import cosine_distance
from tessera.operators.nearest import nearest
from tessera.sources.providers import RerankProvider, reranked

KEY = ["document_id", "node_id", "chunk_seq"]
RESULT = ["document_id", "filename", "frontmatter", "node_id", "chunk_seq", "heading_path", "sort_order", "source", "text", "figures", "markers", "distance"]
#: Rank fusion's constant.
RRF_K = 60
#: Candidates per result that a reranker is given.
OVERFETCH = 4
#: Queries of a batch that meet a part of the rows at once.
QUERY_BLOCK = 16_384
#: Components of the vectors on either side of a tile.
TILE_VALUES = 1 << 21


def searchable(chunks: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their section's place and their document's name and frontmatter."""
    sections = nodes.select("document_id", "node_id", "heading_path", "sort_order")
    named = documents.select("document_id", "filename", "frontmatter")
    return chunks.drop("heading_path", "sort_order").join(sections, ["document_id", "node_id"]).join(named, "document_id")


def _filtered(rows: DataFrame, filters: list[Filter]) -> DataFrame:
    condition = where(F.col("frontmatter"), filters)
    return rows if condition is None else rows.filter(condition)


def _result(rows: DataFrame, source: str, distance: Column) -> DataFrame:
    return rows.select(*[F.lit(source).alias("source") if c == "source" else distance.alias("distance") if c == "distance" else F.col(c) for c in RESULT])


def query_vector(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def vector_search(rows: DataFrame, vector: list[float], k: int, filters: list[Filter] = (), column: str = "embedding", source: str = "VEC") -> DataFrame:
    """The ``k`` rows nearest to a vector, nearest first; filters hold before the limit."""
    near = _result(_filtered(rows, list(filters)).filter(F.col(column).isNotNull()), source, cosine_distance(F.col(column), query_vector(vector)))
    return near.orderBy(F.col("distance").asc_nulls_last(), *KEY).limit(k)


def marker_search(rows: DataFrame, vector: list[float], k: int, filters: list[Filter] = ()) -> DataFrame:
    return vector_search(rows, vector, k, filters, "marker_embedding", "MARKER")


def batch_search(rows: DataFrame, queries: DataFrame, k: int, key: list[str], column: str = "embedding", digits: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest rows of every query (``query_id``, ``vector``), with ``rank`` from 1.

    The queries are a stated set against all rows.  Queries are dealt into blocks of
    about ``block`` and rows into parts; each block meets each part in a tile, which
    keeps the ``k`` nearest of its rows for each query (``operators/nearest.py``), so
    that no query's distances to all rows are sorted in one place.  Distances are
    rounded to ``digits``, if given, before they are compared; equal ones go by the
    key, and rows without a distance come last.
    """
    spark = rows.sparkSession
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(column)), F.lit(1))).first()
    asked, size = queries.count(), max(1, size)
    blocks = max(1, -(-asked // block), -(-asked * size // TILE_VALUES))
    parts = max(1, -(-n * size // TILE_VALUES), min(spark.sparkContext.defaultParallelism, n // 1000))

    def dealt(side: DataFrame, by: Column, own: str, among: int, other: str, of: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(other)
        return side.select("*", F.pmod(by, F.lit(among)).cast("int").alias(own), every).repartition(2 * blocks * parts, "_block", "_part").groupBy("_block", "_part")

    left = dealt(queries.select("query_id", F.col("vector").alias("_v")), F.xxhash64("query_id", "_v"), "_block", blocks, "_part", parts)
    right = dealt(rows.select(*key, F.col(column).alias("_v")), F.xxhash64(*key, "_v"), "_part", parts, "_block", blocks)

    schema = StructType([queries.schema["query_id"], *[rows.schema[c] for c in key]]).add("distance", "double")
    none = to_arrow_schema(schema).empty_table()

    def tile(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not len(asked) or not len(known):
            return none
        known = known.take(pc.sort_indices(known.select(key), [(c, "ascending") for c in key], null_placement="at_end"))
        i, j, distance = nearest(asked.column("_v"), known.column("_v"), k, digits)
        near = [known.column(c).take(pa.array(j)) for c in key]
        return pa.table([asked.column("query_id").take(pa.array(i)), *near, distance], names=["query_id", *key, "distance"])

    found = left.cogroup(right).applyInArrow(tile, schema)
    order = [F.col(c).asc_nulls_last() for c in ("distance", *key)]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def top_by_group(rows: DataFrame, group: list[str], order: list[str], k: int, spread: int = 64) -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1, a large group being cut down in ``spread`` parts first."""
    part = Window.partitionBy(*group, "_part").orderBy(*order)
    few = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(spread))).withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_part", "_r")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def ranked(rows: DataFrame) -> DataFrame:
    """A result list with ``rank`` from 1 (a list is bounded by its search's limit)."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("distance").asc_nulls_last(), *KEY)))


def fuse(marker: DataFrame, vector: DataFrame, k: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists; the marker list's row stands for both.

    Rows keep their list's distance and get ``score``, best first.
    """
    both = marker.withColumn("_list", F.lit(0)).unionByName(vector.withColumn("_list", F.lit(1)))
    row = F.struct(*RESULT)
    found = both.groupBy(*KEY).agg(F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))).alias("score"), F.min_by(row, F.col("_list")).alias("_row"))
    out = found.select("_row.*", "score").orderBy(F.col("score").desc(), *KEY)
    return out if k is None else out.limit(k)


def children(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    child = nodes.select("document_id", F.col("node_id").alias("_child"), F.col("parent_id").alias("node_id"))
    return hits.join(child, ["document_id", "node_id"]).select("document_id", F.col("_child").alias("node_id"))


def ancestors(hits: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Sections above the hits, up to ``depth`` levels, without the root."""
    tree = nodes.select("document_id", "node_id", "parent_id")
    inner = tree.filter("parent_id is not null").select("document_id", "node_id")
    found, frontier = hits.select("document_id", "node_id").limit(0), hits
    for _ in range(depth):
        up = frontier.join(tree, ["document_id", "node_id"]).filter("parent_id is not null").select("document_id", F.col("parent_id").alias("node_id")).distinct()
        frontier = up.join(inner, ["document_id", "node_id"], "left_semi")
        found = found.unionByName(frontier)
    return found


def siblings(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sections with a hit's parent that are not hits themselves."""
    tree = nodes.select("document_id", "node_id", "parent_id")
    parents = hits.join(tree, ["document_id", "node_id"]).filter("parent_id is not null").select("document_id", "parent_id").distinct()
    return tree.join(parents, ["document_id", "parent_id"]).select("document_id", "node_id").join(hits, ["document_id", "node_id"], "left_anti")


def expand(hits: DataFrame, nodes: DataFrame, depth: int = 2) -> DataFrame:
    """Sections near the hits: ancestors up to ``depth`` levels (but the root), children, and siblings from depth 2.

    ``hits`` and the result are distinct (document_id, node_id); siblings that
    are hits are left out, other hits may return.
    """
    hits = hits.select("document_id", "node_id").distinct()
    found = children(hits, nodes).unionByName(ancestors(hits, nodes, depth))
    if depth >= 2:
        found = found.unionByName(siblings(hits, nodes))
    return found.distinct()


def neighbors(rows: DataFrame, sections: DataFrame, filters: list[Filter] = ()) -> DataFrame:
    """The sections' chunks as result rows at distance 0."""
    near = _filtered(rows.join(sections, ["document_id", "node_id"], "left_semi"), list(filters))
    return _result(near, "TREE", F.lit(0.0))


def merge(hits: DataFrame, near: DataFrame) -> DataFrame:
    """Hits and neighbors in document order; of a row in both the hit stays."""
    both = hits.select(*RESULT).withColumn("_o", F.lit(0)).unionByName(near.select(*RESULT).withColumn("_o", F.lit(1)))
    first = both.groupBy(*KEY).agg(F.min_by(F.struct(*RESULT), F.col("_o")).alias("_row"))
    return first.select("_row.*").orderBy("document_id", "sort_order", "chunk_seq", "node_id")


def rerank(spark: SparkSession, provider: RerankProvider, query: str, hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` most relevant of a bounded candidate list, with ``relevance``, best first."""
    rows = hits.select(*RESULT).collect()  # at most OVERFETCH * k candidates and their neighbors: one request's documents
    order = reranked(provider, query, [r["text"] for r in rows], k)
    schema = hits.select(*RESULT).schema.add("relevance", "double").add("_o", "integer")
    made = [(*rows[i], float(score), o) for o, (i, score) in enumerate(order)]
    return spark.createDataFrame(made, schema).orderBy("_o").drop("_o")
