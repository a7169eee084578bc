"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Each vector is scaled to length one and quantised to 8-bit integers with a scale
of its own.  For ``u = s q + e`` the true cosine of two vectors differs from
``s_u s_v q_u . q_v`` by at most ``|s_u q_u| |e_v| + |e_u|``, so a tile product of
integers decides all pairs but those that may reach the threshold; these are
computed again in double precision.

Equal vectors (by a 128-bit BLAKE2b digest of their components) are first merged
with their count.  The rest is dealt into blocks of ``TILE`` vectors, and each pair
of blocks is one bounded task.  A first pass sends 8-bit codes only and names the
vectors of a tile that have a pair possibly above the threshold; a second pass
sends those in double precision and computes their candidate pairs, and no others,
again.  It returns for each vector its number of links and a local spanning tree,
never the pairs.

Nulls and edge cases: a vector that is null, empty, zero, or has a null or
non-finite component links with nothing and is its own component; vectors of
different dimensions do not link; a null vec_id is never a component's id unless
all its members' are null; rows with equal ids count as different vectors; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._base import quoted, scoped, sized, table, written
from tessera.llm._graph import components, union

THRESHOLD = 0.9
TILE = 4096
#: Rows of a tile that are multiplied at once.
_ROWS = 512
#: For rounding in single-precision arithmetic on the bounds.
_SLACK = 1e-4
#: Candidate pairs that are gathered at once.
_GATHERED = 1 << 14
#: A product of whole rows and columns takes the place of gathered pairs where one in so many of its pairs is a candidate.
_DENSE = 4


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers, scales, lengths of what they stand for, and bounds on the length of the error."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    error = np.linalg.norm(x - back, axis=1) * (1 + 1e-9) + 1e-12
    return q, scale, np.linalg.norm(back, axis=1), error


class Codes:
    """What a tile knows of a block's vectors: integers, scales, lengths and error bounds."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, length: np.ndarray, error: np.ndarray):
        # products of up to 1,000 integers below 128 are exact in single precision
        self.q = q.astype(np.float32 if q.shape[1] <= 1000 else np.float64)
        self.scale, self.length, self.error = (x.astype(np.float32) for x in (scale, length, error))

    def part(self, at: np.ndarray) -> Codes:
        out = object.__new__(Codes)
        out.q, out.scale, out.length, out.error = self.q[at], self.scale[at], self.length[at], self.error[at]
        return out


def candidates(left: Codes, right: Codes | None, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For chunks of rows of ``left``: the first row, and which pairs with ``right`` (None: later rows of ``left``) may reach the threshold."""
    other = right or left
    turned = np.ascontiguousarray(other.q.T)
    for a in range(0, len(left.q), _ROWS):
        b = min(a + _ROWS, len(left.q))
        product = left.q[a:b] @ turned
        product *= left.scale[a:b, None]
        product *= other.scale
        product += left.length[a:b, None] * other.error
        near = product >= (threshold - _SLACK - left.error[a:b, None])
        if right is None:
            near &= np.arange(len(other.q)) > np.arange(a, b)[:, None]
        yield a, near


def tile_survivors(left: Codes, right: Codes | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of the two blocks (of the one block, twice) are in a candidate pair."""
    rows = np.zeros(len(left.q), bool)
    cols = rows if right is None else np.zeros(len(right.q), bool)
    for a, near in candidates(left, right, threshold):
        rows[a : a + len(near)] |= near.any(axis=1)
        cols |= near.any(axis=0)
    return rows, cols


def tile_links(left: tuple[Codes, np.ndarray], right: tuple[Codes, np.ndarray] | None, threshold: float, weight_l: np.ndarray, weight_r: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Links of two blocks, given as codes and unit vectors (``right`` None: within ``left``).

    Returns each vector's summed weight of linked vectors, its tree's smallest
    index, both for the vectors of ``left`` followed by those of ``right``, and how
    many pairs were computed in double precision.
    """
    codes, unit = left
    other = unit if right is None else right[1]
    n = len(unit)
    shift = 0 if right is None else n
    count = np.zeros(shift + len(other), np.int64)
    parent = np.arange(len(count))
    computed = 0
    for a, near in candidates(codes, None if right is None else right[0], threshold):
        i, j = np.nonzero(near)
        if not len(i):
            continue
        rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if len(i) * _DENSE >= len(rows) * len(cols):
            # most pairs of these rows and columns are candidates: one product
            full = (unit[a + rows] @ other[cols].T)[np.searchsorted(rows, i), np.searchsorted(cols, j)]
            computed += len(rows) * len(cols)
        else:
            full = np.concatenate([np.einsum("ij,ij->i", unit[a + i[k : k + _GATHERED]], other[j[k : k + _GATHERED]]) for k in range(0, len(i), _GATHERED)])
            computed += len(i)
        linked = full >= threshold
        i, j = a + i[linked], j[linked]
        if len(i):
            count += np.bincount(i, weight_r[j], minlength=len(count)).astype(np.int64)
            count += np.bincount(shift + j, weight_l[i], minlength=len(count)).astype(np.int64)
            parent = union(parent, i, shift + j)
    return count, parent, computed


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with dimension (0: links with nothing), digest, unit vector and codes."""
    for batch in batches:
        n = batch.num_rows
        lists = batch.column(1)
        values = lists.flatten().to_numpy(zero_copy_only=False) + 0.0  # nulls become NaN, and -0 becomes 0
        size = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
        start = np.cumsum(size) - size
        dim, mark = np.zeros(n, np.int32), np.zeros((n, 2), np.int64)
        numbers = np.zeros((n, 3))
        unit: list[bytes | None] = [None] * n
        code: list[bytes | None] = [None] * n
        for d in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == d)
            x = values[start[at][:, None] + np.arange(d)]
            sound = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            at, x = at[sound], x[sound]
            if not len(at):
                continue
            dim[at] = d
            mark[at] = np.frombuffer(b"".join(blake2b(v.tobytes(), digest_size=16).digest() for v in x), "<i8").reshape(-1, 2)
            x = x / np.abs(x).max(axis=1)[:, None]  # no overflow in the length
            x = x / np.linalg.norm(x, axis=1)[:, None]
            q, *some = quantise(x)
            numbers[at] = np.stack(some, axis=1)
            for k, row in enumerate(at.tolist()):
                unit[row], code[row] = x[k].tobytes(), q[k].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dim), pa.array(mark[:, 0]), pa.array(mark[:, 1]), *[pa.array(np.ascontiguousarray(c)) for c in numbers.T], pa.array(code, pa.binary()), pa.array(unit, pa.binary())], names=["_key", "_dim", "_x", "_y", "_scale", "_len", "_err", "_q", "_u"])


def _matrix(column: pa.ChunkedArray, kind: type, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _codes(part: pa.Table) -> Codes:
    return Codes(_matrix(part.column("_q"), np.int8, part.column("_dim")[0].as_py()), *(part.column(c).to_numpy() for c in ("_scale", "_len", "_err")))


def _sides(part: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether a tile is a block with itself, and the rows of its two blocks."""
    i, j = part.column("_i")[0].as_py(), part.column("_j")[0].as_py()
    low = part.column("_block").to_numpy() == i
    return i == j, np.flatnonzero(low), np.flatnonzero(~low)


@scoped
def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``key``, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col(quoted(key)).alias("_key"), F.col(quoted(vector)).cast("array<double>").alias("_v"))
    schema = rows.select("_key").schema.add("_dim", "integer").add("_x", "long").add("_y", "long")
    for name in ("_scale", "_len", "_err"):
        schema = schema.add(name, "double")
    rows = written(rows.mapInArrow(_described, schema.add("_q", "binary").add("_u", "binary")), "vectors")
    told_by = ["_dim", "_scale", "_len", "_err", "_q", "_u"]
    merged = rows.filter("_dim > 0").groupBy("_x", "_y").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in told_by])
    classes = written(merged.select(F.monotonically_increasing_id().alias("_id"), "_first", "_n", "_x", "_y", *told_by), "classes")
    blocks = max(1, math.ceil(classes.count() / tile))
    block = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_block")
    codes = ["_id", "_dim", "_scale", "_len", "_err", "_q"]
    dealt = classes.select(*codes, block).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other"))
    dealt = dealt.select(*codes, "_block", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))

    def survive(part: pa.Table) -> pa.Table:
        same, left, right = _sides(part)
        at = np.zeros(0, np.int64)
        if len(left) and (same or len(right)):
            known = _codes(part)
            rows, cols = tile_survivors(known.part(left), None if same else known.part(right), threshold)
            at = left[rows | cols] if same else np.concatenate((left[rows], right[cols]))
        return part.select(["_dim", "_i", "_j", "_id", "_block"]).take(pa.array(at))

    kept = dealt.groupBy("_dim", "_i", "_j").applyInArrow(survive, "_dim int, _i int, _j int, _id long, _block int")
    kept = written(kept.select("_i", "_j", F.col("_id").alias("_sid"), "_block"), "survivors")

    def compare(part: pa.Table) -> pa.Table:
        same, left, right = _sides(part)
        ids, weight = part.column("_id").to_numpy(), part.column("_n").to_numpy()
        known, unit = _codes(part), _matrix(part.column("_u"), np.float64, part.column("_dim")[0].as_py())
        other = None if same else (known.part(right), unit[right])
        count, parent, _ = tile_links((known.part(left), unit[left]), other, threshold, weight[left], weight[left if same else right])
        ids = ids[left if same else np.concatenate((left, right))]
        some = count > 0
        return pa.table({"_id": pa.array(ids[some]), "_root": pa.array(ids[parent][some]), "_links": pa.array(count[some])})

    whole = kept.join(classes.select(*codes, "_n", "_u"), F.col("_sid") == F.col("_id"))
    found = written(whole.groupBy("_dim", "_i", "_j").applyInArrow(compare, "_id long, _root long, _links long"), "links")
    links = found.groupBy(F.col("_id").alias("_lid")).agg(F.sum("_links").alias("_links"))
    joined = components(found.filter("_id <> _root").select(F.col("_id").alias("a"), F.col("_root").alias("b")))
    each = classes.select("_id", "_first", "_n", "_x", "_y").join(links, F.col("_id") == F.col("_lid"), "left").join(joined, F.col("_id") == F.col("node"), "left")
    each = written(each.select("_x", "_y", "_first", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"), F.coalesce("component", "_id").alias("_c")), "classes")
    # the smallest row id of each component
    smallest = written(each.groupBy(F.col("_c").alias("_cc")).agg(F.min("_first").alias("_smallest")), "smallest")
    told = written(each.join(sized(smallest), F.col("_c") == F.col("_cc")).select(F.col("_x").alias("_cx"), F.col("_y").alias("_cy"), "_links", "_smallest"), "told")
    out = rows.select("_key", "_dim", "_x", "_y").join(sized(told), (F.col("_dim") > 0) & (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy")), "left")
    component = F.when(F.col("_cx").isNull(), F.col("_key")).otherwise(F.col("_smallest"))
    return out.select(F.col("_key").alias(key), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"))


def op1_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
