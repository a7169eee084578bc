"""Nearest rows of many queries by cosine distance: products of tiles, then the pairs that may count again, one by one.

Distances are as list_cosine_distance of SQL has them: NaN where a vector is zero
or not finite, null where one is null, empty, has a null component or another
dimension.  NaN stands after all numbers, null after NaN.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Queries and rows of a tile that are multiplied at once; of the first rows, which give each query its first bound, fewer.
_QUERIES, _ROWS, _FIRST = 512, 4096, 512
#: For rounding in sums of products.
_SLACK = 1e-9
#: Pairs that are gathered at once.
_GATHERED = 1 << 15


def by_dimension(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and components (in double precision) of the vectors of each dimension; null ones, empty ones and those with nulls are left out."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    null = flat.is_null().to_numpy(zero_copy_only=False)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    out = {}
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        cells = start[at][:, None] + np.arange(d)
        if null.any():
            whole = ~null[cells].any(axis=1)
            at, cells = at[whole], cells[whole]
        if len(at):
            out[d] = at, values[cells]
    return out


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of paired vectors, added in the order of their components."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def _distances(x: np.ndarray, x_norm: np.ndarray, y: np.ndarray, y_norm: np.ndarray, i: np.ndarray, j: np.ndarray, digits: int | None) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), _GATHERED):
        p, q = i[a : a + _GATHERED], j[a : a + _GATHERED]
        out[a : a + _GATHERED] = 1.0 - np.clip(_summed(x[p], y[q]) / (x_norm[p] * y_norm[q]), -1.0, 1.0)
    if digits is None:
        return out
    scaled = out * 10.0**digits
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)) / 10.0**digits


def _first(k: int, query: np.ndarray, distance: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` first of each query by distance and row."""
    order = np.lexsort((row, distance, query))
    query = query[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], distance[order][kept], row[order][kept]


def _nearest_numbers(x: np.ndarray, x_norm: np.ndarray, y: np.ndarray, y_norm: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, distances and rows of the ``k`` first of every query, vectors of some length and of one dimension being given."""
    turned = np.ascontiguousarray((y / y_norm[:, None]).T)
    half = 0.0 if digits is None else 0.5 * 10.0**-digits
    found = []
    for a in range(0, len(x), _QUERIES):
        own, own_norm = x[a : a + _QUERIES], x_norm[a : a + _QUERIES]
        unit = own / own_norm[:, None]
        best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        bound = np.full(len(own), np.inf)
        low = 0
        while low < len(y):
            high = min(low + (_ROWS if low else max(_FIRST, k)), len(y))
            near = 1.0 - unit @ turned[:, low:high]
            if low:
                # a later row with the distance of the last of k comes after it
                least = bound - half + _SLACK
            elif high > k:
                least = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * half + _SLACK
            else:
                least = bound
            i, j = np.nonzero(near <= least[:, None])
            if len(i):
                j += low
                more = _distances(own, own_norm, y, y_norm, i, j, digits)
                best = _first(k, *(np.concatenate(s) for s in zip(best, (i, more, j), strict=True)))
                full = np.flatnonzero(np.bincount(best[0], minlength=len(own)) == k)
                bound[full] = best[1][np.searchsorted(best[0], full, side="right") - 1]
            low = high
        found.append((best[0] + a, best[1], best[2]))
    return tuple(np.concatenate(s) for s in zip(*found, strict=True))


def nearest(queries: pa.ChunkedArray | pa.Array, rows: pa.ChunkedArray | pa.Array, k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Queries' and rows' places and distances: of every query at least its ``k`` first rows by distance, then place."""
    asked, known = by_dimension(queries), by_dimension(rows)
    said: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []  # the last: whether the distances are null

    def rest(some: np.ndarray, places: np.ndarray, null: bool) -> None:
        places = places[:k]
        said.append((np.repeat(some, len(places)), np.tile(places, len(some)), np.full(len(some) * len(places), np.nan), null))

    every = np.arange(len(rows))
    without = np.ones(len(queries), bool)
    for d, (at, x) in asked.items():
        without[at] = False
        places, y = known.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
        with np.errstate(over="ignore", invalid="ignore"):
            x_norm, y_norm = np.sqrt(_summed(x, x)), np.sqrt(_summed(y, y))
        some, others = np.isfinite(x_norm) & (x_norm > 0), np.isfinite(y_norm) & (y_norm > 0)
        n = np.zeros(len(x), np.int64)
        if some.any() and others.any():
            i, distance, j = _nearest_numbers(x[some], x_norm[some], y[others], y_norm[others], k, digits)
            n[some] = np.bincount(i, minlength=int(some.sum()))
            said.append((at[some][i], places[others][j], distance, False))
        rest(at[some & (n < k)], places[~others], False)
        rest(at[~some], places, False)
        rest(at[n < k], np.setdiff1d(every, places), True)
    rest(np.flatnonzero(without), every, True)
    i, j, distance = (np.concatenate([s[c] for s in said]) for c in range(3))
    null = np.concatenate([np.full(len(s[0]), s[3]) for s in said])
    return i, j, pa.array(distance, mask=null)
