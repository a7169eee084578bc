import math

import numpy as np
import pytest

from tessera.llm import embeddings
from tests.llm.conftest import Groups


def vectors():
    rng = np.random.default_rng(1)
    some = rng.normal(size=(120, 16))
    near = some[:40] + rng.normal(size=(40, 16)) * 0.15
    hub = some[0] + rng.normal(size=(30, 16)) * 0.05
    rows = [x.astype(np.float32).tolist() for x in np.concatenate((some, near, hub, some[:20], some[:1].repeat(15, 0) * 1))]
    rows = [(i, v) for i, v in enumerate(rows)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    return rows + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, rows[5][1]), (7, rows[7][1])]


@pytest.mark.parametrize("tile", [4096, 32])
def test_links_and_components_as_by_brute_force(spark, tile):
    rows = vectors()
    sound = [i for i, (_, v) in enumerate(rows) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    groups, links = Groups(range(len(rows))), [0] * len(rows)
    for i in sound:
        for j in sound:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    links[i] += 1
                    groups.join(i, j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(groups.of(i), []).append(k)
    least = [min((k for k in ids[groups.of(i)] if k is not None), default=None) for i in range(len(rows))]
    frame = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<float>, _id int, _n int")
    got = embeddings.near_duplicates(frame, tile=tile).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"]), r["kept"]) for r in got) == sorted((repr(k), n, repr(c), k == c) for (k, _), n, c in zip(rows, links, least, strict=True))


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, n, e = embeddings.quantise(x)
    rough = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(x @ x.T - rough) <= n[:, None] * e + e[:, None] + 1e-12).all()


def test_an_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_only_candidate_pairs_are_computed_again():
    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(2000, 64)), rng.normal(size=(1500, 64))
    right[:700] = left[:700] + rng.normal(size=(700, 64)) * 0.05
    unit = [x / np.linalg.norm(x, axis=1)[:, None] for x in (left, right)]
    codes = [embeddings.Codes(*embeddings.quantise(u)) for u in unit]
    rows, cols = embeddings.tile_survivors(*codes, 0.9)
    assert rows[:700].all() and cols[:700].all() and rows[700:].sum() + cols[700:].sum() < 5
    one = np.ones(2000, np.int64)
    count, parent, computed = embeddings.tile_links((codes[0], unit[0]), (codes[1], unit[1]), 0.9, one, one[:1500])
    linked = unit[0] @ unit[1].T >= 0.9
    assert (count == np.concatenate((linked.sum(axis=1), linked.sum(axis=0)))).all()
    assert (parent[2000:2700] == np.arange(700)).all() and linked.sum() <= computed < linked.sum() + 50


def test_a_dense_group_is_one_product():
    rng = np.random.default_rng(4)
    x = rng.normal(size=64) + rng.normal(size=(600, 64)) * 0.05
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    codes = embeddings.Codes(*embeddings.quantise(unit))
    count, parent, _ = embeddings.tile_links((codes, unit), None, 0.9, np.ones(600, np.int64), np.ones(600, np.int64))
    assert (count == 599).all() and (parent == 0).all()
