import random

import pytest

from tessera.llm import _graph
from tests.llm.conftest import Groups


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(_graph, "LOCAL_EDGES", local)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5), (1, 2), (1, 2), (2, 1)]
    groups = Groups({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    got = _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted((x, groups.of(x)) for x in groups.up if groups.of(x) != x)
    assert _graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
