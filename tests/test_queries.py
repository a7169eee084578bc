"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.operators import retrieval
from tessera.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) if x is not None else None
    return sorted([repr([plain(r[i]) for i in order]) for r in rows])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, db, name):
    got = registry.QUERIES[name](spark, DIR)
    want = db.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert comparable([tuple(r) for r in got.collect()], got.columns) == comparable(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def test_batch_search_takes_the_whole_stated_set(spark, db):
    got = registry.QUERIES["vector_topk_batch"](spark, DIR)
    want = {r[0] for r in db.execute("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()}
    assert len(want) > 20 and {r["query_id"] for r in got.collect()} == want


def test_batch_search_in_blocks_finds_the_same(spark):
    vectors = registry.read(spark, DIR, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    one, many = ({tuple(r) for r in retrieval.batch_search(vectors, queries, 5, ["vec_id"], digits=6, block=b).collect()} for b in (1000, 7))
    assert one == many and len(one) == 5 * queries.count()
