import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, retrieval

SCHEMA = "document_id long, filename string, frontmatter string, node_id string, chunk_seq int, heading_path array<string>, sort_order int, source string, text string, figures array<string>, markers array<string>, distance double"


def results(spark, rows):
    return spark.createDataFrame([(1, "f", "{}", k, s, [], o, src, k, [], [], d) for k, s, o, src, d in rows], SCHEMA)


def test_fusion(spark):
    marker = retrieval.ranked(results(spark, [("both", 0, 0, "MARKER", 0.1), ("m1", 0, 0, "MARKER", 0.2)]))
    vector = retrieval.ranked(results(spark, [("both", 0, 0, "VEC", 0.0), ("v1", 0, 0, "VEC", 0.5)]))
    rows = retrieval.fuse(marker, vector).collect()
    assert [(r["node_id"], r["source"]) for r in rows] == [("both", "MARKER"), ("m1", "MARKER"), ("v1", "VEC")]
    assert rows[0]["score"] == pytest.approx(2 / 61) and rows[0]["distance"] == 0.1
    assert retrieval.fuse(marker, vector, 2).count() == 2
    assert retrieval.fuse(marker.limit(0), vector.limit(0)).count() == 0


def test_merge_keeps_hits_and_document_order(spark):
    hits = results(spark, [("b", 0, 2, "VEC", 0.1), ("d", 0, 4, "VEC", 0.2)])
    near = results(spark, [("c", 0, 3, "TREE", 0.0), ("b", 0, 2, "TREE", 0.0), ("a", 0, 1, "TREE", 0.0)])
    assert [(r["node_id"], r["source"]) for r in retrieval.merge(hits, near).collect()] == [("a", "TREE"), ("b", "VEC"), ("c", "TREE"), ("d", "VEC")]


TREE = [("root", None), ("ch1", "root"), ("ch1a", "ch1"), ("ch1b", "ch1"), ("ch2", "root"), ("ch2a", "ch2")]


@pytest.mark.parametrize("hits, depth, expected", [(["ch1a"], 2, "ch1 ch1b"), (["ch1a"], 1, "ch1"), (["ch1a", "ch1b"], 2, "ch1"), (["root"], 2, "ch1 ch2"), ([], 2, "")])
def test_expansion(spark, hits, depth, expected):
    nodes = spark.createDataFrame([(1, n, p) for n, p in TREE] + [(2, "root", None), (2, "ch1", "root")], "document_id long, node_id string, parent_id string")
    found = retrieval.expand(spark.createDataFrame([(1, h) for h in hits], "document_id long, node_id string"), nodes, depth)
    rows = found.collect()
    assert " ".join(sorted(r["node_id"] for r in rows)) == expected and all(r["document_id"] == 1 for r in rows)


def test_top_by_group(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    got = retrieval.top_by_group(rows, ["g"], ["x"], 2).collect()
    assert sorted((r["g"], r["x"], r["rank"]) for r in got) == [(0, 0, 1), (0, 3, 2), (1, 1, 1), (1, 4, 2), (2, 2, 1), (2, 5, 2)]


def runs(spark, texts, counts=None):
    return spark.createDataFrame([("a", 1, i + 1, t, (counts or [1] * len(texts))[i]) for i, t in enumerate(texts)], "arm string, query_id long, rank int, text string, tokens int")


def facts(spark, some):
    return spark.createDataFrame([(1, "t", i, f) for i, f in enumerate(some)], "query_id long, question_type string, fact_no int, fact string")


def test_budgets_and_relevances(spark):
    f = facts(spark, ["alpha", "beta"])
    scored = evaluate.relevances(runs(spark, ["has alpha and beta", "repeats alpha", "nothing"], [100, 500, 100]), f)
    assert [r["relevance"] for r in scored.orderBy("rank").collect()] == [2, 0, 0]
    row = evaluate.budget_recall(scored, f, (0, 512, 700)).first()
    assert (row["recall_0"], row["ndcg_0"], row["recall_512"], row["recall_700"]) == (0, 0, 1, 1)
    assert row["ndcg_512"] == pytest.approx(2.0)  # two facts in one chunk


def test_paper_metrics(spark):
    f = facts(spark, ["fact one", "fact two"])
    scored = evaluate.relevances(runs(spark, ["irrelevant", "fact one", "fact one and fact\ntwo"]), f)
    row = evaluate.paper_metrics(scored, f).first()
    assert row["map_10"] == pytest.approx((1 / 2 + 1 / 3) / 2)
    assert (row["mrr_10"], row["hit_4"], row["hit_10"]) == (0.5, 1, 1)


def test_sampling(spark):
    rows = [(i, "q", t, ["f"]) for i, t in enumerate(["a"] * 10 + ["b"] * 20 + ["c"] * 30 + ["null_query"] * 15)] + [(99, "q", "a", [])]
    queries = spark.createDataFrame(rows, "id long, query string, question_type string, facts array<string>")
    sample = evaluate.stratified_sample(queries, 20)
    counts = {r["question_type"]: r["count"] for r in sample.groupBy("question_type").count().collect()}
    assert counts == {"a": 3, "b": 7, "c": 10}
    assert sample.collect() == evaluate.stratified_sample(queries, 20).collect()
    with pytest.raises(ValueError, match="eligible"):
        evaluate.stratified_sample(queries, 61)


def asked_and_known(spark, tmp_path):
    """Vectors of few directions (so that distances tie), copies, and some that are null, zero or not finite."""
    import random

    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(1500)]
    rows += [(i, [0.5, 0.25, 1.0, 0.125]) for i in range(1500, 2600)] + [(2600, None), (2601, [0.0] * 4), (2620, [0.0] * 4), (2640, None), (2641, [float("nan"), 1.0, 1.0, 1.0]), (2660, [float("inf"), 1.0, 1.0, 1.0])]
    rng.shuffle(rows)
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(path)
    vectors = spark.read.parquet(path)
    return path, vectors, vectors.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")


@pytest.mark.parametrize("block", [retrieval.QUERY_BLOCK, 40])
def test_batch_search_of_ties_copies_and_odd_vectors_is_as_sql(spark, tmp_path, block):
    import duckdb

    from tessera.plans import registry

    path, vectors, queries = asked_and_known(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
    want = con.execute(registry.ORACLE_SQL["vector_topk_batch"]).fetchall()
    got = retrieval.batch_search(vectors, queries, 5, ["vec_id"], digits=6, block=block)
    assert plain(got.select("query_id", "vec_id", "distance", "rank").collect()) == plain(want)


def test_batch_search_makes_no_row_for_each_pair(spark, tmp_path):
    _, vectors, queries = asked_and_known(spark, tmp_path)
    plan = retrieval.batch_search(vectors, queries, 5, ["vec_id"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_batch_search_of_less_than_k_and_nothing(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, None), (2, [1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    got = retrieval.batch_search(rows, queries, 5, ["vec_id"]).orderBy("rank").collect()
    assert [(r["vec_id"], str(r["distance"])) for r in got] == [(3, "0.0"), (4, "nan"), (1, "None"), (2, "None")]
    assert retrieval.batch_search(rows.limit(0), queries, 5, ["vec_id"]).collect() == []
    assert retrieval.batch_search(rows, queries.limit(0), 5, ["vec_id"]).collect() == []
