import json
import os

import numpy as np
import pytest

from tessera.operators import ann
from tessera.plans import catalog, evaluation
from tessera.plans.ingest import Pipeline
from tessera.sources.providers import HashEmbedder, KeywordChat, OverlapReranker


def test_the_harness_from_end_to_end(spark, tmp_path):
    topics = ["whales swim in oceans", "volcanoes erupt with lava", "bakers knead bread dough", "glaciers carve deep valleys"]
    corpus = [{"title": f"Doc {i}", "author": None, "source": "s", "category": "c", "url": f"u{i}", "body": f"Opening words number {i}.\n\n## More\n\n{t} every day. {t} again.\n\n## Other\n\nUnrelated closing."} for i, t in enumerate(topics)]
    queries = [{"query": t, "question_type": "ab"[i % 2], "evidence_list": [{"fact": t}]} for i, t in enumerate(topics)] + [{"query": "none", "question_type": "null_query", "evidence_list": []}]
    (tmp_path / "corpus.json").write_text(json.dumps(corpus), encoding="utf-8")
    (tmp_path / "queries.json").write_text(json.dumps(queries), encoding="utf-8")
    pipeline = Pipeline(catalog.Store(spark, str(tmp_path / "store")), HashEmbedder(128), KeywordChat())
    data = evaluation.MultiHopQuestions(pipeline, str(tmp_path))
    work = str(tmp_path / "work")
    evaluation.build(pipeline, data, "e", work, n=4)
    before = pipeline.store.table("task").count()
    evaluation.build(pipeline, data, "e", work, n=4)  # nothing is left to do
    assert pipeline.store.table("task").count() == before == 4
    rows = evaluation.score(pipeline, "e", work, ["vector", "hybrid-expand"], OverlapReranker()).collect()
    by = {(r["arm"], r["question_type"]): r for r in rows}
    assert len(by) == 12 and by[("vector", None)]["n"] == 4
    assert by[("vector", None)]["hit_4"] == by[("vector", "a")]["mrr_10"] == by[("hybrid-expand+rerank", None)]["mrr_10"] == 1.0
    assert 0 < by[("hybrid-expand", None)]["recall_4096"] <= 1.0
    assert len(json.loads((tmp_path / "work" / "metrics.json").read_text(encoding="utf-8"))) == 12


def test_the_index_finds_most_of_the_nearest(spark, tmp_path):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(600, 16))
    odd = [(999, [0.0] * 16), (998, None), (997, [1.0]), (996, [float("nan")] + [1.0] * 15)]
    rows = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)] + odd, "id long, embedding array<float>")
    index = ann.build(rows, ["id"], "embedding", str(tmp_path / "i"))
    assert index.counts.sum() == 600 == index.rows.count() and len(index.cells) == 24
    exact = {q: np.argsort(-(vectors @ vectors[q]) / np.linalg.norm(vectors, axis=1))[:10].tolist() for q in range(5)}
    hit = 0
    for q in range(5):
        near = [r["id"] for r in index.search(vectors[q].tolist(), 10, ["id"]).collect()]
        assert near[0] == q and len(near) == 10
        hit += len(set(near) & set(exact[q]))
    assert hit >= 45
    assert [r["id"] for r in index.search(vectors[0].tolist(), 10, ["id"], probes=24).collect()] == exact[0]  # all cells: exact
    assert index.search(vectors[0].tolist(), 100, ["id"], probes=1).count() == 100  # cells are read until they hold enough
    groups = np.repeat(rng.normal(size=(20, 16)), 30, axis=0) + 0.01 * vectors
    assert ann.probes_for(ann._units(groups), ann.centroids(ann._units(groups), 24)) <= 3 < index.probes  # groups need few cells
    again = ann.load(spark, str(tmp_path / "i"), "embedding")
    assert (again.cells == index.cells).all() and (again.counts == index.counts).all() and again.probes == index.probes


def test_the_index_of_no_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "id long, embedding array<float>")
    for k, df in enumerate((rows, rows.limit(0))):
        index = ann.build(df, ["id"], "embedding", str(tmp_path / str(k)))
        assert index.search([1.0, 0.0], 3, ["id"]).collect() == []
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "id long, embedding array<float>")
    index = ann.build(same, ["id"], "embedding", str(tmp_path / "same"))
    assert [r["id"] for r in index.search([2.0, 0.0], 3, ["id"]).collect()] == [0, 1, 2]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_index_on_the_given_vectors(spark, tmp_path, sf):
    """Recall for the stated queries, every vector whose id is divisible by 20, against brute force."""
    at = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(at):
        pytest.skip("the test tables are not here")
    rows = spark.read.parquet(at)
    index = ann.build(rows, ["vec_id"], "embedding", str(tmp_path / "i"))
    all_ = rows.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    unit = np.stack(all_["embedding"]).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    ids = all_["vec_id"].to_numpy()
    asked = np.flatnonzero(ids % 20 == 0)
    exact = {(ids[q], i) for q in asked for i in ids[np.argsort(-(unit @ unit[q]), kind="stable")[:5]]}
    queries = rows.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    found = {(r["query_id"], r["vec_id"]) for r in index.batch(queries, 5, ["vec_id"]).collect()}
    read = sum(index.counts[c].sum() for c in ann.probed(unit[asked], index.cells, index.counts, index.probes, 5)) / len(asked) / len(ids)
    recall = len(found & exact) / len(exact)
    print(f"{sf}: {len(ids)} vectors, {index.probes} of {len(index.cells)} cells, {len(asked)} queries, recall {recall:.3f}, share of rows read {read:.2f}")
    assert len(found) == len(exact) == 5 * len(asked) and recall >= 0.9
