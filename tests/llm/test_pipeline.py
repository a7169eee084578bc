import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm._base import written
from tests.llm.conftest import prose, split

DIR = "/root/testdata/sf0.001"


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mixing", "packing"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        if name != "mixing":
            assert docs.count() <= before
        before = docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_planted_cases(spark, tmp_path):
    """Copies and near copies go but for one, a repeated passage is cut once, junk and toxic text go, clean text stays."""
    import random

    rng = random.Random(11)
    clean = [". ".join(prose(rng, 9).capitalize() for _ in range(rng.choice([4, 10, 30]))) + "." for _ in range(300)]
    passage = prose(rng, 55)
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(clean)]
    toxic = [(400 + i, clean[i].replace(clean[i].split()[3], "scum", 1) + " You vile scum. " + prose(rng, 40), "en", "s0") for i in range(30)]
    near = [(500 + i, " ".join([*clean[100 + i].split()[:-1], "changed"]), "en", "s1") for i in range(20) if len(clean[100 + i].split()) > 80]
    same = [(600 + i, clean[i], "en", "s0") for i in range(10)]
    junk = [(700 + i, " ".join(w.upper() + "!!" for w in clean[i].split()), "en", "s0") for i in range(5)]
    shared = [(800 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 40), "en", "s1") for i in range(8)]
    spark.createDataFrame([(*r, len(r[1])) for r in rows + toxic + near + same + junk + shared], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(200)] + [(400 + i, 1, 1) for i in range(15)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(range(300)) <= set(left)
    assert not [i for i in left if 400 <= i < 800]
    whole = [i for i in range(800, 808) if passage.encode() in b" ".join(split(left[i]))]
    assert whole == [800] and all(len(split(left[i])) == 80 for i in range(801, 808))
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(left)
