from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from tessera.functions.frontmatter import Filter
from tessera.operators.chunk import Fixed, Layered
from tessera.plans import catalog, search
from tessera.plans.ingest import Pipeline
from tessera.sources import files
from tessera.sources.providers import HashEmbedder, KeywordChat, OverlapReranker, Usage
from tessera.streaming.ingest import watch

DOC = "---\ntype: chapter\nbook: ddia\n---\n# Intro\n\nReplication keeps copies.\n\n![Fig](f.png)\n\n## Leaders\n\nThe leader takes writes.\n\n## Followers\n\nFollowers read logs.\n"


@pytest.mark.parametrize("name", ["knowledge_base", "KB_2026", "a" * 60])
def test_names(name):
    assert catalog.check_name(name) == name


@pytest.mark.parametrize("name", ["", "a-b", "a b", "a.b", "知", "a" * 61])
def test_bad_names(name):
    with pytest.raises(catalog.CatalogError):
        catalog.check_name(name)


@pytest.fixture
def folder(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text(DOC, encoding="utf-8")
    (docs / "b.md").write_text("no frontmatter", encoding="utf-8")
    (docs / "f.png").write_bytes(b"x" * 100)
    return docs


def test_a_knowledge_base_from_end_to_end(spark, tmp_path, folder):
    store = catalog.Store(spark, str(tmp_path / "store"))
    pipeline = Pipeline(store, HashEmbedder(), KeywordChat())
    pipeline.create_kb("k", Layered())
    with pytest.raises(catalog.CatalogError, match="exists"):
        pipeline.create_kb("k", Layered())
    assert store.meta("k")["query_mode"] == "hybrid"
    pipeline.add_folder("k", str(folder))
    pipeline.drain("k")
    rows = catalog.list_documents(store.table("document"), store.table("chunk"), store.table("task"), "k").collect()
    assert sorted((r["filename"], r["n_chunks"], r["status"]) for r in rows) == [("a.md", 3, "success"), ("b.md", 0, "failed")]
    figure = store.table("chunk").select(F.explode("figures").alias("f")).first()["f"]
    assert (figure["src"], len(figure["blob"])) == ("f.png", 136)
    found = search.query(store, pipeline.embedder, "k", "leader takes writes", top_k=1)
    assert found.first()["heading_path"] == ["Intro", "Leaders"]
    near = search.query(store, pipeline.embedder, "k", "leader takes writes", mode="vector", top_k=1, expand=True)
    assert [r["heading_path"][-1] for r in near.collect()] == ["Intro", "Leaders", "Followers"]
    best = search.query(store, pipeline.embedder, "k", "followers logs", top_k=1, reranker=OverlapReranker(), filters=[Filter.parse("book=ddia")])
    assert best.first()["relevance"] == 1.0
    assert "[score]  1.00 · RERANK" in search.rendered(best).first()["result"]
    assert search.query(store, pipeline.embedder, "k", "x", filters=[Filter.parse("book=other")]).count() == 0

    (folder / "b.md").write_text("---\ntype: x\n---\nnow good", encoding="utf-8")
    pipeline.add_file("k", str(folder / "b.md"))
    pipeline.drain("k")
    assert catalog.failed_tasks(store.table("task"), store.table("document"), "k").count() == 0
    ids = {r["filename"]: r["document_id"] for r in store.table("document").collect()}
    store.update_document("k", ids["a.md"], "a.md", "---\ntype: x\n---\n")
    pipeline.drain("k")
    assert store.table("chunk").filter(F.col("document_id") == ids["a.md"]).count() == 0
    with pytest.raises(catalog.CatalogError, match="is 'a.md'"):
        store.update_document("k", ids["a.md"], "z.md", "")
    assert catalog.Store(spark, str(tmp_path / "store")).remove_document("k", ids["a.md"]) == "a.md"
    store.refresh()
    store.delete_kb("k")
    assert store.table("document").count() == store.table("chunk").count() == store.table("task").count() == 0
    with pytest.raises(catalog.CatalogError, match="no knowledge base"):
        store.delete_kb("k")


def test_capabilities(spark, tmp_path):
    store = catalog.Store(spark, str(tmp_path / "store"))
    pipeline = Pipeline(store, HashEmbedder(8))
    pipeline.create_kb("f", Fixed())
    with pytest.raises(catalog.CatalogError, match="needs them"):
        search.query(store, pipeline.embedder, "f", "x", mode="hybrid")
    with pytest.raises(catalog.CatalogError, match="fixed chunks"):
        search.query(store, pipeline.embedder, "f", "x", expand=True)
    with pytest.raises(catalog.CatalogError, match="dimensions"):
        search.query(store, HashEmbedder(9), "f", "x")


def test_streaming_arrival(spark, tmp_path, folder):
    store = catalog.Store(spark, str(tmp_path / "store"))
    pipeline = Pipeline(store, HashEmbedder())
    pipeline.create_kb("s", Layered())
    watch(pipeline, "s", str(folder), str(tmp_path / "at")).awaitTermination()
    (folder / "c.md").write_text("---\ntype: x\n---\nmore", encoding="utf-8")
    watch(pipeline, "s", str(folder), str(tmp_path / "at")).awaitTermination()
    store.refresh()
    rows = catalog.list_documents(store.table("document"), store.table("chunk"), store.table("task"), "s").collect()
    assert {r["filename"]: r["status"] for r in rows} == {"a.md": "success", "b.md": "failed", "c.md": "success"}


def test_sinks(spark, tmp_path):
    corpus = spark.createDataFrame([(0, 'A "q"', None, "s", "c", "u", "body"), (1, "", "me", "s", "c", "u", None)], "i long, title string, author string, source string, category string, url string, body string")
    docs = files.corpus_markdown(corpus)
    assert files.write_documents(docs, str(tmp_path / "out")) == 2
    text = (tmp_path / "out" / "000-a-q.md").read_text(encoding="utf-8")
    assert text.startswith('---\ntype: article\ntitle: "A \\"q\\""\nresource: "u"\n') and text.endswith('---\n\n# A "q"\n\nbody\n')
    assert 'author: "me"' in (tmp_path / "out" / "001-untitled.md").read_text(encoding="utf-8")
    at = str(tmp_path / "runs")
    files.write_jsonl(spark.range(3).select(F.col("id").alias("query_id"), F.lit("a").alias("arm")), at)
    assert files.is_complete(spark, at, 3) and not files.is_complete(spark, at, 4) and not files.is_complete(spark, at + "x", 0)
    files.write_json(spark, str(tmp_path / "m.json"), {"a": 1})
    assert files.read_json(spark, str(tmp_path / "m.json"), "a int").first()["a"] == 1


class Refuses(HashEmbedder):
    def embed(self, texts):
        if any("refused" in t for t in texts):
            raise ValueError("not this text")
        return super().embed(texts)


class NoMarkers(KeywordChat):
    def chat_json(self, system, user):
        return "not JSON" if "unmarked" in user else super().chat_json(system, user)


def test_a_failing_service_fails_its_document_only(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, body in {"a": "good words", "b": "refused words", "c": "unmarked words", "d": "more good words"}.items():
        (docs / f"{name}.md").write_text(f"---\ntype: x\n---\n# T\n\n{body}\n\n## S\n\nplain words\n", encoding="utf-8")
    store = catalog.Store(spark, str(tmp_path / "store"))
    pipeline = Pipeline(store, Refuses(8), NoMarkers())
    pipeline.create_kb("k", Layered())
    pipeline.add_folder("k", str(docs))
    pipeline.drain("k")
    rows = catalog.list_documents(store.table("document"), store.table("chunk"), store.table("task"), "k").collect()
    assert {r["filename"]: (r["n_chunks"], r["status"]) for r in rows} == {"a.md": (2, "success"), "b.md": (0, "failed"), "c.md": (0, "failed"), "d.md": (2, "success")}
    told = {r["filename"]: r["error_message"] for r in catalog.failed_tasks(store.table("task"), store.table("document"), "k").collect()}
    assert told["b.md"] == "embedding: not this text" and told["c.md"].startswith("markers: the answer is not JSON")


def test_a_change_writes_one_knowledge_base_and_readers_go_on(spark, tmp_path, folder):
    store = catalog.Store(spark, str(tmp_path / "store"))
    pipeline = Pipeline(store, HashEmbedder(8))
    for name in ("one", "two"):
        pipeline.create_kb(name, Layered())
        pipeline.add_folder(name, str(folder))
        pipeline.drain(name)
    ids = [r["document_id"] for r in store.table("document").collect()]
    assert len(set(ids)) == len(ids) == 4
    before, held = dict(store._pointer["chunk"]), store.kb("chunk", "two")
    n = held.count()
    pipeline.add_file("two", str(folder / "a.md"))
    pipeline.drain("two")
    assert store._pointer["chunk"]["one"] == before["one"] and store._pointer["chunk"]["two"] != before["two"]
    assert held.count() == n > 0
    assert len(store._pointers()) == catalog.KEPT
    other = catalog.Store(spark, str(tmp_path / "store"))
    assert other._pointer == store._pointer and other.table("task").count() == 5
    store.flush()
    other.refresh()
    assert other.table("chunk").count() == other.table("kb_meta").count() == 0


def test_numbering_keeps_the_order(spark):
    from tessera.functions.scratch import in_order

    rows = spark.range(5000).repartition(7).select(F.col("id"), (F.col("id") * 7919 % 5000).alias("x")).orderBy("x")
    got = in_order(rows, "place", 1).collect()
    assert sorted((r["x"], r["place"]) for r in got) == [(i, i + 1) for i in range(5000)]


@dataclass
class CountedChat(KeywordChat):
    usage: Usage = field(default_factory=Usage)

    def chat_json(self, system, user):
        self.usage.add({"prompt_tokens": 3, "completion_tokens": 2, "total_tokens": 5})
        return super().chat_json(system, user)


def statuses(store):
    return sorted(r["status"] for r in store.table("task").collect())


def test_interrupts_cancel_and_failures_put_back(spark, tmp_path, folder, monkeypatch):
    store = catalog.Store(spark, str(tmp_path / "store"))
    pipeline = Pipeline(store, HashEmbedder(), CountedChat())
    pipeline.create_kb("k", Layered())
    pipeline.drain("k")  # nothing waits
    pipeline.add_folder("k", str(folder))

    def broken(error):
        def build(*_):
            assert statuses(store) == ["running"] * 2
            raise error

        return build

    with monkeypatch.context() as m:
        m.setattr(pipeline, "build", broken(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            pipeline.drain("k")
        assert statuses(store) == ["pending"] * 2
        m.setattr(pipeline, "build", broken(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            pipeline.drain("k")
    assert statuses(store) == ["canceled"] * 2 and store.table("chunk").isEmpty() and pipeline.usage.calls == 0
    pipeline.add_folder("k", str(folder))
    store.start("k")  # by a writer that died
    pipeline.drain("k")
    assert statuses(store) == ["canceled", "canceled", "failed", "success"]  # one has no frontmatter
    n = store.table("chunk").count()
    assert n > 0 and pipeline.usage.counts() == (3 * n, 2 * n, 0, 5 * n, n)


def test_search_by_index(spark, tmp_path, folder):
    store = catalog.Store(spark, str(tmp_path / "store"))
    pipeline = Pipeline(store, HashEmbedder(), KeywordChat())
    pipeline.create_kb("k", Layered())
    store.create_index("k")  # of nothing
    assert store.index("k", "embedding") is None
    pipeline.add_folder("k", str(folder))
    pipeline.drain("k")
    store.create_index("k")
    assert store.index("k", "embedding").counts.sum() == store.index("k", "marker_embedding").counts.sum() == store.table("chunk").count()
    for mode in search.MODES:
        exact, near = ([tuple(r) for r in search.query(store, pipeline.embedder, "k", "leader writes", mode, 2, approximate=a).collect()] for a in (False, True))
        assert near == exact and exact
    pipeline.add_folder("k", str(folder))
    pipeline.drain("k")  # an index that was there is made again
    assert store.index("k", "embedding") is not None
    store.remove_document("k", 1)
    assert store.index("k", "embedding") is None
    assert search.query(store, pipeline.embedder, "k", "leader", "vector", 2, approximate=True).count() == 0
