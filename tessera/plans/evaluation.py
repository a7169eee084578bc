"""The evaluation harness: builds a knowledge base from a dataset and scores retrieval arms.

All queries of an arm are searched at once; runs are kept as JSON lines, so that
an arm that has been run is not run again.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tokens import token_count
from tessera.operators import evaluate, retrieval
from tessera.operators.chunk import Layered
from tessera.plans.catalog import failed_tasks
from tessera.plans.ingest import Pipeline
from tessera.sources import files
from tessera.sources.providers import RerankProvider, embed_column, reranked

CANDIDATES = 32
#: Arms by name: mode and whether hits are expanded.
MODES = {"vector": ("vector", False), "marker": ("marker", False), "hybrid": ("hybrid", False), "hybrid-expand": ("hybrid", True)}
_KEY = retrieval.KEY


class Dataset(Protocol):
    name: str

    def corpus(self) -> DataFrame: ...

    def queries(self, n: int, seed: int) -> DataFrame: ...


@dataclass
class MultiHopQuestions:
    """``corpus.json`` and ``queries.json`` of a folder: articles, and questions with facts as evidence."""

    pipeline: Pipeline
    folder: str
    name: str = "multihop"

    def corpus(self) -> DataFrame:
        raw = files.read_json(self.pipeline.store.spark, f"{self.folder}/corpus.json", files.CORPUS)
        return files.corpus_markdown(files.numbered(raw))

    def queries(self, n: int, seed: int) -> DataFrame:
        raw = files.numbered(files.read_json(self.pipeline.store.spark, f"{self.folder}/queries.json", files.RAW_QUERIES), "id")
        shaped = raw.select("id", "query", "question_type", F.transform(F.coalesce("evidence_list", F.array().cast("array<struct<fact:string>>")), lambda e: e["fact"]).alias("facts"))
        return evaluate.stratified_sample(shaped, n, seed)


def build(pipeline: Pipeline, data: Dataset, kb: str, work: str, n: int = 100, seed: int = 42, how: Layered | None = None, force: bool = False) -> None:
    """Converts the corpus, samples queries and ingests documents that are not there yet; a failed document is an error."""
    store = pipeline.store
    if force or not files.exists(store.spark, f"{work}/queries"):
        files.write_jsonl(data.queries(n, seed), f"{work}/queries")
    known = store.table("kb_meta").filter(F.col("name") == kb)
    if force and not known.isEmpty():
        store.delete_kb(kb)
    if known.isEmpty() or force:
        pipeline.create_kb(kb, how or Layered())
    docs = data.corpus().select("filename", F.lit("").alias("source_dir"), "content")
    new = docs.join(store.kb("document", kb).select("filename"), "filename", "left_anti")
    if not new.isEmpty():
        store.register(kb, new, 0)
    pipeline.drain(kb)
    failed = failed_tasks(store.table("task"), store.table("document"), kb).collect()
    if failed:
        raise RuntimeError(f"{len(failed)} documents failed, the first: {failed[0]['error_message']}")


def _ranked(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def run_arm(rows: DataFrame, nodes: DataFrame, queries: DataFrame, arm: str, reranker: RerankProvider | None = None, candidates: int = CANDIDATES, depth: int = 2) -> DataFrame:
    """Ranked chunks (arm, query_id, rank, key, text, tokens) for all queries (query_id, query, vector) of an arm.

    An expanded arm without reranker is in document order and not cut.
    """
    mode, expand = MODES[arm]
    lists = {"vector": [("embedding", 1)], "marker": [("marker_embedding", 0)], "hybrid": [("marker_embedding", 0), ("embedding", 1)]}[mode]
    found = None
    for column, _ in lists:
        near = retrieval.batch_search(rows.filter(F.col(column).isNotNull()), queries, candidates, _KEY, column)
        found = near if found is None else found.unionByName(near)
    scored = found.groupBy("query_id", *_KEY).agg(F.sum(F.lit(1.0) / (retrieval.RRF_K + F.col("rank"))).alias("score"))
    hits = _ranked(scored, F.col("score").desc(), *_KEY).select("query_id", *_KEY, "rank")
    if expand:
        # a query's hits and their documents' sections, each query by itself
        own = F.struct("query_id", "document_id").alias("document_id")
        pairs = hits.select("query_id", "document_id").distinct()
        sections = retrieval.expand(hits.select(own, "node_id"), nodes.join(pairs, "document_id").select(own, "node_id", "parent_id"), depth)
        near = sections.select("document_id.query_id", F.col("document_id.document_id").alias("document_id"), "node_id").join(rows.select(*_KEY), ["document_id", "node_id"])
        all_ = hits.select("query_id", *_KEY).unionByName(near.select("query_id", *_KEY)).distinct().join(rows.select(*_KEY, "sort_order"), _KEY)
        hits = _ranked(all_, "document_id", "sort_order", "chunk_seq", "node_id").select("query_id", *_KEY, "rank")
    out = hits.join(rows.select(*_KEY, "text"), _KEY)
    if reranker is not None:
        asked = out.join(F.broadcast(queries.select("query_id", "query")), "query_id")

        def order(part: pd.DataFrame) -> pd.DataFrame:
            # one query's candidates
            part = part.sort_values("rank").reset_index(drop=True)
            got = reranked(reranker, part["query"].iloc[0], part["text"].tolist(), len(part))
            best = part.iloc[[i for i, _ in got]].reset_index(drop=True)
            best["rank"] = range(1, len(best) + 1)
            return best[["query_id", *_KEY, "rank", "text"]]

        key = rows.select(*_KEY).schema
        schema = "query_id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key) + ", rank int, text string"
        out = asked.groupBy("query_id").applyInPandas(order, schema)
    return out.select(F.lit(arm + ("+rerank" if reranker is not None else "")).alias("arm"), "query_id", "rank", *_KEY, "text", token_count(F.col("text")).cast("long").alias("tokens"))


def score(pipeline: Pipeline, kb: str, work: str, arms: list[str] | None = None, reranker: RerankProvider | None = None) -> DataFrame:
    """Metrics by arm and question type; runs and ``metrics.json`` are kept in ``work``."""
    store = pipeline.store
    spark = store.spark
    meta = store.meta(kb)
    arms = arms or [a for a, (mode, _) in MODES.items() if mode == "vector" or meta["llm_config"] is not None]
    asked = files.read_jsonl(spark, f"{work}/queries", files.QUERIES)
    queries = asked.select(F.col("id").alias("query_id"), "query", "question_type", "facts", embed_column(pipeline.embedder, F.col("query"), pipeline.embed_batch, meta["dimension"]).alias("vector"))
    facts = queries.select("query_id", "question_type", F.posexplode("facts").alias("fact_no", "fact"))
    nodes = store.kb("node", kb)
    rows = retrieval.searchable(store.kb("chunk", kb), nodes, store.kb("document", kb))
    runs = None
    for arm in arms:
        for one in [None] + [reranker] * (reranker is not None):
            at = f"{work}/runs/{arm}" + ("+rerank" if one is not None else "")
            if not files.exists(spark, f"{at}/_SUCCESS"):
                files.write_jsonl(run_arm(rows, nodes, queries, arm, one), at)
            kept = files.read_jsonl(spark, at, "arm string, query_id long, rank int, document_id long, node_id string, chunk_seq int, text string, tokens long")
            runs = kept if runs is None else runs.unionByName(kept)
    scored = evaluate.relevances(runs, facts)
    metrics = evaluate.budget_recall(scored, facts).join(evaluate.paper_metrics(scored, facts), ["arm", "query_id"])
    summary = evaluate.summarize(metrics, facts)
    table = [r.asDict() for r in summary.orderBy("arm", F.col("question_type").asc_nulls_first()).collect()]  # a row for each arm and type
    files.write_json(spark, f"{work}/metrics.json", table)
    return summary


