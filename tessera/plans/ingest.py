"""Ingestion: queued documents are parsed, chunked, given markers and vectors, and stored.

One job takes all pending documents of a knowledge base.  A document that cannot be
parsed, or for one of whose chunks a service fails, leaves an outcome and keeps what it
had; the others are stored in one commit.  An interrupt cancels the tasks under way; after
any other failure of the job they wait again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import chunk as chunking
from tessera.plans.catalog import CatalogError, Store
from tessera.sources import documents as sources
from tessera.sources.providers import CONCURRENCY, ChatProvider, EmbedProvider, Usage, dimension, embed_outcomes, marker_outcomes, usage_counter


@dataclass
class Pipeline:
    store: Store
    embedder: EmbedProvider
    chat: ChatProvider | None = None
    embed_batch: int = 32
    tokenizer_path: str | None = None
    concurrency: int = CONCURRENCY
    #: What the services reported for documents ingested so far, with attempts that Spark repeated.
    usage: Usage = field(default_factory=Usage)

    def create_kb(self, name: str, how: chunking.Layered | chunking.Fixed, query_mode: str | None = None, retrieval: dict | None = None, embed_config: dict | None = None, llm_config: dict | None = None) -> None:
        """A knowledge base with these settings; its dimension is the provider's."""
        kind = "layered" if isinstance(how, chunking.Layered) else "fixed"
        llm = (llm_config or {"provider": "configured"}) if self.chat else None
        self.store.create_kb(name, dimension(self.embedder), {"strategy": kind, **how.__dict__}, embed_config or {}, retrieval, llm, query_mode)

    def strategy(self, kb: str) -> chunking.Layered | chunking.Fixed:
        config = json.loads(self.store.meta(kb)["chunk_config"])
        kind = config.pop("strategy")
        if kind not in ("layered", "fixed"):
            raise CatalogError(f"unknown chunk strategy {kind!r}")
        return (chunking.Layered if kind == "layered" else chunking.Fixed)(**config)

    def add_folder(self, kb: str, folder: str, priority: int = 0) -> None:
        self.store.register(kb, sources.scan_folder(self.store.spark, folder), priority)

    def add_file(self, kb: str, path: str, priority: int = 100) -> None:
        self.store.register(kb, sources.scan_file(self.store.spark, path), priority)

    def drain(self, kb: str) -> None:
        """Ingests all pending documents of a knowledge base."""
        meta = self.store.meta(kb)
        size = dimension(self.embedder)
        if size != meta["dimension"]:
            raise CatalogError(f"{kb!r} holds vectors of {meta['dimension']} dimensions and the provider gives {size}")
        if not self.store.start(kb):
            return
        try:
            self._ingest(kb)
        except KeyboardInterrupt:  # Spark's own handler has stopped its jobs by now
            self.store.cancel(kb)
            raise
        except Exception:
            self.store.put_back(kb)
            raise

    def _ingest(self, kb: str) -> None:
        """Builds and stores the documents of running tasks."""
        spark = self.store.spark
        own = self.store.kb("document", kb)
        tasks = self.store.kb("task", kb).filter("status = 'running'").select("task_id", "document_id")
        todo = own.join(tasks.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "filename", "source_dir", "content")
        at = f"{self.store.root}/staging/{kb}"
        counter = usage_counter(spark)
        built = self.build(kb, todo, counter)
        try:
            built.write.mode("overwrite").parquet(at)
        finally:
            self.usage.take(counter.value)
        built = spark.read.parquet(at)
        ok = built.filter("error is null")
        with_kb = lambda df: df.withColumn("kb_name", F.lit(kb))
        indexed = self.store.index(kb, "embedding") is not None
        outcomes = tasks.join(built.select("document_id", "error"), "document_id").select("task_id", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), F.col("error").alias("error_message"))
        nodes = with_kb(ok.select("document_id", F.inline("nodes")))
        chunks = with_kb(ok.select("document_id", F.inline("chunks")))
        self.store.finish(kb, ok.select("document_id", "frontmatter"), nodes, chunks, outcomes)
        if indexed:
            self.store.create_index(kb)

    def build(self, kb: str, raw: DataFrame, counter: Accumulator | None = None) -> DataFrame:
        """``document_id``, frontmatter, nodes, embedded chunks and an error, a row for each document."""
        meta = self.store.meta(kb)
        docs = sources.parsed(raw)
        parsed = chunking.chunk_documents(sources.good(docs).drop("content"), self.strategy(kb), tokenizer_path=self.tokenizer_path)
        chunks = parsed.select("document_id", "source_dir", F.inline("chunks"))
        chunks = sources.with_figures(chunks, self.store.spark)
        lost = chunks.filter(F.size("missing") > 0).groupBy("document_id").agg(F.concat(F.lit("missing figure files: "), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))), ", ")).alias("_lost"))
        chunks = chunks.withColumn("_e", embed_outcomes(self.embedder, F.col("embedding_text"), self.embed_batch, meta["dimension"], counter))
        chunks = chunks.withColumn("embedding", F.col("_e.value"))
        errors = [F.col("_e.error")]
        if self.chat is not None and meta["llm_config"] is not None:
            chunks = chunks.withColumn("_m", marker_outcomes(self.chat, F.col("text"), self.concurrency, counter))
            chunks = chunks.withColumn("markers", F.col("_m.value"))
            chunks = chunks.withColumn("_me", embed_outcomes(self.embedder, F.when(F.col("markers").isNotNull(), F.concat_ws(" ", "markers")), self.embed_batch, meta["dimension"], counter))
            chunks = chunks.withColumn("marker_embedding", F.col("_me.value"))
            errors += [F.col("_m.error"), F.col("_me.error")]
        else:
            chunks = chunks.withColumn("markers", F.array().cast("array<string>")).withColumn("marker_embedding", F.lit(None).cast("array<float>"))
        row = F.struct("node_id", "chunk_seq", "text", "blocks", "figures", "embedding", "marker_embedding", "markers")
        rows = chunks.groupBy("document_id").agg(F.collect_list(row).alias("chunks"), F.min(F.coalesce(*errors)).alias("_failed"))  # bounded by the document
        out = parsed.select("document_id", "frontmatter", "nodes").join(rows, "document_id", "left").join(lost, "document_id", "left")
        out = out.select("document_id", "frontmatter", "nodes", F.coalesce("chunks", F.array().cast(rows.schema["chunks"].dataType)).alias("chunks"), F.coalesce("_lost", "_failed").alias("error"))
        wrong = docs.filter("error is not null").select("document_id", "error")
        return out.unionByName(wrong, allowMissingColumns=True)
