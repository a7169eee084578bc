"""Command line: ``kb create|list|info|delete|index``, ``doc add|update|remove|list``, ``query`` and ``flush-db``.

Without configured services the deterministic local ones are used.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.functions.frontmatter import Filter
from tessera.plans import config as configs
from tessera.plans import search
from tessera.plans.catalog import CatalogError, Store, failed_tasks, list_documents, list_kbs, task_counts
from tessera.plans.ingest import Pipeline
from tessera.sources import providers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--config")
    top.add_argument("--store")
    commands = top.add_subparsers(dest="command", required=True)
    kb = commands.add_parser("kb").add_subparsers(dest="action", required=True)
    for name in ("create", "delete", "info", "index"):
        kb.add_parser(name).add_argument("name")
    kb.choices["create"].add_argument("--mode", choices=search.MODES)
    kb.add_parser("list")
    doc = commands.add_parser("doc").add_subparsers(dest="action", required=True)
    for name, more in (("add", ["path"]), ("update", ["id", "path"]), ("remove", ["id"]), ("list", [])):
        one = doc.add_parser(name)
        one.add_argument("-n", "--name", required=True)
        for x in more:
            one.add_argument(x, type=int if x == "id" else str)
    ask = commands.add_parser("query")
    ask.add_argument("name")
    ask.add_argument("text")
    ask.add_argument("--mode", choices=search.MODES)
    ask.add_argument("--top-k", type=int)
    ask.add_argument("--reranker", nargs="?", const="")
    ask.add_argument("--expand", action="store_true", default=None)
    ask.add_argument("--expand-depth", type=int)
    ask.add_argument("--approximate", action="store_true")
    ask.add_argument("-l", "--filter", action="append", type=Filter.parse, default=[])
    commands.add_parser("flush-db")
    return top


def _embedder(config: configs.AppConfig) -> providers.EmbedProvider:
    if not config.embedders:
        return providers.HashEmbedder()
    m = config.named("embedders", config.embed or None)
    return providers.HttpEmbedder(m.base_url, m.model, m.api_key, m.timeout_secs, m.max_retries, m.retry_delay_ms)


def _chat(config: configs.AppConfig) -> providers.ChatProvider | None:
    if not config.llms:
        return None
    m = config.named("llms")
    return providers.HttpChat(m.base_url, m.model, m.api_key, m.timeout_secs, m.max_retries, m.retry_delay_ms, temperature=m.temperature, max_tokens=m.max_tokens)


def _reranker(config: configs.AppConfig, name: str | None) -> providers.RerankProvider | None:
    if name is None:
        return None
    if not config.rerankers:
        return providers.OverlapReranker()
    m = config.named("rerankers", name or None)
    return providers.HttpReranker(m.base_url, m.model, m.api_key, m.timeout_secs, m.max_retries, m.retry_delay_ms)


def run(spark: SparkSession, argv: list[str], out=print) -> int:
    args = parser().parse_args(argv)
    config = configs.load(args.config) if args.config else configs.AppConfig()
    store = Store(spark, args.store or config.store)
    chat = _chat(config)
    pipeline = Pipeline(store, _embedder(config), chat)
    if args.command == "flush-db":
        store.flush()
    elif args.command == "kb" and args.action == "create":
        retrieval = {"top_k": config.retrieval.top_k, "expand": config.retrieval.expand, "expand_depth": config.retrieval.expand_depth}
        pipeline.create_kb(args.name, config.chunk, args.mode or config.query_mode, retrieval)
    elif args.command == "kb" and args.action == "index":
        store.create_index(args.name)
    elif args.command == "kb" and args.action == "delete":
        store.delete_kb(args.name)
    elif args.command == "kb" and args.action == "list":
        for r in list_kbs(store.table("kb_meta"), store.table("document"), store.table("chunk")).collect():
            out(f"{r['name']}  {r['query_mode']}  {r['n_documents']} documents  {r['n_chunks']} chunks")
    elif args.command == "kb":
        meta = store.meta(args.name)
        counts = task_counts(store.table("task"), store.table("document"), args.name).first()
        for k in ("name", "query_mode", "dimension", "chunk_config", "retrieval_config"):
            out(f"{k}: {meta[k]}")
        out(f"tasks: {counts['pending']} pending, {counts['running']} running, {counts['failed']} failed")
    elif args.command == "doc" and args.action == "add":
        path = Path(args.path)
        if not path.exists():
            raise CatalogError(f"there is no {args.path}")
        began = store.now()
        if path.is_dir():
            pipeline.add_folder(args.name, str(path))
        else:
            pipeline.add_file(args.name, str(path))
        pipeline.drain(args.name)
        failed = failed_tasks(store.table("task"), store.table("document"), args.name, began).collect()
        for r in failed:
            out(f"failed: {r['filename']}: {r['error_message']}")
        if pipeline.usage.calls:
            out(f"used: {pipeline.usage}")
        return int(bool(failed))
    elif args.command == "doc" and args.action == "update":
        path = Path(args.path)
        store.update_document(args.name, args.id, path.name, path.read_text(encoding="utf-8"))
        pipeline.drain(args.name)
    elif args.command == "doc" and args.action == "remove":
        out(f"removed {store.remove_document(args.name, args.id)}")
    elif args.command == "doc":
        store.meta(args.name)
        for r in list_documents(store.table("document"), store.table("chunk"), store.table("task"), args.name).collect():
            out(f"{r['document_id']}  {r['filename']}  {r['n_chunks']} chunks  {r['status']}  {r['updated_at']}")
    else:
        found = search.query(store, pipeline.embedder, args.name, args.text, args.mode, args.top_k, args.filter, args.expand, args.expand_depth, _reranker(config, args.reranker), args.approximate, config.index.ef_search)
        for r in search.rendered(found).collect():
            out(r["result"])
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(spark, sys.argv[1:])
    except (CatalogError, configs.ConfigError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        print("interrupted; what was under way is canceled", file=sys.stderr)
        return 130


if __name__ == "__main__":
    sys.exit(main())
