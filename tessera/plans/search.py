"""The query driver: settings, capability checks, search, expansion and reranking."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.frontmatter import Filter, result_date, result_title, result_url
from tessera.functions.text import base64_byte_len, format_bytes
from tessera.operators import ann, retrieval
from tessera.plans.catalog import CatalogError, Store
from tessera.sources.providers import EmbedProvider, RerankProvider

MODES = ("vector", "marker", "hybrid")


def candidates(rows: DataFrame, mode: str, vector: list[float], limit: int, filters: list[Filter], indexes: dict[str, ann.Index] | None = None, least: int = 0) -> DataFrame:
    """Result rows of one or both channels; hybrid results are fused and not cut.

    A channel with an index searches ``least`` rows or more of it.  With filters the
    search is exact, as what an index finds may not fit them.
    """

    def held(column: str) -> DataFrame:
        index = (indexes or {}).get(column)
        if index is None or filters:
            return rows
        found = index.search(vector, limit, retrieval.KEY, least=least).select(*retrieval.KEY)  # ``limit`` rows
        return rows.join(F.broadcast(found), retrieval.KEY, "left_semi")

    if mode == "vector":
        return retrieval.vector_search(held("embedding"), vector, limit, filters)
    if mode == "marker":
        return retrieval.marker_search(held("marker_embedding"), vector, limit, filters)
    marker = retrieval.ranked(retrieval.marker_search(held("marker_embedding"), vector, limit, filters))
    near = retrieval.ranked(retrieval.vector_search(held("embedding"), vector, limit, filters))
    return retrieval.fuse(marker, near)


def query(store: Store, embedder: EmbedProvider, kb: str, text: str, mode: str | None = None, top_k: int | None = None, filters: list[Filter] = (), expand: bool | None = None, expand_depth: int | None = None, reranker: RerankProvider | None = None, approximate: bool = False, least: int = 0) -> DataFrame:
    """Result rows for a text.  What is not given is as the knowledge base was created, else 5 results, depth 2.

    ``approximate`` takes the indexes that the knowledge base has.
    """
    meta = store.meta(kb)
    config = json.loads(meta["retrieval_config"] or "{}")
    mode = mode or meta["query_mode"]
    top_k = top_k or config.get("top_k", 5)
    expand = config.get("expand", False) if expand is None else expand
    depth = expand_depth or config.get("expand_depth", 2)
    if mode not in MODES:
        raise CatalogError(f"unknown query mode {mode!r}")
    if mode != "vector" and meta["llm_config"] is None:
        raise CatalogError(f"{kb!r} was created without markers: mode {mode} needs them")
    if expand and json.loads(meta["chunk_config"])["strategy"] == "fixed":
        raise CatalogError(f"{kb!r} has fixed chunks: there are no sections to expand to")
    vector = embedder.embed([text])[0]
    if len(vector) != meta["dimension"]:
        raise CatalogError(f"{kb!r} holds vectors of {meta['dimension']} dimensions and the provider gives {len(vector)}")
    nodes = store.kb("node", kb)
    rows = retrieval.searchable(store.kb("chunk", kb), nodes, store.kb("document", kb))
    limit = top_k * retrieval.OVERFETCH if reranker else top_k
    indexes = {c: x for c in ("embedding", "marker_embedding") if (x := store.index(kb, c)) is not None} if approximate else {}
    found = candidates(rows, mode, vector, limit, list(filters), indexes, least)
    if expand:
        sections = retrieval.expand(found.select("document_id", "node_id"), nodes, depth)
        found = retrieval.merge(found, retrieval.neighbors(rows, sections, list(filters)))
    if reranker:
        return retrieval.rerank(store.spark, reranker, text, found, top_k)
    return found if expand else found.limit(top_k)


def rendered(results: DataFrame, order: list | None = None) -> DataFrame:
    """One column ``result``: the text form of each result row."""
    leaf = F.try_element_at("heading_path", F.lit(-1))
    score, channel = (F.col("relevance"), F.lit("RERANK")) if "relevance" in results.columns else (F.col("distance"), F.col("source"))
    label = lambda name, value: F.concat(F.rpad(F.lit(f"[{name}]"), 8, " "), F.lit(" "), value)

    def figure(f):
        blob = F.when(f["blob"].isNotNull(), F.concat(F.lit("blob "), format_bytes(base64_byte_len(f["blob"]))))
        caption = F.when(F.coalesce(f["caption"], F.lit("")) != "", F.concat(F.lit('"'), f["caption"], F.lit('"')))
        return label("figure", F.concat_ws(" · ", f["src"], caption, blob))

    lines = F.concat_ws(
        "\n",
        F.lit("<result>"),
        label("title", result_title(F.col("filename"), F.col("frontmatter"), leaf)),
        label("url", result_url(F.col("filename"), F.col("frontmatter"), leaf)),
        label("date", result_date(F.col("frontmatter"))),
        label("score", F.concat(F.format_string("%.2f", score), F.lit(" · "), channel)),
        F.when(F.size("heading_path") > 0, label("path", F.concat_ws(" > ", "heading_path"))),
        F.when(F.size("figures") > 0, F.array_join(F.transform("figures", figure), "\n")),
        F.col("text"),
        F.lit("</result>"),
    )
    return results.select(lines.alias("result"))
