"""Chunking of parsed documents under token budgets.

*Layered* chunking packs the blocks of one section, keeps blocks whole, and
starts a further chunk of the same section with the last blocks of the one
before.  *Fixed* chunking packs sentences of the whole text.  Both work on any
tokenizer; ``chunk_documents`` applies them to a DataFrame in Arrow batches.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.tokens import TOKEN, Tokenizer, tokenizer
from tessera.operators import markdown

#: Characters that end a sentence.
DELIMITERS = "\n.?!。！？"

FIGURE = "struct<src:string,caption:string,description:string,blob:string>"
BLOCK = "struct<block_index:int,block_type:string,text:string>"
NODE = "struct<node_id:string,parent_id:string,heading_path:array<string>,title:string,level:int,sort_order:int>"
CHUNK = f"struct<node_id:string,chunk_seq:int,text:string,embedding_text:string,heading_path:array<string>,blocks:array<{BLOCK}>,figures:array<{FIGURE}>,tokens:int,oversized:boolean>"


@dataclass(frozen=True)
class Layered:
    max_chunk_tokens: int = 256
    overlap_ratio: float = 0.1
    with_path: bool = True

    @property
    def overlap(self) -> int:
        # the product is taken in single precision and cut
        return min(int(np.float32(self.max_chunk_tokens) * np.float32(self.overlap_ratio)), self.max_chunk_tokens)


@dataclass(frozen=True)
class Fixed:
    chunk_size: int = 256
    overlap_tokens: int = 25


@dataclass
class Section:
    node_id: str
    parent_id: str | None
    heading_path: list[str]
    title: str
    level: int
    sort_order: int


@dataclass
class Chunk:
    node_id: str
    chunk_seq: int
    text: str
    embedding_text: str
    heading_path: list[str] = field(default_factory=list)
    blocks: list[dict] = field(default_factory=list)
    figures: list[dict] = field(default_factory=list)
    tokens: int = 0
    oversized: bool = False


def section_id(parent: str, title: str, level: int, ordinal: int) -> str:
    """The same as ``functions.text.node_id``: like titles under different parents differ."""
    return hashlib.sha256("\x1f".join([parent, title, str(level), str(ordinal)]).encode()).hexdigest()[:16]


ROOT_ID = section_id("", "", 0, 0)


def pack_blocks(counted: Callable[[list[int]], int], n: int, limit: int, overlap: int, sizes: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Chunks of ``n`` blocks as (first, first new, end).

    ``counted`` gives the tokens of some neighbouring blocks joined.  A block that
    alone is over the limit is a chunk of its own.  ``sizes``, the blocks' tokens by
    themselves, tell about where a chunk ends, so that only few joined blocks are
    counted for each chunk.
    """
    if not n:
        return []
    before = list(accumulate(sizes, initial=0)) if sizes else None
    if (before is None or before[-1] <= 2 * limit) and counted(list(range(n))) <= limit:
        return [(0, 0, n)]
    out, i, first = [], 0, 0
    while i < n:
        if first < i and counted(list(range(first, i + 1))) > limit:
            first = i
        end = i + 1
        if before:
            end = max(end, min(n, bisect_right(before, before[first] + limit) - 1))
            while end > i + 1 and counted(list(range(first, end))) > limit:
                end -= 1
        while end < n and counted(list(range(first, end + 1))) <= limit:
            end += 1
        out.append((first, i, end))
        i = first = end
        while i < n and first > out[-1][0] and counted(list(range(first - 1, end))) <= overlap:
            first -= 1
    return out


def layered(root: markdown.Node, how: Layered, tokens: Tokenizer) -> tuple[list[Section], list[Chunk]]:
    sections = [Section(ROOT_ID, None, [], "", 0, 0)]
    chunks: list[Chunk] = []
    seen: dict[tuple, int] = defaultdict(int)

    def walk(node: markdown.Node, path: list[str], own: str) -> None:
        held: list[markdown.Node] = []
        block_at = seq = 0

        def flush() -> None:
            nonlocal block_at, seq
            texts = [markdown.block_text(b) for b in held]
            sizes = [tokens.count(t) for t in texts]
            before = list(accumulate(sizes, initial=0))
            joined = (lambda some: before[some[-1] + 1] - before[some[0]]) if tokens.additive else (lambda some: tokens.count("\n\n".join(texts[i] for i in some)))
            for a, _, b in pack_blocks(joined, len(held), how.max_chunk_tokens, how.overlap, sizes):
                text = "\n\n".join(texts[a:b])
                n = tokens.count(text)
                blocks = [{"block_index": block_at + i, "block_type": held[i].kind, "text": texts[i]} for i in range(a, b)]
                figures = [{"src": x.src, "caption": x.caption, "description": x.description, "blob": None} for x in held[a:b] if x.kind == "figure"]
                under = " > ".join(path) + "\n\n" + text if how.with_path and path else text
                chunks.append(Chunk(own, seq, text, under, list(path), blocks, figures, n, n > how.max_chunk_tokens))
                seq += 1
            block_at += len(held)
            held.clear()

        for child in node.children:
            if child.kind != "heading":
                if markdown.block_text(child):
                    held.append(child)
                continue
            flush()
            like = (own, child.text, child.level)
            below = section_id(own, child.text, child.level, seen[like])
            seen[like] += 1
            sections.append(Section(below, own, [*path, child.text], child.text, child.level, len(sections)))
            walk(child, [*path, child.text], below)
        flush()

    walk(root, [], ROOT_ID)
    return sections, chunks


def sentences(text: str, size: int, tokens: Tokenizer) -> list[str]:
    """Stretches of tokens up to one that ends with a delimiter, none of more than ``size`` tokens.

    Text between tokens goes with the token before (or the first one), so that
    the stretches together are the text.
    """
    spans = tokens.offsets(text)
    if not spans:
        return [text] if text else []
    # a token of several visible characters may end with a delimiter; a line feed after one ends it, too
    edge = [a for a, _ in spans[1:]] + [len(text)]
    starts = [0, *edge[:-1]]
    out, first = [], 0
    for i, (_, end) in enumerate(spans):
        last = i == len(spans) - 1
        if last or text[end - 1] in DELIMITERS or "\n" in text[end : edge[i]]:
            out += [text[starts[k] : edge[min(k + size - 1, i)]] for k in range(first, i + 1, size)]
            first = i + 1
    return out


def pack_sentences(counts: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of sentences as (first, end)."""
    out, start = [], 0
    while start < len(counts):
        end, held = start, 0
        while end < len(counts) and (not held or held + counts[end] <= size):
            held += counts[end]
            end += 1
        out.append((start, end))
        if end == len(counts):
            break
        back = end
        if overlap > 0:
            held = 0
            while back > start and (not held or held + counts[back - 1] <= overlap):
                back -= 1
                held += counts[back]
        start = max(back, start + 1)
    return out


def fixed(text: str, how: Fixed, tokens: Tokenizer) -> tuple[list[Section], list[Chunk]]:
    if how.chunk_size < 1:
        raise ValueError("chunks must have room for a token")
    sections = [Section(ROOT_ID, None, [], "", 0, 0)]
    if not text:
        return sections, []
    n = tokens.count(text)
    if n <= how.chunk_size:
        return sections, [Chunk(ROOT_ID, 0, text, text, tokens=n)]
    parts = sentences(text, how.chunk_size, tokens)
    counts = [tokens.count(p) for p in parts]
    texts = ["".join(parts[a:b]) for a, b in pack_sentences(counts, how.chunk_size, how.overlap_tokens)]
    return sections, [Chunk(ROOT_ID, k, t, t, tokens=tokens.count(t), oversized=tokens.count(t) > how.chunk_size) for k, t in enumerate(texts)]


def chunk(root: markdown.Node, how: Layered | Fixed, tokens: Tokenizer) -> tuple[list[Section], list[Chunk]]:
    return layered(root, how, tokens) if isinstance(how, Layered) else fixed(markdown.full_text(root), how, tokens)


def chunk_documents(docs: DataFrame, how: Layered | Fixed, body: str = "body", prune_references: bool = True, tokenizer_path: str | None = None) -> DataFrame:
    """All columns with ``nodes``, ``chunks`` and ``pruned`` (titles); one row for each document.

    A null body has the root and no chunk.  The parser and the packing are the
    only Python here; rows are handled an Arrow batch at a time.
    """
    schema = docs.select("*", F.lit(None).cast(f"array<{NODE}>").alias("nodes"), F.lit(None).cast(f"array<{CHUNK}>").alias("chunks"), F.lit(None).cast("array<string>").alias("pruned")).schema
    names, at = schema.names, docs.columns.index(body)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(tokenizer_path)
        for batch in batches:
            nodes, chunks, pruned = [], [], []
            for text in batch.column(at):
                root = markdown.parse(text.as_py() or "")
                pruned.append(markdown.prune(root, markdown.is_reference_title) if prune_references else [])
                some, found = chunk(root, how, tokens)
                nodes.append([asdict(x) for x in some])
                chunks.append([asdict(x) for x in found])
            made = [pa.array(v, arrow.field(n).type) for n, v in zip(names[-3:], (nodes, chunks, pruned), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return docs.mapInArrow(run, schema)


def node_rows(chunked: DataFrame, key: str = "document_id") -> DataFrame:
    return chunked.select(key, F.inline("nodes"))


def chunk_rows(chunked: DataFrame, key: str = "document_id") -> DataFrame:
    return chunked.select(key, F.inline("chunks"))


# --- the same packing without overlap, in the JVM ---


def sentence_column(text: Column) -> Column:
    """Sentences by character: up to and with each delimiter."""
    return F.regexp_extract_all(text, F.lit(r"[^\n.?!。！？]*[\n.?!。！？]|[^\n.?!。！？]+$"), F.lit(0))


def packed(counts: Column, size: int) -> Column:
    """Chunks of sentences (token counts), packed greedily without overlap: the number of sentences and of tokens of each."""
    state = F.struct(F.array().cast("array<struct<sentences:int,tokens:int>>").alias("done"), F.lit(0).alias("n"), F.lit(0).alias("held"))
    with_last = lambda s: F.concat(s["done"], F.array(F.struct(s["n"].alias("sentences"), s["held"].alias("tokens"))))

    def step(s: Column, n: Column) -> Column:
        full = (s["held"] > 0) & (s["held"] + n > size)
        return F.struct(F.when(full, with_last(s)).otherwise(s["done"]).alias("done"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, n).otherwise(s["held"] + n).alias("held"))

    return F.aggregate(counts, state, step, lambda s: F.when(s["n"] > 0, with_last(s)).otherwise(s["done"]))


def sentence_counts(sentences_: Column) -> Column:
    return F.transform(sentences_, lambda s: F.size(F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))))


def packed_with_overlap(docs: DataFrame, key: str, counts: str, size: int, overlap: int) -> DataFrame:
    """``key``, chunk_seq, first and last sentence of every chunk."""
    schema = docs.select(key).schema.add("chunk_seq", "integer").add("first_sentence", "integer").add("last_sentence", "integer")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, a, b - 1) for i, c in enumerate(batch.column(1)) for k, (a, b) in enumerate(pack_sentences(c.as_py() or [], size, overlap))]
            i, k, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int64())), pa.array(k, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=names)

    return docs.select(key, counts).mapInArrow(run, schema)
