"""Embedding, chat and rerank services behind small interfaces.

Every interface has a deterministic implementation that needs no network and one
that speaks the usual HTTP form.  Columns are filled in Arrow batches, one client
for each partition.
"""

from __future__ import annotations

import json
import math
import re
import threading
import time
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.accumulators import Accumulator, AccumulatorParam
from pyspark.sql import Column, SparkSession
from pyspark.sql.pandas.functions import pandas_udf


class EmbedProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ChatProvider(Protocol):
    def chat_json(self, system: str, user: str) -> str: ...


class RerankProvider(Protocol):
    def rerank(self, query: str, documents: list[str], top_n: int) -> list[tuple[int, float]]: ...


class ProviderError(RuntimeError):
    pass


def with_retry(call: Callable, retries: int, delay_ms: int, sleep: Callable[[float], None] = time.sleep):
    """The call's result; after a failure again, up to ``retries`` times, waiting twice as long each time."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception:
            if attempt == retries:
                raise
            sleep(delay_ms * 2**attempt / 1000)
    raise AssertionError


#: Requests of one task run in several threads.
_COUNTING = threading.Lock()


@dataclass
class Usage:
    """Tokens that a service reports; missing fields count as 0."""

    prompt: int = 0
    completion: int = 0
    reasoning: int = 0
    total: int = 0
    calls: int = 0

    def add(self, usage: dict | None) -> None:
        usage = usage or {}
        self.take((usage.get("prompt_tokens") or 0, usage.get("completion_tokens") or 0, (usage.get("completion_tokens_details") or {}).get("reasoning_tokens") or 0, usage.get("total_tokens") or 0, 1))

    def counts(self) -> tuple[int, ...]:
        return self.prompt, self.completion, self.reasoning, self.total, self.calls

    def take(self, more: tuple[int, ...]) -> None:
        with _COUNTING:
            self.prompt, self.completion, self.reasoning, self.total, self.calls = (a + b for a, b in zip(self.counts(), more, strict=True))

    def __str__(self) -> str:
        return f"{self.calls} calls, {self.total} tokens (prompt {self.prompt}, completion {self.completion}, reasoning {self.reasoning})"


class _Sums(AccumulatorParam):
    def zero(self, value: tuple) -> tuple:
        return (0,) * len(value)

    def addInPlace(self, value1: tuple, value2: tuple) -> tuple:  # noqa: N802, N803
        return tuple(a + b for a, b in zip(value1, value2, strict=True))


def usage_counter(spark: SparkSession) -> Accumulator:
    """Adds up on the driver what executors' clients used."""
    return spark.sparkContext.accumulator(Usage().counts(), _Sums())


def _told(provider: object, counter: Accumulator | None, before: tuple[int, ...]) -> tuple[int, ...]:
    """Adds what the provider used since ``before``; its counts now."""
    now = getattr(provider, "usage", Usage()).counts()
    if counter is not None and now != before:
        counter.add(tuple(a - b for a, b in zip(now, before, strict=True)))
    return now


# --- without a network ---


@dataclass
class HashEmbedder:
    """Words hashed into signed dimensions, at length one; an empty text is the first axis."""

    dimension: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for word, n in Counter(re.findall(r"\w+", text.lower())).items():
                h = xxhash.xxh64_intdigest(word)
                v[h % self.dimension] += n if h >> 63 else -n
            length = np.linalg.norm(v)
            if not length:
                v[0] = length = 1.0
            out.append((v / length).astype(np.float32).tolist())
        return out


@dataclass
class KeywordChat:
    """Answers a marker prompt with the text's most frequent long words."""

    n: int = 5

    def chat_json(self, system: str, user: str) -> str:
        words = Counter(w for w in re.findall(r"\w+", user.lower()) if len(w) > 3)
        return json.dumps({"markers": [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[: self.n]] or ["text"]})


@dataclass
class OverlapReranker:
    """The share of the query's words that a document has."""

    def rerank(self, query: str, documents: list[str], top_n: int) -> list[tuple[int, float]]:
        wanted = set(re.findall(r"\w+", query.lower()))
        score = [len(wanted & set(re.findall(r"\w+", d.lower()))) / max(1, len(wanted)) for d in documents]
        return sorted(enumerate(score), key=lambda x: (-x[1], x[0]))[:top_n]


# --- over HTTP ---


@dataclass
class _Http:
    base_url: str
    model: str
    api_key: str = ""
    timeout_s: int = 60
    max_retries: int = 3
    retry_delay_ms: int = 1000
    usage: Usage = field(default_factory=Usage)

    def post(self, path: str, body: dict) -> dict:
        def call() -> dict:
            head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
            request = urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(body).encode(), head)
            with urllib.request.urlopen(request, timeout=self.timeout_s) as r:
                return json.load(r)

        found = with_retry(call, self.max_retries, self.retry_delay_ms)
        self.usage.add(found.get("usage"))
        return found


@dataclass
class HttpEmbedder(_Http):
    def embed(self, texts: list[str]) -> list[list[float]]:
        data = self.post("/embeddings", {"model": self.model, "input": texts}).get("data", [])
        out = [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]
        if len(out) != len(texts):
            raise ProviderError(f"{len(texts)} texts were sent and {len(out)} vectors came back")
        return out


@dataclass
class HttpChat(_Http):
    temperature: float = 0.2
    max_tokens: int = 512

    def chat_json(self, system: str, user: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        found = self.post("/chat/completions", {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens, "response_format": {"type": "json_object"}})
        return found["choices"][0]["message"]["content"]


@dataclass
class HttpReranker(_Http):
    def rerank(self, query: str, documents: list[str], top_n: int) -> list[tuple[int, float]]:
        found = self.post("/rerank", {"model": self.model, "query": query, "documents": documents, "top_n": top_n})
        return [(x["index"], x["relevance_score"]) for x in found["results"]]


# --- columns ---


def dimension(provider: EmbedProvider) -> int:
    """The length of the provider's vectors, by trying it."""
    return len(provider.embed(["dimension probe"])[0])


def embed_column(provider: EmbedProvider, text: Column, batch: int = 32, size: int | None = None) -> Column:
    """Vectors of a text column; a null text has none.  Replies of another number or length are errors."""

    @pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list = [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(at), batch):
                some = at[k : k + batch]
                got = provider.embed([texts.iloc[i] for i in some])
                if len(got) != len(some) or (size is not None and any(len(v) != size for v in got)):
                    raise ProviderError("the embedding service returned vectors of another number or length")
                for i, v in zip(some, got, strict=True):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return run(text)


def embed_outcomes(provider: EmbedProvider, text: Column, batch: int = 32, size: int | None = None, counter: Accumulator | None = None) -> Column:
    """``value`` (the vector) and ``error`` of each text: of a request that fails, its texts are tried one by one."""

    def asked(texts: list[str]) -> list[list[float]]:
        got = provider.embed(texts)
        if len(got) != len(texts) or (size is not None and any(len(v) != size for v in got)):
            raise ProviderError("the embedding service returned vectors of another number or length")
        return got

    @pandas_udf("value array<float>, error string")  # type: ignore[call-overload]
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        before = _told(provider, None, ())
        for texts in parts:
            out: list[tuple] = [(None, None)] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(at), batch):
                some = at[k : k + batch]
                try:
                    for i, v in zip(some, asked([texts.iloc[i] for i in some]), strict=True):
                        out[i] = (v, None)
                except Exception:  # noqa: BLE001
                    for i in some:
                        try:
                            out[i] = (asked([texts.iloc[i]])[0], None)
                        except Exception as e:  # noqa: BLE001
                            out[i] = (None, f"embedding: {e}")
            before = _told(provider, counter, before)
            yield pd.DataFrame(out, columns=["value", "error"], dtype=object)

    return run(text)


MARKER_PROMPT = 'Name the ideas that a reader would look this passage up by. Answer with JSON: {"markers": ["...", ...]}, three to eight short phrases.'
#: Requests that a task has under way at once.
CONCURRENCY = 5


def parse_markers(answer: str, key: str = "markers") -> list[str]:
    """The strings under ``key``, trimmed, without blank ones; anything else is an error."""
    try:
        found = json.loads(answer)
    except ValueError as e:
        raise ProviderError(f"the answer is not JSON: {e}") from e
    some = found.get(key) if isinstance(found, dict) else None
    if not isinstance(some, list):
        raise ProviderError(f"the answer has no list {key!r}")
    if any(not isinstance(x, str) for x in some):
        raise ProviderError(f"{key!r} holds something that is not a string")
    kept = [x.strip() for x in some if x.strip()]
    if not kept:
        raise ProviderError(f"{key!r} is empty")
    return kept


def marker_outcomes(provider: ChatProvider, text: Column, concurrency: int = CONCURRENCY, counter: Accumulator | None = None) -> Column:
    """``value`` (the markers) and ``error`` of each text, with a bounded number of requests under way."""

    def one(text: str | None) -> tuple:
        try:
            return (None if text is None else parse_markers(provider.chat_json(MARKER_PROMPT, text)), None)
        except Exception as e:  # noqa: BLE001
            return (None, f"markers: {e}")

    @pandas_udf("value array<string>, error string")  # type: ignore[call-overload]
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        before = _told(provider, None, ())
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for texts in parts:
                got = list(pool.map(one, texts))
                before = _told(provider, counter, before)
                yield pd.DataFrame(got, columns=["value", "error"], dtype=object)

    return run(text)


def reranked(provider: RerankProvider, query: str, documents: list[str], top_n: int) -> list[tuple[int, float]]:
    """Index and relevance, best first (equal ones in order); an index out of range or given twice is an error."""
    if not documents:
        return []
    got = provider.rerank(query, documents, top_n)
    if any(not 0 <= i < len(documents) for i, _ in got) or len({i for i, _ in got}) != len(got):
        raise ProviderError("the rerank service returned an index that is out of range or repeated")
    return sorted(got, key=lambda x: -x[1] if not math.isnan(x[1]) else 0.0)[:top_n]
