"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard follows from its key and the number of shards alone; no ring table
is kept.  When a shard is appended, a row either stays or goes to the new shard,
and only about one in ``n + 1`` rows goes.

Nulls and edge cases: integers are keys as they are, and other types (texts,
decimals, dates) by their hash; a null key is hashed as a key of its own; a null text
counts as no bytes and has the checksum of an empty text; equal keys share a
shard; an empty table gives an empty result; other columns of the input are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from tessera.llm._base import gapless, quoted, table, written
from tessera.llm._words import mix64

_MULTIPLIER = np.uint64(2862933555777941757)
#: Stands for a null key.
_NULL_KEY = -(2**63)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys."""
    if shards < 1:
        raise ValueError("there must be a shard")
    state = mix64(keys.astype(np.int64).view(np.uint64))
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        shard[open_] = ahead[open_]
        state[open_] = state[open_] * _MULTIPLIER + np.uint64(1)
        step = (shard[open_] + 1) * (float(1 << 31) / ((state[open_] >> np.uint64(33)).astype(np.float64) + 1.0))
        ahead[open_] = np.minimum(step, float(1 << 62)).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return shard


def jump_column(key, shards: int):
    """The shard of a column of 64-bit integers; null is a key of its own."""

    @pandas_udf("int")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in parts:
            yield pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(F.coalesce(key, F.lit(_NULL_KEY)))


def stable_key(docs: DataFrame, key: str):
    """A column's integers as they are, and other types by their 64-bit hash."""
    column = F.col(quoted(key))
    if isinstance(docs.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return column.cast("long")
    return F.when(column.isNotNull(), F.xxhash64(column))


def shard(docs: DataFrame, key: str, shards: int = 8, payload: list | None = None) -> DataFrame:
    """``key``, the payload columns, ``shard``, ``slot`` and ``grown_shard`` of every row.

    ``slot`` numbers a shard's rows from 0 without gaps; ``grown_shard`` is the
    shard after one more is appended.
    """
    of = stable_key(docs, key)
    placed = docs.select(F.col(quoted(key)), *(payload or []), jump_column(of, shards).alias("shard"), jump_column(of, shards + 1).alias("grown_shard"))
    return gapless(written(placed, "shard"), ["shard"], "slot")


def op4_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = shard(docs, "doc_id", 8, [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
