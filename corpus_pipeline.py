"""A corpus pipeline of five operators, each working on all that its predecessor kept.

1. ``quality``: documents that the quality rules reject go.
2. ``near_duplicates``: of each group linked by the n-gram Jaccard join (five
   words, 0.8) the document with the smallest id stays.
3. ``substrings``: windows of twenty words that also start earlier are cut out.
4. ``mixing``: documents are repeated, kept or dropped by their rates, which
   raise plain text by a quarter, keep poor text and leave no toxic text.
5. ``packing``: what is left is packed into sequences of 1024 tokens; each piece
   has its ids.

All stages but the last return the columns of ``documents``.  SQL cannot express
the quality and mixing estimates, so there is no SQL for the whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, phrases, quality
from tessera.llm._base import row_columns, table, written

#: Factors on the domains' tokens: a quarter more plain text, which makes up for the toxic documents' share of the
#: tokens (11 to 14 % on the test tables, against 78 to 80 % of plain text); poor text as it is; no toxic document.
TARGETS = (1.25, 1.0, None)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, as of the present text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_sound(docs)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(phrases.remove(docs, phrases.repeated(docs), counts=None))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rated, _ = mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS, reached=0.0)
    times = rated.withColumn("_times", mixing.copies(F.col("_rate"), F.col("_key"))).filter("_times > 0")
    return times.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select(*row_columns(docs, "_row"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(written(packing.pieces(docs, place=True), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_sound),
    ("near_duplicates", keep_first),
    ("substrings", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's output is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
