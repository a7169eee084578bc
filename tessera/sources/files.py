"""JSON, JSON lines and markdown files, on any file system that Spark knows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scratch import in_order
from tessera.functions.text import slug, yaml_quoted

CORPUS = "title string, author string, source string, category string, url string, body string"
RAW_QUERIES = "query string, question_type string, evidence_list array<struct<fact:string>>"
QUERIES = "id long, query string, question_type string, facts array<string>"
RUNS = "query_id long, arm string, chunks array<struct<document_id:long,node_id:string,chunk_seq:int,text:string,tokens:int>>"


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)  # type: ignore[union-attr]
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path  # type: ignore[union-attr]


def exists(spark: SparkSession, at: str) -> bool:
    store, path = _path(spark, at)
    return bool(store.exists(path))


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob pattern fits, in order."""
    store, path = _path(spark, pattern)
    return sorted(str(x.getPath()) for x in store.globStatus(path) or ())


def delete(spark: SparkSession, at: str) -> bool:
    store, path = _path(spark, at)
    return bool(store.delete(path, True))


def read_text(spark: SparkSession, at: str) -> str:
    """A small file, on the driver."""
    return spark.read.text(at, wholetext=True).first()[0]


def write_text(spark: SparkSession, at: str, text: str) -> None:
    """A small file, from the driver: written aside and renamed, so that readers of a new name see all of it or none.

    A file of that name is replaced, which stores without an atomic replacement do
    in two steps; what must not be missing meanwhile takes a new name each time.
    """
    store, path = _path(spark, f"{at}.{uuid.uuid4().hex}.tmp")
    stream = store.create(path, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    _, final = _path(spark, at)
    if store.exists(final):
        store.delete(final, False)
    if not store.rename(path, final):
        raise OSError(f"cannot rename to {at}")


def read_json(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """A JSON array of records."""
    return spark.read.schema(schema).json(at, multiLine=True)


def read_jsonl(spark: SparkSession, at: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(at)


def write_jsonl(df: DataFrame, at: str) -> None:
    df.write.mode("overwrite").json(at)


def write_json(spark: SparkSession, at: str, value: object) -> None:
    write_text(spark, at, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def is_complete(spark: SparkSession, at: str, n: int) -> bool:
    """Whether a file of JSON lines is there with a line for each of ``n`` queries."""
    return exists(spark, at) and spark.read.text(at).count() == n


def numbered(df: DataFrame, name: str = "i") -> DataFrame:
    """Rows numbered from 0 in their present order."""
    return in_order(df, name)


def corpus_markdown(corpus: DataFrame, index: str = "i", process: str = "process:corpus-import") -> DataFrame:
    """``filename`` and ``content``: markdown with frontmatter for each article of a numbered corpus."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), yaml_quoted(F.coalesce(v, F.lit(""))), F.lit("\n"))
    name = F.concat(F.when(F.col(index) < 1000, F.lpad(F.col(index).cast("string"), 3, "0")).otherwise(F.col(index).cast("string")), F.lit("-"), slug(F.col("title")), F.lit(".md"))
    content = F.concat(
        F.lit("---\ntype: article\n"),
        line("title", F.col("title")),
        F.when(F.col("author").isNotNull(), line("author", F.col("author"))).otherwise(""),
        line("resource", F.col("url")),
        F.lit(f"generated: {{ by: {process} }}\n"),
        line("source", F.col("source")),
        line("category", F.col("category")),
        F.lit("---\n\n# "),
        F.translate("title", "\n", " "),
        F.lit("\n\n"),
        F.coalesce("body", F.lit("")),
        F.lit("\n"),
    )
    return corpus.select(name.alias("filename"), content.alias("content"))


def write_documents(docs: DataFrame, folder: str) -> int:
    """Writes ``content`` under ``filename`` for each row, from the executors; returns how many."""
    from tessera.sources.store import open_out

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_out(f"{folder}/{name}") as f:
                    f.write(content.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    out = docs.select("filename", "content").mapInArrow(write, "n long")
    return out.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
