"""Markdown documents with YAML frontmatter: scans, parsing, and the files they refer to."""

from __future__ import annotations

import base64
import datetime
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tessera.sources.store import read_bytes

#: Names that the document format keeps for itself (fixed values).
RESERVED = ("index.md", "log.md")


class _Loader(yaml.SafeLoader):
    """YAML with the core schema: dates, yes and no stay text."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+.0123456789"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
):
    import re as _re

    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", _re.compile(_pattern), list(_first))


def _whole(loader: _Loader, node: yaml.ScalarNode) -> int:
    text = loader.construct_scalar(node)
    sign, digits = (-1, text[1:]) if text[0] == "-" else (1, text.lstrip("+"))
    return sign * (int(digits[2:], 8) if digits.startswith("0o") else int(digits[2:], 16) if digits.startswith("0x") else int(digits))


_Loader.add_constructor("tag:yaml.org,2002:int", _whole)


def split_frontmatter(raw: str) -> tuple[str, str] | None:
    """YAML text and body; None unless the document starts with a closed block."""
    for opening in ("---\n", "---\r\n"):
        if raw.startswith(opening):
            at = len(opening)
            while at < len(raw):
                end = raw.find("\n", at)
                end = len(raw) if end < 0 else end + 1
                if raw[at:end].rstrip("\r\n") == "---":
                    return raw[len(opening) : at], raw[end:]
                at = end
    return None


def _json(value: object) -> object:
    if isinstance(value, dict):
        return {str(k): _json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_json(v) for v in value]
    if isinstance(value, (datetime.date, bytes)):
        return str(value)
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return str(value)
    return value


def parse_document(raw: str, filename: str) -> tuple[str | None, str | None, str | None]:
    """Frontmatter as JSON, body, and an error; of a bad document only the error."""
    parts = split_frontmatter(raw)
    if parts is None:
        return None, None, f"{filename}: the document has no frontmatter"
    try:
        found = yaml.load(parts[0], Loader=_Loader)  # noqa: S506
    except yaml.YAMLError as e:
        return None, None, f"{filename}: invalid frontmatter yaml: {str(e).splitlines()[0]}"
    if found is None:
        found = {}
    if not isinstance(found, dict):
        return None, None, f"{filename}: invalid frontmatter yaml: not a mapping"
    kind = found.get("type")
    if not isinstance(kind, str) or not kind.strip():
        return None, None, f"{filename}: the frontmatter is missing the required 'type' field"
    return json.dumps(_json(found), ensure_ascii=False), parts[1], None


PARSED = "frontmatter string, body string, error string"


def parse_column(content: Column, filename: Column) -> Column:
    """A struct of frontmatter (JSON), body and error."""

    @pandas_udf(PARSED)  # type: ignore[call-overload]
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raws, names in parts:
            rows = [parse_document(r, n) if r is not None else (None, None, f"{n}: not valid UTF-8") for r, n in zip(raws, names, strict=True)]
            yield pd.DataFrame(rows, columns=["frontmatter", "body", "error"], dtype=object)

    return run(content, filename)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files right in a folder (any case of the ending, no reserved names): filename, source_dir, content.

    ``content`` is null where a file is not UTF-8.
    """
    files = spark.read.format("binaryFile").load(folder.rstrip("/") + "/*.[mM][dD]")
    return _named(files).filter(~F.col("filename").isin(*RESERVED))


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """One markdown file; a reserved name is an error, another ending gives no row."""
    name = path.rsplit("/", 1)[-1]
    if name in RESERVED:
        raise ValueError(f"{name} is a reserved filename")
    return _named(spark.read.format("binaryFile").load(path)).filter(F.lower("filename").endswith(".md"))


def _named(files: DataFrame) -> DataFrame:
    path = F.regexp_replace("path", "^file:/+", "/")
    text = F.col("content").cast("string")
    return files.select(F.regexp_extract(path, "[^/]*$", 0).alias("filename"), F.regexp_replace(path, "/[^/]*$", "").alias("source_dir"), F.when(F.is_valid_utf8(text), text).alias("content"))


def parsed(raw: DataFrame) -> DataFrame:
    """All columns with frontmatter, body and error; bad documents keep their row."""
    return raw.withColumn("_parsed", parse_column(F.col("content"), F.col("filename"))).select(*raw.columns, "_parsed.*")


def good(docs: DataFrame) -> DataFrame:
    return docs.filter("error is null").drop("error")


def bad(docs: DataFrame) -> DataFrame:
    return docs.filter("error is not null").select("filename", "error")


def with_figures(chunks: DataFrame, spark: SparkSession, key: str = "document_id") -> DataFrame:
    """Chunks (with ``source_dir``) whose figures hold their file's bytes in base 64; ``missing`` names absent files.

    Figures with an http(s) source are kept without bytes.  Executors read the
    files, each path once.
    """
    each = chunks.select(key, "node_id", "chunk_seq", "source_dir", F.posexplode("figures").alias("_at", "_figure"))
    local = ~F.col("_figure.src").rlike("^https?://")
    target = F.when(local, F.when(F.col("_figure.src").startswith("/"), F.col("_figure.src")).otherwise(F.concat_ws("/", "source_dir", "_figure.src")))
    each = each.withColumn("_path", target)
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                raw = read_bytes(path)
                yield pa.RecordBatch.from_pydict({"_file": pa.array([path], pa.string()), "_blob": pa.array([None if raw is None else base64.b64encode(raw).decode()], pa.string())})

    files = each.select("_path").filter("_path is not null").distinct().mapInArrow(fetch, "_file string, _blob string")
    found = each.join(files, F.col("_file") == F.col("_path"), "left")
    figure = F.struct(F.col("_figure.src").alias("src"), F.col("_figure.caption").alias("caption"), F.col("_figure.description").alias("description"), F.col("_blob").alias("blob"))
    rows = found.groupBy(key, "node_id", "chunk_seq").agg(F.array_sort(F.collect_list(F.struct("_at", figure.alias("f")))).alias("_list"), F.collect_set(F.when(F.col("_path").isNotNull() & F.col("_blob").isNull(), F.col("_path"))).alias("_missing"))
    out = chunks.join(rows, [key, "node_id", "chunk_seq"], "left")
    return out.select(*[c for c in chunks.columns if c != "figures"], F.coalesce(F.transform("_list", lambda x: x["f"]), F.col("figures")).alias("figures"), F.coalesce("_missing", F.array().cast("array<string>")).alias("missing"))
