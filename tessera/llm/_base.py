"""Shared helpers: scratch tables, size-checked joins and skew-free numbering."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Most bytes of rows, as a hash table holds them, that are broadcast; larger tables are joined by a shuffle.
BROADCAST_BYTES = 96 << 20
#: What a row of a hash table takes besides its values.
_ROW_BYTES = 24


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of this machine only where none is set and all runs here."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)  # type: ignore[union-attr]
    if not at:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(at)
    return str(at)


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at  # type: ignore[union-attr]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends."""
    top = f"{scratch(spark).rstrip('/')}/tessera/{spark.sparkContext.applicationId}"
    fs, at = _file_system(spark, top)
    if fs.mkdirs(at):
        fs.deleteOnExit(at)
    return f"{top}/{tag}-{uuid.uuid4().hex}"


#: Paths written in the functions that are running, innermost last.
_scopes: list[list[tuple[SparkSession, str]]] = []


def scoped(f: Callable) -> Callable:
    """On return, removes the scratch tables of ``f`` that no returned DataFrame reads."""

    @functools.wraps(f)
    def run(*args: Any, **kwargs: Any) -> Any:
        _scopes.append([])
        try:
            out = f(*args, **kwargs)
        except BaseException:
            _scopes.pop()
            raise
        mine = _scopes.pop()
        frames = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
        read = {name for x in frames for name in x.inputFiles()}
        for spark, path in mine:
            name = path.rsplit("/", 1)[1]
            if not any(name in r for r in read):
                fs, at = _file_system(spark, path)
                fs.delete(at, True)
            elif _scopes:
                _scopes[-1].append((spark, path))
        return out

    return run


#: Rows and bytes that a Python worker gets at once (one row may be larger); workers share an executor's memory.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds for the session: a plan takes the number of rows when it runs, which its reader decides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: it survives lost executors and cuts lineage."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, tag)
    if _scopes:
        _scopes[-1].append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the (already written) table's rows take at most ``limit`` bytes, else the table for a shuffled join.

    Numbers count eight bytes, texts and arrays their sizes.
    """
    wide = [F.coalesce(F.sum(F.octet_length(F.col(f"`{f.name}`")) if isinstance(f.dataType, (StringType, BinaryType)) else 16 * F.size(F.col(f"`{f.name}`"))), F.lit(0)) for f in small.schema if isinstance(f.dataType, (StringType, BinaryType, ArrayType))]
    rows, *bytes_ = small.agg(F.count(F.lit(1)), *wide).first()
    return F.broadcast(small) if rows * (_ROW_BYTES + 8 * len(small.columns)) + sum(bytes_) <= limit else small


def released(spark: SparkSession) -> None:
    """Frees the shuffle files of steps whose results have been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # type: ignore[union-attr]


def row_of(df: DataFrame):
    """The row in one column, so that no name of it meets one of ours."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])


def row_columns(df: DataFrame, row: str, **instead):
    """The columns of ``df`` out of ``row_of``'s column, with other values for some."""
    return [(instead[c] if c in instead else F.col(row)[c]).alias(c) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_position(df: DataFrame) -> DataFrame:
    """A written table with the file and the row in it, which are the same in every read."""
    return df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def gapless(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` (a written table) with ``name``: 0, 1, ... within each key, by file and row.

    Each file's rows of a key are numbered by themselves and shifted by the counts
    of the files before it, so a key with most of the rows is still numbered by
    many tasks.
    """
    rows = with_position(df)
    # one row for each key and file
    counts = rows.groupBy(*keys, "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_file").alias("_f"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_file").orderBy("_row")) - 1)
    match = F.col("_file") == F.col("_f")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(shift, match)
    return out.select(*df.columns, (F.col("_at") + F.col("_shift")).cast("long").alias(name))
