"""A folder for intermediate files that all executors share, and numbering by way of it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the cluster's ``spark.checkpoint.dir``; in a local folder only where none is set and all runs here.

    What is written there goes when the application ends.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)  # type: ignore[union-attr]
    if not at:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(at)
    top = f"{str(at).rstrip('/')}/tessera/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)  # type: ignore[union-attr]
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # type: ignore[union-attr]
    if store.mkdirs(path):
        store.deleteOnExit(path)
    return f"{top}/{tag}-{uuid.uuid4().hex}"


def in_order(df: DataFrame, name: str, first: int = 0) -> DataFrame:
    """Rows with ``name``: their place, from ``first``, in the present order (``orderBy``'s, or that of the partitions).

    The rows are written once; a row's place is its row in its file and the rows of
    the files before, so no task numbers more than a file.
    """
    at = scratch_path(df.sparkSession, "ordered")
    df.write.parquet(at)
    part = F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).cast("long").alias("_part")
    rows = df.sparkSession.read.schema(df.schema).parquet(at).select("*", part, F.col("_metadata.row_index").alias("_at"))
    counts = rows.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_shift"))  # a row for each file
    return rows.join(F.broadcast(shift), F.col("_part") == F.col("_p")).select(*df.columns, (F.col("_at") + F.col("_shift") + first).cast("long").alias(name))
