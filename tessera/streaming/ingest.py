"""Streaming arrival of documents: new files are registered and ingested batch by batch.

The file source hands over each new file once; a file that is changed in place is
an update and goes through ``Store.update_document``.  Registering is an upsert by
filename, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.ingest import Pipeline
from tessera.sources.documents import RESERVED

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(pipeline: Pipeline, folder: str) -> DataFrame:
    """A stream of filename, source_dir and content of markdown files that appear in a folder."""
    files = pipeline.store.spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.[mM][dD]").load(folder)
    path, text = F.regexp_replace("path", "^file:/+", "/"), F.col("content").cast("string")
    named = files.select(F.regexp_extract(path, "[^/]*$", 0).alias("filename"), F.regexp_replace(path, "/[^/]*$", "").alias("source_dir"), F.when(F.is_valid_utf8(text), text).alias("content"))
    return named.filter(~F.col("filename").isin(*RESERVED))


def watch(pipeline: Pipeline, kb: str, folder: str, checkpoint: str, once: bool = True, poll: str = "30 seconds") -> StreamingQuery:
    """Ingests what has arrived and ends (``once``), or goes on polling."""

    def take(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            pipeline.store.refresh()
            pipeline.store.register(kb, batch, 0)
            pipeline.drain(kb)

    writer = arrivals(pipeline, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()
