"""Knowledge bases as versioned Parquet snapshots.

A store has a folder for each table, knowledge base and version, and small numbered
pointer files, of which the last names the present versions.  A change writes new
versions of what it touches (one knowledge base's part of some tables) and then the
next pointer, under a new name: readers see all of a change or none of it, and a crash
leaves the pointer before.  Versions that none of the last ``KEPT`` pointers names are
removed, so readers may go on with what they have begun to read.

Writers are expected to take turns (one driver at a time), as for any folder of
Parquet files without a transaction log.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import ann
from tessera.operators.chunk import BLOCK, FIGURE
from tessera.sources import files

SCHEMAS = {
    "kb_meta": "name string, chunk_config string, embed_config string, retrieval_config string, llm_config string, dimension int, query_mode string, created_at timestamp",
    "document": "kb_name string, document_id long, filename string, source_dir string, content string, frontmatter string, created_at timestamp, updated_at timestamp",
    "task": "task_id long, document_id long, priority int, status string, error_message string, created_at timestamp, updated_at timestamp",
    "node": "kb_name string, document_id long, node_id string, parent_id string, heading_path array<string>, title string, level int, sort_order int",
    "chunk": f"kb_name string, document_id long, node_id string, chunk_seq int, text string, blocks array<{BLOCK}>, figures array<{FIGURE}>, embedding array<float>, marker_embedding array<float>, markers array<string>",
}
PARTITIONED = ("document", "task", "node", "chunk")
#: Pointers whose versions are kept.
KEPT = 3
#: An index stands beside the chunks that it is of, so that it never answers for others.
INDEX = "-index"
STATUSES = ("pending", "running", "success", "failed", "canceled")
#: A name is a folder's name and stays short.
_NAME = re.compile(r"[A-Za-z0-9_]{1,60}")


class CatalogError(ValueError):
    pass


def check_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise CatalogError(f"a knowledge base's name has 1 to 60 letters, digits and underscores: {name!r}")
    return name


# --- operators on tables, without a store ---


def numbered(rows: DataFrame, keys: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """Rows (distinct by ``keys``) numbered 1, 2, ... by hash bucket and key; each bucket is numbered by itself."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_count"))
    before = F.coalesce(F.sum("_count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("_bucket", before.alias("_shift"))  # a row for each bucket
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return rows.withColumn(name, own).join(F.broadcast(shift), "_bucket").withColumn(name, (F.col(name) + F.col("_shift")).cast("long")).drop("_bucket", "_shift")


def upsert_documents(old: DataFrame, new: DataFrame, now, largest: int | None = None) -> DataFrame:
    """Documents by (kb_name, filename): content and folder are replaced, id, frontmatter and creation time stay.

    ``new`` has kb_name, filename, source_dir and content; of rows with one key
    the last by content wins.  New ids follow the largest (of ``old``, if it is not
    given) without gaps.
    """
    key = ["kb_name", "filename"]
    one = new.groupBy(*key).agg(F.max(F.struct("source_dir", "content")).alias("_n")).select(*key, F.col("_n.source_dir").alias("_dir"), F.col("_n.content").alias("_content"))
    joined = old.join(one, key, "full_outer")
    fresh = F.col("document_id").isNull()
    # only the documents that are new are numbered
    added = numbered(joined.filter(fresh).select(*key), key, "_no")
    rows = joined.join(added, key, "left")
    top = old.agg(F.coalesce(F.max("document_id"), F.lit(0)).alias("_largest"))
    rows = rows.join(F.broadcast(top)) if largest is None else rows.withColumn("_largest", F.lit(largest))
    changed = F.col("_content").isNotNull()
    return rows.select(
        "kb_name",
        F.coalesce("document_id", F.col("_largest") + F.col("_no")).alias("document_id"),
        "filename",
        F.when(changed, F.coalesce("_dir", F.lit(""))).otherwise(F.col("source_dir")).alias("source_dir"),
        F.coalesce("_content", "content").alias("content"),
        "frontmatter",
        F.coalesce("created_at", now).alias("created_at"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def replace_rows(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """All rows of the given documents (which may now have none) give way to ``new``."""
    return old.join(documents.select("document_id").distinct(), "document_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def cascade(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("document_id").distinct(), "document_id", "left_anti").select(*table.columns)


def transition(tasks: DataFrame, outcomes: DataFrame, now) -> DataFrame:
    """Tasks with the status and message of ``outcomes`` (task_id, status, error_message) where there is one."""
    told = outcomes.select(F.col("task_id").alias("_id"), F.col("status").alias("_status"), F.col("error_message").alias("_error"))
    rows = tasks.join(told, F.col("task_id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return rows.select("task_id", "document_id", "priority", F.when(hit, F.col("_status")).otherwise(F.col("status")).alias("status"), F.when(hit, F.col("_error")).otherwise(F.col("error_message")).alias("error_message"), "created_at", F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"))


def cancel_running(tasks: DataFrame, documents: DataFrame, kb: str, now) -> DataFrame:
    """Running tasks of a knowledge base become canceled; pending ones stay."""
    own = documents.filter(F.col("kb_name") == kb).select(F.col("document_id").alias("_own"))
    rows = tasks.join(own, F.col("document_id") == F.col("_own"), "left")
    hit = F.col("_own").isNotNull() & (F.col("status") == "running")
    return rows.select(*[F.when(hit, F.lit("canceled")).otherwise(F.col("status")).alias("status") if c == "status" else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in tasks.columns])


def queue(tasks: DataFrame) -> DataFrame:
    """Pending tasks in the order in which they are taken."""
    return tasks.filter("status = 'pending'").orderBy(F.col("priority").desc(), "created_at", "task_id")


def list_documents(documents: DataFrame, chunks: DataFrame, tasks: DataFrame, kb: str) -> DataFrame:
    """A kb's documents with the number of chunks and the latest task's status, in order of id."""
    own = documents.filter(F.col("kb_name") == kb)
    counts = chunks.filter(F.col("kb_name") == kb).groupBy("document_id").agg(F.count("node_id").alias("n_chunks"))
    latest = tasks.groupBy("document_id").agg(F.max_by("status", F.struct("created_at", "task_id")).alias("status"))
    rows = own.join(counts, "document_id", "left").join(latest, "document_id", "left")
    stamp = F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")
    return rows.select("document_id", "filename", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "status", stamp.alias("updated_at")).orderBy("document_id")


def list_kbs(meta: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Knowledge bases with numbers of documents and chunks, oldest first."""
    docs = documents.groupBy(F.col("kb_name").alias("name")).agg(F.count("document_id").alias("n_documents"))
    own = chunks.groupBy(F.col("kb_name").alias("name")).agg(F.count(F.lit(1)).alias("n_chunks"))
    rows = meta.join(docs, "name", "left").join(own, "name", "left").fillna(0, ["n_documents", "n_chunks"])
    return rows.orderBy("created_at", "name")


def task_counts(tasks: DataFrame, documents: DataFrame, kb: str) -> DataFrame:
    """One row: pending, running and failed tasks of a kb."""
    own = tasks.join(documents.filter(F.col("kb_name") == kb).select("document_id"), "document_id")
    return own.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "failed")])


def failed_tasks(tasks: DataFrame, documents: DataFrame, kb: str, since=None) -> DataFrame:
    """Documents whose latest task failed (since a time, if given), in order of the task."""
    own = documents.filter(F.col("kb_name") == kb).select("document_id", "filename")
    last = tasks.groupBy("document_id").agg(F.max(F.struct("task_id", "status", "error_message", "updated_at")).alias("t")).select("document_id", "t.*")
    rows = last.filter("status = 'failed'").join(own, "document_id")
    rows = rows if since is None else rows.filter(F.col("updated_at") >= since)
    return rows.select("task_id", "document_id", "filename", "error_message").orderBy("task_id")


# --- the store ---


@dataclass
class Store:
    spark: SparkSession
    root: str
    _pointer: dict = field(default_factory=dict)
    _number: int = 0

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/")
        if self._pointers():
            self.refresh()
        else:
            self._commit({"kb_meta": None, **{t: {} for t in PARTITIONED}})

    def _pointers(self) -> list[str]:
        return files.listed(self.spark, f"{self.root}/pointer-*.json")

    def refresh(self) -> None:
        last = self._pointers()[-1]
        self._pointer = json.loads(files.read_text(self.spark, last))
        self._number = int(last.rsplit("-", 1)[1].removesuffix(".json"))

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        none = self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths).select(*none.columns) if paths else none

    def table(self, name: str) -> DataFrame:
        at = self._pointer[name]
        return self._read(name, list(at.values()) if name in PARTITIONED else [at] if at else [])

    def kb(self, name: str, kb: str) -> DataFrame:
        """A knowledge base's part of a table; nothing else is read."""
        at = self._pointer[name].get(kb)
        return self._read(name, [at] if at else [])

    def _written(self, df: DataFrame, name: str, kb: str = "") -> str:
        at = "/".join(filter(None, (self.root, name, kb, uuid.uuid4().hex)))
        df.write.parquet(at)
        return at

    def _changed(self, kb: str, parts: dict[str, DataFrame]) -> None:
        """New versions of a knowledge base's parts."""
        new = {name: dict(at) if name in PARTITIONED else at for name, at in self._pointer.items()}
        for name, df in parts.items():
            new[name][kb] = self._written(df, name, kb)
        self._commit(new)

    @staticmethod
    def _named(pointer: dict) -> set[str]:
        return {p for t in PARTITIONED for p in pointer[t].values()} | ({pointer["kb_meta"]} if pointer["kb_meta"] else set())

    def _commit(self, new: dict) -> None:
        """The next pointer; then versions that none of the last pointers names are removed."""
        self._number += 1
        files.write_text(self.spark, f"{self.root}/pointer-{self._number:012d}.json", json.dumps(new))
        self._pointer = new
        old = self._pointers()
        kept = set().union(*(self._named(json.loads(files.read_text(self.spark, p))) for p in old[-KEPT:]))
        for pointer in old[:-KEPT]:
            for at in self._named(json.loads(files.read_text(self.spark, pointer))) - kept:
                files.delete(self.spark, at)
                files.delete(self.spark, at + INDEX)
            files.delete(self.spark, pointer)

    def create_index(self, kb: str) -> None:
        """Indexes the vectors, and the markers' where there are some, of a knowledge base's present chunks."""
        self.meta(kb)
        at = self._pointer["chunk"].get(kb)
        if at is None:
            return
        for column in ("embedding", "marker_embedding"):
            ann.build(self.kb("chunk", kb), ["document_id", "node_id", "chunk_seq"], column, f"{at}{INDEX}/{column}")

    def index(self, kb: str, column: str) -> ann.Index | None:
        """The index of the present chunks; none if it was not made."""
        at = self._pointer["chunk"].get(kb)
        if at is None or not files.listed(self.spark, f"{at}{INDEX}/{column}/cells/_SUCCESS"):
            return None
        found = ann.load(self.spark, f"{at}{INDEX}/{column}", column)
        return found if len(found.cells) else None

    @staticmethod
    def now():
        """The time, taken once on the driver."""
        return F.lit(datetime.datetime.now(datetime.timezone.utc))

    def meta(self, kb: str) -> dict:
        row = self.table("kb_meta").filter(F.col("name") == kb).first()
        if row is None:
            raise CatalogError(f"there is no knowledge base {kb!r}")
        return row.asDict()

    def create_kb(self, name: str, dimension: int, chunk_config: dict, embed_config: dict, retrieval_config: dict | None = None, llm_config: dict | None = None, query_mode: str | None = None) -> None:
        """Its settings are fixed from here on.  The mode is as given, else hybrid with markers, else vector."""
        check_name(name)
        if dimension < 1:
            raise CatalogError("a vector has at least one dimension")
        meta = self.table("kb_meta")
        if not meta.filter(F.col("name") == name).isEmpty():
            raise CatalogError(f"the knowledge base {name!r} exists")
        mode = query_mode or ("hybrid" if llm_config else "vector")
        row = self.spark.createDataFrame([(name, json.dumps(chunk_config), json.dumps(embed_config), json.dumps(retrieval_config or {}), json.dumps(llm_config) if llm_config else None, dimension, mode)], "name string, chunk_config string, embed_config string, retrieval_config string, llm_config string, dimension int, query_mode string")
        self._commit({**self._pointer, "kb_meta": self._written(meta.unionByName(row.withColumn("created_at", self.now())), "kb_meta")})

    def delete_kb(self, name: str) -> None:
        self.meta(name)
        rest = {t: {k: at for k, at in self._pointer[t].items() if k != name} for t in PARTITIONED}
        self._commit({"kb_meta": self._written(self.table("kb_meta").filter(F.col("name") != name), "kb_meta"), **rest})

    def flush(self) -> None:
        self._commit({"kb_meta": None, **{t: {} for t in PARTITIONED}})

    def register(self, kb: str, raw: DataFrame, priority: int) -> None:
        """Upserts documents (filename, source_dir, content) and queues a task for each."""
        self.meta(kb)
        now = self.now()
        new = raw.select(F.lit(kb).alias("kb_name"), "filename", "source_dir", "content")
        last = self.table("document").agg(F.coalesce(F.max("document_id"), F.lit(0))).first()[0]
        documents = upsert_documents(self.kb("document", kb), new, now, last)
        tasks = self.kb("task", kb)
        touched = documents.join(new.select("kb_name", "filename").distinct(), ["kb_name", "filename"])
        largest = self.table("task").agg(F.coalesce(F.max("task_id"), F.lit(0)).alias("_largest"))
        added = numbered(touched.select("document_id"), ["document_id"], "_no").join(F.broadcast(largest)).select((F.col("_largest") + F.col("_no")).alias("task_id"), "document_id", F.lit(priority).alias("priority"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_message"), now.alias("created_at"), now.alias("updated_at"))
        self._changed(kb, {"document": documents, "task": tasks.unionByName(added)})

    def update_document(self, kb: str, document_id: int, filename: str, content: str, priority: int = 100) -> None:
        """New content of a document, whose filename must be the same."""
        row = self.kb("document", kb).filter(F.col("document_id") == document_id).first()
        if row is None:
            raise CatalogError(f"there is no document {document_id} in {kb!r}")
        if row["filename"] != filename:
            raise CatalogError(f"document {document_id} is {row['filename']!r}, not {filename!r}")
        self.register(kb, self.spark.createDataFrame([(filename, row["source_dir"], content)], "filename string, source_dir string, content string"), priority)

    def remove_document(self, kb: str, document_id: int) -> str:
        row = self.kb("document", kb).filter(F.col("document_id") == document_id).first()
        if row is None:
            raise CatalogError(f"there is no document {document_id} in {kb!r}")
        gone = self.spark.createDataFrame([(document_id,)], "document_id long")
        self._changed(kb, {t: cascade(self.kb(t, kb), gone) for t in PARTITIONED})
        return row["filename"]

    def finish(self, kb: str, documents: DataFrame, nodes: DataFrame, chunks: DataFrame, outcomes: DataFrame) -> None:
        """One commit of ingested documents: frontmatter, sections, chunks and the tasks' outcomes.

        ``documents`` (document_id, frontmatter) are those that succeeded; others
        keep what they had.
        """
        now = self.now()
        told = documents.select("document_id", F.col("frontmatter").alias("_f"))
        all_ = self.kb("document", kb)
        kept = all_.join(told, "document_id", "left").select(*[F.coalesce("_f", "frontmatter").alias("frontmatter") if c == "frontmatter" else F.col(c) for c in all_.columns])
        self._changed(kb, {"document": kept, "node": replace_rows(self.kb("node", kb), nodes, documents), "chunk": replace_rows(self.kb("chunk", kb), chunks, documents), "task": transition(self.kb("task", kb), outcomes, now)})

    def _moved(self, kb: str, before: tuple[str, ...], after: str) -> int:
        """Tasks of some states take another; how many there were."""
        tasks = self.kb("task", kb)
        hit = F.col("status").isin(*before)
        n = tasks.filter(hit).count()
        if n:
            outcomes = tasks.filter(hit).select("task_id", F.lit(after).alias("status"), F.lit(None).cast("string").alias("error_message"))
            self._changed(kb, {"task": transition(tasks, outcomes, self.now())})
        return n

    def start(self, kb: str) -> int:
        """All waiting tasks run.  A store has one writer, so a task that is found running was left by one that died, and runs again."""
        return self._moved(kb, ("pending", "running"), "running")

    def put_back(self, kb: str) -> int:
        """Running tasks wait again."""
        return self._moved(kb, ("running",), "pending")

    def cancel(self, kb: str) -> int:
        """Running tasks are canceled; their documents keep what they had."""
        tasks = self.kb("task", kb)
        n = tasks.filter("status = 'running'").count()
        if n:
            self._changed(kb, {"task": cancel_running(tasks, self.kb("document", kb), kb, self.now())})
        return n
