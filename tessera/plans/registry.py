"""Every query of the library by name, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import frontmatter, text, tokens
from tessera.functions.frontmatter import Filter, entry, tags_of, text_of, where
from tessera.functions.scratch import in_order
from tessera.functions.vectors import cosine_distance
from tessera.operators import chunk, evaluate, retrieval
from tessera.plans import catalog
from tessera.sources import documents, files, providers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, **given) -> DataFrame:
    """Rows as search takes them: the given columns, and nulls for the rest."""
    kinds = {"document_id": "long", "filename": "string", "frontmatter": "string", "node_id": "string", "chunk_seq": "int", "heading_path": "array<string>", "sort_order": "int", "text": "string", "figures": f"array<{chunk.FIGURE}>", "markers": "array<string>", "embedding": "array<float>", "marker_embedding": "array<float>"}
    return df.select(*[given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _chunks(spark, sf_dir) -> DataFrame:
    """Vectors as the chunks of one section each, whose document has the label in its frontmatter."""
    vectors = read(spark, sf_dir, "embeddings")
    key = F.col("vec_id").cast("long")
    chunks = _rows(vectors, document_id=key, node_id=F.lit("s"), chunk_seq=F.lit(0), embedding=F.col("embedding")).drop("filename", "frontmatter")
    nodes = vectors.select(key.alias("document_id"), F.lit("s").alias("node_id"), F.array(F.concat(F.lit("vector "), F.col("vec_id").cast("string"))).alias("heading_path"), F.lit(1).alias("sort_order"))
    documents = vectors.select(key.alias("document_id"), F.concat(F.col("vec_id").cast("string"), F.lit(".md")).alias("filename"), F.to_json(F.struct(F.col("label").cast("string").alias("label"))).alias("frontmatter"))
    return retrieval.searchable(chunks, nodes, documents)


def _asked(spark, sf_dir) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


def _as(spark, sf_dir, name: str, column: str, key: str = "document_id"):
    """A result's key as the table's column."""
    return F.col(key).cast(read(spark, sf_dir, name).schema[column].dataType).alias(column)


# --- search and fusion ---


@query(
    """SELECT e.vec_id, round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    ORDER BY distance, e.vec_id LIMIT 5"""
)
def vector_topk(spark, sf_dir):
    found = retrieval.vector_search(_chunks(spark, sf_dir), _asked(spark, sf_dir), 5)
    return found.select(_as(spark, sf_dir, "embeddings", "vec_id"), F.round("distance", 6).alias("distance"))


_DIST = "round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(f"SELECT e.vec_id, e.label, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY distance, e.vec_id LIMIT 5")
def vector_topk_filtered(spark, sf_dir):
    found = retrieval.vector_search(_chunks(spark, sf_dir), _asked(spark, sf_dir), 5, [Filter.parse("label=3")])
    label = F.get_json_object("frontmatter", "$.label").alias("label")
    return found.select(_as(spark, sf_dir, "embeddings", "vec_id"), label, F.round("distance", 6).alias("distance")).select("vec_id", _as(spark, sf_dir, "embeddings", "label", "label"), "distance")


@query(
    f"""SELECT query_id, vec_id, distance, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_DIST} AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rank
    FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5"""
)
def vector_topk_batch(spark, sf_dir):
    """The stated set of queries, which grows with the table: every row whose id is divisible by 20."""
    vectors = read(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.batch_search(vectors, queries, 5, ["vec_id"], digits=6)
    return found.select("query_id", "vec_id", "distance", F.col("rank").cast("long").alias("rank"))


def _centroids(spark, sf_dir):
    parts = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


_CENTROIDS = """centroids AS (SELECT label, list(m ORDER BY i) AS centroid FROM (
    SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""


@query(
    f"""WITH {_CENTROIDS} SELECT c.label, round(list_cosine_distance(c.centroid, q.embedding::DOUBLE[]), 6) AS distance
    FROM centroids c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, c.label LIMIT 5"""
)
def marker_topk(spark, sf_dir):
    """Class means as the vectors of markers."""
    rows = _rows(_centroids(spark, sf_dir), document_id=F.col("label"), node_id=F.lit("s"), chunk_seq=F.lit(0), marker_embedding=F.col("centroid"))
    found = retrieval.marker_search(rows, _asked(spark, sf_dir), 5)
    return found.select(_as(spark, sf_dir, "embeddings", "label"), F.round("distance", 6).alias("distance"))


_LISTS = f"""WITH near AS (SELECT e.vec_id, e.label, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
    one AS (SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM near ORDER BY distance, vec_id LIMIT 20),
    two AS (SELECT vec_id, distance, row_number() OVER (ORDER BY abs(label - 3), distance, vec_id) AS rank FROM near ORDER BY abs(label - 3), distance, vec_id LIMIT 20),
    fused AS (SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, arg_min(l, l) AS list FROM
        (SELECT vec_id, rank, 0 AS l FROM two UNION ALL SELECT vec_id, rank, 1 AS l FROM one) GROUP BY vec_id)"""


def _fused(spark, sf_dir):
    """The nearest vectors, and those of the nearest labels (a label's step counts more than any distance), fused."""
    rows, asked = _chunks(spark, sf_dir), _asked(spark, sf_dir)
    near = retrieval.vector_search(rows, asked, 20)
    steps = F.abs(F.get_json_object("frontmatter", "$.label").cast("int") - 3)
    every = rows.withColumn("distance", steps * 10 + F.round(cosine_distance(F.col("embedding"), retrieval.query_vector(asked)), 6)).withColumn("source", F.lit("MARKER"))
    by_label = every.select(*retrieval.RESULT).orderBy("distance", *retrieval.KEY).limit(20)
    fused = retrieval.fuse(retrieval.ranked(by_label), retrieval.ranked(near))
    return fused.select(_as(spark, sf_dir, "embeddings", "vec_id"), F.round("score", 9).alias("score"), F.when(F.col("source") == "MARKER", 0).otherwise(1).alias("list"))


@query(_LISTS + " SELECT vec_id, score, list FROM fused")
def rrf_full(spark, sf_dir):
    return _fused(spark, sf_dir)


@query(_LISTS + " SELECT vec_id, score, list FROM fused ORDER BY score DESC, vec_id LIMIT 10")
def rrf_truncated(spark, sf_dir):
    return _fused(spark, sf_dir).orderBy(F.col("score").desc(), "vec_id").limit(10)


@query(_LISTS + " SELECT f.vec_id, f.score, n.distance FROM fused f JOIN near n USING (vec_id) ORDER BY f.score DESC, f.vec_id LIMIT 5")
def rrf_hybrid(spark, sf_dir):
    top = _fused(spark, sf_dir).orderBy(F.col("score").desc(), "vec_id").limit(5)
    distance = F.round(cosine_distance(F.col("embedding"), retrieval.query_vector(_asked(spark, sf_dir))), 6).alias("distance")
    return top.join(read(spark, sf_dir, "embeddings").select("vec_id", distance), "vec_id").select("vec_id", "score", "distance")


@query("SELECT vec_id, 'TREE' AS source, 0.0::DOUBLE AS distance FROM embeddings WHERE label = 3")
def neighbor_chunks(spark, sf_dir):
    """The chunks of all sections, as neighbors of hits are taken, under a filter."""
    rows = _chunks(spark, sf_dir)
    found = retrieval.neighbors(rows, rows.select("document_id", "node_id"), [Filter.parse("label=3")])
    return found.select(_as(spark, sf_dir, "embeddings", "vec_id"), "source", "distance")


# --- frontmatter filters ---


def _with_frontmatter(spark, sf_dir):
    tags = F.array(F.col("event_type"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(5)).cast("string")))
    made = F.to_json(F.struct(F.col("event_type").alias("type"), tags.alias("tags"), F.when(F.pmod("event_id", F.lit(3)) == 0, "even").alias("book")))
    return read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props", made.alias("frontmatter"))


def _filtered(spark, sf_dir, *filters: str):
    rows = _with_frontmatter(spark, sf_dir)
    return rows.filter(where(F.col("frontmatter"), [Filter.parse(f) for f in filters])).select("event_id")


@query("SELECT event_id FROM events WHERE (props::JSON ->> 'k') = '7'")
def filter_eq(spark, sf_dir):
    return read(spark, sf_dir, "events").filter(Filter.parse("k=7").column(F.col("props"))).select("event_id")


@query("SELECT event_id FROM events WHERE NOT (event_id % 3 = 0)")
def filter_neq_missing(spark, sf_dir):
    return _filtered(spark, sf_dir, "book!=even")


@query("SELECT event_id FROM events WHERE list_contains([event_type, 'u' || (user_id % 5)], 'u2')")
def filter_array_contains(spark, sf_dir):
    return _filtered(spark, sf_dir, "tags=u2")


@query("SELECT event_id FROM events WHERE list_contains([event_type, 'u' || (user_id % 5)], 'u2') AND event_id % 3 = 0 AND event_type <> 'click'")
def filter_conjunction(spark, sf_dir):
    return _filtered(spark, sf_dir, "tags=u2", "book=even", "type!=click")


@query("SELECT event_id FROM events WHERE false")
def filter_unknown_key(spark, sf_dir):
    return _filtered(spark, sf_dir, "nope=x")


@query("SELECT event_id, event_type AS type, (props::JSON ->> 'k') AS k, event_type || ',u' || (user_id % 5) AS tags FROM events")
def frontmatter_extract(spark, sf_dir):
    rows = _with_frontmatter(spark, sf_dir)
    fm = F.col("frontmatter")
    return rows.select("event_id", text_of(fm, "type").alias("type"), F.try_variant_get(entry(F.col("props"), "k"), "$", "string").alias("k"), F.array_join(tags_of(fm), ",").alias("tags"))


# --- joins, trees and merging ---


@query(
    """SELECT l_orderkey, l_linenumber, o_orderdate, c_name, l_quantity FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"""
)
def join_chunk_node_doc(spark, sf_dir):
    """Orders as documents (named by their customer) of one section, and their lines as chunks."""
    customers = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    documents = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("document_id"), F.col("c_name").alias("filename"), F.lit("{}").alias("frontmatter"))
    nodes = orders.select(F.col("o_orderkey").alias("document_id"), F.lit("s").alias("node_id"), F.array().cast("array<string>").alias("heading_path"), F.col("o_orderdate").alias("sort_order"))
    chunks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit("s").alias("node_id"), F.col("l_linenumber").alias("chunk_seq"), F.col("l_quantity").alias("text"))
    found = retrieval.searchable(chunks, nodes, documents)
    return found.select(F.col("document_id").alias("l_orderkey"), F.col("chunk_seq").alias("l_linenumber"), F.col("sort_order").alias("o_orderdate"), F.col("filename").alias("c_name"), F.col("text").alias("l_quantity"))


def _tree(spark, sf_dir):
    """Regions, nations, customers and suppliers as sections of one document below a root."""
    one = F.lit(0).cast("long").alias("document_id")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    root = spark.createDataFrame([(0, "root", None)], "document_id long, node_id string, parent_id string")
    regions = read(spark, sf_dir, "region").select(one, name("r", "r_regionkey").alias("node_id"), F.lit("root").alias("parent_id"))
    nations = read(spark, sf_dir, "nation").select(one, name("n", "n_nationkey").alias("node_id"), name("r", "n_regionkey").alias("parent_id"))
    customers = read(spark, sf_dir, "customer").select(one, name("c", "c_custkey").alias("node_id"), name("n", "c_nationkey").alias("parent_id"))
    suppliers = read(spark, sf_dir, "supplier").select(one, name("s", "s_suppkey").alias("node_id"), name("n", "s_nationkey").alias("parent_id"))
    return root.unionByName(regions).unionByName(nations).unionByName(customers).unionByName(suppliers)


_TREE = """WITH tree AS (SELECT 'root' AS node_id, NULL::VARCHAR AS parent_id UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
    hits AS (SELECT node_id FROM tree WHERE node_id IN ('c1', 'c2', 's3', 'n7')),
    child AS (SELECT t.node_id FROM tree t JOIN hits h ON t.parent_id = h.node_id),
    up1 AS (SELECT DISTINCT t.parent_id AS node_id FROM tree t JOIN hits h USING (node_id) WHERE t.parent_id IS NOT NULL AND t.parent_id <> 'root'),
    up2 AS (SELECT DISTINCT t.parent_id AS node_id FROM tree t JOIN up1 h USING (node_id) WHERE t.parent_id IS NOT NULL AND t.parent_id <> 'root'),
    sibling AS (SELECT DISTINCT t.node_id FROM tree t WHERE t.parent_id IN (SELECT p.parent_id FROM tree p JOIN hits USING (node_id)) AND t.node_id NOT IN (SELECT node_id FROM hits))"""


def _hits(spark, sf_dir):
    return _tree(spark, sf_dir).filter(F.col("node_id").isin("c1", "c2", "s3", "n7")).select("document_id", "node_id")


@query(_TREE + " SELECT DISTINCT node_id FROM child")
def children(spark, sf_dir):
    return retrieval.expand(_hits(spark, sf_dir), _tree(spark, sf_dir), 0).select("node_id")


@query(_TREE + " SELECT node_id FROM child UNION SELECT node_id FROM up1")
def parents_depth1(spark, sf_dir):
    return retrieval.expand(_hits(spark, sf_dir), _tree(spark, sf_dir), 1).select("node_id")


@query(_TREE + " SELECT node_id FROM up1 UNION SELECT node_id FROM up2")
def parents_depth2(spark, sf_dir):
    return retrieval.ancestors(_hits(spark, sf_dir), _tree(spark, sf_dir), 2).select("node_id").distinct()


@query(_TREE + " SELECT node_id FROM sibling")
def siblings_anti(spark, sf_dir):
    return retrieval.siblings(_hits(spark, sf_dir), _tree(spark, sf_dir)).select("node_id").distinct()


@query(_TREE + " SELECT node_id FROM child UNION SELECT node_id FROM up1 UNION SELECT node_id FROM up2 UNION SELECT node_id FROM sibling")
def tree_expand(spark, sf_dir):
    return retrieval.expand(_hits(spark, sf_dir), _tree(spark, sf_dir), 2).select("node_id")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'F' THEN 'VEC' ELSE 'TREE' END AS source FROM orders")
def merge_dedupe_order(spark, sf_dir):
    """Orders that are not finished as hits, and all orders as their neighbors."""
    orders = read(spark, sf_dir, "orders")

    def rows(some, source):
        made = _rows(some, document_id=F.col("o_custkey"), sort_order=F.col("o_orderkey"), chunk_seq=F.col("o_orderkey"), node_id=F.lit("x"))
        return made.withColumn("source", F.lit(source)).withColumn("distance", F.lit(0.0)).select(*retrieval.RESULT)

    merged = retrieval.merge(rows(orders.filter("o_orderstatus <> 'F'"), "VEC"), rows(orders, "TREE"))
    return merged.select(_as(spark, sf_dir, "orders", "o_orderkey", "chunk_seq"), _as(spark, sf_dir, "orders", "o_custkey"), "source")


# --- aggregates, queues and changes ---


@query("SELECT n_name, count(c_custkey) AS n_customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def left_count(spark, sf_dir):
    """Nations as the documents of a knowledge base, and customers as their chunks."""
    documents = read(spark, sf_dir, "nation").select(F.lit("kb").alias("kb_name"), F.col("n_nationkey").alias("document_id"), F.col("n_name").alias("filename"), F.lit(None).cast("timestamp").alias("updated_at"))
    chunks = read(spark, sf_dir, "customer").select(F.lit("kb").alias("kb_name"), F.col("c_nationkey").alias("document_id"), F.col("c_custkey").cast("string").alias("node_id"))
    tasks = spark.createDataFrame([], catalog.SCHEMAS["task"])
    return catalog.list_documents(documents, chunks, tasks, "kb").select(F.col("filename").alias("n_name"), F.col("n_chunks").alias("n_customers"))


@query(
    """SELECT r_name, count(DISTINCT n_nationkey) AS n_nations, count(c_custkey) AS n_customers
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name"""
)
def kb_summary(spark, sf_dir):
    """Regions as knowledge bases, nations as their documents, customers as their chunks."""
    regions = read(spark, sf_dir, "region")
    meta = regions.select(F.col("r_name").alias("name"), F.lit(None).cast("timestamp").alias("created_at"))
    documents = read(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("kb_name"), F.col("n_nationkey").alias("document_id"))
    chunks = read(spark, sf_dir, "customer").join(documents, F.col("c_nationkey") == F.col("document_id")).select("kb_name", "document_id")
    rows = catalog.list_kbs(meta, documents, chunks)
    return rows.select(F.col("name").alias("r_name"), F.col("n_documents").alias("n_nations"), F.col("n_chunks").alias("n_customers"))


def _as_tasks(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in catalog.STATUSES]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("document_id"), F.pmod("event_id", F.lit(3)).cast("int").alias("priority"), status.alias("status"), F.lit(None).cast("string").alias("error_message"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))


_TASKS = """WITH tasks AS (SELECT event_id AS task_id, user_id AS document_id, (event_id % 3)::INTEGER AS priority,
    ['pending', 'running', 'success', 'failed', 'canceled'][(event_id % 5 + 1)::INTEGER] AS status, ts AS created_at FROM events)"""


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low, count(*) AS n FROM events GROUP BY event_type")
def count_filter(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"), F.count(F.lit(1)).alias("n"))


@query(_TASKS + " SELECT document_id, max(task_id) AS task_id FROM tasks GROUP BY document_id")
def latest_by_max(spark, sf_dir):
    return _as_tasks(spark, sf_dir).groupBy("document_id").agg(F.max("task_id").alias("task_id"))


@query(_TASKS + " SELECT document_id, arg_max(status, (created_at, task_id)) AS status FROM tasks GROUP BY document_id")
def latest_status(spark, sf_dir):
    tasks = _as_tasks(spark, sf_dir)
    documents = tasks.select(F.lit("kb").alias("kb_name"), "document_id", F.lit("f").alias("filename"), F.lit(None).cast("timestamp").alias("updated_at")).distinct()
    chunks = spark.createDataFrame([], catalog.SCHEMAS["chunk"])
    return catalog.list_documents(documents, chunks, tasks, "kb").select("document_id", "status")


@query(_TASKS + " SELECT t.document_id, t.task_id FROM tasks t WHERE t.status = 'failed' AND t.task_id = (SELECT max(u.task_id) FROM tasks u WHERE u.document_id = t.document_id) AND t.created_at >= TIMESTAMP '2024-01-10 00:00:00'")
def failed_since(spark, sf_dir):
    tasks = _as_tasks(spark, sf_dir)
    documents = tasks.select(F.lit("kb").alias("kb_name"), "document_id", F.lit("f").alias("filename")).distinct()
    return catalog.failed_tasks(tasks, documents, "kb", F.lit("2024-01-10 00:00:00").cast("timestamp")).select("document_id", "task_id")


@query(_TASKS + " SELECT task_id, priority, row_number() OVER (ORDER BY priority DESC, created_at, task_id) AS place FROM tasks WHERE status = 'pending'")
def queue_order(spark, sf_dir):
    return in_order(catalog.queue(_as_tasks(spark, sf_dir)).select("task_id", "priority"), "place", 1)


def _of_two_kbs(spark, sf_dir):
    """Tasks, and their documents in two knowledge bases."""
    tasks = _as_tasks(spark, sf_dir)
    return tasks, tasks.select(F.concat(F.lit("kb"), F.pmod("document_id", F.lit(2)).cast("string")).alias("kb_name"), "document_id").distinct()


@query(_TASKS + " SELECT 'kb' || (document_id % 2) AS kb, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'failed') AS failed FROM tasks GROUP BY 1")
def task_counts(spark, sf_dir):
    tasks, documents = _of_two_kbs(spark, sf_dir)
    one, two = (catalog.task_counts(tasks, documents, kb).withColumn("kb", F.lit(kb)) for kb in ("kb0", "kb1"))
    return one.unionByName(two)


@query(_TASKS + " SELECT task_id, CASE WHEN status = 'running' AND document_id % 2 = 0 THEN 'canceled' ELSE status END AS status FROM tasks")
def cancel_update(spark, sf_dir):
    tasks, documents = _of_two_kbs(spark, sf_dir)
    return catalog.cancel_running(tasks, documents, "kb0", F.lit(None).cast("timestamp")).select("task_id", "status")


@query(_TASKS + " SELECT task_id, CASE WHEN task_id % 4 = 0 THEN 'success' ELSE status END AS status FROM tasks")
def task_transition(spark, sf_dir):
    tasks = _as_tasks(spark, sf_dir)
    outcomes = tasks.filter("task_id % 4 = 0").select("task_id", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message"))
    return catalog.transition(tasks, outcomes, F.lit(None).cast("timestamp")).select("task_id", "status")


def _as_documents(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    return parts.filter("p_partkey % 3 <> 0").select(F.lit("kb").alias("kb_name"), F.col("p_partkey").alias("document_id"), F.concat(F.col("p_partkey").cast("string"), F.lit(".md")).alias("filename"), F.lit("").alias("source_dir"), F.col("p_name").alias("content"), F.lit("{}").alias("frontmatter"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at")), parts


@query(
    """SELECT p_partkey || '.md' AS filename, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS content, p_partkey % 3 <> 0 AS known
    FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0"""
)
def upsert(spark, sf_dir):
    old, parts = _as_documents(spark, sf_dir)
    new = parts.filter("p_partkey % 2 = 0").select(F.lit("kb").alias("kb_name"), F.concat(F.col("p_partkey").cast("string"), F.lit(".md")).alias("filename"), F.lit("d").alias("source_dir"), F.col("p_brand").alias("content"))
    out = catalog.upsert_documents(old, new, F.lit(None).cast("timestamp"))
    return out.select("filename", "content", F.col("frontmatter").isNotNull().alias("known"))


@query("SELECT l_orderkey AS document_id, l_linenumber FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 100 FROM orders WHERE o_orderkey % 14 = 0")
def replace_rows(spark, sf_dir):
    old = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    new = orders.filter("document_id % 14 = 0").withColumn("l_linenumber", F.lit(100))
    return catalog.replace_rows(old, new, orders.filter("document_id % 7 = 0"))


@query("SELECT l_orderkey AS document_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def cascade_delete(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"))
    gone = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    return catalog.cascade(lines, gone).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


# --- text ---


@query("SELECT p_partkey, concat_ws(' > ', p_brand, p_type, p_name) AS path FROM part")
def breadcrumb(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.breadcrumb(F.array("p_brand", "p_type", "p_name")).alias("path"))


@query(
    r"""SELECT doc_id, translate(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS slug FROM documents"""
)
def slug_heading(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.slug_heading(F.col("text")).alias("slug"))


@query(
    """SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id,
    regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+', ''), 1, 48), '-+$', '') AS s FROM documents)"""
)
def slug(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, md5(replace(replace(text, ' ', ''), chr(10), '')) AS digest FROM documents")
def normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("digest"))


@query("SELECT p_partkey, p_brand || ' · ch' || p_size || ' \"' || p_name || '\" · ' || p_type AS title FROM part")
def result_title(spark, sf_dir):
    fm = F.to_json(F.struct(F.col("p_brand").alias("book"), F.col("p_size").alias("chapter"), F.col("p_name").alias("title")))
    return read(spark, sf_dir, "part").select("p_partkey", frontmatter.result_title(F.lit("x.md"), fm, F.col("p_type")).alias("title"))


@query(
    r"""SELECT p_partkey, 'kb://' || p_brand || '/ch' || p_size || '#' || translate(regexp_replace(regexp_replace(p_type, '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS url FROM part"""
)
def result_url(spark, sf_dir):
    fm = F.to_json(F.struct(F.col("p_brand").alias("book"), F.col("p_size").cast("string").alias("chapter")))
    return read(spark, sf_dir, "part").select("p_partkey", frontmatter.result_url(F.lit("x.md"), fm, F.col("p_type")).alias("url"))


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents")
def base64_len(spark, sf_dir):
    encoded = F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "")
    return read(spark, sf_dir, "documents").select("doc_id", text.base64_byte_len(encoded).cast("long").alias("n_bytes"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders")
def ts_format(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.timestamp_text(F.col("o_orderdate")).alias("stamp"))


_TOKEN_SQL = r"'[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+'"
_SENTENCE_SQL = r"regexp_extract_all(text, '[^\n.?!。！？]*[\n.?!。！？]|[^\n.?!。！？]+$')"


@query(f"SELECT doc_id, len(regexp_extract_all(text, {_TOKEN_SQL})) AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tokens.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, len({_SENTENCE_SQL}) AS n_sentences, md5(array_to_string({_SENTENCE_SQL}, '|')) AS digest FROM documents")
def sentence_segments(spark, sf_dir):
    found = chunk.sentence_column(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_sentences"), F.md5(F.array_join(found, "|")).alias("digest"))


_COUNTS_SQL = f"""s AS (SELECT doc_id, i, len(regexp_extract_all(x, {_TOKEN_SQL})) AS n FROM (
    SELECT doc_id, unnest({_SENTENCE_SQL}) AS x, generate_subscripts({_SENTENCE_SQL}, 1) - 1 AS i FROM documents))"""


@query(
    f"""WITH RECURSIVE {_COUNTS_SQL}, packed AS (SELECT doc_id, i, 0 AS chunk, n AS held FROM s WHERE i = 0
    UNION ALL SELECT s.doc_id, s.i, CASE WHEN p.held > 0 AND p.held + s.n > 64 THEN p.chunk + 1 ELSE p.chunk END,
    CASE WHEN p.held > 0 AND p.held + s.n > 64 THEN s.n ELSE p.held + s.n END FROM packed p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i + 1)
    SELECT packed.doc_id, chunk, count(*) AS n_sentences, sum(n)::BIGINT AS n_tokens FROM packed JOIN s USING (doc_id, i) GROUP BY ALL"""
)
def fixed_pack(spark, sf_dir):
    parts = read(spark, sf_dir, "documents").select("doc_id", chunk.sentence_counts(chunk.sentence_column(F.col("text"))).alias("counts"))
    rows = parts.select("doc_id", F.posexplode(chunk.packed(F.col("counts"), 64)).alias("chunk", "x"))
    return rows.select("doc_id", "chunk", F.col("x.sentences").cast("long").alias("n_sentences"), F.col("x.tokens").cast("long").alias("n_tokens"))


@query(
    f"""WITH RECURSIVE {_COUNTS_SQL}, t AS (SELECT doc_id, i, n, (sum(n) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS c, max(i) OVER (PARTITION BY doc_id) AS m FROM s),
    lists AS (SELECT doc_id, list(n ORDER BY i) AS ns, list(c ORDER BY i) AS cs, any_value(m) AS m FROM t GROUP BY doc_id),
    chunks AS (SELECT doc_id, 0 AS chunk_seq, 0::BIGINT AS a, list_max(list_filter(range(0, m + 1), lambda j: cs[j + 1] <= 64 OR cs[j + 1] = ns[j + 1]))::BIGINT AS b FROM lists
    UNION ALL SELECT doc_id, chunk_seq + 1, a2, list_max(list_filter(range(a2, m + 1), lambda j: cs[j + 1] - cs[a2 + 1] + ns[a2 + 1] <= 64 OR cs[j + 1] - cs[a2 + 1] + ns[a2 + 1] = ns[j + 1]))::BIGINT
    FROM (SELECT c.doc_id, c.chunk_seq, l.ns, l.cs, l.m, greatest(list_min(list_filter(range(c.a, c.b + 1), lambda j: cs[c.b + 1] - cs[j + 1] + ns[j + 1] <= 16 OR cs[c.b + 1] = cs[j + 1])), c.a + 1)::BIGINT AS a2
    FROM chunks c JOIN lists l USING (doc_id) WHERE c.b < l.m))
    SELECT doc_id, chunk_seq, a::INTEGER AS first_sentence, b::INTEGER AS last_sentence FROM chunks"""
)
def fixed_pack_overlap(spark, sf_dir):
    parts = read(spark, sf_dir, "documents").select("doc_id", chunk.sentence_counts(chunk.sentence_column(F.col("text"))).alias("counts"))
    return chunk.packed_with_overlap(parts, "doc_id", "counts", 64, 16)


# --- whole documents (rows only: SQL cannot parse markdown) ---


def _markdown(spark, sf_dir):
    """Documents as markdown: a title, a section of the text and one of references."""
    body = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n## Notes\n\nAs above.\n\n# References\n\n- none\n"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), body.alias("body"))


@query()
def parse_blocks(spark, sf_dir):
    made = chunk.chunk_documents(_markdown(spark, sf_dir), chunk.Layered(1 << 30, 0.0), prune_references=False)
    rows = made.select("document_id", F.inline("chunks"))
    return rows.select("document_id", "node_id", "chunk_seq", F.size("blocks").alias("n_blocks"), F.md5("text").alias("digest"))


@query()
def prune_refs(spark, sf_dir):
    made = chunk.chunk_documents(_markdown(spark, sf_dir), chunk.Layered())
    return made.select("document_id", "pruned", F.size("nodes").alias("n_nodes"))


@query()
def layered_chunks(spark, sf_dir):
    made = chunk.chunk_documents(_markdown(spark, sf_dir), chunk.Layered(128, 0.1))
    return made.select("document_id", F.inline("chunks")).select("document_id", "node_id", "chunk_seq", "heading_path", "tokens", "oversized", F.md5("embedding_text").alias("digest"))


@query()
def fixed_chunks(spark, sf_dir):
    made = chunk.chunk_documents(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("body")), chunk.Fixed(128, 16))
    return made.select("document_id", F.inline("chunks")).select("document_id", "chunk_seq", "tokens", F.md5("text").alias("digest"))


# --- documents whose rows SQL can tell: the markdown is made from columns ---


def _catalogue(spark, sf_dir) -> DataFrame:
    """A document for each part, with every kind of block, like titles, a defined link and references."""
    body = """# {p_brand}

*{p_name}* of [{p_type}](t.md).

## Sizes

- size {p_size}
- of `{p_name}`

| key | size |
| - | - |
| {p_partkey} | {p_size} |

![{p_name}](f/{p_partkey}.png "{p_type}")

## Sizes

> As [above][a].

[A]: above.md

# References

## Inner

- none
"""
    parts = re.split(r"\{(\w+)\}", body)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)]).alias("body"))


def _id_sql(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 16)"


_SECTIONS = f"""WITH one AS (SELECT *, {_id_sql("''", "''", "'0'", "'0'")} AS root FROM part),
    two AS (SELECT *, {_id_sql("root", "p_brand", "'1'", "'0'")} AS top FROM one),
    three AS (SELECT *, {_id_sql("top", "'Sizes'", "'2'", "'0'")} AS a, {_id_sql("top", "'Sizes'", "'2'", "'1'")} AS b FROM two)"""


@query(
    _SECTIONS
    + """ SELECT p_partkey AS document_id, root AS node_id, NULL AS parent_id, '' AS path, 0 AS level, 0 AS sort_order FROM three
    UNION ALL SELECT p_partkey, top, root, p_brand, 1, 1 FROM three
    UNION ALL SELECT p_partkey, a, top, p_brand || '/Sizes', 2, 2 FROM three
    UNION ALL SELECT p_partkey, b, top, p_brand || '/Sizes', 2, 3 FROM three"""
)
def section_tree(spark, sf_dir):
    made = chunk.chunk_documents(_catalogue(spark, sf_dir), chunk.Layered())
    return chunk.node_rows(made).select("document_id", "node_id", "parent_id", F.array_join("heading_path", "/").alias("path"), "level", "sort_order")


@query(
    _SECTIONS
    + f""", texts AS (SELECT p_partkey AS document_id, top AS node_id, p_brand AS path, p_name || ' of ' || p_type || '.' AS text, 'paragraph' AS kinds, '' AS figures FROM three
    UNION ALL SELECT p_partkey, a, p_brand || ' > Sizes', concat_ws(chr(10) || chr(10), 'size ' || p_size, 'of ' || p_name, concat_ws(chr(10), '| key | size |', '| --- | --- |', '| ' || p_partkey || ' | ' || p_size || ' |'), p_name, p_type),
        'paragraph,paragraph,table,figure', 'f/' || p_partkey || '.png' FROM three
    UNION ALL SELECT p_partkey, b, p_brand || ' > Sizes', 'As above.', 'paragraph', '' FROM three)
    SELECT document_id, node_id, 0 AS chunk_seq, text, path || chr(10) || chr(10) || text AS embedding_text, kinds, figures, len(regexp_extract_all(text, '[\\p{{L}}]+|[\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]+'))::INTEGER AS tokens FROM texts"""
)
def section_chunks(spark, sf_dir):
    made = chunk.chunk_documents(_catalogue(spark, sf_dir), chunk.Layered())
    kinds, figures = F.array_join(F.col("blocks.block_type"), ","), F.array_join(F.col("figures.src"), ",")
    return chunk.chunk_rows(made).select("document_id", "node_id", "chunk_seq", "text", "embedding_text", kinds.alias("kinds"), figures.alias("figures"), "tokens")


@query("SELECT p_partkey AS document_id, 'References' AS pruned FROM part")
def pruned_sections(spark, sf_dir):
    made = chunk.chunk_documents(_catalogue(spark, sf_dir), chunk.Layered())
    return made.select("document_id", F.array_join("pruned", "|").alias("pruned"))


def _orders(spark, sf_dir, words, sep: str, end: str) -> DataFrame:
    """A document for each order: a stretch of words for each line."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"))
    text = F.concat(F.lit("line "), F.col("n").cast("string"), F.expr(f"repeat(' word', {words})"), F.lit(end))
    held = lines.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "q", text.alias("text")))).alias("x"))
    return held.select("document_id", F.array_join("x.text", sep).alias("body"))


def _prefixes_sql(words: str, more: int, end: str) -> str:
    """Orders' lines with the tokens before each: ``p[k + 1]`` are those of the first ``k``."""
    return f"""b AS (SELECT l_orderkey AS d, l_linenumber AS n, l_quantity::INTEGER AS q FROM lineitem),
    c AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY n, q) AS r, {more} + {words} AS t, 'line ' || n || repeat(' word', {words}) || '{end}' AS x FROM b),
    l AS (SELECT d, list_prepend(0, list(s ORDER BY r)) AS p, list(x ORDER BY r) AS xs, count(*)::INTEGER AS n FROM (SELECT d, r, x, sum(t) OVER (PARTITION BY d ORDER BY r)::INTEGER AS s FROM c) GROUP BY d)"""


_SOME_LONG = "CASE WHEN q % 5 = 0 THEN 30 ELSE q % 9 END"


@query(
    f"""WITH RECURSIVE {_prefixes_sql(_SOME_LONG, 2, "")},
    k AS (SELECT d, 0 AS seq, 0 AS a, greatest(1, coalesce(list_max(list_filter(range(1, n + 1), lambda x: p[x + 1] <= 24)), 1))::INTEGER AS e FROM l
    UNION ALL SELECT d, seq + 1, a, greatest(m + 1, coalesce(list_max(list_filter(range(m + 1, n + 1), lambda x: p[x + 1] - p[a + 1] <= 24)), m + 1))::INTEGER
    FROM (SELECT d, seq, n, p, m, (CASE WHEN f < m AND p[m + 2] - p[f + 1] > 24 THEN m ELSE f END)::INTEGER AS a
    FROM (SELECT k.d, k.seq, l.n, l.p, k.e AS m, list_min(list_filter(range(k.a, k.e + 1), lambda j: l.p[k.e + 1] - l.p[j + 1] <= 9)) AS f FROM k JOIN l USING (d) WHERE k.e < l.n)))
    SELECT d AS document_id, seq AS chunk_seq, a AS first_block, e - a AS n_blocks, p[e + 1] - p[a + 1] AS tokens, p[e + 1] - p[a + 1] > 24 AS oversized FROM k JOIN l USING (d)"""
)
def packed_blocks(spark, sf_dir):
    """Paragraphs of 2 to 32 tokens in chunks of 24, which begin with at most 9 tokens of the chunk before."""
    made = chunk.chunk_documents(_orders(spark, sf_dir, _SOME_LONG, "\n\n", ""), chunk.Layered(24, 0.4))
    return chunk.chunk_rows(made).select("document_id", "chunk_seq", F.col("blocks")[0]["block_index"].alias("first_block"), F.size("blocks").alias("n_blocks"), "tokens", "oversized")


@query(
    f"""WITH RECURSIVE {_prefixes_sql("q % 9", 3, ".")},
    k AS (SELECT d, 0 AS seq, 0 AS a, list_max(list_filter(range(1, n + 1), lambda x: p[x + 1] <= 24))::INTEGER AS e FROM l
    UNION ALL SELECT d, seq + 1, a, list_max(list_filter(range(a + 1, n + 1), lambda x: p[x + 1] - p[a + 1] <= 24))::INTEGER
    FROM (SELECT k.d, k.seq, l.n, l.p, greatest(k.a + 1, list_min(list_filter(range(k.a, k.e), lambda j: l.p[k.e + 1] - l.p[j + 1] <= 8 OR j = k.e - 1)))::INTEGER AS a FROM k JOIN l USING (d) WHERE k.e < l.n))
    SELECT d AS document_id, seq AS chunk_seq, p[e + 1] - p[a + 1] AS tokens, array_to_string(xs[a + 1:e], ' ') || CASE WHEN e < n THEN ' ' ELSE '' END AS text FROM k JOIN l USING (d)"""
)
def fixed_texts(spark, sf_dir):
    """Sentences of 3 to 11 tokens in chunks of 24, which begin with about 8 tokens of the chunk before."""
    made = chunk.chunk_documents(_orders(spark, sf_dir, "q % 9", " ", "."), chunk.Fixed(24, 8))
    return chunk.chunk_rows(made).select("document_id", "chunk_seq", "tokens", "text")


@query(
    """SELECT f AS filename, CASE WHEN k = 0 THEN 'Body ' || s_suppkey END AS body, CASE WHEN k = 0 THEN s_name END AS name, CASE WHEN k = 0 THEN s_nationkey::VARCHAR END AS nation,
    CASE WHEN k = 0 THEN '["a","n' || s_nationkey || '"]' END AS tags,
    CASE k WHEN 1 THEN f || ': the document has no frontmatter' WHEN 2 THEN f || ': the frontmatter is missing the required ''type'' field' WHEN 3 THEN f || ': invalid frontmatter yaml' END AS error
    FROM (SELECT *, s_suppkey % 4 AS k, s_suppkey || '.md' AS f FROM supplier)"""
)
def parsed_documents(spark, sf_dir):
    """Documents with frontmatter, without, without its type, and with YAML that cannot be read."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    good = F.concat(F.lit('---\ntype: supplier\nname: "'), F.col("s_name"), F.lit('"\nnation: '), nation, F.lit("\ntags: [a, n"), nation, F.lit("]\n---\nBody "), key)
    k = F.pmod("s_suppkey", F.lit(4))
    content = F.when(k == 0, good).when(k == 1, F.concat(F.lit("Body "), key)).when(k == 2, "---\nname: x\n---\nBody").otherwise("---\ntype: [open\n---\nBody")
    rows = documents.parsed(read(spark, sf_dir, "supplier").select(F.concat(key, F.lit(".md")).alias("filename"), content.alias("content")))
    of = lambda name: F.get_json_object("frontmatter", f"$.{name}").alias(name)
    return rows.select("filename", "body", of("name"), of("nation"), of("tags"), F.substring_index("error", ":", 2).alias("error"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents),
    n AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) > 3 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM n)
    SELECT d.doc_id, CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(r.w, ' ' ORDER BY r.r), 'text') END AS markers, NULL::VARCHAR AS error
    FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r.r <= 5 GROUP BY d.doc_id"""
)
def keyword_markers(spark, sf_dir):
    """Markers of whole texts by the provider that needs no service, as they are joined before they are embedded."""
    rows = read(spark, sf_dir, "documents").select("doc_id", providers.marker_outcomes(providers.KeywordChat(), F.col("text")).alias("m"))
    return rows.select("doc_id", F.array_join("m.value", " ").alias("markers"), "m.error")


@query(
    r"""SELECT * FROM (SELECT n_nationkey, round(len(list_distinct(regexp_extract_all(lower(n_name || ' of region ' || n_regionkey), '[\p{L}\p{N}_]+')
        .list_filter(lambda w: list_contains(['region', '1', 'with', 'of', '3'], w)))) / 5.0::DOUBLE, 6) AS relevance FROM nation) ORDER BY relevance DESC, n_nationkey LIMIT 10"""
)
def rerank_overlap(spark, sf_dir):
    """The ten most relevant of a list of candidates by the share of the question's words that they have."""
    nations = read(spark, sf_dir, "nation")
    text = F.concat("n_name", F.lit(" of region "), F.col("n_regionkey").cast("string"))
    rows = _rows(nations.orderBy("n_nationkey"), document_id=F.col("n_nationkey"), text=text).withColumns({"distance": F.lit(0.0), "source": F.lit("VECTOR")})
    found = retrieval.rerank(spark, providers.OverlapReranker(), "Region 1 with, of 3", rows, 10)
    return found.select(_as(spark, sf_dir, "nation", "n_nationkey"), F.round("relevance", 6).alias("relevance"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.v1' WHEN 2 THEN '.' || p_type ELSE '' END AS stem FROM part"""
)
def stem_of(spark, sf_dir):
    """Names with an ending, with two, hidden ones and an empty one."""
    k = F.pmod("p_partkey", F.lit(4))
    name = F.when(k == 0, F.concat("p_name", F.lit(".md"))).when(k == 1, F.concat("p_name", F.lit(".v1.md"))).when(k == 2, F.concat(F.lit("."), F.col("p_type"))).otherwise("")
    return read(spark, sf_dir, "part").select("p_partkey", text.stem_of(name).alias("stem"))


@query("SELECT p_partkey, lower(trim(t)) IN ('references', 'bibliography', '参考文献', '参考资料') AS listed FROM (SELECT p_partkey, ['References', ' BIBLIOGRAPHY ', '参考文献', '参考资料', 'Reference', 'My references', p_name][(p_partkey % 7 + 1)::INTEGER] AS t FROM part)")
def reference_title(spark, sf_dir):
    titles = F.array(*[F.lit(t) for t in ("References", " BIBLIOGRAPHY ", "参考文献", "参考资料", "Reference", "My references")], F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", text.is_reference_title(F.get(titles, F.pmod("p_partkey", F.lit(7)).cast("int"))).alias("listed"))


@query("SELECT p_partkey, CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.0f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS size FROM (SELECT p_partkey, 2 * p_partkey * p_partkey * 37 + 2 * p_size + 1 AS n FROM part)")
def format_bytes(spark, sf_dir):
    n = F.col("p_partkey") * F.col("p_partkey") * 74 + F.col("p_size") * 2 + 1
    return read(spark, sf_dir, "part").select("p_partkey", text.format_bytes(n).alias("size"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE ' (generated: ' || o_orderpriority || ')' END END AS date FROM orders")
def result_date(spark, sf_dir):
    """Orders as documents made at a time, by whom it is known or not, and ones that do not tell."""
    k = F.pmod("o_orderkey", F.lit(3))
    made = F.struct(F.when(k > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("at"), F.when(k == 2, F.col("o_orderpriority")).alias("by"))
    return read(spark, sf_dir, "orders").select("o_orderkey", frontmatter.result_date(F.to_json(F.struct(made.alias("generated")))).alias("date"))


@query("SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS place FROM (SELECT DISTINCT o_custkey FROM orders)")
def numbered_keys(spark, sf_dir):
    """Numbers without gaps; which key has which one is the store's choice, so keys and numbers are paired in order."""
    keys = read(spark, sf_dir, "orders").select("o_custkey").distinct()
    places = in_order(catalog.numbered(keys, ["o_custkey"], "place").select("place").orderBy("place"), "at", 1)
    return in_order(keys.orderBy("o_custkey"), "at", 1).join(places, "at").select("o_custkey", "place")


# --- evaluation ---


def _runs(spark, sf_dir):
    """Documents by id as ranked lists of ten; a query's facts are benchmark passages dealt to it."""
    docs = read(spark, sf_dir, "documents")
    runs = docs.select(F.lit("plain").alias("arm"), F.floor(F.col("doc_id") / 10).cast("long").alias("query_id"), (F.pmod("doc_id", F.lit(10)) + 1).alias("rank"), "text", tokens.token_count(F.col("text")).cast("long").alias("tokens"))
    n = F.lit(20)
    queries = docs.select(F.floor(F.col("doc_id") / 10).cast("long").alias("query_id")).distinct()
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fact_no"), F.col("text").alias("fact"), F.pmod("item_id", n).alias("_m"))
    facts = queries.withColumn("_m", F.pmod("query_id", n)).join(items, "_m").select("query_id", F.concat(F.lit("t"), F.pmod("query_id", F.lit(3)).cast("string")).alias("question_type"), "fact_no", "fact")
    return runs, facts


_EVAL = rf"""WITH runs AS (SELECT doc_id // 10 AS query_id, doc_id % 10 + 1 AS rank, replace(replace(text, ' ', ''), chr(10), '') AS t, len(regexp_extract_all(text, {_TOKEN_SQL})) AS tokens FROM documents),
    facts AS (SELECT DISTINCT d.doc_id // 10 AS query_id, b.item_id AS fact_no, replace(replace(b.text, ' ', ''), chr(10), '') AS f FROM documents d JOIN benchmark b ON b.item_id % 20 = (d.doc_id // 10) % 20),
    n AS (SELECT query_id, count(*) AS nf FROM facts GROUP BY query_id),
    first AS (SELECT query_id, fact_no, min(rank) AS rank FROM runs JOIN facts USING (query_id) WHERE contains(t, f) GROUP BY ALL),
    rel AS (SELECT query_id, rank, count(*) AS relevance FROM first GROUP BY ALL),
    scored AS (SELECT r.query_id, r.rank, r.tokens, coalesce(rel.relevance, 0) AS relevance,
        (sum(r.tokens) OVER (PARTITION BY r.query_id ORDER BY r.rank))::BIGINT AS spent FROM runs r LEFT JOIN rel USING (query_id, rank) JOIN n USING (query_id))"""


@query(_EVAL + " SELECT query_id, count(*) FILTER (WHERE spent <= 2048) AS n_fit, max(spent) AS tokens FROM scored GROUP BY query_id")
def budget_prefix(spark, sf_dir):
    runs, facts = _runs(spark, sf_dir)
    scored = evaluate.relevances(runs, facts).join(facts.select("query_id").distinct(), "query_id", "left_semi")
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spent = scored.withColumn("spent", F.sum("tokens").over(upto))
    return spent.groupBy("query_id").agg(F.count_if(F.col("spent") <= 2048).alias("n_fit"), F.max("spent").alias("tokens"))


_RECALL = ", ".join(f"round(coalesce(sum(relevance) FILTER (WHERE spent <= {b}), 0) / any_value(nf), 6) AS recall_{b}" for b in evaluate.BUDGETS)


@query(_EVAL + f" SELECT query_id, {_RECALL} FROM scored JOIN n USING (query_id) GROUP BY query_id")
def recall_at_budget(spark, sf_dir):
    runs, facts = _runs(spark, sf_dir)
    out = evaluate.budget_recall(evaluate.relevances(runs, facts), facts)
    return out.select("query_id", *[F.round(f"recall_{b}", 6).alias(f"recall_{b}") for b in evaluate.BUDGETS])


def _ndcg_sql(b: int) -> str:
    ideal = f"list_sum(list_transform(range(1, least(any_value(nf), count(*) FILTER (WHERE spent <= {b})) + 1), lambda i: 1.0 / log2(i + 1)))"
    return f"round(CASE WHEN count(*) FILTER (WHERE spent <= {b}) = 0 THEN 0 ELSE coalesce(sum(relevance / log2(rank + 1)) FILTER (WHERE spent <= {b}), 0) / {ideal} END, 6) AS ndcg_{b}"


@query(_EVAL + f" SELECT query_id, {', '.join(_ndcg_sql(b) for b in evaluate.BUDGETS)} FROM scored JOIN n USING (query_id) GROUP BY query_id")
def ndcg(spark, sf_dir):
    runs, facts = _runs(spark, sf_dir)
    out = evaluate.budget_recall(evaluate.relevances(runs, facts), facts)
    return out.select("query_id", *[F.round(f"ndcg_{b}", 6).alias(f"ndcg_{b}") for b in evaluate.BUDGETS])


_PAPER = """paper AS (SELECT query_id, coalesce(sum(relevance / rank), 0) / least(any_value(nf), 10) AS map_10, coalesce(1.0 / min(rank) FILTER (WHERE relevance > 0), 0) AS mrr_10,
    (coalesce(sum(relevance) FILTER (WHERE rank <= 4), 0) > 0)::INTEGER::DOUBLE AS hit_4, (sum(relevance) > 0)::INTEGER::DOUBLE AS hit_10 FROM scored JOIN n USING (query_id) WHERE rank <= 10 GROUP BY query_id)"""
_METRICS = ("map_10", "mrr_10", "hit_4", "hit_10")
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)


@query(f"{_EVAL}, {_PAPER} SELECT query_id, {_ROUNDED} FROM paper")
def map_mrr_hit(spark, sf_dir):
    runs, facts = _runs(spark, sf_dir)
    out = evaluate.paper_metrics(evaluate.relevances(runs, facts), facts)
    return out.select("query_id", *[F.round(m, 6).alias(m) for m in _METRICS])


@query(
    f"""{_EVAL}, {_PAPER} SELECT 't' || (query_id % 3) AS question_type, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)} FROM paper GROUP BY 1
    UNION ALL SELECT NULL, count(*), {', '.join(f'round(avg({m}), 6)' for m in _METRICS)} FROM paper"""
)
def eval_summary(spark, sf_dir):
    runs, facts = _runs(spark, sf_dir)
    metrics = evaluate.paper_metrics(evaluate.relevances(runs, facts), facts)
    out = evaluate.summarize(metrics, facts)
    return out.select("question_type", "n", *[F.round(m, 6).alias(m) for m in _METRICS])


@query(
    """WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, n, n * 101.0::DOUBLE / (SELECT sum(n) FROM s) AS x FROM s),
    r AS (SELECT lang, n, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, lang) AS p, 101 - sum(floor(x)) OVER () AS missing FROM e)
    SELECT lang, n, (f + CASE WHEN p <= missing THEN 1 ELSE 0 END)::BIGINT AS quota FROM r"""
)
def stratified_quota(spark, sf_dir):
    return evaluate.quotas(read(spark, sf_dir, "documents").select("lang"), 101, "lang")


# --- sinks ---


@query(
    r"""SELECT md5('---' || chr(10) || 'type: article' || chr(10) || 'title: "' || replace(p_name, '"', '\"') || '"' || chr(10) || 'resource: "u' || p_partkey || '"' || chr(10)
    || 'generated: { by: process:corpus-import }' || chr(10) || 'source: "' || p_brand || '"' || chr(10) || 'category: "' || p_type || '"' || chr(10) || '---' || chr(10) || chr(10)
    || '# ' || p_name || chr(10) || chr(10) || p_type || chr(10)) AS digest, p_partkey FROM part"""
)
def doc_markdown(spark, sf_dir):
    corpus = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("author"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_brand").alias("source"), F.col("p_type").alias("category"), F.col("p_type").alias("body"))
    made = files.corpus_markdown(corpus)
    return made.select(F.md5("content").alias("digest"), F.regexp_extract("filename", "^([0-9]+)-", 1).cast("long").alias("p_partkey"))


@query("SELECT event_id, event_type, value FROM events")
def jsonl_roundtrip(spark, sf_dir):
    from tessera.functions.scratch import scratch_path

    at = scratch_path(spark, "jsonl")
    files.write_jsonl(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), at)
    return files.read_jsonl(spark, at, "event_id long, event_type string, value double")
