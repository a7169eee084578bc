"""Retrieval evaluation: sampling of queries and metrics under token budgets.

Runs have a row for each retrieved chunk (``arm``, ``query_id``, ``rank`` from 1,
``text``, ``tokens``), queries one for each fact (``query_id``, ``question_type``,
``fact_no``, ``fact``).  Facts are told apart by their number, so that a repeated
fact counts twice.  Texts are compared without spaces and line feeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize

BUDGETS = (512, 1024, 2048, 4096)


def quotas(strata: DataFrame, total: int, by: str = "question_type") -> DataFrame:
    """Largest-remainder quotas: ``by``, ``n`` and ``quota``, which sum to ``total``.

    ``strata`` has a row for each member; a small table of strata is all that is
    ranked.  Ties of remainders go by name.
    """
    sizes = strata.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("_all"))
    exact = F.col("n") * F.lit(total) / F.col("_all")
    share = sizes.join(F.broadcast(whole)).withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    place = F.row_number().over(Window.orderBy(F.col("_rest").desc(), by))
    missing = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    return share.select(by, "n", (F.col("_floor") + (place <= missing).cast("long")).alias("quota"))


def stratified_sample(queries: DataFrame, total: int, seed: int = 42, by: str = "question_type", key: str = "id") -> DataFrame:
    """``total`` queries by quota, those of least hash in each stratum, in order of their key.

    Queries of type ``null_query`` or without evidence are not eligible.
    """
    eligible = queries.filter((F.col(by) != "null_query") & (F.size("facts") > 0))
    n = eligible.count()
    if not 0 < total <= n:
        raise ValueError(f"{total} queries are asked for and {n} are eligible")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(key, F.lit(seed)), key))
    picked = eligible.withColumn("_rank", rank).join(F.broadcast(quotas(eligible, total, by).select(by, "quota")), by)
    return picked.filter(F.col("_rank") <= F.col("quota")).select(*queries.columns).orderBy(key)


def gains(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """For each arm, query and fact the rank of the first chunk that has it (no row for a fact never found)."""
    chunks = runs.select("arm", "query_id", "rank", normalize(F.col("text")).alias("_t"))
    wanted = facts.select("query_id", "fact_no", normalize(F.col("fact")).alias("_f"))
    return chunks.join(wanted, "query_id").filter(F.contains("_t", F.col("_f"))).groupBy("arm", "query_id", "fact_no").agg(F.min("rank").alias("rank"))


def relevances(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Runs (arm, query_id, rank, tokens) with ``relevance``: facts first found there."""
    first = gains(runs, facts).groupBy("arm", "query_id", "rank").agg(F.count(F.lit(1)).alias("relevance"))
    return runs.select("arm", "query_id", "rank", "tokens").join(first, ["arm", "query_id", "rank"], "left").fillna(0, ["relevance"])


def budget_recall(scored: DataFrame, facts: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """``recall@b`` and ``ndcg@b`` for each arm, query and budget: the longest run of chunks that fits.

    The ideal has a fact in each of the first chunks, so a chunk with several
    facts can bring the gain above 1.
    """
    upto = Window.partitionBy("arm", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    n_facts = facts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_facts"))
    rows = scored.withColumn("_sum", F.sum("tokens").over(upto)).join(n_facts, "query_id")
    discount = F.log2(F.col("rank") + 1)
    columns = []
    for b in budgets:
        fits = F.col("_sum") <= b
        columns += [F.sum(F.when(fits, F.col("relevance")).otherwise(0)).alias(f"_hits{b}"), F.sum(F.when(fits, F.col("relevance") / discount).otherwise(0.0)).alias(f"_dcg{b}"), F.count_if(fits).alias(f"_n{b}")]
    each = rows.groupBy("arm", "query_id", "n_facts").agg(*columns)

    def ideal(b: int):
        n = F.least(F.col("n_facts"), F.col(f"_n{b}")).cast("int")
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))).otherwise(0.0)

    out = [e for b in budgets for e in ((F.col(f"_hits{b}") / F.col("n_facts")).alias(f"recall_{b}"), F.when(F.col(f"_n{b}") > 0, F.col(f"_dcg{b}") / F.when(ideal(b) > 0, ideal(b))).otherwise(0.0).alias(f"ndcg_{b}"))]
    return each.select("arm", "query_id", *out).fillna(0.0)


def paper_metrics(scored: DataFrame, facts: DataFrame) -> DataFrame:
    """``map_10``, ``mrr_10``, ``hit_4`` and ``hit_10`` for each arm and query."""
    n_facts = facts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_facts"))
    top = scored.filter("rank <= 10")
    relevant = F.col("relevance") > 0
    each = top.groupBy("arm", "query_id").agg(
        F.sum(F.col("relevance") / F.col("rank")).alias("_ap"),
        F.min(F.when(relevant, F.col("rank"))).alias("_first"),
        F.sum(F.when(F.col("rank") <= 4, F.col("relevance")).otherwise(0)).alias("_at4"),
        F.sum("relevance").alias("_at10"),
    )
    rows = each.join(n_facts, "query_id")
    return rows.select(
        "arm",
        "query_id",
        (F.col("_ap") / F.least("n_facts", F.lit(10))).alias("map_10"),
        F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)).alias("mrr_10"),
        (F.col("_at4") > 0).cast("double").alias("hit_4"),
        (F.col("_at10") > 0).cast("double").alias("hit_10"),
    )


def summarize(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """Means by arm and question type, and by arm (``question_type`` null) in one pass; 0 for nothing."""
    names = [c for c in metrics.columns if c not in ("arm", "query_id")]
    rows = metrics.join(queries.select("query_id", "question_type").distinct(), "query_id")
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names]
    return rows.groupingSets([[F.col("arm"), F.col("question_type")], [F.col("arm")]], "arm", "question_type").agg(F.count(F.lit(1)).alias("n"), *means)
