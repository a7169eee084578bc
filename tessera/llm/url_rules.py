"""URL filtering: fixed host and path rules, and association rules mined from labels.

Spark's FP-growth finds combinations of URL tokens among the pages with bad labels.  A
combination becomes a rule if enough bad pages have it, and the share of bad ones among
all labelled pages that have it is both well over the share among all (``MIN_LIFT``) and
further from it than chance explains (``DEVIATIONS``), unless a part of it is a rule
whose confidence is no less than chance explains.  Rules are kept in an inverted index under their rarest token, so
that a page is compared only with rules whose index token it has.

What FP-growth gets is bounded: tokens that the same labelled pages have are one item,
and a page gives it its ``MINED_TOKENS`` most common items.  If a bad page has more, the
combinations that this may miss are found level by level over all items of all pages
(``wider``), so no rule is lost.  Supports and confidences are then counted on whole
token sets, and pages are judged by all their tokens.

Nulls and edge cases: a null url, or one without ``://``, has an empty host and
path, no tokens and is allowed; labels with nulls count as not bad; several
labels of a page count as bad if one is; a page without label is judged but not
learnt from; without any label there are no mined rules; equal urls get equal
verdicts and repeated rows stay; other columns are not looked at.

Everything runs in the JVM: DataFrame functions and Spark ML.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._base import scoped, sized, table, written


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and a path, such as ``example.net/en/``."""

    text: str
    verdict: str


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))

#: A rule needs this many bad pages that it fits.
MIN_BAD = 20
#: The share of bad pages among those that it fits must be this many times that among all, or half way from that to 1.
MIN_LIFT = 2.0
#: And exceed it by this many standard deviations of chance.
DEVIATIONS = 4.0
#: Items that a page gives to FP-growth at most; combinations beyond them are found by ``wider``.
MINED_TOKENS = 12


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    none = F.lit("")
    return F.coalesce(lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), none), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), none)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    name, _, rest = rule.text.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def fixed_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits, else null."""
    none = F.lit(None).cast("string")
    by_length = sorted(rules, key=lambda r: -len(r.text))
    return F.coalesce(*[F.when(fits(r, host, path), r.text) for r in by_length], none), F.coalesce(*[F.when(fits(r, host, path), r.verdict) for r in by_length], none)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, folders of the path, names of parameters, and shapes."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    some = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    scheme = F.array(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    shapes = F.array(
        F.concat(F.lit("labels="), F.size(F.split(host, r"\.")).cast("string")),
        F.concat(F.lit("depth="), F.size(folders).cast("string")),
        F.when(host.contains("-"), "hyphen").otherwise(""),
        F.when(host.rlike("[0-9]"), "digits").otherwise(""),
    )
    ending = F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))
    all_ = F.concat(some("scheme=", scheme), some("host=", F.split(host, r"\.")), some("path=", folders), some("query=", names), some("ending=", ending), some("shape:", shapes))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(all_))


def _contained(pages: DataFrame, sets: DataFrame) -> DataFrame:
    """Pages (columns and ``_tokens``) with the sets (``rule_tokens``, ``index_token``, ...) that they contain."""
    return pages.withColumn("index_token", F.explode("_tokens")).join(sized(sets), "index_token").filter(F.size(F.array_except("rule_tokens", "_tokens")) == 0)


def wider(rows: DataFrame, least_bad: int, good: Column, deviations: float) -> DataFrame:
    """``rule_tokens`` (sorted) of all combinations that may be rules that last, whatever the number of a page's items.

    ``rows`` has ``_id``, ``_bad`` and all ``items`` (sorted) of the labelled pages; ``good`` says of ``b`` bad ones
    among ``pages`` whether a combination is a rule.  A combination of which a part has the same pages is left out, with
    all that contain it: the part has the same confidence, so they are spare.  So are those with a rule of confidence c
    among their parts that have too few bad pages b to be told from it even if all their pages are bad:
    b (1 - c) < deviations ** 2 c.  A level extends the last one's combinations by items behind their last.
    """
    levels: list[DataFrame] = []
    at = written(rows.select("_id", "_bad", F.array().cast("array<string>").alias("set"), "items"), "level")
    while True:
        more = at.select("_id", "_bad", "set", F.posexplode("items").alias("_p", "t"), F.col("items").alias("_of"))
        longer = more.select("_id", "_bad", F.concat("set", F.array("t")).alias("set"), F.expr("slice(_of, _p + 2, size(_of))").alias("items"))
        counted = longer.groupBy("set").agg(F.count(F.lit(1)).alias("pages"), F.sum("_bad").alias("b")).filter(F.col("b") >= least_bad)
        if levels:
            # every part with one item less is there, and has more pages
            counted = written(counted, "counted")
            part = F.explode(F.transform("set", lambda x: F.array_except("set", F.array(x)))).alias("_part")
            known = levels[-1].filter("goes_on").select(F.col("set").alias("_known"), F.col("pages").alias("_pages"))
            whole = counted.select("set", "pages", part).join(sized(known), F.col("_part") == F.col("_known")).filter("_pages > pages")
            free = written(whole.groupBy(F.col("set").alias("_free")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = size(_free)").select("_free"), "free")
            counted = counted.join(sized(free), F.col("set") == F.col("_free"), "left_semi")
        c = F.col("b") / F.col("pages")
        ends = good & ((F.col("b") == F.col("pages")) | (F.col("b") * (1 - c) < deviations**2 * c * (1 - 1e-9)))
        level = written(counted.withColumn("goes_on", ~ends), "sets")
        levels.append(level)
        on = written(level.filter("goes_on").select(F.col("set").alias("_set")), "on")
        if on.isEmpty():
            break
        at = written(longer.filter("size(items) > 0").join(sized(on), F.col("set") == F.col("_set"), "left_semi"), "level")
    found = levels[0].select("set")
    for level in levels[1:]:
        found = found.unionByName(level.select("set"))
    return found.select(F.col("set").alias("rule_tokens"))


def mine(labelled: DataFrame, min_bad: int = MIN_BAD, min_lift: float = MIN_LIFT, deviations: float = DEVIATIONS, min_confidence: float | None = None) -> DataFrame:
    """Rules (rule_tokens, index_token, confidence, pages) from rows of ``tokens`` and boolean ``bad``.

    ``min_confidence``, if given, stands in the place of what ``min_lift`` asks for.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "rule_tokens array<string>, index_token string, confidence double, pages long")
    rows = labelled.filter("size(tokens) > 0").select(F.col("tokens").alias("_tokens"), F.coalesce("bad", F.lit(False)).cast("int").alias("_bad"))
    rows = written(rows.withColumn("_id", F.monotonically_increasing_id()), "labelled")
    n, n_bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_bad"), F.lit(0))).first()
    if n_bad < min_bad:
        return none
    base = n_bad / n
    # tokens that the same pages have are told by two sums over those and are one item, the least of them
    each = rows.select("_id", "_bad", F.explode("_tokens").alias("t"))
    seen = each.groupBy("t").agg(F.count(F.lit(1)).alias("f"), F.sum("_bad").alias("b"), F.sum(F.xxhash64("_id").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("_id", F.lit("other"))).alias("y"))
    items = written(seen.filter(F.col("b") >= min_bad).groupBy("f", "x", "y").agg(F.min("t").alias("t")).select("t", "f"), "items")
    common = each.filter("_bad = 1").join(sized(items), "t")
    whole = common.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("f", "t")), asc=False)["t"].alias("_items"))
    baskets = written(whole.select(F.slice("_items", 1, MINED_TOKENS).alias("items"), (F.size("_items") > MINED_TOKENS).alias("_more")), "baskets")
    n_baskets, more = baskets.agg(F.count(F.lit(1)), F.max("_more")).first()
    if not n_baskets:
        return none
    least = min_confidence if min_confidence is not None else min(min_lift * base, (1 + base) / 2)
    chance = F.sqrt(F.col("pages") * base * (1 - base))
    good = (F.col("b") >= min_bad) & (F.col("b") >= least * F.col("pages")) & (F.col("b") - F.col("pages") * base >= deviations * chance)
    # of the sets that bad pages have often enough; a little is left to the rounding of the share
    found = FPGrowth(itemsCol="items", minSupport=(min_bad - 0.5) / n_baskets, minConfidence=1.0).fit(baskets.select("items")).freqItemsets
    sets = found.select(F.array_sort("items").alias("rule_tokens"))
    if more:
        every = each.join(sized(items), "t").groupBy("_id", "_bad").agg(F.array_sort(F.collect_list("t")).alias("items"))
        sets = sets.unionByName(wider(every, min_bad, good, deviations)).distinct()
    sets = written(sets, "itemsets")
    rarest = sets.select("rule_tokens", F.explode("rule_tokens").alias("t")).join(sized(items), "t").groupBy("rule_tokens").agg(F.min(F.struct("f", "t"))["t"].alias("index_token"))
    counted = _contained(rows, written(rarest, "indexed")).groupBy("rule_tokens", "index_token").agg(F.count(F.lit(1)).alias("pages"), F.sum("_bad").alias("b"))
    rules = written(counted.filter(good).select("rule_tokens", "index_token", (F.col("b") / F.col("pages")).alias("confidence"), "pages"), "rules")
    # a rule goes if a part of it is a rule whose confidence is no less, but for chance
    whole = rules.select(F.col("rule_tokens").alias("_tokens"), F.col("confidence").alias("_of"), F.col("pages").alias("_pages"))
    likely = F.col("confidence") + deviations * F.sqrt(F.col("confidence") * (1 - F.col("confidence")) / F.col("_pages"))
    spare = _contained(whole, rules).filter((F.size("rule_tokens") < F.size("_tokens")) & (likely >= F.col("_of"))).select("_tokens").distinct()
    return rules.join(spare, F.col("rule_tokens") == F.col("_tokens"), "left_anti").select("rule_tokens", "index_token", "confidence", "pages")


def judge(pages: DataFrame, mined: DataFrame, fixed: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule, verdict, the mined rules that fit and the best confidence among them."""
    u = F.col("_url")
    host, path = host_and_path(u)
    rows = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"))
    told = rows.select("_url").filter("_url is not null").distinct().withColumn("_tokens", tokens(u, host, path))
    best = written(_contained(told, mined).groupBy("_url").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_mined_rules")).withColumnRenamed("_url", "_found"), "verdicts")
    out = rows.join(sized(best), u == F.col("_found"), "left")
    rule, verdict = fixed_rule(fixed, host, path)
    method = F.when(F.col("_found").isNotNull(), "block").otherwise("allow")
    return out.select(F.col("_key").alias(key), host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.coalesce("n_mined_rules", F.lit(0)).cast("long").alias("n_mined_rules"), "confidence")


@scoped
def op2_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False)).alias("bad"))
    u = F.col("url")
    labelled = pages.select("page_id", "url").join(bad, F.col("page_id") == F.col("_doc")).select(tokens(u, *host_and_path(u)).alias("tokens"), "bad")
    return judge(pages, written(mine(labelled), "mined"))
