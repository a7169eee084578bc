"""Quality rules: fixed rules, and robust multivariate outliers.

Each text gives a vector of transformed statistics.  Every language and source has
its own minimum-covariance-determinant estimate of location and scatter, found by
concentration steps: the three quarters of the documents that are nearest (by
Mahalanobis distance) to the present estimate give the next one, until the
determinant rests.  Determinants are bounded below, and steps end when none falls, so
they do end.  They go from three starts (medians and quartile ranges, spatial
signs, plain moments), and each group keeps the estimate of least determinant.
Documents beyond ``CUTOFF`` are rejected.

A group's estimate is that of its documents and of ``PRIOR`` documents like those of
its language, whose estimate in turn has ``PRIOR`` documents like those of the whole
table: a large group is judged by itself, and a small one shades into its parent.

All groups are estimated at once from sums, so that neither a large group nor many
of them gather in one place: a step adds up counts and moments in fine logarithmic
bins of the distance, and finds each group's bins up to the three-quarter point.

Nulls and edge cases: a null text is empty, and an empty one fails the fixed rules;
null languages and sources are groups of their own; features without spread have a
least variance, so no estimate is singular; a group without any document that passes
the fixed rules has no estimate, and no distance; repeated rows are judged alike; an
empty table gives an empty result; other columns of the input pass unchanged,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._base import quoted, row_columns, row_of, scoped, sized, table, written
from tessera.llm._words import Words, slices, text_bytes

#: Statistics of a text; the first five are base columns of the result.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_same")
FEATURES = 7
#: The features' least standard deviations.
LEAST_SD = (0.05, 0.02, 0.05, 0.05, 0.02, 0.02, 0.02)
#: The share of documents from which an estimate is made.
KEEP = 0.75
#: The share of Gaussian documents that the cut-off rejects.
REJECTED = 1e-6
#: Documents like its parent's in a group's estimate.
PRIOR = 50
#: Steps end when no determinant's logarithm is less than in all steps before by more than this.
AT_REST = 0.01
STARTS = ("quartiles", "signs", "moments")
_BIN = 16  # bins for each doubling of a squared distance


def chi_square(x: float, k: int) -> float:
    """The share of a chi-square distribution of ``k`` degrees of freedom up to ``x``."""
    a, y = k / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= y / n
        total += term
    return total * math.exp(a * math.log(y) - y - math.lgamma(a))


def chi_square_point(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < share else (low, mid)
    return low


#: Squared distances over this are rejected.
CUTOFF = chi_square_point(1 - REJECTED, FEATURES)
#: The covariance of a Gaussian's central ``KEEP`` is smaller than the whole's by this factor.
SHRINK = chi_square(chi_square_point(KEEP, FEATURES), FEATURES + 2) / KEEP

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARK = np.zeros(256, np.int64)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&|<>"]] = 1


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[at[1:]] - total[at[:-1]]


def same_words(w: Words, h: np.ndarray) -> np.ndarray:
    """For each document the words that equal the one before."""
    same = np.zeros(len(w), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[w.first[:-1][w.count > 0]] = 0
    return _sums(same, w.first)


def repeated_words(w: Words, h: np.ndarray, size: int = 8) -> np.ndarray:
    """For each document the words within windows of ``size`` words that it has twice or more."""
    windows, inside = w.windows(h, size)
    at = np.flatnonzero(inside)
    doc = w.doc_of()
    order = at[np.lexsort((windows[at], doc[at]))]
    same = (windows[order][1:] == windows[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(w) + size + 1, np.int64)
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    starts = order[hit]
    again[starts] += 1
    np.subtract.at(again, starts + size, 1)
    return _sums((np.cumsum(again)[: len(w)] > 0).astype(np.int64), w.first)


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in text.split(b"\n") if x and x.split(None, 1)]
    return len(lines) - len(set(lines)), len(lines)


def statistics(column: pa.Array) -> list[np.ndarray]:
    data, offsets = text_bytes(column)
    out: list[list[np.ndarray]] = [[] for _ in STATS]
    for i, j in slices(offsets):
        w = Words(data, offsets, i, j)
        h = w.hashes()
        chars = w.solid & ((w.buf & 0xC0) != 0x80)
        raw = w.buf.tobytes()
        lines = np.array([duplicate_lines(raw[a:b]) for a, b in zip(w.docs[:-1], w.docs[1:], strict=True)], np.int64).reshape(-1, 2)
        for to, x in zip(out, (w.count, _sums(chars, w.docs), _sums(_SYMBOL[w.buf], w.docs), lines[:, 0], repeated_words(w, h), lines[:, 1], _sums(_UPPER[w.buf], w.docs), _sums(_MARK[w.buf], w.docs), same_words(w, h)), strict=True):
            to.append(x.astype(np.int64))
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def with_statistics(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) with a column ``_q_...`` for each statistic."""
    columns = docs.columns if columns is None else columns
    kept = docs.select(*columns, F.col(text).alias("_q_text"))
    schema = docs.select(*columns).schema
    for s in STATS:
        schema = schema.add(f"_q_{s}", "long")
    names = schema.names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(x) for x in found]], names=names)

    return kept.mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("_q_n_words") < 20) | (100 * F.col("_q_n_repeat_words") > 30 * F.col("_q_n_words"))


def features() -> list[Column]:
    """Transformed statistics, drawn towards a typical value in short texts."""
    q = lambda s: F.col(f"_q_{s}").cast("double")
    chars = q("word_chars") + 100
    return [F.log((q("word_chars") + 100) / (q("n_words") + 20)), F.sqrt(q("n_symbols") / chars), q("n_dup_lines") / (q("n_lines") + 5), q("n_repeat_words") / (q("n_words") + 50), q("n_upper") / chars, q("n_marks") / chars, q("n_same") / (q("n_words") + 50)]


def _part(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def _group(lang: str, source: str) -> Column:
    """The group's name; without its last part, its parent's."""
    return F.concat(F.lit("*\x1f"), _part(lang), F.lit("\x1f"), _part(source))


_PAIRS = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]
_X = [f"x{i}" for i in range(FEATURES)]
_M = [f"m{i}" for i in range(FEATURES)]
_P = [f"p{i}_{j}" for i, j in _PAIRS]
_FIT = "g string, s int, ld double, old double, " + ", ".join(f"{c} double" for c in (*_M, *_P))


def _quadratic(inverse: list[Column], d: list[Column]) -> Column:
    total = F.lit(0.0)
    for p, (i, j) in zip(inverse, _PAIRS, strict=True):
        total = total + p * d[i] * d[j] * (1.0 if i == j else 2.0)
    return total


def distance() -> Column:
    """The squared Mahalanobis distance of features ``x0..`` to the estimate ``m0.., p0_0..``."""
    return _quadratic([F.col(p) for p in _P], [F.col(x) - F.col(m) for x, m in zip(_X, _M, strict=True)])


def _moments(x: list[Column], weight: Column | None = None) -> list[Column]:
    """Sums ``m0..`` of values and ``p0_0..`` of products."""
    w = F.lit(1.0) if weight is None else weight
    return [F.sum(c * w).alias(m) for c, m in zip(x, _M, strict=True)] + [F.sum(x[i] * x[j] * w).alias(p) for p, (i, j) in zip(_P, _PAIRS, strict=True)]


def _matrix(flat: np.ndarray) -> np.ndarray:
    out = np.zeros((len(flat), FEATURES, FEATURES))
    for k, (i, j) in enumerate(_PAIRS):
        out[:, i, j] = out[:, j, i] = flat[:, k]
    return out


def mixed(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Locations and scatters of groups from counts, means and covariances of themselves and their parents, the topmost first.

    A count of 0 (no such level) leaves the parent's.
    """
    _, mean, cov = levels[0]
    for n, own, scatter in levels[1:]:
        w = (n / (n + prior))[:, None]
        off = own - mean
        mean, cov = mean + w * off, w[:, :, None] * scatter + (1 - w[:, :, None]) * cov + (w * (1 - w))[:, :, None] * off[:, :, None] * off[:, None, :]
    return mean, cov


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of groups and of their parents to location, inverse scatter and the logarithm of its determinant."""
    for batch in batches:
        if not batch.num_rows:
            continue
        levels = []
        for k in range(3):
            sums = batch.column(3 + k).combine_chunks() if isinstance(batch.column(3 + k), pa.ChunkedArray) else batch.column(3 + k)
            sums = np.nan_to_num(np.asarray(sums.flatten()).reshape(batch.num_rows, -1))
            n = sums[:, 0]
            mean = sums[:, 1 : 1 + FEATURES] / np.maximum(n, 1)[:, None]
            cov = _matrix(sums[:, 1 + FEATURES : 1 + FEATURES + len(_PAIRS)] / np.maximum(n, 1)[:, None]) - mean[:, :, None] * mean[:, None, :]
            levels.append((n, mean, cov / sums[:, -1][:, None, None].clip(1e-9) + np.diag(np.square(LEAST_SD))))
        mean, cov = mixed(levels)
        inverse = np.linalg.inv(cov)
        values = [*mean.T, *[inverse[:, i, j] for i, j in _PAIRS]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.linalg.slogdet(cov)[1]), batch.column(2), *[pa.array(np.ascontiguousarray(v)) for v in values]], names=["g", "s", "ld", "old", *_M, *_P])


def _with_parents(sums: DataFrame, shrink: float) -> DataFrame:
    """Estimates from a (written) table of sums ``g, s, old, n, m0.., p0_0..``."""
    held = F.array("n", *_M, *_P, F.lit(shrink)).alias("v")
    own = sums.select("g", "s", "old", held)
    up = sized(own.filter(F.size(F.split("g", "\x1f")) < 3).select("g", "s", "v"))
    none = F.array(*[F.lit(0.0)] * (2 + FEATURES + len(_PAIRS)))
    depth = F.size(F.split("g", "\x1f"))
    top, lang = up.toDF("tg", "ts", "tv"), up.toDF("lg", "ls", "lv")
    rows = own.join(top, (F.col("tg") == "*") & (F.col("ts") == F.col("s"))).join(lang, (F.col("lg") == F.substring_index("g", "\x1f", 2)) & (F.col("ls") == F.col("s")), "left")
    # the topmost level, the language's (none for the topmost itself), the group's (none for the others)
    rows = rows.select("g", "s", "old", "tv", F.when(depth >= 2, F.col("lv")).otherwise(none).alias("lv"), F.when(depth >= 3, F.col("v")).otherwise(none).alias("v"))
    return written(rows.mapInArrow(_estimated, _FIT), "estimate")


@scoped
def fit(stats: DataFrame, group: Column) -> DataFrame:
    """Estimates of each group, of each language and of all (``*``); from a (written) table of statistics.

    A row has the group ``g``, the start ``s`` that led to it, location ``m0..`` and inverse scatter ``p0_0..``.
    """
    sound = stats.filter(~base_failed()).select(group.alias("_g"), *[x.alias(n) for x, n in zip(features(), _X, strict=True)])
    levels = F.array(F.lit("*"), F.substring_index("_g", "\x1f", 2), F.col("_g"))
    rows = written(sound.select(F.explode(levels).alias("g"), *_X), "features")

    # the first start: coordinatewise medians and quartile ranges from bins of 1/1024
    long = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(x) * 1024) for x in _X])).alias("i", "bin"))
    bins = long.groupBy("g", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("g", "i").orderBy("bin")
    bins = bins.select("g", "i", "bin", F.sum("n").over(so_far).alias("c"), F.sum("n").over(Window.partitionBy("g", "i")).alias("all"))
    point = lambda q: F.min(F.when(F.col("c") >= F.col("all") * q, (F.col("bin") + 0.5) / 1024))
    start = bins.groupBy("g", "i").agg(point(0.5).alias("mid"), (point(0.75) - point(0.25)).alias("iqr"))
    least = F.element_at(F.array(*[F.lit(x) for x in LEAST_SD]), F.col("i") + 1)
    start = start.select("g", "i", "mid", (F.pow(F.col("iqr") / 1.349, 2) + F.pow(least, 2)).alias("var"))
    only = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    start = written(start.groupBy("g").agg(*[only("mid", i).alias(f"c{i}") for i in range(FEATURES)], *[only("var", i).alias(f"v{i}") for i in range(FEATURES)]), "start")
    # sums as of a group with those medians and variances; of signs, whose scatter has the right directions; and plain ones
    d = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(FEATURES)]
    length = sum((d[i] * d[i] / F.col(f"v{i}") for i in range(1, FEATURES)), d[0] * d[0] / F.col("v0"))
    own = rows.join(sized(start), "g")
    count = F.count(F.lit(1)).cast("double").alias("n")
    old = F.lit(math.inf).alias("old")
    plain = own.groupBy("g").agg(count, *_moments([F.col(x) for x in _X])).select("g", F.lit(2).alias("s"), old, "n", *_M, *_P)
    signs = own.groupBy("g").agg(count, *_moments(d, FEATURES / F.greatest(length, F.lit(1e-9)))).join(sized(start), "g")
    about = lambda i, j, spread: F.col("n") * (spread + F.col(f"c{i}") * F.col(f"c{j}"))
    signs = signs.select("g", F.lit(1).alias("s"), old, "n", *[(F.col("n") * F.col(f"c{i}")).alias(_M[i]) for i in range(FEATURES)], *[about(i, j, F.col(p) / F.col("n")).alias(p) for p, (i, j) in zip(_P, _PAIRS, strict=True)])
    alone = plain.select("g", "n").join(sized(start), "g").select("g", F.lit(0).alias("s"), old, "n", *[(F.col("n") * F.col(f"c{i}")).alias(_M[i]) for i in range(FEATURES)], *[about(i, j, F.col(f"v{i}") if i == j else F.lit(0.0)).alias(p) for p, (i, j) in zip(_P, _PAIRS, strict=True)])
    estimate = _with_parents(written(plain.unionByName(signs).unionByName(alone), "sums"), 1.0)
    steps: list[DataFrame] = []
    while True:
        # ``old`` is the least so far (bins' edges can let determinants swing)
        near = rows.join(sized(estimate.withColumn("least", F.least("old", "ld") if steps else F.col("old"))), "g").select("g", "s", "least", *_X, F.floor(F.log2(F.greatest(distance(), F.lit(0.0)) + 1e-9) * _BIN).alias("b"))
        binned = near.groupBy("g", "s", "b").agg(F.first("least").alias("old"), count, *_moments([F.col(x) for x in _X]))
        whole = Window.partitionBy("g", "s")
        # bins up to the one that reaches the share to be kept: a group has at most some hundreds of bins
        binned = binned.withColumn("_before", F.sum("n").over(whole.orderBy("b")) - F.col("n")).withColumn("_all", F.sum("n").over(whole))
        sums = binned.filter(F.col("_before") < F.col("_all") * KEEP).groupBy("g", "s").agg(F.first("old").alias("old"), *[F.sum(c).alias(c) for c in ("n", *_M, *_P)])
        estimate = _with_parents(written(sums.select("g", "s", "old", "n", *_M, *_P), "sums"), SHRINK)
        steps.append(estimate)
        fell = estimate.agg(F.max(F.col("old") - F.col("ld"))).first()[0]
        if fell is None or fell <= AT_REST:
            break
    names = [c for c in estimate.columns if c not in ("g", "old")]
    every = steps[0]
    for one in steps[1:]:
        every = every.unionByName(one)
    best = every.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("ld", "s")).alias("e"))
    return written(best.select("g", "e.*"), "estimate")


def judge(stats: DataFrame, estimate: DataFrame, group: Column) -> DataFrame:
    """The rows with ``_q_distance`` (squared) and ``_q_kept``."""
    own = estimate.select(F.col("g").alias("_own_g"), *[F.col(n).alias(f"_own_{n}") for n in (*_M, *_P)])
    rows = stats.withColumn("_q_g", group).join(sized(own), F.col("_q_g") == F.col("_own_g"), "left")
    total = _quadratic([F.col(f"_own_{p}") for p in _P], [x - F.col(f"_own_{m}") for x, m in zip(features(), _M, strict=True)])
    return rows.select(*stats.columns, total.alias("_q_distance"), (~base_failed() & (total <= CUTOFF)).alias("_q_kept"))


@scoped
def keep_sound(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with their columns."""
    rows = docs.select(row_of(docs).alias("_q_row"), *[F.col(quoted(c)).alias(n) for c, n in ((text, "_q_body"), (lang, "_q_lang"), (source, "_q_source"))])
    # the texts with their statistics are written once: reading them is cheaper than counting again
    stats = written(with_statistics(rows, "_q_body", ["_q_row", "_q_lang", "_q_source"]), "statistics")
    group = _group("_q_lang", "_q_source")
    return judge(stats, fit(stats, group), group).filter("_q_kept").select(*row_columns(docs, "_q_row"))


@scoped
def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(with_statistics(table(spark, sf_dir, "documents"), "text", ["doc_id", "lang", "source"]), "statistics")
    group = _group("lang", "source")
    out = judge(stats, fit(stats, group), group)
    return out.select("doc_id", *[F.col(f"_q_{s}").alias(s) for s in STATS[:5]], base_failed().alias("base_failed"), F.coalesce("_q_kept", F.lit(False)).alias("kept"), F.col("_q_distance").alias("distance"))
