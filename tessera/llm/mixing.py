"""Mixing by soft membership: document rates that bring domain totals to targets.

A classifier learnt from a labelled table gives each document a posterior over
domains.  A document with ``n`` tokens and posterior ``p`` contributes
``rate * n * p[k]`` expected tokens to domain ``k``.  Rates that are nonnegative
and bring these totals to the targets, staying near 1 where there is a choice,
minimise

    1/2 sum_k ((sum_d r_d n_d p_dk - t_k) / s_k)^2 + mu/2 sum_d (n_d / N) (r_d - 1)^2

where ``s`` is the larger of target and present total.  At the optimum a rate is
``max(0, 1 - sum_k p_dk N y_k / (s_k mu))``, the projection of what the domains'
scaled residuals ``y`` ask for, so the unknowns are a few numbers.  Projected
Newton steps find them: each is one pass of sums over a narrow table, the domains'
sizes do not slow them down, and no rate is stored until the end.  They end when
every total is within ``REACHED`` of its target, or else, where the targets cannot
all be met so far, at the optimum: when the residuals of the rates are ``y`` to
within ``TOLERANCE``, that is, when the projected gradient vanishes.  If neither is
reached, there is an error and no result.  The query and the pipeline ask for the
optimum itself (``reached`` 0).

The classifier is a softmax regression on which hashed words (``BUCKETS`` of
them) a document has and on a few shares, fitted on at most ``TRAINING_ROWS``
labelled documents, those whose ids have the smallest hashes; that bound is a
parameter.  Everything else covers all documents.

Nulls and edge cases: labels with a null id or class are not learnt from, and of
several labels of a document the largest class holds; without labels every
document belongs to each domain by equal parts; a null or empty text counts one
token; a target domain without any member cannot be reached and is left out; an
empty table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessera.llm._base import quoted, row_of, scoped, table, written
from tessera.llm._words import LOWER, Words, slices, text_bytes

BUCKETS = 1 << 17
TRAINING_ROWS = 8_000
#: Steps after which rates that are not yet the optimum are an error.
STEPS = 40
MU = 0.001
#: Totals that miss their targets by no more than this share of the domains' scales have reached them.
REACHED = 0.02
#: The largest difference, as a share of a domain's scale, at which residuals count as those of the optimum.
TOLERANCE = 1e-9
#: Shares of a step that one pass tries.
_TRIALS = 0.25 ** np.arange(12)
#: Documents with no more than this posterior of a domain count as others, where a domain is to keep nothing of its own.
DOUBT = 0.25
#: Domains, in the order of the classifier's classes.
DOMAINS = ("plain", "poor", "toxic")
#: The query's factors.
TARGETS = (1.25, 0.5, None)


#: Upper-case letters fall to lower case and ASCII marks to spaces.
_LETTERS = LOWER.copy()
_LETTERS[[c for c in range(128) if not chr(c).isalnum()]] = 32
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARKS = np.zeros(256, np.int64)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
#: Levels of each of three shares that a document has besides its words.
_LEVELS = 8
_ALL = BUCKETS + 3 * _LEVELS


def _level(part: np.ndarray, whole: np.ndarray, times: float) -> np.ndarray:
    return np.minimum(part * times * _LEVELS / np.maximum(whole, 1), _LEVELS - 1).astype(np.int64)


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of documents: pairs of document and feature, in order, and the tokens of each document.

    Features are hashed words (runs of letters, digits and non-ASCII characters,
    in lower case), and levels of the shares of capitals, marks and new words.
    """
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        w = Words(data, offsets, i, j, bytes_as=_LETTERS)
        n = len(w.count)
        raw = data[offsets[i] : offsets[j]]
        bucket = (w.hashes() % np.uint64(BUCKETS)).astype(np.int64)
        both = np.unique(w.doc_of() * _ALL + bucket)
        new = np.bincount(both // _ALL, minlength=n)
        size = np.diff(w.docs)
        upper, marks = (np.diff(np.concatenate(([0], np.cumsum(flag[raw])))[w.docs]) for flag in (_UPPER, _MARKS))
        for k, level in enumerate((_level(upper, size, 2.0), _level(marks, size, 4.0), _level(new, w.count, 1.0))):
            both = np.concatenate((both, np.arange(n) * _ALL + BUCKETS + k * _LEVELS + level))
        both.sort()
        yield both // _ALL, both % _ALL, w.count


def _training(docs: DataFrame, key: str, text: str, labels: DataFrame, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The bounded sample: distinct buckets of each document, and classes."""
    few = labels.orderBy(F.xxhash64("_label_key"), "_label_key").limit(rows)
    few = written(few, "training")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[np.ndarray] = []
            for doc, feature, count in _features(batch.column(0)):
                at = np.searchsorted(doc, np.arange(len(count) + 1))
                lists += [feature[a:b].astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), batch.column(1)], names=["_b", "_class"])

    got = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(few), F.col("_key") == F.col("_label_key"))
    # of rows that share an id, one
    one = got.groupBy("_key").agg(F.min("_text").alias("_text"), F.first("_class").alias("_class"))
    found = one.select("_text", "_class").mapInArrow(parts, "_b array<int>, _class int").toArrow()
    return [np.asarray(x.values, np.int64) for x in found.column("_b").combine_chunks()], found.column("_class").to_numpy()


def fit(members: list[np.ndarray], classes: np.ndarray, n_classes: int, steps: int = 200, penalty: float = 1e-4) -> np.ndarray:
    """Weights ``(features + 1, n_classes)`` of a softmax regression on which features a document has.

    Only features that three or more documents have, and some class has more or
    less often than by chance (by four standard deviations), get a weight.
    """
    weights = np.zeros((_ALL + 1, n_classes))
    n = len(members)
    if not n:
        return weights
    size = np.array([len(m) for m in members])
    flat = np.concatenate(members)
    doc = np.repeat(np.arange(n), size)
    known = np.eye(n_classes)[classes]
    share = known.mean(axis=0)
    seen = np.bincount(flat, minlength=_ALL)
    told = np.zeros(_ALL, bool)
    for k in range(n_classes):
        expected = seen * share[k]
        told |= np.square(np.bincount(flat, known[doc, k], minlength=_ALL) - expected) > 16 * np.maximum(expected * (1 - share[k]), 0.25)
    told &= seen >= 3
    doc, flat = doc[told[flat]], flat[told[flat]]
    used, flat = np.unique(flat, return_inverse=True)
    w = np.zeros((len(used) + 1, n_classes))
    w[-1] = np.log(np.maximum(known.mean(axis=0), 1e-6))
    moment, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        score = np.stack([np.bincount(doc, w[flat, k], minlength=n) + w[-1, k] for k in range(n_classes)], axis=1)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - known) / n
        gradient = np.empty_like(w)
        for k in range(n_classes):
            gradient[:-1, k] = np.bincount(flat, error[doc, k], minlength=len(used)) + penalty * w[:-1, k]
            gradient[-1, k] = error[:, k].sum()
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        w -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights[used] = w[:-1]
    weights[-1] = w[-1]
    return weights


def with_posteriors(docs: DataFrame, text: str, weights: np.ndarray, columns: list[str], rates: Rates | None = None) -> DataFrame:
    """``columns`` with ``_tokens`` (runs of letters and digits, at least 1), ``_p`` (the posterior) and, by given rates, ``_rate``."""
    kept = docs.select(*columns, F.col(text).alias("_text"))
    schema = docs.select(*columns).schema.add("_tokens", "long").add("_p", ArrayType(DoubleType()))
    schema = schema.add("_rate", "double") if rates is not None else schema
    names = schema.names
    weights = weights.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = weights.shape[1]
        for batch in batches:
            tokens, found = [np.zeros(0, np.int64)], [np.zeros((0, k))]
            for d, b, count in _features(batch.column(batch.num_columns - 1)):
                n = len(count)
                s = np.stack([np.bincount(d, weights[b, i], minlength=n) + weights[-1, i] for i in range(k)], axis=1)
                s = np.exp(s - s.max(axis=1, keepdims=True))
                found.append(s / s.sum(axis=1, keepdims=True))
                tokens.append(np.maximum(count, 1).astype(np.int64))
            p = np.concatenate(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.reshape(-1)))
            more = [pa.array(rates.of(p))] if rates is not None else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(tokens)), lists, *more], names=names)

    return kept.mapInArrow(score, schema)


class Rates:
    """Rates as a function of the posterior, by dual variables; ``missed`` is what totals miss, as shares of the domains' scales."""

    def __init__(self, unit: np.ndarray, mu: float):
        self.unit, self.mu = unit, mu
        self.dual = self.missed = np.zeros(len(unit))

    def of(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1.0 - p @ (self.unit * self.dual) / self.mu)


def solve(members: DataFrame, targets: np.ndarray, mu: float = MU, steps: int = STEPS, reached: float = REACHED) -> Rates:
    """Rates from a (written) table of ``_tokens`` and ``_p``; targets are in tokens.

    The dual function that is minimised is strongly convex and made of quadratic
    pieces.  A Newton step goes as far as the function falls enough.
    """
    k = len(targets)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += batch.column(0).to_numpy().astype(float) @ batch.column(1).flatten().to_numpy().reshape(-1, k)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    def summed(df: DataFrame, width: int) -> np.ndarray:
        v = df.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # a row for each sum
        out = np.zeros(width)
        for r in v:
            out[r["i"]] = r["x"]
        return out

    rows = members.select("_tokens", "_p")
    now = summed(rows.mapInArrow(present, "v array<double>"), k)
    whole = max(now.sum(), 1.0)
    scale = np.where(now > 0, np.maximum(targets, now), np.inf)
    unit = whole / scale  # of a rate's change on a scaled total
    aim = targets / scale
    rates = Rates(unit, mu)
    width = 1 + k + k * k

    def tried(points: np.ndarray) -> list[tuple[np.ndarray, float, np.ndarray, np.ndarray]]:
        """Points with the dual function's value, gradient and second derivatives there."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(points), width))
            for batch in batches:
                share = batch.column(0).to_numpy() / whole
                pull = batch.column(1).flatten().to_numpy().reshape(-1, k) * unit
                for i, y in enumerate(points):
                    a = pull @ y
                    rate = np.maximum(0.0, 1.0 - a / mu)
                    total[i, 0] -= share @ np.where(rate > 0, a - a * a / (2 * mu), mu / 2)
                    total[i, 1 : k + 1] -= (share * rate) @ pull
                    total[i, k + 1 :] += ((pull * (share * (rate > 0))[:, None]).T @ pull).reshape(-1) / mu
            yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], names=["v"])

        found = summed(rows.mapInArrow(sums, "v array<double>"), len(points) * width).reshape(-1, width)
        return [(y, t[0] + y @ (y / 2 + aim), t[1 : k + 1] + y + aim, t[k + 1 :].reshape(k, k) + np.eye(k)) for y, t in zip(points, found, strict=True)]

    y, value, gradient, second = tried(np.zeros((1, k)))[0]
    # what the totals miss is the dual variable less the gradient
    done = lambda: np.abs(y - gradient).max() <= reached or np.abs(gradient).max() <= TOLERANCE
    for _ in range(steps):
        if done():
            break
        step = -np.linalg.solve(second, gradient)
        # near the optimum values differ by less than rounding, and the gradient tells
        better = [t for t, part in zip(tried(y + _TRIALS[:, None] * step), _TRIALS, strict=True) if t[1] <= value + 1e-4 * part * (gradient @ step) or np.abs(t[2]).max() <= np.abs(gradient).max() / 2]
        if not better:
            break
        y, value, gradient, second = better[0]
    if not done():
        raise ArithmeticError(f"no rates found in {steps} steps: totals miss their targets by up to {np.abs(y - gradient).max():.3g} and the optimum's by up to {np.abs(gradient).max():.3g} of the domains' scales")
    rates.dual, rates.missed = y, y - gradient
    return rates


def copies(rate: Column, key: Column) -> Column:
    """A whole number of copies whose expectation is the rate, the same in every run."""
    chance = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def classes_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Domains from the labelled table: toxic, else poor (quality 0), else plain."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0)
    some = labels.select(F.col(key).alias("_label_key"), domain.alias("_class")).filter("_label_key is not null and _class is not null")
    return some.groupBy("_label_key").agg(F.max("_class").cast("int").alias("_class"))


@scoped
def mix(docs: DataFrame, labels: DataFrame, targets: tuple[float | None, ...], key: str = "doc_id", text: str = "text", rows: int = TRAINING_ROWS, reached: float = REACHED) -> tuple[DataFrame, np.ndarray]:
    """``_row`` (all columns), ``_key``, ``_tokens``, ``_p`` and ``_rate`` of every row; and the domains' totals before.

    ``targets`` are factors on the present totals of the domains.  None stands for
    none of the domain's own documents: the target is what the documents with a
    posterior of at most ``DOUBT`` add up to, which any that stay bring along.
    """
    k = len(targets)
    docs_key, docs_text = F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_body")
    members, classes = _training(docs.select(docs_key, docs_text), "_key", "_body", classes_of(labels), rows)
    weights = fit(members, classes, k)
    narrow = written(with_posteriors(docs.select(docs_text), "_body", weights, []), "posteriors")
    part = [F.col("_tokens") * F.col("_p")[i] for i in range(k)]
    some = narrow.select(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in part], *[F.coalesce(F.sum(F.when(F.col("_p")[i] <= DOUBT, x)), F.lit(0.0)) for i, x in enumerate(part)]).first()
    totals, others = np.array(some[:k]), np.array(some[k:])
    rates = solve(narrow, np.array([others[i] if t is None else t * totals[i] for i, t in enumerate(targets)]), reached=reached)
    whole = docs.select(row_of(docs).alias("_row"), docs_key, docs_text)
    return with_posteriors(whole, "_body", weights, ["_row", "_key"], rates), totals


def op7_soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that halve the poor domain's tokens, raise the plain one's by a quarter and leave no toxic documents."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out, _ = mix(docs, labels, TARGETS, reached=0.0)
    return out.select(F.col("_key").alias("doc_id"), F.col("_tokens").alias("n_tokens"), *[F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], F.col("_rate").alias("rate"), copies(F.col("_rate"), F.col("_key")).alias("n_copies"))
