import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, quality
from tests.llm.conftest import prose, split


def by_hand(text):
    t = text or ""
    w = [x.decode() for x in split(t)]
    windows = {}
    for s in range(len(w) - 7):
        windows.setdefault(tuple(w[s : s + 8]), []).append(s)
    again = {k for at in windows.values() if len(at) > 1 for s in at for k in range(s, s + 8)}
    seen, lines = set(), 0
    for line in t.split("\n"):
        if split(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(again)


def test_repeated_single_words_are_counted():
    got = quality.statistics(pa.array(["This This This that that x", "a", None, "a b a b", "p\np\tP"]))[-1]
    assert got.tolist() == [3, 0, 0, 0, 1]


def test_statistics_as_by_hand(docs):
    texts = [t for _, t in docs] + ["a\nb\na\n \n \na", "### a|b <x> 100% é$\u2003&", "p q r s t u v w " * 3, "\u00a0x\u3000y z"]
    got = quality.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(int(c[i]) for c in got[:5]) == by_hand(t), t


def corpus(spark, n=900):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        words = prose(rng, rng.choice([30, 80, 200, 1500])).split()
        text = ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) + "."
        kind = "clean"
        if i % 30 == 0:
            kind, text = "junk", " ".join(x.upper() + "!!" for x in words)
        if i % 30 == 1:
            kind, text = "junk", " ".join(x + "###" for x in words)
        if i % 30 == 2:
            kind, text = "junk", "\n".join([" ".join(words[:9])] * 12 + words[9:40])
        rows.append((i, text, "de" if i % 3 else None, "s1" if i % 2 else "rare" if i < 20 else None, kind))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string")


def test_junk_goes_and_clean_text_stays(spark):
    docs = corpus(spark).withColumn("_q_n_words", F.lit(1)).withColumn("_n", F.lit(2))
    kept = quality.keep_sound(docs)
    assert kept.columns == docs.columns
    count = {r["kind"]: r["count"] for r in kept.groupBy("kind").count().collect()}
    assert count["clean"] == 810 and count.get("junk", 0) == 0


def test_estimates_withstand_outliers(spark):
    """Junk does not move them: clean texts' distances stay like those that clean texts alone would have."""
    docs = corpus(spark)
    group = quality._group("lang", "source")

    def distances(some):
        stats = quality.written(quality.with_statistics(some, "text", ["doc_id", "lang", "source", "kind"]), "s")
        out = quality.judge(stats, quality.fit(stats, group), group).filter("kind = 'clean'")
        return out.select("doc_id", "_q_distance").toPandas().set_index("doc_id")["_q_distance"]

    among, alone = distances(docs), distances(docs.filter("kind = 'clean'"))
    assert among.max() < quality.CUTOFF
    assert among.median() == pytest.approx(alone.median(), rel=0.2)


def test_the_chi_square_factors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400_000, quality.FEATURES))
    d = np.square(x).sum(axis=1)
    inner = x[d <= np.quantile(d, quality.KEEP)]
    assert np.square(inner).mean() == pytest.approx(quality.SHRINK, abs=0.005)
    assert quality.chi_square(quality.CUTOFF, quality.FEATURES) == pytest.approx(1 - quality.REJECTED, abs=1e-9)
    assert quality.chi_square_point(0.75, 6) == pytest.approx(7.8408, abs=1e-3) and quality.chi_square(7.8408, 8) / 0.75 == pytest.approx(0.734, abs=1e-3)


def statistics_table(spark, rng, groups):
    """Statistics of made-up documents: (lang, source, n, share of outliers) for each group."""
    rows = []
    for lang, source, n, odd in groups:
        for i in range(n):
            words = int(rng.integers(300, 900))
            chars = int(words * rng.normal(5.0, 0.6))
            row = dict(n_words=words, word_chars=chars, n_symbols=int(rng.integers(0, 30)), n_dup_lines=int(rng.integers(0, 8)), n_repeat_words=int(rng.integers(0, 90)), n_lines=30, n_upper=int(rng.integers(60, 240)), n_marks=int(rng.integers(50, 300)), n_same=int(rng.integers(0, 60)))
            if i < odd * n:
                row.update(n_upper=chars // 2, n_marks=chars // 3)
            rows.append((lang, source, *[row[s] for s in quality.STATS]))
    return quality.written(spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"_q_{s} long" for s in quality.STATS)), "s")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_least_determinant_as_by_brute_force(spark, seed):
    """All subsets of a small table: no three quarters of it have a determinant that is less by more than the bins allow."""
    from itertools import combinations

    stats = statistics_table(spark, np.random.default_rng(seed), [("en", "a", 16, 0.19)])
    got = quality.fit(stats, quality._group("lang", "source")).collect()
    assert {r["g"] for r in got} == {"*", "*\x1f=en", "*\x1f=en\x1f=a"}
    x = np.array([list(r) for r in stats.select(*quality.features()).collect()])
    best = np.inf
    for some in combinations(range(16), 12):
        cov = np.cov(x[list(some)].T, bias=True) / quality.SHRINK + np.diag(np.square(quality.LEAST_SD))
        best = min(best, np.linalg.slogdet(cov)[1])
    for r in got:
        assert best - 1e-6 <= r["ld"] <= best + 0.7, (r["ld"], best)


def test_every_language_and_source_has_an_estimate_and_small_ones_shade_into_their_parents(spark):
    rng = np.random.default_rng(5)
    stats = statistics_table(spark, rng, [("en", "a", 600, 0.1), ("en", "b", 5, 0), ("de", "a", 300, 0.1), (None, None, 1, 0)])
    fitted = {r["g"]: r for r in quality.fit(stats, quality._group("lang", "source")).collect()}
    assert set(fitted) == {"*", "*\x1f=en", "*\x1f=en\x1f=a", "*\x1f=en\x1f=b", "*\x1f=de", "*\x1f=de\x1f=a", "*\x1fnull", "*\x1fnull\x1fnull"}
    m = lambda g: np.array([fitted[g][f"m{i}"] for i in range(quality.FEATURES)])
    assert np.abs(m("*\x1f=en\x1f=b") - m("*\x1f=en")).max() < np.abs(m("*")).max() * 0.2
    judged = quality.judge(stats, quality.fit(stats, quality._group("lang", "source")), quality._group("lang", "source"))
    rejected = judged.filter("not _q_kept").count()
    assert rejected == 60 + 30


def test_mixed_levels_are_those_of_added_documents():
    rng = np.random.default_rng(7)
    parent, own = rng.normal(size=(quality.PRIOR, 3)), rng.normal(1.0, 2.0, size=(20, 3))
    level = lambda x: (np.array([float(len(x))]), x.mean(axis=0)[None], np.cov(x.T, bias=True)[None])
    mean, cov = quality.mixed([level(parent), level(own)])
    both = np.concatenate((parent, own))
    assert mean[0] == pytest.approx(both.mean(axis=0)) and cov[0] == pytest.approx(np.cov(both.T, bias=True))


def test_quality_of_odd_rows(docs, frame, spark):
    got = quality.keep_sound(frame(docs)).collect()
    ids = {r["doc_id"] for r in got}
    assert all(by_hand(t)[0] >= 20 for i, t in docs if i in ids and i is not None)
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.keep_sound(none).collect() == []
    some = spark.createDataFrame([(1, "a " * 50, None, None), (2, None, "x", "y")], "doc_id long, text string, lang string, source string")
    assert quality.keep_sound(some).collect() == []


def mixed(spark, n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        kind = i % 10
        words = prose(rng, rng.choice([20, 60, 150])).split()
        if kind == 0:
            words[rng.randrange(len(words))] = rng.choice(["vile", "Scum,"])
        text = " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join(words)
        rows.append((i, text, kind))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    return spark.createDataFrame(rows, "doc_id long, text string, kind int").withColumn("_tokens", F.lit(1)), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_rates_bring_totals_to_their_targets(spark):
    docs, labels = mixed(spark)
    out, before = mixing.mix(docs, labels, (1.2, 0.5, 0.0))
    rows = out.select("_row.kind", "_key", "_tokens", "_p", "_rate", mixing.copies(F.col("_rate"), F.col("_key")).alias("c")).collect()
    p, n, r = np.array([x["_p"] for x in rows]), np.array([x["_tokens"] for x in rows]), np.array([x["_rate"] for x in rows])
    after = (n * r) @ p
    assert before == pytest.approx(n @ p) and (r >= 0).all()
    assert after == pytest.approx(before * [1.2, 0.5, 0.0], abs=0.02 * before.sum())
    held_out = [x for x in rows if x["_key"] % 2 and x["_key"] % 3]
    right = [int(np.argmax(x["_p"])) == {0: 2, 1: 1}.get(x["kind"], 0) for x in held_out]
    assert np.mean(right) > 0.95
    assert all(x["c"] >= 1 for x in rows if x["kind"] > 1 and x["_p"][0] > 0.95)
    assert all(x["c"] in (int(x["_rate"]), int(x["_rate"]) + 1) for x in rows)


def test_projected_gradient_reaches_the_optimum(spark):
    """Against a long run of plain projected gradient on every document's own rate."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 80)
    n = rng.integers(1, 50, 80).astype(float)
    now = n @ p
    targets = now * [1.5, 0.5, 0.0]
    members = quality.written(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "_tokens long, _p array<double>"), "m")
    got = mixing.solve(members, targets, mu=0.05, steps=400).of(p)
    scale, whole = np.maximum(targets, now), n.sum()
    r = np.ones(80)
    for _ in range(200_000):
        gradient = p @ (((n * r) @ p - targets) / scale**2) * n + 0.05 * n / whole * (r - 1)
        r = np.maximum(0, r - gradient / (n / whole) / 30)
    value = lambda r: 0.5 * ((((n * r) @ p - targets) / scale) ** 2).sum() + 0.025 * (n / whole * (r - 1) ** 2).sum()
    assert value(got) == pytest.approx(value(r), abs=1e-4)


@pytest.mark.parametrize("shares", [(0.985, 0.01, 0.005), (0.979, 0.02, 0.001)])
def test_a_rare_domain_does_not_keep_the_others_from_their_targets(spark, shares):
    """With the parameters of the pipeline; the rates are a fixed point of projected gradient."""
    rng = np.random.default_rng(1)
    domain = rng.choice(3, 20_000, p=shares)
    score = rng.normal(size=(20_000, 3)) + np.log(shares)
    score[np.arange(20_000), domain] += 4.0 - 0.5 * np.log(np.array(shares))[domain]
    p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    n = rng.integers(20, 400, 20_000).astype(float)
    now = n @ p
    targets = now * [1.25, 1.0, 0.0]
    members = quality.written(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "_tokens long, _p array<double>"), "m")
    rates = mixing.solve(members, targets)
    r = rates.of(p)
    after = (n * r) @ p
    assert after / now == pytest.approx([1.25, 1.0, 0.0], abs=0.08) and after[0] / now[0] > 1.23
    scale = np.maximum(targets, now)
    residual = (after - targets) / scale
    assert residual == pytest.approx(rates.missed, abs=1e-8)
    gradient = p @ (n.sum() / scale * residual) + mixing.MU * (r - 1)
    assert np.abs(r - np.maximum(0, r - gradient)).max() < 1e-5
    with pytest.raises(ArithmeticError):
        mixing.solve(members, targets, steps=1)


def test_the_querys_rates_are_the_optimum_and_meet_their_targets(spark):
    """With the query's own parameters: no long run of plain projected gradient finds a lower value, and clean documents stay."""
    docs, labels = mixed(spark)
    out, before = mixing.mix(docs, labels, mixing.TARGETS, reached=0.0)
    rows = out.select("_row.kind", "_tokens", "_p", "_rate").collect()
    p, n, r = np.array([x["_p"] for x in rows]), np.array([x["_tokens"] for x in rows], float), np.array([x["_rate"] for x in rows])
    kind = np.array([x["kind"] for x in rows])
    others = (n[:, None] * np.where(p <= mixing.DOUBT, p, 0)).sum(axis=0)
    targets = np.array([others[i] if t is None else t * before[i] for i, t in enumerate(mixing.TARGETS)])
    assert np.abs(n * r @ p - targets).max() / before.max() < 0.01
    scale_, whole = np.maximum(targets, before), n.sum()
    value = lambda x: 0.5 * np.square(((n * x) @ p - targets) / scale_).sum() + mixing.MU / 2 * (n / whole * np.square(x - 1)).sum()
    best = r.copy()
    for start in (np.ones(len(r)), r + 0.2):
        x = start
        for _ in range(4000):
            # preconditioned by each document's tokens
            gradient = p @ (whole * ((n * x) @ p - targets) / scale_**2) + mixing.MU * (x - 1)
            x = np.maximum(0, x - gradient / (2 * whole * (1 / scale_).max() ** 2 * whole))
        best = x if value(x) < value(best) else best
    assert value(r) <= value(best) + 1e-6
    assert (r[kind > 1] >= 1).mean() > 0.99 and (r[kind == 0] < 0.2).mean() > 0.9


def test_mixing_without_labels_and_of_odd_rows(docs, frame, spark):
    _, labels = mixed(spark, 5)
    out, _ = mixing.mix(frame(docs), labels.limit(0), (1.0, 1.0, 1.0))
    rows = out.collect()
    assert len(rows) == len(docs) and all(x["_p"] == pytest.approx([1 / 3] * 3) and x["_rate"] == pytest.approx(1) for x in rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert mixing.mix(none, labels, (1.0, 0.5, 0.0))[0].collect() == []
