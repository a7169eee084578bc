"""URL rules and license scans."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import license_scan, url_rules

URLS = [
    ("http://A.Example.net/en/1?x=1#t", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("x://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"),
    ("x://m.example.com/DE/1", "m.example.com", "/DE/1", None, None),
    ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
    ("http://b.org/fr", "b.org", "/fr", None, None),
    ("http://x.net", "x.net", "", None, None),
    ("http://x.net?/en", "x.net", "", None, None),
    ("http://É.NET/en/a://b", "É.net", "/en/a://b", "net/", "block"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "a", "b") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "a", "b")], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "rule_tokens array<string>, index_token string, confidence double, pages long")
    got = url_rules.judge(pages, none).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def labelled(spark):
    """Pages of spam.example.com/win are bad; either token alone is not."""
    rows = []
    for i in range(400):
        host, path = ("spam" if i % 2 else "news"), ("win" if i % 4 < 2 else "read")
        rows.append((f"http://{host}.example.com/{path}/{i}?ref=x", host == "spam" and path == "win" or i % 50 == 0))
    return spark.createDataFrame(rows, "url string, bad boolean")


def test_mined_rules(spark):
    from pyspark.sql import functions as F

    u = F.col("url")
    train = labelled(spark).select(url_rules.tokens(u, *url_rules.host_and_path(u)).alias("tokens"), "bad")
    rules = url_rules.mine(train)
    got = rules.collect()
    assert [sorted(r["rule_tokens"]) for r in got] == [["host=spam", "path=win"]] and got[0]["confidence"] == 1.0
    pages = spark.createDataFrame([(1, "http://spam.example.com/win/x"), (2, "http://spam.example.com/read"), (3, "http://news.example.com/win"), (4, None), (5, "http://spam.example.org/win?z")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, rules).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block"}


def test_mined_rules_as_by_brute_force(spark):
    from itertools import combinations

    from pyspark.sql import functions as F

    u = F.col("url")
    train = labelled(spark).select(url_rules.tokens(u, *url_rules.host_and_path(u)).alias("tokens"), "bad")
    rows = [(frozenset(r["tokens"]), r["bad"]) for r in train.collect()]
    found = {}
    for some in {frozenset(c) for t, _ in rows for n in range(1, 4) for c in combinations(sorted(x for x in t if not x.startswith("path=") or not x[5:].isdigit()), n)}:
        fits = [bad for t, bad in rows if some <= t]
        if sum(fits) >= 20 and sum(fits) / len(fits) >= 0.3:
            found[some] = sum(fits) / len(fits)
    kept = {s for s, c in found.items() if not any(p < s and found[p] >= c for p in found)}
    got = {frozenset(r["rule_tokens"]) for r in url_rules.mine(train, min_confidence=0.3).collect()}
    assert got == kept


def test_planted_rules_hold_on_pages_without_label(spark):
    """At the base rate of the given tables: rules fire, and are right more often than the base rate says."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = []
    for i in range(4000):
        host = rng.choice(["shop", "news", "blog", "m"]) + "." + rng.choice(["abc", "defg", "hij-k", "lm1"]) + ".example." + rng.choice(["com", "org"])
        path = rng.choice(["en", "de"]) + "/" + rng.choice(["buy", "read", "list"]) + f"/{i}" + rng.choice(["", ".html"])
        spam = host.startswith("shop") and "/buy" in path or "hij-k" in host
        rows.append((i, f"http://{host}/{path}", rng.random() < (0.85 if spam else 0.1)))
    u = F.col("url")
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean").withColumn("tokens", url_rules.tokens(u, *url_rules.host_and_path(u)))
    rules = url_rules.written(url_rules.mine(pages.filter("page_id % 2 = 0")), "rules")
    assert {frozenset(r["rule_tokens"]) for r in rules.collect()} == {frozenset({"host=shop", "path=buy"}), frozenset({"host=hij-k"})} or rules.count() == 2
    held = url_rules.judge(pages.filter("page_id % 2 = 1"), rules, fixed=()).join(pages.select("page_id", "bad"), "page_id").collect()
    blocked = [r["bad"] for r in held if r["verdict"] == "block"]
    base = sum(r["bad"] for r in held) / len(held)
    assert len(blocked) > 400 and sum(blocked) / len(blocked) > 0.8 > 2 * base
    # labels that say nothing about urls give no rules
    noise = pages.select("tokens", (F.pmod(F.xxhash64("page_id"), F.lit(4)) == 0).alias("bad"))
    assert url_rules.mine(noise).count() == 0


def test_rules_of_rare_tokens_on_pages_of_many_are_found(spark):
    """Pages have more common tokens than FP-growth takes, and the rules are of rarer ones; as by brute force."""
    import random
    from itertools import combinations

    rng = random.Random(8)
    rows = []
    for i in range(400):
        bad = i < 60
        some = {f"c{j:02d}" for j in range(30) if rng.random() < 0.5}
        some |= {"r1", "r2", "r3"} if i < 24 else {"r1"} if 60 <= i < 100 else {"r2"} if 100 <= i < 140 else set()
        some |= {"r3"} if 140 <= i < 180 or 24 <= i < 45 else set()
        rows.append((sorted(some), bad))
    assert sum(len(t) > url_rules.MINED_TOKENS for t, bad in rows if bad) > 50
    base, least, known = 60 / 400, 0.3, {}
    for n in range(1, 4):
        for c in combinations(sorted({x for t, _ in rows for x in t}), n):
            fits = [bad for t, bad in rows if set(c) <= set(t)]
            b, k = sum(fits), len(fits)
            if b >= 20 and b >= least * k and b - k * base >= 4 * (k * base * (1 - base)) ** 0.5:
                known[frozenset(c)] = (b / k, k)
    want = {s: v for s, v in known.items() if not any(p < s and known[p][0] + 4 * (known[p][0] * (1 - known[p][0]) / v[1]) ** 0.5 >= v[0] for p in known)}
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert {frozenset(r["rule_tokens"]): (r["confidence"], r["pages"]) for r in got} == want
    assert frozenset({"r1", "r2"}) in want and frozenset({"r3"}) in want


def test_many_constant_folders_are_one_item(spark):
    from pyspark.sql import functions as F

    path = "/".join(f"f{i}" for i in range(40))
    rows = [(f"http://{'bad' if i % 4 == 0 else 'fine'}.example.com/{path}/{i}", i % 4 == 0) for i in range(200)]
    u = F.col("url")
    train = spark.createDataFrame(rows, "url string, bad boolean").select(url_rules.tokens(u, *url_rules.host_and_path(u)).alias("tokens"), "bad")
    assert [r["rule_tokens"] for r in url_rules.mine(train).collect()] == [["host=bad"]]


def test_very_long_urls_and_clashing_names(spark):
    long = "http://a.example.net/en/" + "x/" * 50_000
    pages = spark.createDataFrame([(1, long, "t", 2, "h"), (1, long, "t", 2, "h")], "page_id long, url string, tokens string, confidence int, _url string")
    none = spark.createDataFrame([], "rule_tokens array<string>, index_token string, confidence double, pages long")
    got = url_rules.judge(pages, none).collect()
    assert [(r["rule"], r["verdict"], len(r["path"])) for r in got] == [("example.net/en/", "allow", len(long) - 20)] * 2


def test_without_labels(spark):
    none = spark.createDataFrame([], "tokens array<string>, bad boolean")
    assert url_rules.mine(none).count() == 0


TEXTS = [
    "Released under the MIT License.",
    "UNDER-THE\nmit   license, and again under the mit license",
    "under the mit licenses",
    "Licensed under the Apache License, Version 2.0.",
    "CC BY-NC 4.0; cc by nc",
    "This work is licensed under the GNU General Public License, version 3.",
    "under the m\u0130t license under the \u212aMIT license",
    None,
    "",
    "...",
    "xé under the mit licenseé",
    "filler words here " * 300 + license_scan.TEMPLATES[0].text + " more " * 500,
    " ".join(license_scan.TEMPLATES[1].text.split()[:-9]) + " z" * 200,
]


def by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    own, best = set(labels), 1.0 if at else 0.0
    for t in license_scan.TEMPLATES:
        # every block, by sliding one word at a time
        here, most = Counter(), 0
        for i, x in enumerate(w):
            here[x] += x in t.words
            if i >= t.window:
                here[w[i - t.window]] -= w[i - t.window] in t.words
            most = max(most, sum(here[y] > 0 for y in t.words) if x in t.words else 0)
        if most >= t.need:
            own.add(t.label)
            best = max(best, most / len(t.words))
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels), sorted(own), best


def test_license_scan_as_by_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, _w string, labels int")
    got = license_scan.scan(docs).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        n, k, first, last, base, all_, score = by_hand(TEXTS[r["doc_id"]])
        places = r["places"]
        assert (r["n_words"], len(places), min(places, default=None), max(places, default=None), r["base_labels"], r["labels"]) == (n, k, first, last, base, all_), TEXTS[r["doc_id"]]
        assert r["score"] == pytest.approx(score)


def test_blocks_that_start_anywhere_and_many_templates(spark):
    """Passages spread out to just within and just beyond a window, and a library of hundreds of templates."""
    import random

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    library = tuple(license_scan.Template(f"t{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 40)))) for i in range(200))
    texts = []
    for t in library[::10]:
        words, gap = t.text.split(), rng.randrange(0, 5)
        spread = [x for y in words for x in [y, *["z"] * gap]]
        cut = [x for x in words if rng.random() < 0.85]
        texts += [" ".join(["q"] * rng.randrange(60) + spread + ["q"] * 9), " ".join(cut), " ".join(reversed(words)) + " " + " ".join(words)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (300, 3000)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("a.b", F.lit("x"))
    got = {r["doc_id"]: r for r in license_scan.scan(docs, templates=library, phrases={"q q": "qq"}).collect()}
    found = 0
    for i, t in enumerate(texts):
        w = (t or "").split()
        labels, best = set(), 0.0
        for one in library:
            kinds = set(one.words)
            most = max((len(kinds & set(w[a : a + one.window])) for a in range(len(w))), default=0)
            if most >= one.need:
                labels.add(one.label)
                best = max(best, most / len(kinds))
        phrase = any(w[a : a + 2] == ["q", "q"] for a in range(len(w)))
        found += len(labels)
        assert set(got[i]["labels"]) == labels | ({"qq"} if phrase else set())
        assert got[i]["score"] == pytest.approx(1.0 if phrase else best)
    assert found > 30


def test_license_scan_of_nothing(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
