import hashlib

import pytest

from tessera.llm import phrases
from tests.llm.conftest import split


def brute(rows, size=20):
    """Words kept and removed for each row; a null id is larger than any."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in sorted(rows, key=lambda r: (key(r[0]), r[1] or "")):
        w = split(t)
        for s in range(len(w) - size + 1):
            x = tuple(w[s : s + size])
            first[x] = min(first.get(x, (float("inf"), 1 << 60)), (key(i), s))
    out = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (key(i), s):
                gone[s : s + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("limit", [1_000_000, 500])
def test_removal_as_by_brute_force(docs, frame, monkeypatch, limit):
    monkeypatch.setattr(phrases, "_RUN", 30 if limit == 500 else 256)
    whole = frame(docs)
    told = phrases.repeated(whole)
    got = phrases.remove(whole, told, joined=True).collect()
    assert order((r["doc_id"], r["_words"], r["_removed"], r["text"].encode()) for r in got) == order(brute(docs))


def test_the_rest_of_a_text_is_unchanged(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(1, "a  b\n" + passage + "\nend "), (2, "x\t" + passage + "\n\ny  z"), (3, None), (4, " none\n"), (5, passage)]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in phrases.remove(whole, phrases.repeated(whole)).collect()}
    assert got == {1: rows[0][1], 2: "x\ty  z", 3: None, 4: " none\n", 5: ""}


def test_repeats_within_a_text_and_repeated_rows(spark):
    twice = " ".join(["p q r s t"] * 12)
    rows = [(1, twice), (1, twice), (2, twice), (3, "p q r s t " * 3)]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    got = phrases.remove(whole, phrases.repeated(whole), joined=True).collect()
    assert order((r["doc_id"], r["_words"], r["_removed"], r["text"].encode()) for r in got) == order(brute(rows))


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert phrases.remove(none, phrases.repeated(none)).collect() == []


def test_locating_goes_by_strings():
    words = [f"w{i}" for i in range(30)]
    texts = [(0, words), (100, ["x", *words]), (200, [w + "é" for w in words])]
    marks = phrases.locate([(" " + " ".join(words[2:22]) + " ", 2, 20), (" " + " ".join(words[5:28]) + " ", 5, 23)], texts, 20, 50)
    assert marks[0].sum() == 0 and list(marks[1].nonzero()[0]) == list(range(3, 29)) and marks[2].sum() == 0


def test_digest(spark, tmp_path):
    from tessera.llm.phrases import op9_phrase_automata

    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in op9_phrase_automata(spark, str(tmp_path)).collect()}
    assert rows[1]["kept_sha256"] == hashlib.sha256(b"a b").hexdigest() and rows[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_columns_of_any_name_pass(spark):
    rows = spark.createDataFrame([(1, "a b", 7, 8, 9)], "doc_id long, text string, _words int, _removed int, `a.b` int")
    told = phrases.repeated(rows)
    assert phrases.remove(rows, told, counts=None).collect() == rows.collect()
    assert phrases.remove(rows, told, counts=("before", "gone")).columns == [*rows.columns, "before", "gone"]
    with pytest.raises(ValueError):
        phrases.remove(rows, told)


def test_shards_follow_the_texts_that_are_scanned(spark, monkeypatch):
    """One passage in all documents: its documents are dealt into many shards."""
    import random

    from tests.llm.conftest import prose

    monkeypatch.setattr(phrases, "_SHARD_BYTES", 2000)
    rng = random.Random(2)
    passage = prose(rng, 30)
    rows = [(i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(120)]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    got = phrases.remove(whole, phrases.repeated(whole), joined=True).collect()
    assert order((r["doc_id"], r["_words"], r["_removed"], r["text"].encode()) for r in got) == order(brute(rows))
