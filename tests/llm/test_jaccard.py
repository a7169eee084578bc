import numpy as np
import pytest

from tessera.llm import jaccard
from tests.llm.conftest import Groups, split


def sets(rows, size):
    out = []
    for _, t in rows:
        w = split(t, True)
        out.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    return out


def brute(rows, size, share):
    """Component (smallest id, by row) of each row."""
    some = sets(rows, size)
    groups = Groups(range(len(rows)))
    for i, a in enumerate(some):
        for j in range(i):
            shared = len(a & some[j])
            if shared and 100 * shared >= share * (len(a) + len(some[j]) - shared):
                groups.join(i, j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(groups.of(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in members.items()}
    return some, [least[groups.of(i)] for i in range(len(rows))]


@pytest.mark.parametrize("size, share", [(4, 85), (5, 80), (2, 50), (1, 100)])
def test_components_as_by_brute_force(docs, frame, size, share):
    some, want = brute(docs, size, share)
    got = jaccard.join_components(frame(docs), size=size, share=share).collect()
    expected = sorted([(i if i is not None else -1, len(s), c if c is not None else -1) for (i, _), s, c in zip(docs, some, want, strict=True)])
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == expected


def test_large_groups_go_through_tiles(docs, frame, monkeypatch):
    monkeypatch.setattr(jaccard, "_SMALL_GROUP", 3)
    monkeypatch.setattr(jaccard, "_TILE", 7)
    _, want = brute(docs, 4, 90)
    got = jaccard.join_components(frame(docs), share=90).collect()
    key = lambda x: -1 if x is None else x
    assert sorted((key(r["doc_id"]), key(r["component_id"])) for r in got) == sorted((key(i), key(c)) for (i, _), c in zip(docs, want, strict=True))


def test_one_of_each_group_stays_with_its_columns(docs, frame):
    whole = frame(docs)
    got = jaccard.keep_first(whole).collect()
    _, want = brute(docs, 5, 80)
    keep = [(i, t) for (i, t), c in zip(docs, want, strict=True) if not split(t) or i == c]
    assert sorted(map(repr, {(r["doc_id"], r["text"]) for r in got})) == sorted(map(repr, set(keep)))
    assert list(got[0].asDict()) == whole.columns


def test_repeated_and_clashing_ids(spark):
    text = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (1, "other words stand here now and then again"), (None, text)], "doc_id long, text string")
    got = jaccard.join_components(rows).collect()
    assert [r["component_id"] for r in got if r["n_shingles"] == 7] == [1, 1, 1, 1]
    assert len(jaccard.keep_first(rows).collect()) == 2


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join_components(none).collect() == [] and jaccard.keep_first(none).collect() == []


def test_segments_reach_every_similar_pair():
    """Whatever sets are similar enough share a signature, small and large ones."""
    rng = np.random.default_rng(3)
    for share in (60, 80, 85, 95):
        allocation = jaccard.Allocation(share)
        for n in [*range(1, 40), 60, 100, 250, 900]:
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            drop = rng.integers(0, n + 1)
            for cut in {0, 1, drop, (100 - share) * n // 100}:
                other = np.concatenate((base[cut:], rng.integers(0, 2**63, int(rng.integers(0, cut + 2)), dtype=np.uint64)))
                shared = n - cut
                if not shared or 100 * shared < share * (n + len(other) - shared) or set(base) == set(other):
                    continue
                doc = np.repeat([0, 1], [n, len(other)])
                owner, sig, _ = jaccard.signatures(allocation, doc, np.concatenate((base, other)), np.array([n, len(other)]))
                assert set(sig[owner == 0]) & set(sig[owner == 1]), (share, n, cut, len(other))


def test_two_similar_sets_keep_a_signature_that_they_share():
    """Whatever is common: every set drops what it can spare, and similar ones still meet."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    for share in (80, 85):
        allocation = jaccard.Allocation(share)
        for n in (6, 30, 120, 400):
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            some = []
            for _ in range(40):
                other = base.copy()
                at = rng.choice(n, int(rng.integers(0, max(2, (100 - share) * n // 130))), replace=False)
                other[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
                some.append(np.unique(other))
            count = np.array([len(x) for x in some])
            owner, sig, place = jaccard.signatures(allocation, np.repeat(np.arange(40), count), np.concatenate(some), count)
            names, times = np.unique(sig, return_counts=True)
            seen = dict(zip(names.tolist(), times.tolist(), strict=True))
            rows = [[{"n": seen[s], "sig": s, "place": p} for s, p in zip(sig[owner == d].tolist(), place[owner == d].tolist(), strict=True) if seen[s] > 1] for d in range(40)]
            kind = pa.list_(pa.struct([("n", pa.int64()), ("sig", pa.int64()), ("place", pa.int64())]))
            out = next(jaccard._spared(iter([pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(rows, kind)], names=["m", "f"])])))
            kept = [set() for _ in range(40)]
            for s, m in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                kept[m].add(s)
            assert sum(map(len, kept)) < sum(map(len, rows)) or n < 30
            for a in range(40):
                for b in range(a):
                    shared = len(np.intersect1d(some[a], some[b]))
                    if 100 * shared >= share * (count[a] + count[b] - shared):
                        assert kept[a] & kept[b], (share, n)


def test_equal_sets_of_other_sequences_are_linked(spark):
    text = "a b c d a b c d a b c d"
    rows = spark.createDataFrame([(3, text), (1, "A B C D A b c d a b c d a"), (2, "x y z"), (4, "x  y\nz"), (5, "x y z x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(rows).collect()}
    assert got == {3: (4, 1), 1: (4, 1), 2: (1, 2), 4: (1, 2), 5: (1, 5)}
