import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import packing, sharding
from tessera.llm._base import written


def jump_by_hand(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_algorithm():
    keys = np.arange(-50, 200, dtype=np.int64)
    state = sharding.mix64(keys.view(np.uint64))
    assert sharding.jump(keys, 13).tolist() == [jump_by_hand(int(k), 13) for k in state]
    assert (sharding.jump(keys, 1) == 0).all()


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20000, dtype=np.int64)
    old, new = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(new[old != new]) == {8} and abs((old != new).mean() - 1 / 9) < 0.02


def test_sharding_of_rows(docs, frame):
    out = sharding.shard(frame(docs), "doc_id", 5, [F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c")]).collect()
    assert Counter((r["doc_id"], r["c"]) for r in out) == Counter((i, zlib.crc32((t or "").encode())) for i, t in docs)
    for s in range(5):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1


def test_sharding_of_nothing(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long"), "doc_id").collect() == []


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_librarys(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    one = test_ids_are_the_librarys.__dict__.setdefault("library", Tokenizer.from_file(path))
    assert packing.encoder(path)(text).tolist() == one.encode(text, add_special_tokens=False).ids


def test_special_strings_and_other_files(library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a <|endoftext|> b"
    assert packing.encoder(path)(text).tolist() == library.encode(text, add_special_tokens=False).ids
    other = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert len(other("Some words")) == 2


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plans_use_every_piece_once(counts):
    used = Counter()
    for items, many in packing.plan(counts, 40):
        assert sum(length * n for length, n in items) <= 40 and many > 0
        for length, n in items:
            used[length] += n * many
    assert used == Counter(counts)


def test_plans_fill_gaps_exactly():
    plan = packing.plan({600: 5, 424: 3, 400: 2, 24: 2, 10: 2, 8: 2, 406: 2}, 1024)
    assert [[(600, 1), (424, 1)], 3] in [list(p) for p in plan]
    assert sum(many for _, many in plan) == 6
    assert packing.plan({1: 10_000_000}, 1024)[0] == ([(1, 1024)], 9765) or sum(m for _, m in packing.plan({1: 10_000_000}, 1024)) == 9766


@pytest.mark.parametrize("limit", [1024, 64])
def test_packing_of_documents(docs, frame, library, limit):
    cut = packing.pieces(frame(docs), limit=limit)
    rows = packing.pack(written(cut, "pieces"), limit).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    want = Counter()
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % limit + 1
        for k, a in enumerate([0, *range(first, len(ids), limit)]):
            b = first if not k else a + limit
            want[(i, k, a, b - a, np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= total / limit * 1.3 + 2


def test_pieces_are_laid_where_they_are_read(docs, frame):
    """No piece is exchanged, whether pieces were numbered when they were made or are now; both give whole sequences."""
    for cut in (packing.pieces(frame(docs), place=True), packing.pieces(frame(docs)).drop("ids")):
        out = packing.pack(written(cut, "pieces"))
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.columns == [c for c in cut.columns if c not in packing.PLACE] + ["sequence_id", "offset"]
        ends = {}
        for r in out.orderBy("sequence_id", "offset").collect():
            assert r["offset"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(ends.values()) <= packing.LIMIT


def test_packing_of_nothing(spark):
    none = packing.pieces(spark.createDataFrame([], "doc_id long, text string"))
    assert packing.pack(written(none, "pieces")).collect() == []


def test_keys_of_other_types(spark):
    """Texts, decimals and dates go by their hash: equal keys together, a null on its own, growth only into the new shard."""
    rows = spark.range(600).select((F.col("id") % 300).cast("string").alias("s"), (F.col("id") % 300 / 7).cast("decimal(20,6)").alias("d"), F.expr("date_add(date'2020-01-01', cast(id % 300 as int))").alias("t"), F.when(F.col("id") % 2 == 0, F.col("id").cast("short")).alias("n"))
    for key in ("s", "d", "t", "n"):
        out = sharding.shard(rows.withColumn("a.b", F.lit(1)), key).collect()
        assert len(out) == 600
        where = {}
        for r in out:
            assert where.setdefault(r[key], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
            assert r["grown_shard"] in (r["shard"], 8)
        assert {r["shard"] for r in out} == set(range(8))


def test_very_long_texts_are_cut_whole(spark, library):
    text = "word " * 120_000
    cut = packing.pieces(spark.createDataFrame([(1, text, 2)], "doc_id long, text string, ids int")).orderBy("piece").collect()
    ids = library.encode(text, add_special_tokens=False).ids + [2]
    assert b"".join(bytes(r["ids"]) for r in cut) == np.array(ids, "<u4").tobytes()
    assert [r["length"] for r in cut[1:]] == [1024] * (len(cut) - 1) and sum(r["length"] for r in cut) == len(ids)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plans_come_near_the_least_number_of_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths, n = np.unique(np.clip(rng.lognormal(5.5, 0.9, 30_000), 1, 1024).astype(int), return_counts=True)
    made = packing.plan(dict(zip(lengths.tolist(), n.tolist(), strict=True)), 1024)
    # whole sequences' worth of ids, or what no two of which fit together
    least = max(-(-int(lengths @ n) // 1024), int(n[lengths > 512].sum()))
    assert sum(many for _, many in made) <= 1.003 * least + 1


def test_ranks_tell_merges_of_the_given_file_only():
    assert packing.ranks_tell_merges(public_tokenizers.path("byte_bpe_50k.json"))
    assert not packing.ranks_tell_merges(public_tokenizers.path("word_bpe_49k.json"))
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 5}
    assert packing._split(b"abc", ranks) == [b"a", b"bc"]
