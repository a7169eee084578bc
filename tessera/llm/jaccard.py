"""Exact Jaccard join on word shingles by universe partition and pigeonhole.

Sets are put into bands by size.  A band has its own partition of the universe of
shingles into segments (by hash).  Two sets as similar as asked differ in at most
``H`` shingles, so if segments are given thresholds 0 or 1 whose sum with the
number of segments is over ``H``, some segment differs by no more than its
threshold: its subsets are equal, or equal after one deletion.  A set is indexed
by its subsets in its own band and looked up in the smaller bands that can hold
partners; segments with threshold 1 also give their one-deletion
neighbourhoods.  How many segments get which threshold, and how many more than
needed there are, is decided for each band by a cost of signatures against empty
or weak segments.

Empty subsets of segments with threshold 0 are not indexed.  That loses nothing
as long as one of two sets has no more empty segments than the band has to spare;
sets with more are joined with each other by a prefix of their shingles in hash
order.  Candidates are first ruled out by the counts of their shingles in parts
of the universe, which bound the difference of two sets from below; the rest is
verified on the texts.

A set drops the signatures that most sets share as long as the segments that they
stand for are ones that it can spare.  All sets drop in the same order, so of the
signatures that two similar sets share the least common one is dropped by neither.

Rows with the same words (by a 128-bit BLAKE2b digest of the lower-cased sequence)
are merged first.  In a group of sets with the same signature, all are compared
with the one that shares most signatures (what others are copies of); those found
linked, directly or not, need no comparison with each other.  The rest of a group
is compared in full: a small one pair by pair, a large one in tiles of two blocks,
which rule pairs out by sizes and folded sketches and make only those that may be
similar.

What is exact: whether two sets are linked is decided on their words, and so are
their sizes.  Signatures and sketches are made of 52-bit hashes, which can only
lose a link if two shingles of one text have equal hashes (for a text of 20,000
words the chance is 5e-8).

Nulls and edge cases: a null or empty text, or one of white space, has the empty
set and links with nothing, not even another such text; a text of fewer words
than a shingle has its whole sequence as its only shingle; a null id is never a
component's id unless all its members' are null; rows with equal texts are one
set, whatever their ids; an empty table gives an empty result; other columns are
not looked at (or, in ``keep_first``, pass unchanged).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.llm._base import quoted, released, row_columns, row_of, scoped, sized, table, written
from tessera.llm._graph import components
from tessera.llm._words import LOWER, Words, mix64, slices, text_bytes

#: The bands' sizes grow by this factor at most.
_GROWTH = 1.3
#: Groups of at most this many sets are joined pair by pair.
_SMALL_GROUP = 32
#: Members in a block of a larger group.
_TILE = 4096
#: Parts of the universe that a sketch in a tile has at most.
_FOLDED = 256
#: Groups that a member remembers, so that a pair is made once.
_REMEMBERED = 32
#: Shingles (about as many as signatures) for each task that counts signatures.
_PART_SHINGLES = 400_000
#: Bytes of text whose shingles are handled at once.
_SLICE = 1 << 18


class Allocation:
    """Bands and their segments for a similarity of ``share`` percent."""

    def __init__(self, share: int):
        if not 0 < share <= 100:
            raise ValueError("the similarity must be over 0 and at most 100 percent")
        self.share = share
        self.low = [1]

    def band(self, n: np.ndarray) -> np.ndarray:
        while self.low[-1] <= (int(n.max()) if len(n) else 0):
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * _GROWTH)))
        return np.searchsorted(np.array(self.low), n, side="right") - 1

    def most_different(self, band: int) -> int:
        """Shingles in which a set of this band and a similar one that is no smaller differ at most."""
        return (100 - self.share) * (self.low[band + 1] - 1) // self.share

    @lru_cache(maxsize=None)  # noqa: B019
    def segments(self, band: int) -> tuple[int, int, int]:
        """How many segments there are, how many of the first have threshold 1, and how many may be empty."""
        small, large = self.low[band], self.low[band + 1] - 1
        best = None
        least = self.most_different(band) + 1
        for spare in range(4) if least <= 4 else range(least // 4 + 2, least // 4 + 6):
            need = least + spare
            for doubled in {*range(min(need // 2, 4) + 1), need // 2}:
                n = need - doubled
                mean = small / n
                weak = n * math.exp(-mean) * (1 + mean)
                empty = (n - doubled) * math.exp(-mean)
                # the chance of more empty segments than there are to spare
                few = term = math.exp(-empty)
                for k in range(1, spare + 1):
                    term *= empty / k
                    few += term
                too_many = 1 - few
                cost = n + doubled * large / n + 2 * weak + 100 * max(0.0, too_many)
                if best is None or cost < best[0]:
                    best = (cost, (n, doubled, spare))
        return best[1]


_HASH = np.uint64((1 << 52) - 1)


def packed_shingles(w: Words, size: int) -> np.ndarray:
    """The distinct shingles in order: a document's number above 52 bits of the shingle's hash."""
    h = w.hashes()
    hashes, inside = w.windows(h, size)
    at = np.flatnonzero(inside)
    doc, value = w.doc_of()[at], hashes[at]
    short = (w.count > 0) & (w.count < size)
    if short.any():
        # the whole sequence as one shingle
        few = np.flatnonzero(short)
        own = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            has = w.count[few] > k
            own[has] = mix64(own[has] * np.uint64(31) + h[w.first[few][has] + k])
        doc, value = np.concatenate((doc, few)), np.concatenate((value, own))
    both = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (value >> np.uint64(12)))
    if len(both):
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        both = both[new]
    return both


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, in order: document, hash, first of each document, count."""
    both = packed_shingles(w, size)
    doc = (both >> np.uint64(52)).astype(np.int64)
    first = np.searchsorted(doc, np.arange(len(w.count) + 1))
    return doc, mix64(both & _HASH), first, np.diff(first)


def fingerprints(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a digest of each document's sequence of words."""
    raw = w.buf.tobytes()
    out = b"".join(blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(w.docs[:-1].tolist(), w.docs[1:].tolist(), strict=True))
    both = np.frombuffer(out, "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def shingle_set(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def exact_counts(w: Words, count: np.ndarray, size: int) -> np.ndarray:
    """Sizes of the sets; where all of a text's windows have different hashes, ``count`` (by hash) is exact."""
    out = count.astype(np.int64)
    for d in np.flatnonzero(count < np.maximum(w.count - size + 1, np.minimum(w.count, 1))):
        out[d] = len(shingle_set(w.texts(d), size))
    return out


def sketches(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set how many shingles it has in each of equal parts of the universe, half as many parts as shingles.

    Two sets differ in at least the sum of the differences of these counts.  The
    number of parts is a power of two, so that a finer sketch can be folded.
    """
    place = mix64(h ^ np.uint64(0x2222))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        bits = min(max(6, (b - a - 1).bit_length() - 1), 16)
        part = (place[a:b] >> np.uint64(64 - bits)).astype(np.int64)
        out.append(np.minimum(np.bincount(part, minlength=1 << bits), 65535).astype("<u2").tobytes())
    return out


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound on the number of shingles that are in one of two sets, from their sketches."""
    x, y = np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u2").astype(np.int64)
    n = min(len(x), len(y))
    return int(np.abs(x.reshape(n, -1).sum(axis=1) - y.reshape(n, -1).sum(axis=1)).sum())


def signatures(allocation: Allocation, doc: np.ndarray, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, signature and segment of every indexed subset, of whole slices of documents at once.

    The segment's number has, from its top: bands below the set's own (8 bits),
    128 and the segments that the set can still spare there (16), the segment (32)
    and its threshold (1).
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    own = allocation.band(np.maximum(count, 1))
    value, place = mix64(h ^ np.uint64(0xABCD)), h >> np.uint64(32)
    low = np.array(allocation.low)
    for lower in range(int(own.max(initial=0)) + 1):
        band = own - lower
        use = (band >= 0) & (count > 0)
        if lower:
            # smaller bands whose largest sets can be similar
            use &= allocation.share * count <= 100 * (low[np.maximum(band, 0) + 1] - 1)
            if not use.any():
                break
        kinds = np.array([allocation.segments(int(b)) if b >= 0 else (1, 0, 0) for b in range(-1, int(own.max(initial=0)) + 1)], np.int64)
        n, doubled, spare = kinds[np.maximum(band, -1) + 1].T
        if lower:
            use &= (n > 1) | (doubled > 0)  # else only equal sets are similar enough, and those are in one band
        mine = use[doc]
        d, v = doc[mine], value[mine]
        seg = ((place[mine] * n.astype(np.uint64)[d]) >> np.uint64(32)).astype(np.int64)
        base = np.concatenate(([0], np.cumsum(np.where(use, n, 0))))
        total = np.zeros(base[-1], np.uint64)
        cell = base[d] + seg
        np.add.at(total, cell, v)
        filled = np.bincount(cell, minlength=base[-1])
        seg_doc = np.repeat(np.arange(len(count)), np.where(use, n, 0))
        seg_no = np.arange(base[-1]) - base[seg_doc]
        name = mix64((band[seg_doc].astype(np.uint64) << np.uint64(32)) + seg_no.astype(np.uint64))
        pairs = seg_no < doubled[seg_doc]
        empty = np.zeros(len(count), np.int64)
        np.add.at(empty, seg_doc[(filled == 0) & ~pairs], 1)
        left = (lower << 49) | (np.clip(spare - empty, -128, 32767) + 128) << 33
        give = (filled > 0) | pairs
        out.append((seg_doc[give], mix64(total[give] ^ name[give]), left[seg_doc[give]] | seg_no[give] << 1 | pairs[give]))
        less = seg < doubled[d]
        at = cell[less]
        out.append((d[less], mix64((total[at] - v[less]) ^ name[at]), left[d[less]] | seg[less] << 1 | 1))
        sparse = use & (empty > spare)
        if sparse.any():
            # prefixes in hash order
            some = sparse[doc]
            sd, sh = doc[some], value[some]
            order = np.lexsort((sh, sd))
            sd, sh = sd[order], sh[order]
            rank = np.arange(len(sd)) - np.searchsorted(sd, sd)
            keep = rank <= count[sd] - -(-allocation.share * count[sd] // 100)
            out.append((sd[keep], mix64(sh[keep] ^ np.uint64(0x77)), left[sd[keep]]))
    owner, sig, place = (np.concatenate(x) for x in zip(*out, strict=True))
    return owner, sig.view(np.int64), place


def _sets(batch_text: pa.Array, size: int) -> Iterator[tuple[int, Words, tuple]]:
    data, offsets = text_bytes(batch_text)
    for i, j in slices(offsets, _SLICE, most=4096):
        w = Words(data, offsets, i, j, lower=True)
        yield i, w, shingles(w, size)


def described(docs: DataFrame, text: str, size: int, columns: list[str], sets: bool = True) -> DataFrame:
    """``columns`` with ``_n`` (size of the set) and the digest ``_x``, ``_y``; with the sketch ``_s``, or else ``_n`` is the number of words."""
    kept = docs.select(*columns, F.col(text).alias("_text"))
    schema = docs.select(*columns).schema.add("_n", "long").add("_x", "long").add("_y", "long")
    schema = schema.add("_s", "binary") if sets else schema

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            sketch: list[bytes] = []
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets, _SLICE, most=4096):
                w = Words(data, offsets, i, j, lower=True)
                if sets:
                    _, h, first, count = shingles(w, size)
                    sketch += sketches(h, first)
                n.append(exact_counts(w, count, size) if sets else w.count.astype(np.int64))
                for to, f in zip((x, y), fingerprints(w), strict=True):
                    to.append(f)
            made = [pa.array(np.concatenate(c)) for c in (n, x, y)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made, *([pa.array(sketch, pa.binary())] if sets else [])], names=schema.names)

    return kept.mapInArrow(describe, schema)


_SIGNATURE = StructType([StructField("sig", LongType()), StructField("place", LongType())])


def _emitted(docs: DataFrame, key: str, text: str, size: int, share: int, places: bool) -> DataFrame:
    """A row for each document: key, fingerprints, and the array of its signatures (with segments, if wanted)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allocation = Allocation(share)
        for batch in batches:
            for i, w, (doc, h, first, count) in _sets(batch.column(1), size):
                n = len(w.count)
                x, y = fingerprints(w)
                owner, sig, place = signatures(allocation, doc, h, count)
                order = np.argsort(owner, kind="stable")
                offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
                values = pa.array(sig[order])
                if places:
                    values = pa.StructArray.from_arrays([values, pa.array(place[order])], names=["sig", "place"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(x), pa.array(y), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["_key", "_x", "_y", "_sigs"])

    schema = docs.select(F.col(key).alias("_key")).schema.add("_x", "long").add("_y", "long").add("_sigs", ArrayType(_SIGNATURE if places else LongType()))
    return docs.select(F.col(key), F.col(text)).mapInArrow(emit, schema)


def similar(x: set, y: set, share: int) -> bool:
    """Whether two sets of shingles are as similar as asked."""
    if not x or not y:
        return False
    shared = len(x & y)
    return 100 * shared >= share * (len(x) + len(y) - shared)


def all_similar(left: pa.Array, right: pa.Array, size: int, share: int) -> np.ndarray:
    """Which rows' two texts are as similar as asked, by their words."""
    (da, oa), (db, ob) = text_bytes(left), text_bytes(right)
    out = np.zeros(len(left), bool)
    held: dict[bytes, set] = {}  # the last text's set: rows of a group's pivot come one after another

    def shingles_of(raw: bytes) -> set:
        if raw not in held:
            if len(held) > 1:
                held.clear()
            held[raw] = shingle_set(raw.split(), size)
        return held[raw]

    for i in range(len(left)):
        a, b = LOWER[da[oa[i] : oa[i + 1]]].tobytes(), LOWER[db[ob[i] : ob[i + 1]]].tobytes()
        out[i] = similar(shingles_of(a), shingles_of(b), share)
    return out


def _wanted(pairs: DataFrame) -> DataFrame:
    ids = pairs.select(F.col("a").alias("_w")).unionByName(pairs.select(F.col("b").alias("_w"))).distinct()
    return sized(written(ids, "wanted"))


def _near(pairs: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """Those of the pairs ``a``, ``b`` of classes that sizes and sketches do not rule out."""
    n = classes.select("_id", "_n")
    sizes = pairs.join(sized(n.toDF("a", "_na")), "a").join(sized(n.toDF("b", "_nb")), "b")
    pairs = written(sizes.filter(100 * F.least("_na", "_nb") >= share * F.greatest("_na", "_nb")), "pairs")
    sketch = classes.join(_wanted(pairs), F.col("_id") == F.col("_w")).select("_id", "_s")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy()
            fits = [(100 + share) * least_difference(x.as_py(), y.as_py()) <= (100 - share) * t for t, x, y in zip(total.tolist(), batch.column(3), batch.column(4), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(fits, pa.bool_()))

    both = pairs.join(sketch.toDF("a", "_sa"), "a").join(sketch.toDF("b", "_sb"), "b").select("a", "b", F.col("_na") + F.col("_nb"), "_sa", "_sb")
    return both.mapInArrow(near, "a long, b long")


def folded(sketch: bytes) -> bytes:
    """A sketch of at most ``_FOLDED`` parts, each count cut at 255, so that differences are no larger than before."""
    x = np.frombuffer(sketch, "<u2").astype(np.int64)
    return np.minimum(x.reshape(min(len(x), _FOLDED), -1).sum(axis=1), 255).astype(np.uint8).tobytes()


def near_in_tile(ids: np.ndarray, label: np.ndarray, n: np.ndarray, sketch: list[bytes], low: np.ndarray, same: bool, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels, of two blocks or within one, that sizes and folded sketches do not rule out."""
    parts = min(map(len, sketch))
    flat = np.empty((len(ids), parts), np.int16)
    for i, x in enumerate(sketch):
        # counts cut at 255 are cut again when parts are joined: differences still do not grow
        flat[i] = np.minimum(np.frombuffer(x, np.uint8).astype(np.int64).reshape(parts, -1).sum(axis=1), 255)
    order = np.argsort(n, kind="stable")
    left, right = (order, order) if same else (order[low[order]], order[~low[order]])
    sizes = n[right]
    least, most = np.searchsorted(sizes, -(-share * n[left] // 100)), np.searchsorted(sizes, 100 * n[left] // share, side="right")
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (i, lo, hi) in enumerate(zip(left.tolist(), least.tolist(), most.tolist(), strict=True)):
        j = right[max(lo, k + 1) if same else lo : hi]
        j = j[label[j] != label[i]]
        if len(j):
            j = j[(100 + share) * np.abs(flat[j] - flat[i]).sum(axis=1, dtype=np.int64) <= (100 - share) * (n[j] + n[i])]
            a.append(np.minimum(ids[j], ids[i]))
            b.append(np.maximum(ids[j], ids[i]))
    return np.concatenate(a), np.concatenate(b)


def _near_in_tiles(groups: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """The same for all pairs of different labels in large groups (sig, m, l, n).

    A group's members are dealt into blocks of ``_TILE``, and each pair of blocks is
    one bounded task; only pairs that may be similar are made.  A member is sent as
    a few numbers and a folded sketch.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([folded(x.as_py()) for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["m", "_n", "_s"])

    each = classes.select(F.col("_id").alias("m"), "_n", "_s").join(_wanted(groups.select(F.col("m").alias("a"), F.col("m").alias("b"))), F.col("m") == F.col("_w"))
    each = each.select("m", "_n", "_s").mapInArrow(fold, "m long, _n long, _s binary")
    blocks = F.ceil(F.col("n") / _TILE).cast("long")
    # a pair of members of several groups is made in the least of those both remember, or in each if they remember none together
    kept = groups.groupBy("m").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, _REMEMBERED).alias("_sigs"))  # bounded by the text
    dealt = groups.join(kept, "m").join(each, "m").withColumn("_b", F.pmod(F.xxhash64("m"), blocks)).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("sig", "m", "l", "_n", "_s", "_sigs", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def compare(part: pa.Table) -> pa.Table:
        m, label, n, block = (part.column(c).to_numpy() for c in ("m", "l", "_n", "_b"))
        i, j = part.column("_i")[0].as_py(), part.column("_j")[0].as_py()
        low = block == i
        if i != j and (low.all() or not low.any()):
            a = b = np.zeros(0, np.int64)
        else:
            a, b = near_in_tile(m, label, n, part.column("_s").to_pylist(), low, i == j, share)
            own, sigs = part.column("sig")[0].as_py(), part.column("_sigs").combine_chunks()
            at = {x: k for k, x in enumerate(m.tolist())}
            of = lru_cache(maxsize=None)(lambda x: frozenset(sigs[at[x]].as_py()))
            here = np.array([min(of(x) & of(y), default=own) == own for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
            a, b = a[here], b[here]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("sig", "_i", "_j").applyInArrow(compare, "a long, b long")


def _similar(pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, size: int, share: int) -> DataFrame:
    """Those of the (written) pairs that are similar, by their texts."""
    if pairs.isEmpty():
        return pairs
    first = written(classes.join(_wanted(pairs), F.col("_id") == F.col("_w")).select("_id", "_first", "_x", "_y"), "representatives")
    got = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(sized(first), F.col("_key").eqNullSafe(F.col("_first")))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of rows that share an id, the one with the class's text
        for batch in batches:
            keep = [np.zeros(0, bool)]
            x, y = (batch.column(k).to_numpy() for k in (2, 3))
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                fx, fy = fingerprints(Words(data, offsets, i, j, lower=True))
                keep.append((fx == x[i:j]) & (fy == y[i:j]))
            yield batch.select([0, 1]).filter(pa.array(np.concatenate(keep)))

    texts = written(got.select("_id", "_text", "_x", "_y").mapInArrow(own, "_id long, _text string"), "texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(all_similar(batch.column(2), batch.column(3), size, share)))

    one, two = texts.toDF("a", "_ta"), texts.toDF("b", "_tb")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "_ta", "_tb")
    out = written(both.mapInArrow(verify, "a long, b long"), "similar")
    released(docs.sparkSession)
    return out


def _spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signatures that sets keep, with the sum of all their signatures' counts.

    A set drops its signatures from the most common one on (ties by the signature)
    until the segments of those would be more than it can spare in their band.
    """
    for batch in batches:
        some = batch.column(1)
        n, sig, place = (np.asarray(x) for x in some.flatten().flatten())
        row = np.repeat(np.arange(batch.num_rows), np.asarray(some.value_lengths()))
        order = np.lexsort((place, sig, -n, row))
        row, n, sig, place = row[order], n[order], sig[order], place[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (sig[1:] != sig[:-1])
        row, n, sig, place = row[new], n[new], sig[new], place[new]
        shares = np.bincount(row, n, minlength=batch.num_rows).astype(np.int64)
        # by set and band, in the same order
        order = np.lexsort((np.arange(len(row)), place >> 33, row))
        row, sig, place = row[order], sig[order], place[order]
        band = np.ones(len(row), bool)
        band[1:] = (row[1:] != row[:-1]) | (place[1:] >> 33 != place[:-1] >> 33)
        of_band = np.cumsum(band) - 1
        segment = place & ((1 << 33) - 1)
        _, first = np.unique(of_band << 33 | segment, return_index=True)
        weight = np.zeros(len(row), np.int64)
        weight[first] = (segment[first] & 1) + 1
        total = np.cumsum(weight)
        start = np.flatnonzero(band)
        spent = total - (total[start] - weight[start])[of_band]
        keep = spent > ((place >> 33) & 65535) - 128
        yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), batch.column(0).take(pa.array(row[keep])), pa.array(shares[row[keep]])], names=["sig", "m", "shares"])


@scoped
def classes_of(docs: DataFrame, key: str, text: str, size: int, share: int) -> tuple[DataFrame, DataFrame]:
    """A written description of each row (``_key``, ``_n``, ``_x``, ``_y``) and of each class with its ``_component``.

    A class is a non-empty set; its component is given by the smallest id in it.
    """
    spark = docs.sparkSession
    rows = written(described(docs.select(F.col(key).alias("_key"), F.col(text).alias("_body")), "_body", size, ["_key"]), "described")
    merged = rows.filter("_n > 0").groupBy("_x", "_y").agg(F.min("_key").alias("_first"), F.first("_n").alias("_n"), F.first("_s").alias("_s"))
    classes = written(merged.select(F.monotonically_increasing_id().alias("_id"), "_first", "_n", "_x", "_y", "_s"), "classes")
    reps = classes.select("_id", "_first", F.col("_x").alias("_cx"), F.col("_y").alias("_cy"))

    def emission(places: bool) -> DataFrame:
        sent = _emitted(docs, key, text, size, share, places)
        sent = sent.join(sized(reps), (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy"))).filter(F.col("_key").eqNullSafe(F.col("_first")))
        return sent.select(F.col("_id").alias("m"), F.explode("_sigs").alias("s"))

    # most signatures are of one set: counting them before the exchange would only take memory
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(classes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] // _PART_SHINGLES) + 1)
    again = written(emission(False).select(F.col("s").alias("sig")).repartition(parts, "sig").groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    released(spark)
    found = emission(True).join(sized(again), F.col("s.sig") == F.col("sig")).select("m", F.struct("n", "sig", "s.place").alias("f"))
    # a row for each set that shares a signature, with all of those: bounded by its text
    kept = written(found.groupBy("m").agg(F.collect_list("f").alias("f")).mapInArrow(_spared, "sig long, m long, shares long"), "kept")
    released(spark)
    # the text that others are copies of shares more signatures than they do with each other: it is their pivot
    groups = kept.groupBy("sig").agg(F.max(F.struct("shares", "m"))["m"].alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sig", "a")
    members = written(kept.join(groups, "sig").filter("a <> m").select("sig", "a", "m"), "members")  # each group's pivot is compared with all others
    pairs = members.select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b")).distinct()
    links = _similar(written(_near(pairs, classes, share), "near"), docs, classes, key, text, size, share)
    label = written(components(links), "labels")
    marked = members.join(sized(label), F.col("m") == F.col("node"), "left").select("sig", "m", F.coalesce("component", "m").alias("l"))
    open_ = marked.groupBy(F.col("sig").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("lo"), F.max("l").alias("hi")).filter("lo < hi").select("s", "n")
    left = written(marked.join(open_, F.col("sig") == F.col("s")).select("sig", "m", "l", "n"), "left")
    few = left.filter(F.col("n") <= _SMALL_GROUP)
    tests = few.join(few.select("sig", F.col("m").alias("p"), F.col("l").alias("pl")), "sig").filter("m < p and l <> pl").select(F.col("m").alias("a"), F.col("p").alias("b")).distinct()
    new = _similar(written(_near(tests.unionByName(_near_in_tiles(left.filter(F.col("n") > _SMALL_GROUP), classes, share)).distinct(), classes, share), "near"), docs, classes, key, text, size, share)
    if not new.isEmpty():
        # the trees found before stand for all links found before
        label = written(components(label.toDF("a", "b").unionByName(new)), "labels")
    first = classes.join(sized(label), F.col("_id") == F.col("node"), "left").select("_x", "_y", "_first", F.coalesce("component", "_id").alias("_c"))
    first = written(first, "classes")
    smallest = written(first.groupBy(F.col("_c").alias("_cc")).agg(F.min("_first").alias("_component")), "smallest")
    told = first.join(sized(smallest), F.col("_c") == F.col("_cc")).select(F.col("_x").alias("_cx"), F.col("_y").alias("_cy"), "_component", F.col("_c").alias("_group"))
    return rows, written(told, "told")


@scoped
def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, share: int = 85) -> DataFrame:
    """``key``, n_shingles and component_id of every row."""
    rows, told = classes_of(docs, key, text, size, share)
    out = rows.join(sized(told), (F.col("_n") > 0) & (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy")), "left")
    return out.select(F.col("_key").alias(key), F.col("_n").alias("n_shingles"), F.when(F.col("_cx").isNull(), F.col("_key")).otherwise(F.col("_component")).alias("component_id"))


@scoped
def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """One row of each component (the one with the smallest id; of equal rows one), with all columns.

    Texts without words are in no component and all stay.
    """
    _, told = classes_of(docs, key, text, size, share)
    rows = docs.select(row_of(docs).alias("_row"), F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_body"))
    full = described(rows, "_body", size, ["_row", "_key"], sets=False)
    out = full.join(sized(told), (F.col("_n") > 0) & (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy")), "left")
    out = out.filter(F.col("_cx").isNull() | F.col("_key").eqNullSafe(F.col("_component"))).select("_row", "_group", "_x", "_y")
    # rows that share the smallest id (or a null one) of their component: one of them stays
    again = out.filter("_group is not null").groupBy(F.col("_group").alias("_again")).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").select("_again")
    again = written(again.withColumn("_yes", F.lit(True)), "again")
    if again.isEmpty():
        return out.select(*row_columns(docs, "_row"))
    marked = out.join(sized(again), F.col("_group") == F.col("_again"), "left")
    one = marked.filter("_yes").groupBy("_group").agg(F.min_by("_row", F.struct("_x", "_y", F.xxhash64("_row"))).alias("_row"))
    return marked.filter("_yes is null").select("_row").unionByName(one.select("_row")).select(*row_columns(docs, "_row"))


def op3_universe_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
