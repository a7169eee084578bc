"""Removal of repeated passages: every window of words that also starts earlier.

1. *Confirm recurring passages.*  Of each text that is the first of its equals, an
   anchor (the eight-word run of least hash) stands for every window.  Equal
   windows have equal anchors, so only windows whose anchor occurs twice or more
   are hashed and counted.  Those that occur twice give, for every later place,
   the place of the first, and runs of such places are passages.
2. *Compile automata.*  Documents with such places are dealt into shards of a bounded
   number of bytes, and each shard's passages, cut from the text of their first
   place, make its Aho-Corasick automata (several, if one would get large).
3. *Stream the documents* of a shard through its automata.  Documents without any
   window that occurs elsewhere are not streamed: step 1 has looked at each window of
   each of them.

A window is removed only if its words equal the earlier one's, and a text as a copy
only if its words have the same 128-bit BLAKE2b digest as the first one's.  Windows
are paired by 64-bit hashes; should two of them that differ share one, a repeat could
be left standing.

All places are numbers: a text's first word has as many words before it as the
texts of smaller ids have together.  So two integers describe an occurrence, and
minima and counts are combined before any exchange; a passage that a third of all
documents share is one counted row from each task.

Nulls and edge cases: a null or empty text has no words and nothing is removed;
texts of fewer words than a window stay whole; of equal texts the one with the
smallest id stays (a null id is larger than any other) and the others lose all
words if they have a window's; rows that repeat id and text are one document;
different texts under one id are ordered by a hash of the text; overlapping
repeats within one text follow the same rule; an empty table gives an empty
result; other columns are not looked at (or pass unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.llm._base import quoted, released, row_columns, scoped, sized, table, with_position, written
from tessera.llm._words import Words, slices, text_bytes

WINDOW = 20
ANCHOR = 8
#: Windows in a phrase at most; a longer passage is several overlapping phrases.
_RUN = 256
#: Characters of phrases in one automaton at most.
_AUTOMATON_CHARS = 1_000_000
#: Most bytes of windows' first places that are broadcast: they grow with the repeats, and one side of a large join is enough.
_FIRST_BYTES = 8 << 20
#: Bytes of texts in a shard.
_SHARD_BYTES = 1 << 21


def sequence_prints(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a digest of each document's sequence of words."""
    raw = w.buf.tobytes()
    out = b"".join(blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(w.docs[:-1].tolist(), w.docs[1:].tolist(), strict=True))
    both = np.frombuffer(out, "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _words_of(column: pa.Array) -> Iterator[tuple[int, Words]]:
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        yield i, Words(data, offsets, i, j)


def described(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``columns`` with ``_n`` (words) and the fingerprints ``_x``, ``_y`` of the text."""
    kept = docs.select(*columns) if text in columns else docs.select(*columns, F.col(text).alias("_text"))
    at = columns.index(text) if text in columns else len(columns)
    schema = docs.select(*columns).schema.add("_n", "long").add("_x", "long").add("_y", "long")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, w in _words_of(batch.column(at)):
                fx, fy = sequence_prints(w)
                n.append(w.count.astype(np.int64))
                x.append(fx)
                y.append(fy)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *[pa.array(np.concatenate(c)) for c in (n, x, y)]], names=schema.names)

    return kept.mapInArrow(describe, schema)


def anchors(w: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window (by index of its first word): whether it is one, and its anchor's place and hash."""
    grams, _ = w.windows(h, ANCHOR)
    inside = np.repeat(w.first[1:], w.count) - np.arange(len(w)) >= size
    wide = size - ANCHOR + 1
    if len(w) < size:
        return inside, np.zeros(len(w), np.int64), grams
    # the least of `wide` grams from each place on, by doubling
    best, at, step = grams.copy(), np.arange(len(w)), 1
    while step < wide:
        jump = min(step, wide - step)
        b, a = best[jump:], at[jump:]
        less = b < best[: len(b)]
        best = np.concatenate((np.where(less, b, best[: len(b)]), best[len(b) :]))
        at = np.concatenate((np.where(less, a, at[: len(a)]), at[len(a) :]))
        step += jump
    return inside, at, best


_ANCHOR_TYPE = ArrayType(StructType([StructField("a", LongType()), StructField("s", LongType()), StructField("w", ArrayType(LongType()))]))


def _emitted(docs: DataFrame, key: str, text: str, size: int, windows: bool) -> DataFrame:
    """A row for each document: key, fingerprints and its anchors, with their windows' hashes if wanted."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w in _words_of(batch.column(1)):
                n = len(w.count)
                h = w.hashes()
                x, y = sequence_prints(w)
                inside, at, least = anchors(w, h, size)
                start = np.flatnonzero(inside)
                doc = w.doc_of()[start]
                new = np.ones(len(start), bool)
                new[1:] = (at[start][1:] != at[start][:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                per_doc = np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=n)))).astype(np.int32)
                found = pa.array(least[start][first].view(np.int64))
                if windows:
                    hashes, _ = w.windows(h, size)
                    offsets = np.append(first, len(start)).astype(np.int32)
                    own = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[start].view(np.int64)))
                    values = pa.StructArray.from_arrays([found, pa.array((start - w.first[doc])[first]), own], names=["a", "s", "w"])
                else:
                    values = found
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(x), pa.array(y), pa.ListArray.from_arrays(pa.array(per_doc), values)], names=["_key", "_x", "_y", "_found"])

    schema = docs.select(F.col(key).alias("_key")).schema.add("_x", "long").add("_y", "long").add("_found", _ANCHOR_TYPE if windows else ArrayType(LongType()))
    return docs.select(F.col(key), F.col(text)).mapInArrow(emit, schema)


def _ordered(firsts: DataFrame) -> DataFrame:
    """Texts with ``_base``: the words of all texts before, by id and hash."""
    dealt = firsts.repartitionByRange(F.col("_first").asc_nulls_last(), "_x", "_y").sortWithinPartitions(F.col("_first").asc_nulls_last(), "_x", "_y")
    rows = with_position(written(dealt, "ordered"))
    sums = rows.groupBy("_file").agg(F.sum("_n").alias("_sum"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    shift = sums.select(F.col("_file").alias("_f"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_w", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(shift, F.col("_file") == F.col("_f"))
    return written(placed.select("_first", "_n", "_x", "_y", (F.col("_w") + F.col("_shift")).alias("_base")), "texts")


def _runs(places: DataFrame) -> DataFrame:
    """Places (base, pos, fbase, fpos) to runs (base, s, k, fbase, fs) of up to ``_RUN`` windows."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, pos, fbase, fpos = (c.to_numpy() for c in batch.columns)
            if not len(base):
                continue
            new = np.ones(len(base), bool)
            new[1:] = (base[1:] != base[:-1]) | (pos[1:] != pos[:-1] + 1) | (fpos[1:] != fpos[:-1] + 1) | (fbase[1:] != fbase[:-1])
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(base)))
            parts = -(-length // _RUN)
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.repeat(at, parts) + k * _RUN
            size = np.minimum(_RUN, np.repeat(at + length, parts) - first)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (base[first], pos[first] - base[first], size, fbase[first], fpos[first] - fbase[first])], names=["base", "s", "k", "fbase", "fs"])

    near = places.repartition("base").sortWithinPartitions("base", "pos").select("base", "pos", "fbase", "fpos")
    return near.mapInArrow(join, "base long, s long, k long, fbase long, fs long")


def _texts(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """``_base`` and ``_text`` of the wanted texts (first id, fingerprints, base)."""
    got = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(sized(wanted), F.col("_key").eqNullSafe(F.col("_first")))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of rows that share an id, those with the text
        for batch in batches:
            keep = [np.zeros(0, bool)]
            x, y = (batch.column(k).to_numpy() for k in (2, 3))
            for i, w in _words_of(batch.column(1)):
                fx, fy = sequence_prints(w)
                keep.append((fx == x[i : i + len(fx)]) & (fy == y[i : i + len(fy)]))
            yield batch.select([0, 1]).filter(pa.array(np.concatenate(keep)))

    return got.select("_base", "_text", "_x", "_y").mapInArrow(own, "_base long, _text string")


def _phrase_texts(texts: DataFrame, phrases: DataFrame, size: int) -> DataFrame:
    """Phrases (fbase, fs, k) with their words, a space around each, from the text of their first place."""
    each = phrases.groupBy(F.col("fbase").alias("_base")).agg(F.collect_list(F.struct("fs", "k")).alias("_parts"))  # bounded by the text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for base, text, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().encode().split()
                rows += [(base, p["fs"], p["k"], " " + b" ".join(words[p["fs"] : p["fs"] + p["k"] + size - 1]).decode() + " ") for p in parts]
            if rows:
                a, b, c, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["fbase", "fs", "k", "phrase"])

    return texts.join(each, "_base").select("_base", "_text", "_parts").mapInArrow(cut, "fbase long, fs long, k long, phrase string")


def locate(phrases: list[tuple[str, int, int]], texts: list[tuple[int, list[str]]], size: int, limit: int = _AUTOMATON_CHARS) -> list[np.ndarray]:
    """For each text (place of its first word, words) which words stand in an occurrence of a phrase.

    A phrase is (words with a space around each, first place, number of words);
    its occurrence at its first place, or before, does not count.
    """
    import ahocorasick

    joined = [" " + " ".join(words) + " " for _, words in texts]
    edges = [np.cumsum([0] + [len(x) + 1 for x in words]) for _, words in texts]
    marks = [np.zeros(len(words) + 1, np.int64) for _, words in texts]
    i = 0
    while i < len(phrases):
        automaton, held = ahocorasick.Automaton(), 0
        while i < len(phrases) and (not held or held + len(phrases[i][0]) <= limit):
            phrase, place, n = phrases[i]
            held += len(phrase)
            old = automaton.get(phrase, None)
            automaton.add_word(phrase, (min(place, old[0]) if old else place, n))
            i += 1
        automaton.make_automaton()
        for (base, _), text, edge, mark in zip(texts, joined, edges, marks, strict=True):
            for end, (place, n) in automaton.iter(text):
                last = int(np.searchsorted(edge, end))  # the word before the closing space is last - 1
                if base + last - n > place:
                    mark[last - n] += 1
                    mark[last] -= 1
    return [np.cumsum(m)[:-1] > 0 for m in marks]


def _spans(removed: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], removed.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


@scoped
def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """The spans of words to remove: for each text with any (by fingerprints and first id) ``_spans``.

    Copies (equal texts under larger ids) are told by ``_copies``: they lose all words.
    """
    if size < ANCHOR:
        raise ValueError(f"a window must have at least {ANCHOR} words")
    spark = docs.sparkSession
    docs, key, text = docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_body")), "_key", "_body"
    rows = written(described(docs, text, [key]), "described")
    equal = rows.filter(F.col("_n") >= size).groupBy("_x", "_y").agg(F.min("_key").alias("_first"), F.first("_n").alias("_n"), (F.count(F.lit(1)) > 1).alias("_copies"))
    equal = written(equal, "equal")
    firsts = _ordered(equal.select("_first", "_n", "_x", "_y"))
    own = sized(firsts.select("_first", F.col("_x").alias("_cx"), F.col("_y").alias("_cy"), "_base"))

    def emission(windows: bool) -> DataFrame:
        sent = _emitted(docs, key, text, size, windows)
        # a row for each text: rows that repeat id and text are taken once below
        return sent.join(own, (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy"))).filter(F.col("_key").eqNullSafe(F.col("_first"))).select("_base", F.explode("_found").alias("f"))

    often = emission(False).groupBy(F.col("f").alias("anchor")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    often = written(often, "anchors")
    released(spark)
    near = emission(True).join(sized(often), F.col("f.a") == F.col("anchor"))
    near = near.select(F.col("_base").alias("base"), (F.col("_base") + F.col("f.s")).alias("at"), F.posexplode("f.w").alias("i", "w"))
    near = written(near.select("w", "base", (F.col("at") + F.col("i")).alias("pos")), "windows")
    released(spark)
    first = near.groupBy("w").agg(F.min("pos").alias("fpos"), F.max("pos").alias("lpos"), F.min("base").alias("fbase")).filter("fpos < lpos").select("w", "fpos", "fbase")
    first = written(first, "firsts")
    released(spark)
    later = near.join(sized(first, _FIRST_BYTES), "w").filter("pos > fpos").select("base", "pos", "fbase", "fpos")
    again = _repeats(rows)
    later = later.distinct() if again else later
    runs = written(_runs(later), "runs")
    released(spark)
    phrases = runs.select("fbase", "fs", "k").distinct()
    wanted = runs.select("base").unionByName(runs.select(F.col("fbase").alias("base"))).distinct()
    wanted = written(firsts.join(sized(written(wanted, "wanted")), F.col("_base") == F.col("base")).select("_first", "_x", "_y", "_base"), "wanted")
    texts = _texts(docs, key, text, wanted)
    texts = written(texts.dropDuplicates(["_base"]) if again else texts, "texts")
    cut = written(_phrase_texts(texts, phrases, size), "phrases")
    released(spark)
    placed = runs.select("base").distinct()
    scanned = texts.withColumnRenamed("_base", "base").join(placed, "base")
    volume = scanned.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    shards = int(volume // _SHARD_BYTES) + 1
    shard = F.pmod(F.xxhash64("base"), F.lit(shards))
    needed = runs.select(shard.alias("shard"), "fbase", "fs", "k").distinct().join(cut, ["fbase", "fs", "k"]).select("shard", "phrase", (F.col("fbase") + F.col("fs")).alias("place"), (F.col("k") + size - 1).alias("n"))
    scanned = scanned.select(shard.alias("shard"), "base", "_text")

    def stream(left: pa.Table, right: pa.Table) -> pa.Table:
        some = [(base, text.encode().split()) for base, text in zip(left.column("base").to_pylist(), left.column("_text").to_pylist(), strict=True)]
        some = [(base, [w.decode() for w in words]) for base, words in some]
        found = list(zip(right.column("phrase").to_pylist(), right.column("place").to_pylist(), right.column("n").to_pylist(), strict=True))
        removed = locate(found, some, size)
        spans = [_spans(m) for m in removed]
        return pa.table({"base": pa.array([b for b, _ in some], pa.int64()), "spans": pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))})

    located = scanned.groupBy("shard").cogroup(needed.groupBy("shard")).applyInArrow(stream, "base long, spans array<struct<a:long,b:long>>")
    located = written(located, "spans")
    released(spark)
    told = equal.select("_x", "_y", "_copies").join(firsts.select("_x", "_y", "_first", "_base"), ["_x", "_y"]).join(located, F.col("_base") == F.col("base"), "left")
    return written(told.filter("_copies or spans is not null").select(F.col("_x").alias("_cx"), F.col("_y").alias("_cy"), "_first", F.col("spans").alias("_spans")), "told")


def _repeats(rows: DataFrame) -> bool:
    """Whether some row repeats another's id and text."""
    return not rows.filter("_n > 0").groupBy("_key", "_x", "_y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).isEmpty()


def remove(docs: DataFrame, told: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, joined: bool = False, counts: tuple[str, str] | None = ("_words", "_removed")) -> DataFrame:
    """All columns with the text without its repeated words, and columns ``counts`` (words before, words removed).

    ``joined``: kept words have one space between them; else the white space
    after a kept word stays, and a text that loses nothing is unchanged.
    """
    if counts and set(counts) & set(docs.columns):
        raise ValueError(f"the table has a column named like one of {counts}: give other names, or none")
    others = F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns if c != text])
    rows = docs.select(others.alias("_row"), F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_body"))
    # written, so that no task runs two Python workers at once
    full = written(described(rows, "_body", ["_row", "_key", "_body"]), "texts").join(sized(told), (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy")), "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("_n").alias("b")))
    copy = F.col("_cx").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first"))
    full = full.select("_row", "_body", F.when(copy, whole).otherwise(F.col("_spans")).alias("_out"))
    schema = rows.select("_row").schema.add("_kept", "string").add("_words", "long").add("_removed", "long")
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[str | None] = []
            counts: list[np.ndarray] = [np.zeros(0, np.int64)]
            gone: list[int] = []
            spans = batch.column(2)
            nulls = batch.column(1).is_null()
            for i, w in _words_of(batch.column(1)):
                counts.append(w.count.astype(np.int64))
                for d in range(len(w.count)):
                    out = spans[i + d].as_py() or ()
                    gone.append(sum(s["b"] - s["a"] for s in out))
                    raw = w.buf[w.docs[d] : w.docs[d + 1]].tobytes()
                    if joined:
                        words, parts, at = raw.split(), [], 0
                        for s in out:
                            parts += words[at : s["a"]]
                            at = s["b"]
                        kept.append(b" ".join([*parts, *words[at:]]).decode())
                    elif nulls[i + d].as_py():
                        kept.append(None)
                    else:
                        start = w.start[w.first[d] : w.first[d + 1]] - w.docs[d]
                        parts, at = [], 0
                        for s in out:
                            parts.append(raw[at : start[s["a"]]])
                            at = int(start[s["b"]]) if s["b"] < len(start) else len(raw)
                        kept.append(b"".join([*parts, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(np.concatenate(counts)), pa.array(gone, pa.int64())], names=names)

    done = full.mapInArrow(cut, schema)
    return done.select(*row_columns(docs, "_row", **{text: F.col("_kept")}), *[F.col(c).alias(to) for c, to in zip(("_words", "_removed"), counts or (), strict=False)])


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove(docs, repeated(docs), joined=True)
    return out.select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
