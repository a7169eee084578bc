"""Best-fit packing by exact-complement hashing.

Only the histogram of piece lengths decides the packing: it has at most
``limit`` entries however many pieces there are.  Lengths, and sums of two and
three lengths, are looked up by the gap that they fill exactly, and such
combinations are consumed as often as their counts allow; what is left is packed
best-fit, longest first.  The resulting plan (a bounded list of combinations and
how often each is used) is then laid over the pieces by their rank among those
of their length, where they are read.

Nulls and edge cases: a null or empty text is a document of the end token alone;
a document of exactly ``limit`` ids is one piece; repeated rows are packed each;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm._base import BROADCAST_BYTES, quoted, scoped, table, written

LIMIT = 1024
END_ID = 2

_encoders: dict[str, object] = {}


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _split(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging by the ranks of joined parts makes of a token before its own rank."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while True:
        rank, at = min(((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(own, 0))
        if rank >= own:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


@lru_cache(maxsize=8)
def ranks_tell_merges(path: str) -> bool:
    """Whether a file is plain byte-level BPE whose merges follow from its tokens' ranks alone.

    Merging by pairs takes the pair of least rank; merging by ranks takes the two
    neighbours whose joined token has the least rank.  The two agree on every text
    if each token's pair is what merging by ranks makes of the token: whenever two
    neighbours join to a token, no merge went across its ends, so they are those
    that it is made of by itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    base = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
    merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"].get("merges", [])]
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return False
    ordered = [base[a + b] for a, b in merges]
    if ordered != sorted(set(ordered)) or len(ordered) + 256 != len(base):
        return False
    of = _byte_of()
    ranks = {bytes(of[c] for c in k): v for k, v in base.items()}
    return all(_split(bytes(of[c] for c in a + b), ranks) == [bytes(of[c] for c in x) for x in (a, b)] for a, b in merges)


def encoder(path: str, plain: bool | None = None):
    """``text -> ids`` of a byte-level BPE file of the tokenizers library.

    The file's own ranks are given to tiktoken, which yields the same ids several
    times faster, if they tell the merges (``plain``; found out where it is not
    given); a text that spells a special token, and other files, go to the
    tokenizers library itself.
    """
    if path in _encoders:
        return _encoders[path]
    plain = ranks_tell_merges(path) if plain is None else plain
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    library: list = []
    special = [t["content"] for t in spec.get("added_tokens", [])]
    base = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}

    def by_library(text: str) -> np.ndarray:
        if not library:  # loaded where it is needed: it takes memory in every worker
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_file(path))
        return np.asarray(library[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    if not plain:
        _encoders[path] = by_library
        return by_library
    import tiktoken

    of = _byte_of()
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks={bytes(of[c] for c in k): v for k, v in base.items()}, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return by_library(text)
        return np.asarray(fast.encode_ordinary(text), dtype="<u4")

    _encoders[path] = encode
    return encode


#: Columns of a piece's place: the task that made it, and which it is there of its length.
PLACE = ("_task", "_nth")


class _Count:
    """Numbers the pieces of a task, from 0 for each length."""

    def __init__(self) -> None:
        from pyspark import TaskContext

        context = TaskContext.get()
        self.task = context.partitionId() if context else 0
        self.seen: dict[int, int] = {}

    def columns(self, lengths: list[int]) -> list[pa.Array]:
        nth = []
        for x in lengths:
            nth.append(self.seen.get(x, 0))
            self.seen[x] = nth[-1] + 1
        return [pa.array(np.full(len(nth), self.task, np.int32)), pa.array(nth, pa.int64())]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID, place: bool = False) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length`` and ``ids`` (little-endian 32-bit) of every piece.

    A document's ids end with ``end_id``; one of more than ``limit`` ids is cut
    into pieces of ``limit``, of which the first takes the remainder.  ``place``
    adds the columns ``PLACE``, which hold for one run: they are to be written
    before they are used.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    key_type = docs.schema[key].dataType
    plain = ranks_tell_merges(tokenizer)
    out = f"`{key}` {key_type.simpleString()}, piece int, start long, length long, ids binary" + (", _task int, _nth long" if place else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, plain)
        count = _Count() if place else None
        for batch in batches:
            rows: list[int] = []
            parts: tuple[list, list, list, list] = ([], [], [], [])
            held = 0
            for row, one in enumerate(batch.column(1)):
                ids = np.append(encode(one.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % limit + 1
                for k, a in enumerate([0, *range(first, len(ids), limit)]):
                    b = first if k == 0 else a + limit
                    rows.append(row)
                    for to, value in zip(parts, (k, a, b - a, ids[a:b].tobytes()), strict=True):
                        to.append(value)
                held += len(ids)
                if held > 500_000:
                    yield _piece_batch(batch, rows, parts, count)
                    rows, parts, held = [], ([], [], [], []), 0
            yield _piece_batch(batch, rows, parts, count)

    return docs.select(F.col(quoted(key)), F.col(quoted(text))).mapInArrow(cut, out)


def _piece_batch(batch: pa.RecordBatch, rows: list, parts: tuple, count: _Count | None) -> pa.RecordBatch:
    keys = batch.column(0).take(pa.array(rows, pa.int64()))
    more = count.columns(parts[2]) if count else []
    return pa.RecordBatch.from_arrays([keys, pa.array(parts[0], pa.int32()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.int64()), pa.array(parts[3], pa.binary()), *more], names=[batch.schema.names[0], "piece", "start", "length", "ids", *PLACE[: len(more)]])


class Sums:
    """The sums of one, two and three lengths that are there, by the gap that they fill exactly."""

    def __init__(self, left: np.ndarray, limit: int):
        self.left = left
        self.lengths = np.flatnonzero(left)
        a, b = (x.reshape(-1) for x in np.meshgrid(self.lengths, self.lengths, indexing="ij"))
        some = (a >= b) & (a + b < limit)
        a, b = a[some], b[some]
        order = np.lexsort((-a, a + b))
        self.a, self.b = a[order], b[order]
        self.at = np.searchsorted(self.a + self.b, np.arange(limit + 2))

    def pairs(self, gap: int, most: int) -> list[tuple[int, int]]:
        """Pairs of lengths that are left, neither over ``most``, the most unequal first."""
        if gap < 2:
            return []
        a, b = self.a[self.at[gap] : self.at[gap + 1]], self.b[self.at[gap] : self.at[gap + 1]]
        some = (a <= most) & (self.left[a] > 0) & (self.left[b] > 0)
        return list(zip(a[some].tolist(), b[some].tolist(), strict=True))

    def triples(self, gap: int, most: int) -> Iterator[tuple[int, int, int]]:
        for a in self.lengths[::-1].tolist():
            if a <= most and 3 * a >= gap > a and self.left[a]:
                for b, c in self.pairs(gap - a, a):
                    yield a, b, c


def plan(counts: dict[int, int], limit: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations ``[(length, times), ...]`` and how many sequences use each."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= limit:
            raise ValueError(f"a piece of {length} does not fit into {limit}")
        left[length] += n
    made: list[tuple[list[tuple[int, int]], int]] = []

    def use(*lengths: int) -> None:
        kinds = {x: lengths.count(x) for x in lengths}
        n = min(int(left[x]) // k for x, k in kinds.items())
        if n:
            made.append((sorted(kinds.items(), reverse=True), n))
            for x, k in kinds.items():
                left[x] -= k * n

    use(limit)
    sums = Sums(left, limit)
    for longest in range(limit - 1, 0, -1):
        gap = limit - longest
        if left[longest] and left[gap]:
            use(longest, gap)
        for some in sums.pairs(gap, longest) if left[longest] else ():
            if not left[longest]:
                break
            use(longest, *some)
        for some in sums.triples(gap, longest) if left[longest] else ():
            if not left[longest]:
                break
            use(longest, *some)
    # best fit of the rest: open sequences by the room they have left
    room: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for length in range(limit, 0, -1):
        n = int(left[length])
        while n:
            fits = min((r for r in room if r >= length), default=limit)
            like = room.get(fits)
            items, many = like.pop() if like else ([], n)
            if like is not None and not like:
                del room[fits]
            each = fits // length
            whole = min(many, n // each)
            if whole:
                room.setdefault(fits - each * length, []).append(([*items, (length, each)], whole))
                n -= whole * each
            used = whole
            if n and used < many:
                room.setdefault(fits - n * length, []).append(([*items, (length, n)], 1))
                n, used = 0, used + 1
            if items and used < many:
                room.setdefault(fits, []).append((items, many - used))
    made += [x for some in room.values() for x in some]
    return made


def placed(cut: DataFrame) -> DataFrame:
    """Any table of pieces with the columns ``PLACE``, written."""
    schema = StructType([*cut.schema.fields]).add("_task", "integer").add("_nth", "long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Count()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *count.columns(batch.column("length").to_pylist())], names=[*batch.schema.names, *PLACE])

    return written(cut.mapInArrow(number, schema), "pieces")


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The (written) table of pieces with ``sequence_id`` and ``offset``.

    A piece's rank among those of its length is its number within the task that made
    it (``PLACE``; one without is written with it first) and the number of those in
    the tasks before, so pieces are laid where they are read, without an exchange.
    """
    if not set(PLACE) <= set(cut.columns):
        cut = placed(cut)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `limit` rows
    taken: dict[int, int] = {}
    steps: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for items, many in plan(counts, limit):
        at = 0
        for length, each in items:
            low = taken.get(length, 0)
            taken[length] = low + each * many
            steps.setdefault(length, []).append((low, base, each, at))
            at += length * each
        base += many
    lookup = {k: np.array(v, np.int64) for k, v in steps.items()}

    # how many pieces of each length the tasks before have: a row for each task, of at most `limit` numbers
    each = cut.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = each.select("length", "_task", before.alias("_s")).groupBy(F.col("_task").alias("_of")).agg(F.collect_list("length").alias("_lengths"), F.collect_list("_s").alias("_shifts"))
    shifts = written(shifts.select("_of", F.map_from_arrays("_lengths", "_shifts").alias("_before")), "shifts")
    # 16 bytes a length, and as much again for what the rows take besides
    near = F.broadcast(shifts) if (shifts.agg(F.sum(F.size("_before"))).first()[0] or 0) * 32 <= BROADCAST_BYTES else shifts
    own = [c for c in cut.columns if c not in PLACE]
    rank = F.element_at("_before", F.col("length")) + F.col("_nth")
    ranked = cut.join(near, F.col("_task") == F.col("_of")).select(*[F.col(quoted(c)) for c in own], rank.alias("_rank"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                mine, how = length == one, lookup[int(one)]
                low, first, each, at = how[np.searchsorted(how[:, 0], rank[mine], side="right") - 1].T
                k = rank[mine] - low
                sequence[mine] = first + k // each
                offset[mine] = at + k % each * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*own, "sequence_id", "offset"])

    schema = StructType([cut.schema[c] for c in own]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(lay, schema)


@scoped
def op10_exact_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents"), place=True)
    slim = written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *PLACE), "pieces")
    return pack(slim)
