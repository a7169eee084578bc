"""WARC archives: a writer of gzipped records and a splittable reader.

Every record is a gzip member of its own.  A reading task gets a byte range of a
file: it looks for gzip's magic bytes, takes a place for a record only if the
member there decodes to a WARC header, and owns the records that *start* in its
range, reading past the end of the range to finish the last one.

Equal payloads of at least ``REVISIT_BYTES`` are stored once: the row with the
largest id is the response and the others are revisits that refer to it.

Nulls and edge cases: a null payload is empty and a null url gives a record
without a target; a null id sorts below all others (if a group has only null
ids, each is a response); rows that repeat the largest id of their group are
responses too; control characters in a url are percent-encoded in the header;
an empty table gives an archive without records; keys are percent-encoded in the
header, whatever characters they have.  A member whose header decodes but whose rest
does not, bytes after a record that are no member, and an archive with another number
of records than its manifest says are errors, not missing records.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._base import scoped, scratch_path, sized, table, written

REVISIT_BYTES = 1000
SPLIT_BYTES = 16 << 20
_MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
RECORD = "file string, start long, warc_type string, record_id string, target_uri string, refers_to_record string, payload_digest string, headers map<string,string>, http_headers map<string,string>, payload binary"


def _open(uri: str, mode: str):
    """A file by its path or URI; stores other than local folders go through Arrow's file systems."""
    scheme, _, rest = uri.partition(":")
    if not rest.startswith("/") or len(scheme) < 2:
        return open(uri, mode)  # noqa: SIM115
    if scheme == "file":
        return open("/" + rest.lstrip("/"), mode)  # noqa: SIM115
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path) if "r" in mode else store.open_output_stream(path)


def _commit(made: str, final: str) -> None:
    """Gives a finished file its name; a second attempt replaces it by the same bytes."""
    if made.partition(":")[0] in ("file", "") or made.startswith("/"):
        local = [("/" + x.partition(":")[2].lstrip("/")) if x.startswith("file:") else x for x in (made, final)]
        os.replace(*local)
        return
    from pyarrow import fs

    store, a = fs.FileSystem.from_uri(made)
    store.move(a, fs.FileSystem.from_uri(final)[1])


def _make_folder(folder: str) -> None:
    if folder.startswith("/") or folder.startswith("file:"):
        os.makedirs("/" + folder.partition(":")[2].lstrip("/") if folder.startswith("file:") else folder, exist_ok=True)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)


def record_id(key: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"


def _header_value(text: str) -> str:
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def record_bytes(key: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One gzipped record; a revisit if it refers to another row's."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(key, digest),
        "WARC-Date": _DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    }
    if url is not None:
        head["WARC-Target-URI"] = _header_value(url)
    if key is not None:
        head["X-Row-Key"] = quote(str(key), safe="")
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to, digest)
        head["X-Refers-To-Row-Key"] = quote(str(refers_to), safe="")
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes an archive and returns its manifest (file, bytes, records)."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), body.alias("b"), F.sha1(body).alias("d"))
    large = rows.filter(F.octet_length("b") >= REVISIT_BYTES).groupBy("d").agg(F.max("k").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = written(large.filter("n > 1 and first is not null").select(F.col("d").alias("sd"), "first"), "payloads")
    rows = rows.join(sized(shared), F.col("d") == F.col("sd"), "left")
    rows = rows.select("k", "u", "b", "d", F.when(~F.col("k").eqNullSafe(F.col("first")), F.col("first")).alias("r"))
    _make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        made = f"{name}.{uuid.uuid4().hex}.tmp"
        n = size = 0
        out = None
        for batch in batches:
            k, u, b, d, r = batch.columns
            for i in range(batch.num_rows):
                out = out or _open(made, "wb")
                one = record_bytes(k[i].as_py(), u[i].as_py(), b[i].as_py(), d[i].as_py(), r[i].as_py())
                out.write(one)
                n, size = n + 1, size + len(one)
        if out is not None:
            out.close()
            _commit(made, name)
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return written(rows.mapInArrow(write, "file string, bytes long, records long"), "manifest")


def _member(f, start: int, size: int) -> tuple[bytes, int] | bool:
    """The decoded member at ``start`` and its end; else whether one has begun there that cannot be decoded."""
    f.seek(start)
    unpack, parts, at = zlib.decompressobj(31), [], start
    checked = False
    while not unpack.eof:
        chunk = f.read(4096 if not checked else 1 << 18)
        if not chunk:
            return checked
        at += len(chunk)
        try:
            parts.append(unpack.decompress(chunk))
        except zlib.error:
            return checked
        if not checked:
            seen = b"".join(parts)[:5]
            if seen != b"WARC/"[: len(seen)]:
                return False
            checked = len(seen) == 5
    return (b"".join(parts), at - len(unpack.unused_data)) if checked else False


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, found, value = line.partition(b":")
        if found:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes] | None:
    """Header fields (names in lower case), HTTP fields and payload; None if it is no whole record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    if not found or not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        return None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        return fields, _fields(http), payload
    return fields, {}, block


def records_in(f, size: int, start: int, end: int, damaged: list[int] | None = None) -> Iterator[tuple[int, tuple]]:
    """Records that start in ``start..end`` of an open archive of ``size`` bytes.

    ``damaged`` gets the places of members that have begun and cannot be decoded,
    and of bytes after a record that are no member.
    """
    at = start
    window, base = b"", start
    told = damaged if damaged is not None else []
    after = None  # the end of the record before
    while at < end:
        if not base <= at < base + max(0, len(window) - 2):
            f.seek(at)
            window, base = f.read(min(1 << 20, size - at)), at
            if len(window) < 3:
                if window and after == at:
                    told.append(at)
                return
        found = window.find(_MAGIC, at - base)
        if after is not None and base + found != after:
            told.append(after)
        follows, after = after, None
        if found < 0:
            at = base + max(1, len(window) - 2)
            continue
        at = base + found
        if at >= end:
            return
        member = _member(f, at, size)
        record = parse_record(member[0]) if isinstance(member, tuple) else None
        if record is None:
            if member or at == follows:
                told.append(at)
            at += 1
            continue
        yield at, record
        at = after = member[1]


def digest_hex(field: str | None) -> str | None:
    """A ``sha1:`` field, in base 32 or hex, as lower-case hex."""
    if not field or not field.lower().startswith("sha1:"):
        return None
    value = field[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def read_warc(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of archives given as (path or URI, bytes); payload digests are checked."""
    splits = [(f, size, a, min(a + split_bytes, size)) for f, size in files for a in range(0, size, split_bytes)]
    todo = spark.createDataFrame(splits, "file string, size long, start long, end long")
    todo = todo.repartition(max(1, len(splits)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), *[(n, pa.string()) for n in ("warc_type", "record_id", "target_uri", "refers_to_record", "payload_digest")], ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for one in batch.to_pylist():
                rows, held = [], 0
                damaged: list[int] = []
                with _open(one["file"], "rb") as f:
                    for at, (fields, http, payload) in records_in(f, one["size"], one["start"], one["end"], damaged):
                        for name in ("x-row-key", "x-refers-to-row-key"):
                            if name in fields:
                                fields[name] = unquote(fields[name])
                        digest = digest_hex(fields.get("warc-payload-digest"))
                        if fields["warc-type"] == "response" and digest and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{one['file']} at {at}: the payload does not have its digest")
                        rows.append((one["file"], at, fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, list(fields.items()), list(http.items()), payload))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if damaged:
                    raise ValueError(f"{one['file']}: no whole record at {damaged[0]}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return todo.mapInArrow(read, RECORD)


def complete(records: DataFrame, manifest: list) -> DataFrame:
    """The (written) records, after every file has been found to have as many as its manifest says."""
    found = {r["file"]: r["n"] for r in records.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each file
    wrong = [r["file"] for r in manifest if found.get(r["file"], 0) != r["records"]]
    if wrong:
        raise ValueError(f"{len(wrong)} archives do not have the records of their manifest, such as {wrong[0]}")
    return records


@scoped
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = write_warc(pages, scratch_path(spark, "warc")).collect()  # a row for each file
    records = read_warc(spark, [(r["file"], r["bytes"]) for r in manifest])
    revisit = F.col("warc_type") == "revisit"
    key_type = pages.schema["page_id"].dataType
    told = records.select(
        "file",
        F.col("headers")["x-row-key"].cast(key_type).alias("page_id"),
        F.when(revisit, F.col("http_headers")["content-length"].cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.col("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.col("headers")["x-refers-to-row-key"].cast(key_type).alias("refers_to"),
    )
    return complete(written(told, "records"), manifest).drop("file")
