"""WARC archives: writing, a normaliser for monolithic gzip, and reading by offset.

Many tools compress a whole WARC file as one gzip stream, so that no record can be read without all before it. The
normaliser inflates such a file once, in pieces, rewrites every record as a gzip member of its own, and writes a sidecar
index (offset and length of each member) beside the new file. Records are then read by seeking to their member. On the
way, records that repeat the payload of another become revisit records, which name it and hold no payload.

Files are bounded: a task begins a new one after `roll` bytes of records. A file's name holds a fresh id and is listed
in a written table when its task succeeds, so what a lost or repeated task leaves behind is never read. Files go to a
folder that all executors share, through pyarrow's file systems (s3a and s3n as s3, dbfs by its mount); memory holds one
record and one piece at a time. Archives are dealt to as many tasks as there are archives, records to one task per
`CHUNK` bytes of members. Of equal payloads only a count and the largest id are gathered, before the shuffle; joining
them to their records is a plain join, in which Spark splits a hot digest's partition.

A null payload counts as empty. Null urls and ids leave out their header and come back as null. Control characters in
a url are percent-encoded. Repeated rows are separate records. An archive that ends inside a member or record, or holds
anything else after its last one than zero bytes, raises ValueError, as does a head without Content-Length. An empty
table gives no files and an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import discard, utf8, written
from quarry.sources.shared import shared_folder

#: Bytes of members that one task reads.
CHUNK = 1 << 24
_PIECE = 1 << 18
_MOST_HEAD = 1 << 20
_ID, _REFERS = "X-Record-Key", "X-Refers-To-Key"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP_LENGTH = re.compile(rb"\r\ncontent-length:\s*(\d+)", re.I)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _block(head: dict[str, str], body: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def record(key: str | None, url: str | None, payload: bytes, date: str, name: str | None = None) -> bytes:
    """One response record: WARC head, HTTP head, payload. name: the record's id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = {
        "WARC-Type": "response", "WARC-Record-ID": f"<{name or uuid.uuid4().urn}>", "WARC-Date": date, "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(http) + len(payload)), "WARC-Payload-Digest": f"sha1:{digest(payload)}",
    }
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    if key is not None:
        head[_ID] = key
    return _block(head, http + payload)


def _split(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return fields, rest[: int(fields["Content-Length"])]


def parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """The WARC head and the payload of one record: what follows the HTTP head, if it has one."""
    fields, body = _split(block)
    return fields, body.partition(b"\r\n\r\n")[2] if fields.get("Content-Type", "").startswith("application/http") else body


def revisit(block: bytes, key: str | None, name: str) -> bytes:
    """A response record as a revisit of the record `name`, whose key is key; its HTTP head stays, its payload goes."""
    fields, body = _split(block)
    http = body[: body.find(b"\r\n\r\n") + 4]
    head = fields | {"WARC-Type": "revisit", "WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{name}>", "Content-Length": str(len(http))}
    if key is not None:
        head[_REFERS] = key
    return _block(head, http)


def inflated(source, piece: int = _PIECE) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, piece by piece."""
    machine, begun = zlib.decompressobj(31), False
    while raw := source.read(piece):
        while raw:
            if not begun and not raw.strip(b"\0"):
                break
            begun = True
            try:
                data = machine.decompress(raw, 1 << 22)
            except zlib.error as e:
                raise ValueError(f"not a gzip member: {e}") from e
            if data:
                yield data
            raw = machine.unconsumed_tail
            if machine.eof:
                raw, machine, begun = machine.unused_data, zlib.decompressobj(31), False
    if begun:
        if data := machine.flush():
            yield data
        if not machine.eof:
            raise ValueError("the archive ends inside a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated WARC stream, cut by their Content-Length."""
    held, need, seen = bytearray(), 0, 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", max(0, seen - 3))
                if end < 0:
                    seen = len(held)
                    if seen > _MOST_HEAD:
                        raise ValueError("no end of a record's head")
                    break
                lengths = [x.split(b":", 1)[1] for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
                if not lengths:
                    raise ValueError("a record's head has no Content-Length")
                need = end + 4 + int(lengths[0]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = seen = 0
    if held.strip():
        raise ValueError("the archive ends inside a record")


def uri(path: str) -> str:
    """A path as Spark writes it, as pyarrow reads it."""
    scheme = path.partition(":")[0]
    if scheme == "dbfs":
        return "/dbfs/" + path[5:].lstrip("/")
    return "s3" + path[3:] if scheme in ("s3a", "s3n") else path


def _open(path: str):
    """The file system and the name of a path."""
    return fs.FileSystem.from_uri(uri(path))


def _path(spark: SparkSession, folder: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _make(spark: SparkSession, folder: str) -> None:
    store, where = _path(spark, folder)
    store.mkdirs(where)


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes archives that nothing reads any more."""
    store, where = _path(spark, folder)
    store.delete(where, True)


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll: int = 1 << 26, date: datetime | None = None) -> DataFrame:
    """Writes a record per row into whole-file gzip WARC files; the written list of records.

    Per record: file, number (its place in the file, from 0), key, name (its id), payload_bytes, payload_digest.
    """
    when = (date or datetime(2024, 1, 1, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    _make(pages.sparkSession, folder)
    schema = pa.schema([("file", pa.string()), ("number", pa.int64()), ("key", pa.string()), ("name", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size, path = None, 0, 0, ""
        for b in batches:
            done = []
            for key, url, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, name = _open(path)
                    out, squeeze = store.open_output_stream(name, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                block = record(key, url, payload, when, own := uuid.uuid4().urn)
                out.write(squeeze.compress(block))
                done.append({"file": path, "number": n, "key": key, "name": own, "payload_bytes": len(payload), "payload_digest": digest(payload)})
                n, size = n + 1, size + len(block)
                if size >= roll:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if out is not None:
            out.write(squeeze.flush())
            out.close()

    rows = pages.select(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return written(rows.mapInArrow(run, "file string, number long, key string, name string, payload_bytes long, payload_digest string"))


def repeats(listed: DataFrame, kind: str = "string", least: int = 0) -> DataFrame:
    """(file, number, refers_key, refers_name) of the listed records that repeat another's payload.

    Of records with equal payloads of at least `least` bytes, that with the largest key, compared as type kind, stays and
    the others refer to it; records without a key, smaller ones, and those that share the largest key stay too.
    """
    same = ["payload_digest", "payload_bytes"]
    known = listed.where((F.col("payload_bytes") >= least) & F.col("key").isNotNull())
    last = known.groupBy(*same).agg(F.count("*").alias("n"), F.max(F.struct(F.col("key").cast(kind).alias("k"), "name")).alias("last")).where("n > 1")
    last = written(last.select(*same, F.col("last.k").alias("last_key"), F.col("last.name").alias("refers_name")))
    again = known.join(last, same).where(F.col("key").cast(kind) < F.col("last_key"))
    return again.select("file", "number", F.col("last_key").cast("string").alias("refers_key"), "refers_name")


def normalise(files: DataFrame, folder: str, again: DataFrame | None = None) -> DataFrame:
    """Rewrites each monolithic file (column file) record by record; the written index (file, offset, length, key).

    Beside each new file lies its sidecar, `<file>.idx`, with one JSON line per record. A file is one task's work: the
    stream before a record has to be inflated to reach it, which is what the rewriting ends. again: rows of repeats();
    these records become revisits. They come to their file's task in order, so that none is held.
    """
    _make(files.sparkSession, folder)
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.string())])

    def one(source: str, turns: Iterator[tuple]) -> Iterator[dict]:
        store, name = _open(source)
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        target, new = _open(path)
        at, turn = 0, next(turns, None)
        with store.open_input_stream(name, compression=None) as raw, target.open_output_stream(new, compression=None) as out, target.open_output_stream(f"{new}.idx", compression=None) as index:
            for number, block in enumerate(records(inflated(raw))):
                if turn is not None and turn[1] == number:
                    block, turn = revisit(block, *turn[2:]), next(turns, None)
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(block) + squeeze.flush()
                out.write(member)
                row = {"offset": at, "length": len(member), "key": _split(block)[0].get(_ID)}
                index.write(json.dumps(row).encode() + b"\n")
                at += len(member)
                yield {"file": path} | row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for source, turns in groupby(rows, lambda x: x[0]):
            next(turns)  # the file's own row
            held = []
            for row in one(source, turns):
                held.append(row)
                if len(held) == 4096:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    files = files.select("file").distinct()
    todo = files.select("file", F.lit(-1).cast("long").alias("number"), F.lit(None).cast("string").alias("refers_key"), F.lit(None).cast("string").alias("refers_name"))
    if again is not None:
        todo = todo.union(again.select("file", "number", "refers_key", "refers_name"))
    dealt = todo.repartitionByRange(max(1, files.count()), "file").sortWithinPartitions("file", "number")
    return written(dealt.mapInArrow(run, "file string, offset long, length long, key string"))


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Each indexed record, read by its own member: key, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A revisit's bytes and digest are those of the full payload, as its heads have them; refers_to is the key of the
    record that it names, its payload null. payloads: whether to return the payloads too.
    """
    fields_ = [("key", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), *([("payload", pa.binary())] if payloads else [])]
    schema = pa.schema(fields_)

    def read(member: bytes) -> dict:
        block = zlib.decompress(member, 31)
        fields, payload = parts(block)
        row = {"key": fields.get(_ID), "url": fields.get("WARC-Target-URI"), "record_type": fields.get("WARC-Type"), "refers_to": None, "payload": None}
        if row["record_type"] != "revisit":
            return row | {"payload_bytes": len(payload), "payload_digest": digest(payload), "payload": payload}
        length = _HTTP_LENGTH.search(_split(block)[1])
        return row | {"payload_bytes": int(length[1]) if length else None, "payload_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), "refers_to": fields.get(_REFERS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for b in batches:
            held, size = [], 0
            for file, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if file != path:
                    if source is not None:
                        source.close()
                    store, name = _open(file)
                    path, source = file, store.open_input_file(name)
                source.seek(offset)
                row = read(source.read(length))
                size += len(row["payload"] or b"") if payloads else 64
                held.append({k: row[k] for k in schema.names})
                if size > 1 << 23:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)
        if source is not None:
            source.close()

    size = index.agg(F.sum("length").alias("size"), F.countDistinct("file").alias("files")).first()
    n = max(1, size.files, -(-(size.size or 0) // CHUNK))
    dealt = index.select("file", "offset", "length").repartition(n, F.col("file"), F.floor(F.col("offset") / CHUNK)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, roll: int = 1 << 26, least: int = 0) -> DataFrame:
    """Writes pages as monolithic archives, normalises them into folder/members, and returns the written index of these.

    The monolithic archives are deleted when they have been rewritten.
    """
    folder = folder or shared_folder(pages.sparkSession)
    listed = write_monolithic(pages, f"{folder}/monolithic", id_col, url_col, html_col, roll)
    again = repeats(listed, pages.schema[id_col].dataType.simpleString(), least)
    index = normalise(listed, f"{folder}/members", again)
    drop(pages.sparkSession, f"{folder}/monolithic")
    discard(listed)
    return index
