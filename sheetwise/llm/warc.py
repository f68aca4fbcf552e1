"""WARC archives as a PySpark Python data source (``format("warc")``).

Writing: one gzip member per record; each task writes files of its own and the
commit names the files that count, so a lost or repeated task leaves nothing
that a reader sees.  Reading: one partition per archive file (files are rolled
at ``ROLL_BYTES``); predicates on the record type and on other header columns
are pushed into the reader, which parses a record's headers first and steps over
the payload of a record that fails them.  The gzip header of each member carries
its compressed size in an ``sl`` extra field, so stepping over does not even
inflate it; members without the field (other writers') are inflated and dropped.

Columns on reading: record_id, record_type, target_uri, warc_date,
payload_digest, refers_to, content_length (block), http_length (the full
payload's length, also of revisits), payload.  ``option("payload", "false")``
leaves payloads out altogether.

Revisit rule: of the rows with equal payloads of at least 1000 bytes, the row
with the largest page_id is the response; the others carry no payload and point
to it.  Defined results: null html is an empty payload; a null page_id counts as
smaller than any other; rows that tie for the largest page_id are all responses;
a null url has no target header; control characters in a url are
percent-encoded; an empty table writes no records and reads back as no rows;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    IsNotNull, WriterCommitMessage)
from pyspark.sql.types import StructType

from . import common as C

MIN_REVISIT_BYTES = 1000
ROLL_BYTES = 64 << 20
MANIFEST = "_committed.json"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, payload_digest string, "
               "refers_to string, content_length long, http_length long, payload binary")
#: column -> header
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date",
           "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Any store pyarrow can open; Hadoop writes local paths as file:/x."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


# ---- records --------------------------------------------------------------------

def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, kind: str, uri: str | None, digest_hex: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record: WARC headers, then HTTP headers, then (unless it is a
    revisit) the payload.  Content-Length of the HTTP part is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Target-URI: {_clean(uri)}"] if uri else []
    head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if kind == "revisit" else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds its whole compressed size
    and the size of its content."""
    z = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(data))
            + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def _member_size(head: bytes) -> int | None:
    """Compressed size of the member that starts with ``head``, if it says so."""
    if head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        name, n = head[at:at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"sl" and n >= 4:
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + n
    return None


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


PEEK = 4096


def records(f, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of one open archive for which
    ``wanted(headers)``; the block of any other record is not decoded."""
    f.seek(0)
    start, size = 0, f.size()
    while start < size:
        f.seek(start)
        raw = f.read(PEEK)
        if raw[:2] != b"\x1f\x8b":  # not compressed
            while b"\r\n\r\n" not in raw and (more := f.read(PEEK)):
                raw += more
            cut = raw.index(b"\r\n\r\n")
            headers = _parse(raw[:cut])
            n = int(headers.get("content-length", 0))
            if wanted(headers):
                f.seek(start + cut + 4)
                yield headers, f.read(n)
            start += cut + 4 + n + 4
            continue
        z, whole = zlib.decompressobj(31), _member_size(raw)
        # headers first: only as much is inflated as they need
        text, rest = z.decompress(raw, PEEK), z.unconsumed_tail
        read = len(raw)
        while b"\r\n\r\n" not in text and not z.eof:
            if not rest:
                rest = f.read(PEEK)
                read += len(rest)
                if not rest:
                    raise ValueError(f"a record is cut off at {start}")
            text += z.decompress(rest, PEEK)
            rest = z.unconsumed_tail
        cut = text.index(b"\r\n\r\n")
        headers = _parse(text[:cut])
        keep = wanted(headers)
        if not keep and whole:
            start += whole
            continue
        parts = [text[cut + 4:]] if keep else []
        while not z.eof:
            if not rest:
                rest = f.read(max(PEEK, start + whole - f.tell()) if whole else 1 << 16)
                read += len(rest)
                if not rest:
                    raise ValueError(f"a record is cut off at {start}")
            out = z.decompress(rest)
            rest = b"" if z.eof else z.unconsumed_tail
            if keep:
                parts.append(out)
        start += whole or read - len(z.unused_data)
        if keep:
            yield headers, b"".join(parts)[:int(headers.get("content-length", 0))]


def _row(headers: dict[str, str], block: bytes | None) -> tuple:
    value = {c: headers.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        value[c] = value[c] and value[c].strip("<>")
    digest = value["payload_digest"]
    if digest and digest.startswith("sha1:") and len(digest) == 37:
        value["payload_digest"] = base64.b32decode(digest[5:]).hex()
    payload = http_length = None
    if block is not None and "application/http" in headers.get("content-type", ""):
        head, gap, body = block.partition(b"\r\n\r\n")
        n = _parse(head).get("content-length")
        http_length = int(n) if n else len(body)
        payload = None if headers.get("warc-type") == "revisit" else body
    elif block is not None:
        payload, http_length = block, len(block)
    return (*value.values(), int(headers.get("content-length", 0)), http_length, payload)


# ---- the data source ----------------------------------------------------------------

class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        """Equality and IN on header columns run inside the reader."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((name, frozenset([f.value])))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, frozenset(f.value)))
            elif not (name == "record_type" and isinstance(f, IsNotNull)):
                yield f

    def partitions(self):
        store, path = _file_system(self.path)
        found = {x.path: x for x in store.get_file_info(pafs.FileSelector(path)) if x.is_file}
        manifest = f"{path}/{MANIFEST}"
        if manifest in found:
            with store.open_input_file(manifest) as f:
                names = [f"{path}/{x}" for x in json.loads(f.read())]
        else:
            names = [x for x in found if re.search(r"\.warc(\.gz)?$", x)]
        # the largest first, so that no long task starts last
        return [FilePartition(x) for x in sorted(names, key=lambda x: -found[x].size)] or [FilePartition("")]

    def wanted(self, headers: dict[str, str]) -> bool:
        value = dict(zip(HEADERS, _row(headers, None), strict=False))
        return all(value[name] in values for name, values in self.tests)

    def read(self, partition):
        if not partition.path:
            return
        store, _ = _file_system(self.path)
        types = [pa.string()] * len(HEADERS) + [pa.int64(), pa.int64(), pa.binary()]
        with store.open_input_file(partition.path) as f:
            rows, size = [], 0
            for headers, block in records(f, self.wanted):
                row = _row(headers, block)
                rows.append(row if self.payload else (*row[:-1], None))
                size += len(block)
                if size > 4 << 20 or len(rows) >= 2000:
                    yield self.batch(rows, types)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows, types)

    def batch(self, rows: list[tuple], types: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=self.schema.fieldNames())


class Committed(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Input columns: record_id, record_type, target_uri, payload_digest (hex),
    refers_to, payload (binary)."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator):
        store, path = _file_system(self.path)
        store.create_dir(path, recursive=True)
        names, out = [], None
        try:
            for batch in iterator:
                column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    if out is None or out.tell() >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = store.open_output_stream(f"{path}/{names[-1]}", compression=None)  # members are compressed here
                    out.write(gzip_member(record(*(column[c][i] for c in ("record_id", "record_type", "target_uri", "payload_digest")), column["payload"][i] or b"", column["refers_to"][i])))
        finally:
            if out is not None:
                out.close()
        return Committed(names)

    def commit(self, messages):
        store, path = _file_system(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages):
        store, path = _file_system(self.path)
        for name in (x for m in messages if m for x in m.files):
            store.delete_file(f"{path}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---- pages to archives and back ------------------------------------------------------

URN = "urn:sheetwise:page:"


def revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that repeat a payload.  Works on
    ids and digests; a payload that very many pages share is counted before the
    shuffle, and its rows are one side of a join that Spark can split."""
    p = pages.where(F.octet_length("html") >= least).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    groups = p.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return p.join(groups, "digest").where("page_id IS NULL AND refers_to IS NOT NULL OR page_id < refers_to").distinct()


def to_records(pages: DataFrame) -> DataFrame:
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    r = revisits(pages.select("page_id", "html")).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    d = p.join(r, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    return d.select(
        F.concat(F.lit(URN), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"), F.col("digest").alias("payload_digest"),
        F.concat(F.lit(URN), F.col("refers_to").cast("string")).alias("refers_to"), "payload")


def write_archive(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    to_records(pages).write.format("warc").mode("append").save(path)


def _page_id(urn) -> F.Column:
    return F.expr(f"try_cast(substring({urn}, {len(URN) + 1}) AS bigint)")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Responses from their payloads, revisits from their headers alone."""
    register(spark)
    # a loaded source keeps the predicates pushed into it, so each side loads its own
    load = lambda: spark.read.format("warc").load(path)
    full = load().where("record_type = 'response'").select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    short = load().where("record_type = 'revisit'").select("record_id", F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return full.unionByName(short).select(_page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page_id("refers_to").alias("refers_to"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    path = C.scratch_path(spark, "warc")
    write_archive(C.table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT p.*, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS best FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN best <> page_id THEN best END AS refers_to
FROM r
"""
