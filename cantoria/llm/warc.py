"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition per archive file. Conjuncts on the columns of ``PUSHED`` (record type and header fields:
equality, IN, prefix) are pushed into the reader: of every record the headers are parsed first, and the payload of a
record that fails a predicate, or of every record with option payload=false, is skipped without being decoded. Gzip
members written here carry the skip-length extra field of the format's annex, so skipping seeks over the compressed
bytes; members without it are inflated to find their end but not kept. Plain files are skipped by Content-Length.

Writing makes one gzip member per record, rolls files at ``roll`` bytes, and commits by a manifest that names the
files of the successful task attempts, so files of lost executors are never read. Paths are URIs of any store that
Arrow's file systems open; the folder must be shared by driver and executors.

Defined results: a null payload or one of length 0 gives an empty block body; null headers are left out; a null page
id makes a record without page header; an empty table gives an archive without records; repeated rows give repeated
records; very long payloads are written and read as one value and must fit a task's memory; extra columns are ignored
by the writer. A record cut off at the end of a file raises an error.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    StringStartsWith, WriterCommitMessage)

from cantoria.llm.common import scratch

SCHEMA = ("file string, offset bigint, warc_type string, record_id string, target_uri string, date string, refers_to string, "
          "payload_digest string, content_length bigint, payload_length bigint, headers map<string,string>, payload binary")
ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()),
                   ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
                   ("content_length", pa.int64()), ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())),
                   ("payload", pa.binary())])
#: column -> header field (lower case) that decides it
PUSHED = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
MANIFEST = "_manifest.json"
BATCH = 16 << 20
BLOCK = 64 << 10


def _open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


# ---------------------------------------------------------------- records

def _headers(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:  # folded
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return first, out


class _Plain:
    """One record of an uncompressed file."""

    def __init__(self, f, at: int):
        self.f, self.at, self.length = f, at, None
        f.seek(at)

    def read(self) -> bytes:
        return self.f.read(BLOCK)

    def rest(self, have: int, need: int) -> bytes:
        return self.f.read(max(0, need - have))

    def end(self, used: int) -> int:
        return self.at + used


class _Member:
    """One gzip member: inflated as far as asked for."""

    def __init__(self, f, at: int, head: bytes):
        self.f, self.at, self.length, self.fed = f, at, _skip_length(head), 0
        self.inflate = zlib.decompressobj(31)
        f.seek(at)

    def _block(self) -> bytes:
        raw = self.f.read(BLOCK if self.length is None else max(0, min(BLOCK, self.length - self.fed)))
        if not raw:
            raise ValueError(f"record at {self.at} is cut off")
        self.fed += len(raw)
        return self.inflate.decompress(raw)

    def read(self) -> bytes:
        return b"" if self.inflate.eof else self._block()

    def rest(self, have: int, need: int) -> bytes:
        parts = []
        while not self.inflate.eof:
            parts.append(self._block())
        return b"".join(parts)

    def end(self, used: int) -> int:
        if self.length is not None:
            return self.at + self.length
        while not self.inflate.eof:
            self._block()
        return self.at + self.fed - len(self.inflate.unused_data)


def _skip_length(head: bytes) -> int | None:
    """Compressed length of a gzip member from its "sl" extra subfield, if it has one."""
    if len(head) < 12 or not head[3] & 4:
        return None
    extra = head[12:12 + struct.unpack("<H", head[10:12])[0]]
    while len(extra) >= 4:
        n = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == b"sl" and n >= 8:
            length = struct.unpack("<I", extra[4:8])[0]
            return length if length != 0xFFFFFFFF else None
        extra = extra[4 + n:]
    return None


def read_records(f, size: int, wanted=lambda headers: True, payloads: bool = True):
    """(offset, headers, http headers or None, payload or None) of the wanted records of an open archive."""
    at = 0
    while at < size:
        f.seek(at)
        head = f.read(64)
        record = _Member(f, at, head) if head[:2] == b"\x1f\x8b" else _Plain(f, at)
        text = b""
        while (cut := text.find(b"\r\n\r\n")) < 0:
            more = record.read()
            if not more:
                if text.strip():
                    raise ValueError(f"record at {at} has no header end")
                return
            text += more
        version, pairs = _headers(text[:cut].lstrip(b"\r\n"))
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v for k, v in pairs}
        length = int(headers.get("content-length", 0))
        if wanted(headers):
            http = payload = None
            block = text[cut + 4:]
            is_http = headers.get("content-type", "").startswith("application/http")
            if payloads or (is_http and b"\r\n\r\n" not in block):
                block += record.rest(len(block), length)
                if len(block) < length:
                    raise ValueError(f"record at {at} is cut off")
            block = block[:length]
            if is_http:
                top, _, body = block.partition(b"\r\n\r\n")
                http, payload = _headers(top)[1], body
            else:
                payload = block
            yield at, pairs, http, payload if payloads else None
        at = record.end(cut + 4 + length + 4)


def make_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(plain: bytes, level: int = 6) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(plain) + squeeze.flush()
    total = 12 + 12 + len(body) + 8
    skip = struct.pack("<2sHII", b"sl", 8, min(total, 0xFFFFFFFF), min(len(plain), 0xFFFFFFFF))
    return (b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(skip)) + skip + body
            + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF))


def base32_digest(hex_sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def hex_digest(field: str | None) -> str | None:
    """Bare lower-case hex of a "sha1:BASE32" digest field; others as they are."""
    if field and field.startswith("sha1:") and len(field) == 37:
        return base64.b32decode(field[5:]).hex()
    return field


# ---------------------------------------------------------------- data source

class WarcDataSource(DataSource):
    """Options: payload (true), level (6), roll (bytes per file, 256 MB)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


class _File(InputPartition):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payloads = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for x in filters:
            field = PUSHED.get(x.attribute[0]) if getattr(x, "attribute", None) and len(x.attribute) == 1 else None
            if field and isinstance(x, (EqualTo, In, StringStartsWith)):
                self.tests.append((field, type(x).__name__, tuple(x.value) if isinstance(x, In) else x.value))
            else:
                yield x

    def _wanted(self, headers: dict) -> bool:
        for field, kind, value in self.tests:
            own = headers.get(field)
            if own is None or not (own == value if kind == "EqualTo" else own in value if kind == "In" else own.startswith(value)):
                return False
        return True

    def partitions(self):
        store, top = _open_store(self.path)
        found = store.get_file_info(top)
        if found.type == fs.FileType.File:
            return [_File(top, found.size)]
        names = {x.base_name: x for x in store.get_file_info(fs.FileSelector(top))}
        if MANIFEST in names:
            with store.open_input_stream(f"{top}/{MANIFEST}") as f:
                listed = json.loads(f.read())
        else:
            listed = sorted(n for n in names if n.endswith((".warc", ".warc.gz")))
        return [_File(names[n].path, names[n].size) for n in listed] or [_File("", 0)]

    def read(self, partition):
        if not partition.size:
            return
        store, _ = _open_store(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.uri) as f:
            for at, pairs, http, payload in read_records(f, partition.size, self._wanted, self.payloads):
                own = {k.lower(): v for k, v in pairs}
                length = next((int(v) for k, v in http or () if k.lower() == "content-length" and v.isdigit()), None)
                revisit = own.get("warc-type") == "revisit"
                body = None if revisit else payload
                rows.append({
                    "file": partition.uri, "offset": at, "warc_type": own.get("warc-type"), "record_id": own.get("warc-record-id"),
                    "target_uri": own.get("warc-target-uri"), "date": own.get("warc-date"), "refers_to": own.get("warc-refers-to"),
                    "payload_digest": hex_digest(own.get("warc-payload-digest")), "content_length": int(own.get("content-length", 0)),
                    "payload_length": length if length is not None or body is None else len(body),
                    "headers": list({k: v for k, v in pairs}.items()), "payload": body})
                held += 1000 + len(body or b"")
                if held > BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Columns: warc_type, record_id, target_uri, date, refers_to, payload_digest (hex SHA-1), payload_length, payload
    (not written for revisits) and headers (further header fields)."""

    def __init__(self, options):
        self.path, self.level, self.roll = options["path"], int(options.get("level", 6)), int(options.get("roll", 256 << 20))

    def write(self, iterator):
        store, top = _open_store(self.path)
        store.create_dir(top, recursive=True)
        names: list[str] = []
        out = None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() > self.roll:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = store.open_output_stream(f"{top}/{names[-1]}", compression=None)
                    out.write(gzip_member(_record_of(row), self.level))
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages):
        store, top = _open_store(self.path)
        store.create_dir(top, recursive=True)
        known: list[str] = []
        if store.get_file_info(f"{top}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{top}/{MANIFEST}") as f:
                known = json.loads(f.read())
        with store.open_output_stream(f"{top}/{MANIFEST}") as f:
            f.write(json.dumps(sorted([*known, *(n for m in messages if m for n in m.names)])).encode())

    def abort(self, messages):
        store, top = _open_store(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{top}/{name}")


def _record_of(row: dict) -> bytes:
    payload = b"" if row["warc_type"] == "revisit" else row["payload"] or b""
    length = row.get("payload_length")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n"
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row["warc_type"] == "revisit" else None
    digest = row.get("payload_digest")
    fields = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row.get("date")),
              ("WARC-Target-URI", row.get("target_uri")), ("WARC-Refers-To", row.get("refers_to")), ("WARC-Profile", profile),
              ("WARC-Payload-Digest", digest and base32_digest(digest)), *(row.get("headers") or []),
              ("Content-Type", "application/http; msgtype=response")]
    clean = [(k, v if v is None else " ".join(str(v).split())) for k, v in fields]
    return make_record(clean, http.encode() + payload)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


# ---------------------------------------------------------------- pages

LEAST = 1000
PAGE = "X-Page-Id"


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A record per page; of equal payloads of at least LEAST bytes the greatest key is the response (every row with
    that key, if it is repeated), the others revisit it. Payloads are equal if length and SHA-1 are."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("target_uri"), body.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("bigint")})
    # only groups of two or more are joined back; their counts combine map-side, so a hot group is one row per task
    groups = (rows.filter(F.col("payload_length") >= LEAST).groupBy("payload_digest", "payload_length")
              .agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n"))
    rows = rows.join(groups, ["payload_digest", "payload_length"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"), name(F.col("key")).alias("record_id"), "target_uri",
        F.lit(date).alias("date"), F.when(revisit, name(F.col("first"))).alias("refers_to"), "payload_digest", "payload_length",
        F.when(F.col("key").isNotNull(), F.create_map(F.lit(PAGE), F.col("key").cast("string"))).alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Archive of the pages; returns its path."""
    register(pages.sparkSession)
    path = path or scratch(pages.sparkSession, "warc")
    page_records(pages, **columns).write.format("warc").mode("append").save(path)
    return path


def page_table(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """Per record of an archive of pages: key, payload_bytes, payload_digest, record_type, refers_to. Responses are
    hashed anew from the payload read back; of revisits only the headers are read."""
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    own = F.col("headers")[PAGE].cast("bigint").alias(key)
    full = read_warc(spark, path).filter(F.col("warc_type") == "response").select(
        own, F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    light = read_warc(spark, path, payload=False).filter(F.col("warc_type") == "revisit").select(
        own, F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"),
        number(F.col("refers_to")).cast("bigint").alias("refers_to"))
    return full.unionByName(light)


def sql() -> str:
    """DuckDB SQL for op9 over the view pages."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM g"""
