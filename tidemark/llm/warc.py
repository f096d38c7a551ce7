"""WARC archives as a Spark data source, and an operator that archives pages with revisit records.

Files are .warc.gz, one gzip member for each record, with the member's length in its header's `sl` extra field; of
others (.warc, or gzip streams without that field, however cut into members) whole files are read. The source plans partitions from the byte offsets
that the writer's manifest gives, takes over filters on the record type and on headers, reads a record's headers first,
and leaves its payload compressed and unread if a filter rejects the record or no payload is wanted. A file or record
that is cut off, or has no length, raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from tidemark.llm.storage import new_path, settle

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length bigint, payload binary"
_HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
MANIFEST = "_manifest"  # one file of such a name for each write


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _member(data: bytes) -> bytes:
    """One gzip member with its own and the data's length in the `sl` field."""
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
    size = len(head) + 2 + 12 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value) -> str:
    return " ".join(str(value).split())


def encode_record(record_type: str, record_id: str, uri: str | None, refers_to: str | None, digest: bytes, length: int, payload: bytes | None) -> bytes:
    """One record. A response's block is an HTTP response with the payload; a revisit has no payload, only its digest."""
    http = b""
    if record_type == "response":
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(length).encode() + b"\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    lines += [f"WARC-Target-URI: {_clean(uri)}"] * bool(uri) + [f"WARC-Refers-To: <{refers_to}>"] * bool(refers_to)
    lines += [f"WARC-Profile: {_REVISIT}"] * (record_type == "revisit")
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"X-Payload-Length: {length}"]
    block = http + (payload or b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space continues the one before."""
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def digest_of(field: str | None) -> str | None:
    """A SHA-1 in upper-case base32, from base32 or hexadecimal; those of other algorithms as they are, with their name
    and a colon. Only SHA-1 is verified."""
    if not field:
        return None
    name, colon, value = field.rpartition(":")
    if colon and name.lower() not in ("sha1", "sha-1"):
        return field
    return base64.b32encode(bytes.fromhex(value)).decode() if re.fullmatch("[0-9A-Fa-f]{40}", value) else value.upper()


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class _Part(InputPartition):
    path: str
    start: int
    end: int | None


def _manifests(where: fs.FileSystem, root: str) -> dict[str, dict]:
    """The manifests of an archive that no other one replaces, by name."""
    found = {}
    for x in where.get_file_info(fs.FileSelector(root)):
        if x.base_name.startswith(f"{MANIFEST}-") and x.base_name.endswith(".json"):
            with where.open_input_stream(x.path) as f:
                found[x.base_name] = json.loads(f.read())
    gone = {n for x in found.values() for n in x["replaces"]}
    return {n: x for n, x in sorted(found.items()) if n not in gone}


class _Writer(DataSourceArrowWriter):
    """A task writes its rows to files of its own; only those that a manifest names belong to the archive. A write adds one
    manifest when all its tasks have ended. One that overwrites names the manifests that it replaces: they count no more
    from the moment on that the new one is there, and are then deleted with their files."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("filebytes", 1 << 30))
        self.split_bytes = int(options.get("splitbytes", 16 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        where, root = filesystem(self.path)
        where.create_dir(root, recursive=True)
        files, out, at = [], None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                data = _member(encode_record(r["record_type"], r["record_id"], r["target_uri"], r["refers_to"], r["digest"], r["payload_length"], r["payload"]))
                if out is None or at + len(data) > self.file_bytes and at:
                    if out:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                    files.append({"name": name, "splits": [0]})
                if at - files[-1]["splits"][-1] >= self.split_bytes:
                    files[-1]["splits"].append(at)
                out.write(data)
                at += len(data)
                files[-1]["bytes"] = at
        if out:
            out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        where, root = filesystem(self.path)
        where.create_dir(root, recursive=True)
        old = _manifests(where, root) if self.overwrite else {}
        name = f"{MANIFEST}-{uuid.uuid4().hex}.json"
        made = {"files": [x for m in messages if m for x in m.files], "replaces": sorted(old)}
        with where.open_output_stream(f"{root}/{name}.tmp") as f:
            f.write(json.dumps(made).encode())
        where.move(f"{root}/{name}.tmp", f"{root}/{name}")
        for gone, x in old.items():
            where.delete_file(f"{root}/{gone}")
            for file in x["files"]:
                where.delete_file(f"{root}/{file['name']}")

    def abort(self, messages: list[_Written | None]) -> None:
        where, root = filesystem(self.path)
        for x in (x for m in messages if m for x in m.files):
            where.delete_file(f"{root}/{x['name']}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.schema = options["path"], schema
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.verify = str(options.get("verify", "true")).lower() == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        """Takes over =, IN and prefix filters on the columns that are headers; hands the others back."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name in _HEADERS and name != "payload_length" and isinstance(f, EqualTo | In | StringStartsWith):
                self.tests.append((name, type(f).__name__, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for name, kind, values in self.tests:
            x = row[name]
            if x is None or not (x.startswith(values[0]) if kind == "StringStartsWith" else x in values):
                return False
        return True

    def partitions(self) -> list[_Part]:
        where, root = filesystem(self.path)
        info = where.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [_Part(root, 0, None)]
        manifests = _manifests(where, root)
        if manifests:
            listed = [x for m in manifests.values() for x in m["files"]]
            return [_Part(f"{root}/{x['name']}", a, b) for x in listed for a, b in zip(x["splits"], [*x["splits"][1:], x["bytes"]], strict=True)] or [_Part("", 0, 0)]
        found = [x.path for x in where.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        return [_Part(x, 0, None) for x in sorted(found)] or [_Part("", 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        names, rows, size = self.schema.fieldNames(), [], 0
        types = {"payload": pa.binary(), "payload_length": pa.int64()}
        schema = pa.schema([(n, types.get(n, pa.string())) for n in names])
        for row in self.records(partition) if partition.path else ():
            rows.append(row)
            size += 500 + len(row["payload"] or b"")
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, part: _Part) -> Iterator[dict]:
        where, _ = filesystem(self.path)
        with where.open_input_file(part.path) as raw:
            f = io.BufferedReader(raw, 1 << 20)
            at, end = part.start, part.end if part.end is not None else raw.size()
            while at < end:
                f.seek(at)
                head = f.read(24)  # peek would stop where the buffer ends
                f.seek(at)
                if head[:2] == b"\x1f\x8b" and not (len(head) == 24 and head[3] & 4 and head[12:14] == b"sl"):
                    yield from self.stream(f)  # members of unknown length: the rest of the file is read as one stream
                    return
                row, at = (self.member if head[:2] == b"\x1f\x8b" else self.plain)(f, at, end)
                if row is not None:
                    yield row

    def member(self, f: io.BufferedReader, at: int, end: int) -> tuple[dict | None, int]:
        """A record that is a gzip member with its length in the `sl` field; only wanted blocks are decoded."""
        then = at + struct.unpack("<I", f.read(24)[16:20])[0]
        f.seek(at)
        unzip, got = zlib.decompressobj(31), b""

        def more(size: int) -> bytes:
            data = unzip.unconsumed_tail or f.read(min(65536, max(0, then - f.tell())))
            out = unzip.decompress(data, size)
            if not (data or out or unzip.eof):
                raise ValueError("a gzip member is cut off")
            return out

        while b"\r\n\r\n" not in got and not unzip.eof:
            got += more(4096)
        headers, _, rest = got.partition(b"\r\n\r\n")
        row, fields = self.row(headers)
        if row is None or not self.payload:
            return row, then
        block = [rest]
        while not unzip.eof:
            block.append(more(1 << 20))
        return self.filled(row, fields, b"".join(block)), then

    def stream(self, f: io.BufferedReader) -> Iterator[dict]:
        """All records of gzip members that follow each other, however they are cut into members."""
        unzipped = io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 20)
        try:
            while (found := self.next(unzipped)) is not None:
                row, fields, length = found
                wanted, block = row is not None and self.payload, []
                for size in self.pieces(length):
                    piece = unzipped.read(size)
                    if len(piece) < size:
                        raise ValueError("a WARC record is cut off")
                    if wanted:
                        block.append(piece)
                if row is not None:
                    yield self.filled(row, fields, b"".join(block)) if wanted else row
        except EOFError:
            raise ValueError("a gzip member is cut off") from None

    def plain(self, f: io.BufferedReader, at: int, end: int) -> tuple[dict | None, int]:
        found = self.next(f)
        if found is None:
            return None, end
        row, fields, length = found
        start = f.tell()
        if start + length > end:
            raise ValueError("a WARC record is cut off")
        if row is not None and self.payload:
            row = self.filled(row, fields, f.read(length))
        return row, start + length

    @staticmethod
    def pieces(length: int) -> Iterator[int]:
        for done in range(0, length, 1 << 20):
            yield min(1 << 20, length - done)

    def next(self, f) -> tuple[dict | None, dict, int] | None:
        """Row, fields and block length of the record that begins at f, after empty lines; None at the end."""
        lines = []
        while True:
            line = f.readline()
            if line.strip():
                lines.append(line)
            elif not line and lines:
                raise ValueError("a WARC record is cut off")
            elif lines or not line:
                break
        if not lines:
            return None
        row, fields = self.row(b"".join(lines).rstrip(b"\r\n"))
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"a WARC record has no length: {lines[0][:40]!r}")
        return row, fields, int(fields["content-length"])

    def row(self, head: bytes) -> tuple[dict | None, dict]:
        fields = parse_headers(head)
        row = {c: fields.get(h.lower()) for c, h in _HEADERS.items()} | {"payload": None}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else row[c]
        row["payload_digest"] = digest_of(row["payload_digest"])
        row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
        return (row if self.wanted(row) else None), fields

    def filled(self, row: dict | None, fields: dict, block: bytes) -> dict | None:
        if row is None or row["record_type"] == "revisit":
            return row
        length = int(fields["content-length"])
        if len(block) < length:
            raise ValueError("a WARC record is cut off")
        block = block[:length]
        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        given = row["payload_digest"]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if self.verify or not given else None
        if digest and given and ":" not in given and digest != given:
            raise ValueError(f"payload of {row['record_id']} differs from its digest")
        return row | {"payload": payload, "payload_length": len(payload), "payload_digest": given or digest}


class WarcSource(DataSource):
    """format("warc"). Options of reading: payload, verify (true or false); of writing: fileBytes, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of a file or folder. Without payload no block is decoded. Turns on spark.sql.python.filterPushdown.enabled
    for the session, without which filters aren't taken over."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, mode: str = "append") -> None:
    """Write one record per page to the archive at path: beside the records that it has, or with mode overwrite in their
    place. Pages of different writes aren't compared.

    Of pages with equal payloads of at least least_bytes bytes the one with the smallest key is a response, the others
    revisit it; all smaller ones are responses. A null html is an empty payload. Pages without a key get records of
    their own; they are responses only if no equal page has a key. Rows that share key and payload are alike.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    p = pages.select(F.col(key).alias("id"), F.col(url).alias("uri"), payload.alias("payload"))
    p = p.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("payload_length", F.octet_length("payload").cast("long"))
    # written first, so that the join deals out both sides and may split a payload that is everywhere
    first = settle(p.groupBy("digest").agg(F.min("id").alias("first")), "first")
    p = p.join(first, "digest")
    revisit = (F.col("payload_length") >= least_bytes) & F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull())
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    rows = p.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name("id").alias("record_id"), F.col("uri").alias("target_uri"),
        F.when(revisit, name("first")).alias("refers_to"), "digest", "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    )
    spark.dataSource.register(WarcSource)
    rows.write.format("warc").mode(mode).save(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archive: responses with their payloads, which are checked against their
    digests, revisits by the pushed-down record type without decoding a block."""
    path = new_path(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    records = read_warc(spark, path).where("record_type = 'response'").unionByName(read_warc(spark, path, payload=False).where("record_type = 'revisit'"))
    return records.select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
