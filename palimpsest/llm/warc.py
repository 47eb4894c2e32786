"""WARC as a PySpark data source: format("warc"), for writing and reading.

Writing: each task writes rolling ``.warc.gz`` files (one gzip member a record)
under names of its own attempt; the commit writes a manifest of the files of the
attempts that count, so files of lost or repeated tasks are never read.  Each
member says in its gzip header (extra field "SL") how long it is, so a reader
can step over it; other readers of gzip pass over that field.

Reading: files are planned into partitions by size; predicates on record type,
target URI, record id, page id, reference and digest are pushed to the reader.
It inflates a member only as far as the record's header block, and of unwanted
records (all, if option ``payload`` is false) inflates nothing more: it goes to
the next member.  Files without that field are inflated through.  Rows go to
Spark as Arrow batches.

Columns: page_id, target_uri, record_type, record_id, refers_to, payload_digest,
payload_bytes, payload.  A row with type ``revisit`` is written without its
payload; its payload_bytes and payload_digest stay in its headers.

Paths are local paths, file: URIs or anything pyarrow's file systems open.

Defined cases: a null html is an empty payload; a null url is left out of the
headers and read as null; a null page_id likewise, and is never a revisit's
target unless the whole group has none (then all are responses); rows that tie
at the smallest page_id are all responses, of which one has the record id that
revisits refer to; an empty table writes an empty archive and reads as no rows.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from palimpsest.llm.common import fresh_path

SCHEMA = "page_id long, target_uri string, record_type string, record_id string, refers_to long, payload_digest string, payload_bytes long, payload binary"
ARROW_SCHEMA = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
ROLL_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
#: Rows and payload bytes of a batch that is read; groups of equal payloads that are broadcast at most.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
BROADCAST_GROUPS = 200_000
#: Parts of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _fs(path: str):
    import pyarrow.fs as pafs

    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def record_bytes(page_id, target_uri, record_type, record_id, refers_to, payload_digest, payload_bytes, payload) -> bytes:
    """One record as bytes, before compression."""
    revisit = record_type == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block = http if revisit else http + (payload or b"")
    head = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if target_uri is not None:
        head.append(("WARC-Target-URI", target_uri.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{payload_digest}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_name(refers_to, payload_digest)}>")]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_name(page_id, digest: str) -> str:
    """The record id that revisits refer to."""
    return f"urn:x-page:{'none' if page_id is None else page_id}:{digest}"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member of ``data`` that says its whole length and that of ``data`` in the extra field "SL"."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 24 + len(packed) + 8
    if max(whole, len(data)) >= 1 << 32:  # too long for the field
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + packed + tail
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"SL", 8, whole, len(data)) + packed + tail


class _Message(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(n) for n in ARROW_SCHEMA.names]
                for k in range(batch.num_rows):
                    if out is None or size >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(posixpath.join(root, files[-1]), compression=None), 0
                    data = member(record_bytes(*[c[k].as_py() for c in columns]))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Message(files)

    def commit(self, messages):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        names = sorted(f for m in messages if m is not None for f in m.files)
        with fs.open_output_stream(posixpath.join(root, "_manifest.json"), compression=None) as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages):
        fs, root = _fs(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                fs.delete_file(posixpath.join(root, f))


class _Files(InputPartition):
    def __init__(self, files):
        super().__init__(0)
        self.files = files


class _Members:
    """The records of a file one after the other: plain bytes, or the inflated gzip members, no further than asked for."""

    def __init__(self, stream, gz: bool, tally: dict):
        self.stream, self.gz, self.tally = stream, gz, tally
        self.raw, self.at = b"", 0  # read, and how much of it is used
        self.data, self.z, self.rest = bytearray(), None, None  # inflated, its decompressor, compressed bytes of the member still unused

    def _raw(self, n: int) -> bool:
        """At least n unused bytes are in ``raw``."""
        if len(self.raw) - self.at < n:
            self.raw, self.at = self.raw[self.at:] + self.stream.read(max(n, 1 << 20)), 0
        return len(self.raw) - self.at >= n

    def _pass(self, n: int) -> None:
        here = min(n, len(self.raw) - self.at)
        self.at += here
        if n > here:
            self.stream.seek(n - here, 1)

    def next(self) -> bool:
        """To the next record; what is left of this one is passed over, if its length is known without inflating."""
        if not self.gz:
            return bool(self.data) or self._raw(1)
        if self.rest is not None:
            self._pass(self.rest)
            self.data.clear()
            self.z = None
        if self.z is not None or self.data:  # a member of unknown length, or several records in one
            return bool(self.data) or self._more()
        return self._open()

    def _open(self) -> bool:
        self.rest = None
        if not self._raw(24) and not self._raw(1):
            return False
        head = self.raw[self.at:self.at + 24]
        if len(head) >= 24 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"SL" and head[10:12] == b"\x0c\x00":
            whole, _ = struct.unpack("<II", head[16:24])
            self._pass(24)
            self.rest, self.z = whole - 24, zlib.decompressobj(-15)
        else:
            self.z = zlib.decompressobj(31)
        return True

    def _more(self, most: int = 1 << 16) -> bool:
        if not self.gz:
            if not self._raw(1):
                return False
            self.data += self.raw[self.at:]
            self.at = len(self.raw)
            return True
        while True:
            if self.z is None and not self._open():
                return False
            if not self._raw(1):
                return False
            chunk = self.raw[self.at:self.at + (1 << 14 if self.rest is None else min(1 << 14, self.rest))]
            got = self.z.decompress(chunk, most)
            used = len(chunk) - len(self.z.unused_data if self.z.eof else self.z.unconsumed_tail)
            self.at += used
            if self.rest is not None:
                self.rest -= used
            self.tally["inflated"] = self.tally.get("inflated", 0) + len(got)
            self.data += got
            if self.z.eof:
                if self.rest is not None:
                    self._pass(self.rest)
                    self.rest = 0
                    return bool(got)
                self.z = None
            if got:
                return True

    def until(self, mark: bytes) -> bytes | None:
        at, step = self.data.find(mark), 1 << 11
        while at < 0:
            seen = max(0, len(self.data) - len(mark))
            if not self._more(step):
                return None
            at, step = self.data.find(mark, seen), min(1 << 16, 2 * step)
        out = bytes(self.data[:at])
        del self.data[:at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) < n and self._more(max(1 << 16, n - len(self.data))):
            pass
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def skip(self, n: int) -> None:
        """Passes over the rest of a record; a member of known length is left as it is."""
        if self.gz and self.rest is not None:
            return
        if not self.gz and n > len(self.data):
            self._pass(n - len(self.data))
            self.data.clear()
            return
        while n:
            cut = min(n, len(self.data))
            del self.data[:cut]
            n -= cut
            if n and not self._more():
                return


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records(stream, gz: bool, wanted=lambda row: True, payload: bool = True, tally: dict | None = None):
    """Rows of a file; ``wanted`` sees the header's fields before the block is read. ``tally`` counts the bytes inflated."""
    data = _Members(stream, gz, {} if tally is None else tally)
    while data.next():
        block = data.until(b"\r\n\r\n")
        if block is None:
            return
        head = parse_headers(block.lstrip(b"\r\n"))
        length = int(head.get("content-length", 0))
        page, refers = head.get("x-page-id"), head.get("warc-refers-to", "").strip("<>").split(":")
        row = {
            "page_id": int(page) if page else None, "target_uri": head.get("warc-target-uri"), "record_type": head.get("warc-type"),
            "record_id": head.get("warc-record-id", "").strip("<>") or None,
            "refers_to": int(refers[2]) if refers[:2] == ["urn", "x-page"] and refers[2] != "none" else None,
            "payload_digest": (head.get("warc-payload-digest") or "").rpartition(":")[2] or None,
        }
        if not wanted(row):
            data.skip(length + 4)
            continue
        http_head = data.until(b"\r\n\r\n") if length else b""
        rest = max(0, length - len(http_head or b"") - 4)
        row["payload_bytes"] = int(parse_headers(http_head or b"").get("content-length", rest))
        row["payload"] = data.take(rest) if payload and row["record_type"] != "revisit" else None
        data.skip(rest + 4 if row["payload"] is None else 4)
        yield row


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in ("record_type", "target_uri", "record_id", "page_id", "refers_to", "payload_digest"):
                self.tests.append(("in", name, [f.value]))
            elif isinstance(f, In) and name in ("record_type", "target_uri", "record_id", "page_id", "refers_to", "payload_digest"):
                self.tests.append(("in", name, list(f.value)))
            elif isinstance(f, StringStartsWith) and name in ("target_uri", "record_id", "payload_digest"):
                self.tests.append(("starts", name, f.value))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for kind, name, value in self.tests:
            if row[name] is None or (row[name] not in value if kind == "in" else not row[name].startswith(value)):
                return False
        return True

    def partitions(self):
        import pyarrow.fs as pafs

        fs, root = _fs(self.path)
        names = None
        if fs.get_file_info(posixpath.join(root, "_manifest.json")).type == pafs.FileType.File:
            with fs.open_input_stream(posixpath.join(root, "_manifest.json"), compression=None) as f:
                names = {*json.loads(f.read())}
        infos = [fs.get_file_info(root)]
        if infos[0].type == pafs.FileType.Directory:
            infos = [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File and i.base_name.endswith((".warc", ".warc.gz")) and (names is None or i.base_name in names)]
        groups, held = [[]], 0
        for i in sorted(infos, key=lambda i: i.path):
            if held and held + i.size > PARTITION_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(i.path)
            held += i.size
        return [_Files(g) for g in groups]

    def read(self, partition):
        fs, _ = _fs(self.path)
        held, size = [], 0
        for path in partition.files:
            with fs.open_input_file(path) as stream:
                for row in records(stream, path.endswith(".gz"), self.wanted, self.payload):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=ARROW_SCHEMA)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW_SCHEMA)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows for the writer from pages (page_id, url, html): equal payloads of at least ``least_bytes`` become revisits.

    Groups of equal payloads are found on digests, sizes and ids alone.  The
    groups of two or more are broadcast, and payloads stay where they are, if
    there are at most ``BROADCAST_GROUPS``; else rows are joined by digest and
    a salt, so that no group of copies is one task.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("at"))
    base = base.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("key", F.sha2("payload", 256))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), "at"))
    groups = base.groupBy(F.col("key").alias("k"), F.col("payload_bytes").alias("n")).agg(first.alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    groups = groups.select("k", "n", F.col("first.id").alias("first"), F.col("first.at").alias("first_at"))
    same = (F.col("key") == F.col("k")) & (F.col("payload_bytes") == F.col("n"))
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        joined = base.join(F.broadcast(groups), same, "left")
    else:
        salted = groups.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(15))))
        joined = base.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(16)).cast("int")).join(salted, same & (F.col("salt") == F.col("s")), "left")
    revisit = F.coalesce((F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    digest = base32_sha1("payload")
    # Of responses that tie, one has the plain name; every other record's ends with its row number.
    plain = ~revisit & (F.col("first_at").isNull() | (F.col("first_at") == F.col("at")))
    name = F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("payload_digest"))
    typed = joined.select("page_id", "target_uri", "payload", "payload_bytes", "at", "first", revisit.alias("again"), plain.alias("plain"), digest.alias("payload_digest"))
    return typed.select(
        "page_id", "target_uri", F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("plain"), name).otherwise(F.concat(name, F.lit(":"), F.col("at").cast("string"))).alias("record_id"),
        F.when(F.col("again"), F.col("first")).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~F.col("again"), F.col("payload")).alias("payload"))


def base32_sha1(column: str):
    """Bare upper-case base 32 of the SHA-1 of a binary column, with DataFrame functions: ten hex digits are eight of base 32."""
    hex_ = F.sha1(column)
    digits = F.concat(*[F.lpad(F.conv(F.substring(hex_, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def register(spark) -> None:
    """Makes format("warc") known, with predicates handed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def round_trip(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes an archive of ``pages`` at ``path`` and reads it back."""
    register(pages.sparkSession)
    with_revisits(pages, least_bytes).write.format("warc").mode("append").save(path)
    return pages.sparkSession.read.format("warc").load(path)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    back = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    # The digest of what was read, where a payload was; a revisit has that of its header.
    digest = F.when(F.col("record_type") == "response", base32_sha1("payload")).otherwise(F.col("payload_digest"))
    size = F.when(F.col("record_type") == "response", F.length("payload")).otherwise(F.col("payload_bytes")).cast("long")
    return back.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
     w AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS UBIGINT) >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & 31) AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN first END AS refers_to
FROM w
"""
