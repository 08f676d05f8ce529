"""WARC 1.1 archives as a PySpark data source.

``register(spark)`` makes the format ``warc`` known::

    read_records(spark, path, [("record_type", "in", ["response"]), ("target_uri", "prefix", "http://a/")])
    spark.read.format("warc").load(path)          # one row per record
    records.write.format("warc").mode("append").save(path)

**Reading.** The driver lists the files and packs them into partitions of about ``partition_bytes``. A task reads
the headers of a record first; the predicates on record type and headers that :func:`read_records` was given are tested
on them, and the payload of an unwanted record is skipped by its length without being decoded. So is every payload if the
columns asked for have no ``payload``. Predicates travel as options of the load. Spark's own push-down to Python sources is
not used: Spark 4.1 keeps what one query pushed to a loaded table for later queries over it, which then lose rows
without an error. Filters on a loaded DataFrame are right, and applied after reading. Archives may be plain or have one gzip member per record; members written here hold their
length ("sl" extra field of the WARC standard), so that a whole member is skipped unread.

**Writing.** Each task writes one file of its own name; the driver then writes a list of the files of finished tasks. Readers take
files from such lists where there are any, so files of failed or repeated tasks are never read.

Files are opened with ``pyarrow.fs``, so a path may name any store that it knows.
Truncated records raise an error. Null payloads are empty; null header values are left out.
"""

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

SCHEMA = ("record_id string, record_type string, target_uri string, date string, content_length long, "
          "payload_digest string, refers_to string, headers map<string, string>, payload binary")
# column -> header
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LISTING = "_files-"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it; Hadoop writes local paths as ``file:/x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def gzip_member(record: bytes, level: int = 6) -> bytes:
    """One gzip member with its own length and the record's in the "sl" field (0 beyond 4 GB)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    lengths = (size, len(record)) if max(size, len(record)) < 1 << 32 else (0, 0)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<HccHII", 12, b"s", b"l", 8, *lengths)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """A whole record. A revisit has the HTTP headers only."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    http = b""
    if row["record_type"] in ("response", "revisit"):
        size = len(payload) if row.get("payload_bytes") is None else row["payload_bytes"]
        http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http + (b"" if revisit else payload)
    fields = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row.get("date"),
              "WARC-Target-URI": row.get("target_uri"), "WARC-Payload-Digest": row.get("payload_digest"),
              "WARC-Refers-To": row.get("refers_to"), "WARC-Profile": REVISIT_PROFILE if revisit else None,
              "Content-Type": "application/http; msgtype=response" if http else "application/octet-stream",
              **(dict(row.get("headers") or {})), "Content-Length": len(block)}
    lines = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value) -> str:
    return " ".join(str(value).split("\n")).replace("\r", " ")


class _Plain:
    """Records of an uncompressed archive: headers are read, blocks read or skipped by length."""

    def __init__(self, stream):
        self.stream, self.buffer = stream, b""

    def _fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            more = self.stream.read(max(n - len(self.buffer), 1 << 16))
            if not more:
                return False
            self.buffer += more
        return True

    def head(self) -> bytes | None:
        """Header lines of the next record, None at the end."""
        while True:
            end = self.buffer.find(b"\r\n\r\n")
            if end >= 0 and not self.buffer[:end].strip():
                self.buffer = self.buffer[end + 4:]
            elif end >= 0:
                head, self.buffer = self.buffer[:end], self.buffer[end + 4:]
                return head.strip(b"\r\n")
            elif not self._fill(len(self.buffer) + 1):
                if self.buffer.strip():
                    raise ValueError("archive ends within a header")
                return None

    def block(self, n: int) -> bytes:
        if not self._fill(n):
            raise ValueError("archive ends within a record")
        block, self.buffer = self.buffer[:n], self.buffer[n:]
        return block

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.stream.seek(self.stream.tell() + n - len(self.buffer))
            self.buffer = b""


class _Members:
    """Records of a gzip archive, one member each; the head is inflated first, the rest on demand."""

    def __init__(self, stream):
        self.stream, self.start, self.size = stream, 0, 0
        self.inflater, self.plain = None, b""

    def _length(self, at: int) -> int:
        """Length of the member from its "sl" field, 0 if it has none."""
        self.stream.seek(at)
        head = self.stream.read(24)
        if len(head) < 24 or not head[3] & 4 or head[12:14] != b"sl":
            return 0
        return struct.unpack("<I", head[16:20])[0]

    def _inflate(self) -> bool:
        more = self.stream.read(1 << 14)
        if not more or self.inflater.eof:
            return False
        self.plain += self.inflater.decompress(more)
        return True

    def head(self) -> bytes | None:
        self.size = self._length(self.start)
        self.stream.seek(self.start)
        self.inflater, self.plain = zlib.decompressobj(31), b""
        while b"\r\n\r\n" not in self.plain:
            if not self._inflate():
                if self.plain.strip():
                    raise ValueError("archive ends within a header")
                return None
        head, self.plain = self.plain.split(b"\r\n\r\n", 1)
        return head.strip(b"\r\n")

    def block(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._inflate():
                raise ValueError("archive ends within a record")
        block = self.plain[:n]
        self.skip(n)
        return block

    def skip(self, _n: int) -> None:
        if self.size:
            self.start += self.size
            return
        # no length given: run to the end of the member, keeping nothing
        while not self.inflater.eof:
            more = self.stream.read(1 << 16)
            if not more:
                raise ValueError("archive ends within a record")
            self.inflater.decompress(more)
        self.start = self.stream.tell() - len(self.inflater.unused_data)


def parse_head(head: bytes) -> dict[str, str]:
    """Header values by lower-case name; continued lines are joined."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records(stream, is_gzip: bool, wanted=lambda head: True, payloads: bool = True):
    """(headers, payload or None) of the wanted records."""
    source = _Members(stream) if is_gzip else _Plain(stream)
    while (head := source.head()) is not None:
        fields = parse_head(head)
        size = int(fields.get("content-length", 0))
        if not wanted(fields):
            source.skip(size)
            continue
        if not payloads:
            source.skip(size)
            yield fields, None
            continue
        block = source.block(size)
        if fields.get("content-type", "").startswith("application/http"):
            block = block.split(b"\r\n\r\n", 1)[-1]
        yield fields, block


@dataclass
class _Files(InputPartition):
    paths: list[str]


KINDS = ("eq", "in", "prefix", "set", "unset")


def _tests(where) -> list[tuple]:
    """(header, kind, value) of predicates on columns or on other headers by their name."""
    for name, kind, _ in where:
        if kind not in KINDS or name in ("content_length", "headers", "payload"):
            raise ValueError(f"no test of headers: {kind} of {name}")
    return [(HEADERS.get(name, name.lower()), kind, value) for name, kind, value in where]


def _passes(fields: dict[str, str], tests) -> bool:
    for name, kind, value in tests:
        have = fields.get(name)
        ok = {"eq": lambda: have == value, "in": lambda: have in value, "set": lambda: have is not None,
              "unset": lambda: have is None,
              "prefix": lambda: have is not None and have.startswith(value)}[kind]()
        if not ok:
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.path = options["path"]
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.columns = [f.name for f in schema.fields]
        self.tests = _tests(json.loads(options.get("where", "[]")))

    def partitions(self):
        store, root = open_store(self.path)
        found = [i for i in store.get_file_info(pafs.FileSelector(root, recursive=False)) if i.is_file]
        lists = [i for i in found if i.base_name.startswith(LISTING)]
        if lists:
            named = set()
            for i in lists:
                with store.open_input_stream(i.path) as f:
                    named.update(json.loads(f.read()))
            found = [i for i in found if i.base_name in named]
        else:
            found = [i for i in found if i.base_name.endswith((".warc", ".warc.gz"))]
        parts, size = [_Files([])], 0
        for i in sorted(found, key=lambda i: i.path):
            if parts[-1].paths and size + i.size > self.bytes:
                parts.append(_Files([]))
                size = 0
            parts[-1].paths.append(i.base_name)
            size += i.size
        return parts

    def _batch(self, rows):
        columns = []
        for name in self.columns:
            if name == "payload":
                columns.append(pa.array([p for _, p in rows], pa.binary()))
            elif name == "content_length":
                columns.append(pa.array([int(h.get("content-length", 0)) for h, _ in rows], pa.int64()))
            elif name == "headers":
                columns.append(pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string())))
            else:
                columns.append(pa.array([h.get(HEADERS[name]) for h, _ in rows], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=self.columns)

    def read(self, partition):
        store, root = open_store(self.path)
        payloads = "payload" in self.columns
        rows, size = [], 0
        for name in partition.paths:
            with store.open_input_file(f"{root}/{name}") as f:
                # the packed form is told from the first bytes, not from the name
                is_gzip = f.read(2) == b"\x1f\x8b"
                f.seek(0)
                for fields, payload in records(f, is_gzip, lambda h: _passes(h, self.tests), payloads):
                    rows.append((fields, payload))
                    size += len(payload or b"") + 500
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, record_type, target_uri, date, payload, and if given payload_digest, refers_to, payload_bytes,
    headers."""

    def __init__(self, options):
        self.path = options["path"]
        self.run = uuid.uuid4().hex

    def write(self, iterator):
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            buffered = io.BytesIO()
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    buffered.write(gzip_member(record_bytes(row)))
                    if buffered.tell() >= BATCH_BYTES:
                        out.write(buffered.getvalue())
                        buffered = io.BytesIO()
            out.write(buffered.getvalue())
        return _Written(name)

    def commit(self, messages):
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{LISTING}{self.run}.json", compression=None) as out:
            out.write(json.dumps([m.name for m in messages if m]).encode())

    def abort(self, messages):
        store, root = open_store(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are only appended to; give a new path")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def read_records(spark: SparkSession, path: str, where=(), columns: str = SCHEMA) -> DataFrame:
    """The records that pass all of ``where``: (column or header name, kind, value) with kind ``eq``, ``in``, ``prefix``,
    ``set`` or ``unset`` (value None). ``columns``: those of ``SCHEMA`` to read, as DDL; without ``payload`` none is decoded."""
    register(spark)
    tests = [(name, kind, list(value) if kind == "in" else value) for name, kind, value in where]
    _tests(tests)
    return spark.read.format("warc").schema(columns).option("where", json.dumps(tests)).load(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, digest):
    """The same urn for the same page and payload."""
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _base32(hex_digest):
    """Base32 of 40 hex digits: five digits are 20 bits, hence four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(8):
        n = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, (F.shiftright(n, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def page_records(pages: DataFrame, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Records of pages (page_id, url, html): of equal payloads of ``least_bytes`` or more the one with the largest
    page_id is a response, the others revisit it.

    Equal rows are told apart by nothing, so all with the largest page_id are responses. A null page_id is less
    than any other. Digests are grouped without their pages; pages are shuffled once, by id and digest, so that copies of one
    page do not meet in a task.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digest = F.sha1(payload)
    rows = pages.select("page_id", "url", payload.alias("payload"), digest.alias("digest"))
    narrow = pages.select("page_id", digest.alias("digest"), F.octet_length(payload).alias("bytes"))
    groups = narrow.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("refers"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # only the ids that revisit, each with what it refers to
    again = narrow.join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers"))).groupBy(
        "page_id", "digest").agg(F.first("refers").alias("refers"))
    a, b = rows.alias("a"), again.alias("b")
    joined = a.join(b, F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest")),
                    "left")
    revisit = F.col("b.refers").isNotNull()
    page, own = F.col("a.page_id"), F.col("a.digest")
    size = F.octet_length("payload").cast("long")
    headers = F.map_filter(F.map_from_arrays(
        F.array(F.lit("X-Page-ID"), F.lit("X-Refers-To-Page-ID"), F.lit("X-Payload-Bytes")),
        F.array(page.cast("string"), F.col("b.refers").cast("string"), size.cast("string"))),
        lambda _, v: v.isNotNull())
    return joined.select(
        _record_id(page, own).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), _base32(own)).alias("payload_digest"),
        F.when(revisit, _record_id(F.col("b.refers"), own)).alias("refers_to"), size.alias("payload_bytes"),
        headers.alias("headers"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    page_records(pages, least_bytes).write.format("warc").mode("append").option("path", path).save()


def _digests(batches):
    """What the archive says of each page; payloads of responses are hashed again."""
    for batch in batches:
        rows = []
        for kind, digest, heads, payload in zip(*(batch.column(c).to_pylist() for c in (
                "record_type", "payload_digest", "headers", "payload"))):
            heads = dict(heads)
            page, refers = heads.get("x-page-id"), heads.get("x-refers-to-page-id")
            size, digest = int(heads["x-payload-bytes"]), digest.removeprefix("sha1:")
            ok = True
            if kind == "response":
                ok = size == len(payload) and digest == base32_sha1(payload)
                size, digest = len(payload), base32_sha1(payload)
            rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, ok))
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload_ok) of archived pages."""
    rows = read_records(spark, path, [("record_type", "in", ["response", "revisit"])],
                        "record_type string, payload_digest string, headers map<string, string>, payload binary")
    return rows.mapInArrow(
        _digests, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                  "payload_ok boolean")
