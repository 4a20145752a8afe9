"""WARC archives as a Spark data source, written and read in Python on the executors.

``read_archive`` reads through ``spark.read.format("warc")``, which ``spark.dataSource.register(WarcSource)`` makes known.
The reader plans partitions of whole files, up to ``partition_bytes`` each (the writer ends a file at ``file_bytes``, so
no file grows with the table). Of a record it first parses the WARC header alone. Predicates on header columns (HEADER)
are pushed down and decided on it, and the schema asked for says whether the block is needed at all. A record that is not
wanted is stepped over: by its length in plain files; in compressed ones by the member's length, which the writer puts in
the gzip extra field 'sl' (two 32-bit numbers, the member's and the record's length), so that its payload is neither read
nor inflated. Members without that field are inflated to find their end. Wanted payloads are freed of HTTP headers,
chunked transfer and gzip or deflate coding, and held against the SHA-1 in the header.

The writer takes rows of WRITTEN, gzips each record on its own, and names its files after the attempt. Files count once the
commit has listed them in a manifest (``_files-*.json``), so attempts that were lost or repeated leave nothing that is read.
A folder without manifests is read whole: every ``.warc`` and ``.warc.gz`` in it.

``records_of`` turns pages into records. Rows of equal payload and at least ``min_bytes`` are one response, of the largest
page_id (then url), and revisits that name it and carry no payload. Who is who is settled by one aggregation of digests;
payloads are shuffled only where payloads repeat in more pages than can be broadcast. Record ids are version 8 UUIDs that
hold the page_id, so nothing need be joined to tell a revisit's page.

Defined results: null html is an empty payload; a null page_id is smaller than any, and null again when read back; rows equal
in page_id, url and html are one response and revisits of it, or all responses below ``min_bytes``; a null url writes no
target, and control characters, blanks and '%' in one are percent-encoded; pages have no time, so all records carry the same
date; other columns are ignored, whatever their names; an empty table writes no file, and an empty folder has no records;
a damaged record, or one whose payload does not match its digest, stops the read with the file and offset.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from missivelake.llm.common import shared_folder, stored

#: Columns of the WARC header, by field; predicates on these are pushed down.
HEADER = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type", "content_length": "Content-Length", "payload_digest": "WARC-Payload-Digest",
}
PLACE, BLOCK = ("file", "offset", "headers"), ("http_status", "payload_bytes", "payload")
SCHEMA = "record_type string, record_id string, date string, target_uri string, refers_to string, content_type string, content_length long, payload_digest string, headers map<string,string>, http_status int, payload_bytes long, payload binary, file string, offset long"
WRITTEN = "record_type string, record_id string, date string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
DATE = "1970-01-01T00:00:00Z"
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES = 64 << 20, 32 << 20, 4 << 20
READ_BYTES, HEADER_BYTES = 1 << 18, 1 << 20
#: Winners of repeated payloads (some 200 bytes each) that are broadcast; more are joined by a shuffle, whose skew Spark splits.
BROADCAST_WINNERS = 200_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ------------------------------------------------------------------------------------------------------


def record_bytes(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """An uncompressed record; fields without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field 'sl' tells its own length and the record's, where these fit 32 bits."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = z.compress(record) + z.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 24 + len(data) + 8
    if max(size, len(record)) >> 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + data + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record)) + data + tail


def _record(row: dict) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    n = row["payload_bytes"] if revisit else len(payload)
    digest = row["payload_digest"] if revisit else base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"] or DATE), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    return record_bytes(row["record_type"], fields, http if revisit else http + payload)


@dataclass
class Written(ds.WriterCommitMessage):
    """Files of a task, with their lengths and records."""

    files: list[tuple[str, int, int]]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        missing = {x.split()[0] for x in WRITTEN.split(", ")} - set(schema.names)
        if missing:
            raise ValueError(f"records lack the columns {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        attempt, done, out = uuid.uuid4().hex, [], None
        name, size, n = "", 0, 0

        def close() -> None:
            if out:
                out.close()
                done.append((name, size, n))

        try:
            for batch in iterator:
                for i in range(0, batch.num_rows, 64):
                    for row in batch.slice(i, 64).to_pylist():
                        if out is None or size >= self.file_bytes:
                            close()
                            name = f"part-{attempt}-{len(done):05d}.warc.gz"
                            out, size, n = store.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                            info = record_bytes("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                            size += out.write(member(info))
                        size += out.write(member(_record(row)))
                        n += 1
            close()
        except BaseException:
            _delete(self.path, [f for f, _, _ in done] + ([name] if name else []))
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        before = _manifests(store, folder)
        listed = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{folder}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())
        if self.overwrite:
            gone = [f for m in before for f, _, _ in _json(store, m)]
            _delete(self.path, [m.rpartition("/")[2] for m in before] + gone)

    def abort(self, messages: list[Written | None]) -> None:
        _delete(self.path, [f for m in messages if m for f, _, _ in m.files])


def _delete(path: str, names: list[str]) -> None:
    store, folder = fs.FileSystem.from_uri(path)
    for name in names:
        if store.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
            store.delete_file(f"{folder}/{name}")


def _manifests(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("_files-") and f.base_name.endswith(".json"))


def _json(store: fs.FileSystem, path: str) -> list:
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


# --- reading ------------------------------------------------------------------------------------------------------


class Bytes:
    """Reads at any place of a file through one buffer; what is stepped over is not read."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""
        self.read_bytes = 0

    def at(self, place: int, n: int) -> bytes:
        if not (self.start <= place and place + n <= self.start + len(self.held)):
            self.file.seek(place)
            self.start, self.held = place, self.file.read(max(n, READ_BYTES))
            self.read_bytes += len(self.held)
        return self.held[place - self.start : place - self.start + n]


class Record:
    """The record at a place of a file. ``head`` reads on until it holds n bytes; ``end`` is where the next one starts."""

    def __init__(self, source: Bytes, place: int):
        self.source, self.place, self.text, self.inflated = source, place, b"", 0
        self.z = self.next = self.length = None
        start = source.at(place, 12)
        self.fed = place
        if start[:3] == b"\x1f\x8b\x08":
            self.z = zlib.decompressobj(31)
            if start[3] & 4:
                extra, k = source.at(place + 12, struct.unpack_from("<H", start, 10)[0]), 0
                while k + 4 <= len(extra):
                    (n,) = struct.unpack_from("<H", extra, k + 2)
                    if extra[k : k + 2] == b"sl" and n == 8:
                        self.next = place + struct.unpack_from("<I", extra, k + 4)[0]
                    k += 4 + n

    def head(self, n: int) -> bytes:
        """The record's first n bytes, or all if it is shorter."""
        if not self.z:
            return self.source.at(self.place, n)
        parts, have = [self.text], len(self.text)
        while have < n and not self.z.eof:
            data = self.z.unconsumed_tail or self.source.at(self.fed, 4096 if have < 4096 else READ_BYTES)
            if not data:
                raise ValueError("the file ends within a member")
            if not self.z.unconsumed_tail:
                self.fed += len(data)
            parts.append(self.z.decompress(data, n - have))
            have += len(parts[-1])
        self.inflated = have
        self.text = b"".join(parts)
        return self.text[:n]

    def until(self, mark: bytes, start: int) -> int:
        """Where the first mark after start ends; a header longer than HEADER_BYTES is damage."""
        n = start + 2048
        while True:
            text = self.head(n)
            at = text.find(mark, start)
            if at >= 0:
                return at + len(mark)
            if len(text) < n or n - start > HEADER_BYTES:
                raise ValueError("a header has no end")
            n *= 2

    def end(self, size: int) -> int:
        """Where the next record starts, given this one's length in full."""
        if not self.z:
            place = self.place + size
            while self.source.at(place, 2) == b"\r\n":
                place += 2
            return place
        if self.next is None:
            while not self.z.eof:
                data = self.z.unconsumed_tail or self.source.at(self.fed, READ_BYTES)
                if not data:
                    raise ValueError("the file ends within a member")
                if not self.z.unconsumed_tail:
                    self.fed += len(data)
                self.z.decompress(data, READ_BYTES)
            self.next = self.fed - len(self.z.unused_data)
        return self.next


def fields_of(text: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines go on, and of a repeated field the first counts."""
    found: dict[str, str] = {}
    name = ""
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            if name in found:
                name = ""
            else:
                found[name] = value.strip()
    return found


def _body(http: dict[str, str], body: bytes) -> bytes:
    """The payload of an HTTP message's body."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        parts, at = [], 0
        while True:
            line = body.index(b"\r\n", at)
            n = int(body[at:line].split(b";")[0], 16)
            if not n:
                break
            parts.append(body[line + 2 : line + 2 + n])
            at = line + 4 + n
        body = b"".join(parts)
    coding = http.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip"):
        return gzip.decompress(body)
    if coding == "deflate":
        return zlib.decompress(body) if body[:1] == b"\x78" else zlib.decompress(body, -15)
    return body


def records(source: Bytes, columns: set[str], wanted: Callable[[dict], bool] = lambda row: True, verify: bool = True) -> Iterator[dict]:
    """The wanted records of a file, with these columns (and those of the header)."""
    place = 0
    while place < source.size:
        try:
            record = Record(source, place)
            top = record.until(b"\r\n\r\n", 0)
            head = record.head(top)
            if not head.startswith(b"WARC/"):
                raise ValueError("no record starts here")
            fields = fields_of(head[:-4])
            size = int(fields["content-length"])
            row = {c: fields.get(f.lower()) for c, f in HEADER.items()}
            row["content_length"] = size
            if row["payload_digest"]:
                row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
            row |= {"offset": place, "headers": fields}
            if wanted(row):
                if columns & set(BLOCK):
                    _read_block(record, row, top, size, columns, verify)
                yield row
            place = record.end(top + size)
        except (ValueError, KeyError, zlib.error, EOFError, OSError) as e:
            raise ValueError(f"damaged record at offset {place}: {e}") from e


def _read_block(record: Record, row: dict, top: int, size: int, columns: set[str], verify: bool) -> None:
    """http_status, payload_bytes and payload; the payload is decoded only if it is asked for or its length isn't known without."""
    http: dict[str, str] = {}
    start = top
    if (row["content_type"] or "").startswith("application/http") and size:
        start = record.until(b"\r\n\r\n", top)
        text = record.head(start)[top : start - 4]
        http = fields_of(text)
        status = text.split(b"\r\n")[0].split()
        row["http_status"] = int(status[1]) if len(status) > 1 and status[1].isdigit() else None
    if row["record_type"] == "revisit":
        length = http.get("content-length")
        row["payload_bytes"] = int(length) if length else None
    elif columns & {"payload", "payload_bytes"}:
        payload = _body(http, record.head(top + size)[start : top + size])
        if len(record.head(top + size)) < top + size:
            raise ValueError("the record is shorter than its length says")
        row["payload"], row["payload_bytes"] = payload, len(payload)
        if verify and row["payload_digest"] and len(row["payload_digest"]) == 32 and base32_sha1(payload) != row["payload_digest"]:
            raise ValueError("the payload does not match its digest")


def _decided(f: ds.Filter, row: dict) -> bool | None:
    """A predicate's value on a header, null as in SQL."""
    if isinstance(f, ds.Not):
        value = _decided(f.child, row)
        return None if value is None else not value
    x = row[f.attribute[0]]
    if isinstance(f, ds.IsNull):
        return x is None
    if isinstance(f, ds.IsNotNull):
        return x is not None
    if isinstance(f, ds.EqualNullSafe):
        return x == f.value
    if x is None or isinstance(f, ds.In) is False and f.value is None:
        return None
    if isinstance(f, ds.In):
        return True if x in f.value else None if None in f.value else False
    return {
        ds.EqualTo: lambda: x == f.value, ds.GreaterThan: lambda: x > f.value, ds.GreaterThanOrEqual: lambda: x >= f.value, ds.LessThan: lambda: x < f.value,
        ds.LessThanOrEqual: lambda: x <= f.value, ds.StringStartsWith: lambda: x.startswith(f.value), ds.StringEndsWith: lambda: x.endswith(f.value), ds.StringContains: lambda: f.value in x,
    }[type(f)]()


DECIDABLE = (
    ds.IsNull, ds.IsNotNull, ds.EqualNullSafe, ds.In, ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains,
)


def pushable(f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):
        return pushable(f.child)
    return isinstance(f, DECIDABLE) and len(f.attribute) == 1 and f.attribute[0] in HEADER


@dataclass
class Files(ds.InputPartition):
    """Files of a partition."""

    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(len(paths))
        self.paths = paths


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.verify = options.get("verify", "true").lower() == "true"
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, folder = fs.FileSystem.from_uri(self.path)
        manifests = _manifests(store, folder)
        if manifests:
            sized = [(f"{folder}/{f}", size) for m in manifests for f, size, _ in _json(store, m)]
        else:
            found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
            sized = [(f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz"))]
        out: list[list[str]] = []
        room = 0
        for path, size in sorted(sized):
            if not out or size > room:
                out.append([])
                room = self.partition_bytes
            out[-1].append(path)
            room -= size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        schema = to_arrow_schema(self.schema)
        columns = set(self.schema.names)
        wanted = lambda row: all(_decided(f, row) for f in self.filters)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                try:
                    for row in records(Bytes(file, file.size()), columns, wanted, self.verify):
                        row["file"] = path
                        rows.append({c: row.get(c) for c in schema.names})
                        size += 200 + len(row.get("payload") or b"") * ("payload" in columns)
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(ds.DataSource):
    """Options: path, partition_bytes, file_bytes, verify (payloads against digests)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, dict(self.options), overwrite)


def read_archive(spark: SparkSession, folder: str, *columns: str, where: Column | None = None, **options: str) -> DataFrame:
    """Records of a folder with these columns, or all of SCHEMA; the block is read only if one of BLOCK is among them.

    where is a condition on HEADER columns and is pushed down. Spark 4.1 keeps the predicates it pushed last with a loaded
    table, and would apply them to every other use of it; so each call loads a table of its own, which always gets a predicate
    and is shut off from later ones by a generator. A frame that is loaded by hand is good for one condition only.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    kinds = {x.split()[0]: x for x in SCHEMA.split(", ")}
    names = columns or tuple(kinds)
    schema = ", ".join(kinds[c] for c in dict.fromkeys([*names, "offset", *(HEADER if where is not None else ())]))
    rows = spark.read.format("warc").schema(schema).options(**options).load(folder).where("offset >= 0")
    rows = rows if where is None else rows.where(where)
    return rows.select(F.inline(F.array(F.struct(*names))))


def write_archive(rows: DataFrame, folder: str, *, overwrite: bool = False, **options: str) -> None:
    """Write rows of WRITTEN as compressed archives."""
    rows.sparkSession.dataSource.register(WarcSource)
    rows.write.format("warc").options(**options).mode("overwrite" if overwrite else "append").save(folder)


# --- pages --------------------------------------------------------------------------------------------------------


def _record_id(page_id: Column, *tag: Column) -> Column:
    """A version 8 UUID that holds a page_id (64 bits), whether it is null, and 44 bits of a hash of the tag."""
    own = F.lpad(F.hex(F.coalesce(page_id, F.lit(0).cast("long"))), 16, "0")
    mark = F.lpad(F.hex(F.xxhash64(*tag)), 16, "0")
    part = lambda h, start, n: F.lower(F.substring(h, start, n))
    null = F.when(page_id.isNull(), "001").otherwise("000")
    return F.concat(F.lit("<urn:uuid:"), part(own, 1, 8), F.lit("-"), part(own, 9, 4), F.lit("-8"), null, F.lit("-8"), part(mark, 1, 3), F.lit("-"), part(own, 13, 4), part(mark, 4, 8), F.lit(">"))


def page_of(record_id: Column) -> Column:
    """The page_id that a record id holds."""
    own = F.concat(F.substring(record_id, 11, 8), F.substring(record_id, 20, 4), F.substring(record_id, 35, 4))
    return F.when(F.substring(record_id, 26, 3) == "000", F.conv(own, 16, -10).cast("long"))


def _base32(digest: Column) -> Column:
    """Base 32 of 20 bytes: every five bytes are eight digits."""
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(4):
        five = F.conv(F.hex(F.substring(digest, 5 * k + 1, 5)), 16, 10).cast("long")
        out += [F.substr(digits, (F.shiftright(five, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*out)


def _target(url: Column) -> Column:
    """A url as a header value: '%', blanks and control characters percent-encoded."""
    pieces = F.regexp_extract_all(url, F.lit(r"(?s)[%\x00-\x20\x7F]|[^%\x00-\x20\x7F]+"), F.lit(0))
    encoded = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"(?s)\A[%\x00-\x20\x7F]\z"), F.concat(F.lit("%"), F.lpad(F.hex(x.cast("binary")), 2, "0"))).otherwise(x)), "")
    return F.when(url.rlike(r"[%\x00-\x20\x7F]"), encoded).otherwise(url)


def records_of(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Rows of WRITTEN, one for each page (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    sizes = rows.select("page_id", "url", "key", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    counts = stored(sizes.groupBy("page_id", "url", "key", "digest", "bytes").agg(F.count("*").alias("n")), "warc-digests")
    first = F.max(F.struct("page_id", "url", "n")).alias("first")
    winners = counts.where(F.col("bytes") >= min_bytes).groupBy("key").agg(first, F.sum("n").alias("total")).where("total > 1")
    winners = winners.select(F.col("key").alias("w_key"), F.col("first.page_id").alias("w_page"), F.col("first.url").alias("w_url"), F.col("first.n").alias("w_n"))
    winners = stored(winners, "warc-winners")
    joined = F.broadcast(winners) if winners.count() <= BROADCAST_WINNERS else winners
    match = F.col("key") == F.col("w_key")
    own = F.col("page_id").eqNullSafe(F.col("w_page")) & F.col("url").eqNullSafe(F.col("w_url"))
    winner_id = _record_id(F.col("w_page"), F.col("w_url"), F.col("w_key"))

    none = F.lit(None).cast("string")
    response = [F.lit(DATE).alias("date"), _target(F.col("url")).alias("target_uri"), none.alias("refers_to"), none.alias("payload_digest"), F.lit(None).cast("long").alias("payload_bytes"), "payload"]
    # Rows with a payload: those that nothing repeats, and winners that stand once.
    alone = rows.join(joined, match, "left").where(F.col("w_key").isNull() | (own & (F.col("w_n") == 1)))
    other_id = _record_id(F.col("page_id"), F.col("url"), F.col("key"), F.monotonically_increasing_id())
    alone = alone.select(F.lit("response").alias("record_type"), F.when(F.col("w_key").isNotNull(), winner_id).otherwise(other_id).alias("record_id"), *response)
    # Winners that several equal rows stand for: one of these is the response.
    several = rows.join(F.broadcast(winners.where("w_n > 1")) if joined is not winners else winners.where("w_n > 1"), match & own)
    several = several.groupBy("w_key", "w_page", "w_url").agg(F.any_value("payload").alias("payload")).withColumn("url", F.col("w_url"))
    several = several.select(F.lit("response").alias("record_type"), winner_id.alias("record_id"), *response)
    # All other rows of a repeated payload, by their counts; many equal ones are dealt out by roots of their number.
    again = counts.join(joined, match).withColumn("copies", F.col("n") - own.cast("long")).where("copies > 0")
    again = again.withColumn("root", F.ceil(F.sqrt("copies"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("root") - 1)))
    again = again.withColumn("left", F.least("root", F.col("copies") - F.col("i") * F.col("root"))).where("`left` > 0")
    again = again.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), "left")))
    revisit = again.select(
        F.lit("revisit").alias("record_type"),
        _record_id(F.col("page_id"), F.col("url"), F.col("key"), F.lit("revisit"), F.col("i"), F.col("j")).alias("record_id"),
        F.lit(DATE).alias("date"),
        _target(F.col("url")).alias("target_uri"),
        winner_id.alias("refers_to"),
        _base32(F.col("digest")).alias("payload_digest"),
        F.col("bytes").alias("payload_bytes"),
        F.lit(None).cast("binary").alias("payload"),
    )
    return alone.unionByName(several).unionByName(revisit)


def round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from archives written to the shared folder."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(records_of(pages, min_bytes=min_bytes), folder)
    kinds = F.col("record_type").isin("response", "revisit")
    found = read_archive(spark, folder, "record_type", "record_id", "refers_to", "payload_digest", "payload_bytes", where=kinds)
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, row_number() OVER w AS k, first_value(page_id) OVER w AS top FROM pages
  WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST)),
five AS (
  SELECT *, list_transform(range(0, 4), lambda i: list_reduce(list_transform(range(1, 11), lambda k: (instr('0123456789abcdef', substr(h, 10 * i + k, 1)) - 1)::BIGINT), lambda x, y: 16 * x + y)) AS f FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((f[i // 8 + 1] >> (35 - 5 * (i % 8))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM five
"""
