"""Reading XML message backups and writing exports."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from missivelake.functions import text as T

PART = "struct<_seq: string, _ct: string, _name: string, _cl: string, _text: string, _data: string>"
PARTS = f"parts struct<part: array<{PART}>>, part array<{PART}>"
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/heic": ".heic", "video/mp4": ".mp4", "video/3gpp": ".3gp", "audio/mpeg": ".mp3", "audio/amr": ".amr", "audio/ogg": ".ogg", "application/ogg": ".ogg", "text/x-vcard": ".vcf"}


#: A numeric or predefined reference; two numeric ones that stand for one character beyond 16 bits; runs of these (not longer,
#: since the regular-expression engine goes deeper with each), and an ampersand that starts none.
_REFERENCE = r"&(?:#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6})|lt|gt|quot|apos|amp);"
_PAIR = r"&#(?:5[56][0-9]{3}|[xX][dD][89abAB][0-9A-Fa-f]{2});&#(?:5[67][0-9]{3}|[xX][dD][c-fC-F][0-9A-Fa-f]{2});"
_REFERENCES, _PAIRS = rf"(?:{_PAIR}|{_REFERENCE}){{1,400}}", rf"(?:{_PAIR}){{1,400}}"
_NO_REFERENCE = "&(?!" + _REFERENCE[1:] + ")"
#: A name and a quoted value, right where the one before it ended.
_ATTRIBUTE = r"""\G\s+([^\s=/<>"'&]+)\s*=\s*("[^"]*"|'[^']*')"""


def _decoded(run: Column) -> Column:
    """The text of a run of references; half a pair alone becomes U+FFFD."""
    for name, code in (("lt", 60), ("gt", 62), ("quot", 34), ("apos", 39), ("amp", 38)):
        run = F.replace(run, F.lit(f"&{name};"), F.lit(f"&#{code};"))
    numbers = F.filter(F.split(F.replace(run, F.lit("&#"), F.lit("")), ";"), lambda x: x != "")

    def units(x: Column) -> Column:
        hexed = F.lower(F.substring(x, 1, 1)) == "x"
        code = F.when(hexed, F.conv(F.substr(x, F.lit(2)), 16, 10)).otherwise(x).cast("int")
        beyond = code - 0x10000
        pair = F.concat(F.hex(F.lit(0xD800) + F.floor(beyond / 1024)), F.lit(" "), F.hex(F.lit(0xDC00) + beyond % 1024))
        return F.when(code.between(0x10000, 0x10FFFF), pair).when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise("FFFD")

    joined = F.array_join(F.transform(numbers, units), " ")
    whole = F.regexp_replace(F.regexp_replace(joined, "D[89AB]..(?! D[C-F])", "FFFD"), "(?<!D[89AB].. )D[C-F]..", "FFFD")
    return F.decode(F.unhex(F.replace(whole, F.lit(" "), F.lit(""))), "UTF-16BE")


def _referenced(value: Column, runs: str) -> Column:
    """value with the references that the pattern finds replaced by their characters."""
    pieces = F.arrays_zip(F.split(value, runs, -1).alias("gap"), F.regexp_extract_all(value, F.lit(runs), F.lit(0)).alias("run"))
    text = F.transform(pieces, lambda x: F.concat(x["gap"], F.coalesce(_decoded(x["run"]), F.lit(""))))
    return F.when(F.contains(value, F.lit("&")), F.array_join(text, "")).otherwise(value)


def scanned(rows: DataFrame, tag: Column, *kept: str) -> DataFrame:
    """rows with `attributes`, the names and quoted values of a start tag in their order, and `whole`, whether it is well formed.

    tag is what follows the element's name. One pass goes from attribute to attribute, so nothing within a value is taken for
    one; what is left must be the tag's end. The result goes through a generator, so that it is computed once.
    """
    names, values, texts = (F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(k)) for k in (1, 2, 0))
    attributes = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.struct(x["n"].alias("name"), x["v"].alias("value")))
    size = F.aggregate(texts, F.lit(0), lambda acc, x: acc + F.char_length(x))
    end = F.substr(tag, size + 1).rlike(r"\A\s*/?>")
    whole = end & ~F.exists(values, lambda x: x.rlike(_NO_REFERENCE))
    return rows.select(*kept, F.inline(F.array(F.struct(attributes.alias("attributes"), whole.alias("whole")))))


def attribute(names: tuple[str, ...], nulls: tuple[str, ...] = ()) -> Column:
    """The last value among `attributes` of any of these names that is none of nulls, its references resolved."""
    bare = lambda v: F.substr(v, F.lit(2), F.char_length(v) - 2)
    fits = lambda x: x["name"].isin(*names) & ~bare(x["value"]).isin(*nulls) if nulls else x["name"].isin(*names)
    return _referenced(bare(F.try_element_at(F.filter("attributes", fits), F.lit(-1))["value"]), _REFERENCES)


def _messages(rows: DataFrame, kind: int | Column, parts: Column, text: Column | None = None) -> DataFrame:
    """Messages out of `attributes`. Ids and the direction are the last given ones; text stands in for an empty body."""
    given = rows.select(
        attribute(("msg_id", "m_id", "id"), ("", "null")).alias("message_id"),
        attribute(("date",)).alias("_date"),
        attribute(("address",)).alias("_address"),
        attribute(("body",)).alias("_body"),
        attribute(("type", "msg_box")).alias("_box"),
        attribute(("thread_id",), ("", "null")).alias("thread_id"),
        F.regexp_replace(attribute(("contact_name",)), r"^\s+|\s+$", "").alias("_name"),
        parts.alias("parts"),
        (F.lit(None).cast("string") if text is None else text).alias("_text"),
        (F.lit(kind) if isinstance(kind, int) else kind).alias("message_type"),
    )
    body = F.coalesce(F.nullif("_body", F.lit("")), "_text", F.lit(""))
    return given.select(
        "message_id",
        F.coalesce(F.when(F.col("_date").rlike(r"\A[+-]?[0-9]+\z"), F.expr("try_cast(_date as bigint)")), F.lit(0).cast("long")).alias("timestamp_ms"),
        T.normalize_address(F.coalesce("_address", F.lit(""))).alias("address"),
        T.normal_form(body, "NFC").alias("body"),
        T.normal_form(body, "NFKD").alias("body_searchable"),
        "message_type",
        T.direction_code(F.coalesce("_box", F.lit(""))).alias("direction"),
        "thread_id",
        F.when(~F.col("_name").isin("", "null", "(Unknown)"), F.col("_name")).alias("contact_name"),
        "parts",
    )


def read_sms(spark: SparkSession, path: str) -> DataFrame:
    """Short messages; elements that can't be read are left out (see read_sms_tolerant)."""
    return read_sms_tolerant(spark, path)[0]


def _sms_elements(spark: SparkSession, path: str) -> DataFrame:
    """value, attributes and whole of every short message's element."""
    lines = spark.read.option("lineSep", "<").text(path).where(F.col("value").rlike(r"\Asms[\s/>]"))
    return scanned(lines, F.substr("value", F.lit(4)), "value")


def _sms(elements: DataFrame) -> DataFrame:
    return _messages(elements.where("whole"), 1, F.array().cast(f"array<{PART}>"))


def read_sms_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Short messages and the elements that can't be read: a broken element doesn't take the rest of the file with it.

    The file is split at '<', which no attribute value may hold, so files of any size are read in parallel. An element is
    its start tag, whether that ends itself or an end tag follows. Of attributes that are repeated the last counts; elements
    with an unclosed quote, an unknown reference or no end of the tag are broken.
    """
    rows = _sms_elements(spark, path)
    return _sms(rows), rows.where(~F.col("whole")).select(F.substring("value", 1, 200).alias("element"))


def read_mms(spark: SparkSession, path: str) -> DataFrame:
    """Multimedia messages; elements that can't be read are left out (see read_mms_tolerant)."""
    return read_mms_tolerant(spark, path)[0]


def _mms_elements(spark: SparkSession, path: str) -> DataFrame:
    """piece, attributes, parts (null if they can't be read) and whole of every multimedia message's element."""
    records = spark.read.option("lineSep", "</mms>").text(path).where(F.contains("value", F.lit("<mms")))
    pieces = F.filter(F.split("value", r"(?=<mms[\s/>])"), lambda x: x.rlike(r"^<mms[\s/>]"))
    rows = records.select(F.posexplode(pieces).alias("k", "piece"), F.size(pieces).alias("n"))
    return _with_parts(rows.select("piece", (F.col("k") == F.col("n") - 1).alias("ended"), F.lit(2).alias("kind")))


def _with_parts(rows: DataFrame, *kept: str) -> DataFrame:
    """piece, kind, attributes, parts (null if they can't be read) and whole of elements: start tags of short messages (kind 1),
    multimedia messages (2) from their start tag on; ended: whether an end tag follows."""
    mms = F.col("kind") == 2
    alone = F.regexp_extract("piece", r"^<mms(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*/>", 0)
    element = F.when(mms, F.when(alone != "", alone).when(F.col("ended"), F.concat("piece", F.lit("</mms>"))))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = F.from_xml(_referenced(element, _PAIRS), f"{PARTS}, _corrupt string", options)
    kept = ("piece", "kind", *kept)
    rows = scanned(rows.select(*kept, read.alias("m")), F.substr("piece", F.lit(5)), *kept, "m")
    none = F.array().cast(f"array<{PART}>")
    parts = F.concat(F.coalesce(F.col("m.parts.part"), none), F.coalesce(F.col("m.part"), none))
    whole = F.col("whole") & (~mms | (F.col("m").isNotNull() & F.col("m._corrupt").isNull()))
    return rows.select(*kept, "attributes", whole.alias("whole"), F.when(whole & mms, parts).alias("_parts"))


#: Bytes of a file that one row of a plan of reads stands for, and bytes that are read at once.
RANGE, STEP = 16 << 20, 1 << 20
#: Bits of a message's number that are its byte in its file; those above are the file's place among the names.
FILE_BITS = 40
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
_STARTS, _SMS_END, _MMS_END = re.compile(rb"<[sm]ms[\s/>]"), re.compile(rb"<"), re.compile(rb"</mms>|<mms[\s/>]")


def elements_from(file, start: int, end: int) -> Iterator[tuple[int, int, bytes, bool]]:
    """Place, kind, bytes and whether an end tag follows, of each element that starts in these bytes of an open file.

    A short message ends at the next '<'; a multimedia one at its end tag (or the file's end), or at the next one's start.
    """
    data, base, pos = b"", start, 0
    while base + pos < end:
        found = _STARTS.search(data, pos)
        if found is None:
            more = file.read(STEP)
            if not more:
                return
            keep = max(pos, len(data) - 4)  # a start may stand across what was read
            data, base, pos = data[keep:] + more, base + keep, 0
            continue
        first = found.start()
        if base + first >= end:
            return
        mark, look = _MMS_END if data[first + 1 :].startswith(b"m") else _SMS_END, first + 1
        while (stop := mark.search(data, look)) is None and (more := file.read(max(STEP, len(data)))):
            look = max(first + 1, len(data) - 5)
            data += more
        yield base + first, 2 if mark is _MMS_END else 1, data[first : stop.start() if stop else len(data)], stop is None or stop[0] == b"</mms>"
        pos = first + 1


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("piece", pa.string()), ("ended", pa.bool_()), ("kind", pa.int32()), ("rowid", pa.int64())])
    for batch in batches:
        for path, number, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "number", "start", "end")), strict=True):
            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_stream(place) if place.endswith(_COMPRESSED) else store.open_input_file(place) as file:
                if start:
                    file.seek(start)
                rows, size = [], 0
                for at, kind, piece, ended in elements_from(file, start, end):
                    rows.append((piece.decode("utf-8", "replace"), ended, kind, (number << FILE_BITS) + at))
                    size += len(piece)
                    if size >= STEP or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def backup_elements(spark: SparkSession, path: str) -> DataFrame:
    """piece, ended and kind (see _with_parts) of every message's element, and rowid, its place in the backup: files by their
    paths, then bytes. It is the same however the files are split among tasks; each range of a file is read once."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    numbered = files.select("path", "length", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("number"))  # names only
    whole = reduce(lambda a, b: a | b, [F.endswith("path", F.lit(x)) for x in _COMPRESSED])
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE).cast("long")))
    ranges = numbered.select("path", "number", F.explode(starts).alias("start"), whole.alias("_whole"))
    ranges = ranges.select("path", "number", "start", F.when(F.col("_whole"), F.lit(1 << FILE_BITS)).otherwise(F.col("start") + RANGE).alias("end"))
    return ranges.repartition(max(1, min(ranges.count(), 10_000))).mapInArrow(_read_ranges, "piece string, ended boolean, kind int, rowid long")


def _mms(elements: DataFrame) -> DataFrame:
    text = F.get(F.filter("_parts", lambda p: (p["_ct"] == "text/plain") & p["_text"].isNotNull()), 0)["_text"]
    return _messages(elements.where("whole"), 2, F.col("_parts"), text)


def read_mms_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Multimedia messages and the elements that can't be read.

    The text part is the body where the message has none; parts may stand in <parts> or alone. The file is split at
    the end tag, so files of any size are read in parallel; what lies before the last start tag of a record is an element
    without children, or a broken one.
    """
    rows = _mms_elements(spark, path)
    return _mms(rows), rows.where(~F.col("whole")).select(F.substring("piece", 1, 200).alias("element"))


def _is_media(p: Column) -> Column:
    return ~F.coalesce(p["_ct"], F.lit("")).isin("application/smil", "text/plain") & (F.coalesce(F.trim(p["_data"]), F.lit("")) != "")


def _content(p: Column) -> Column:
    return F.try_to_binary(F.regexp_replace(p["_data"], r"\s", ""), F.lit("base64"))


def read_backup(spark: SparkSession, path: str, seen: Observation) -> DataFrame:
    """All messages of a backup with `key` (see archive.with_dedupe_key), `rowid` (see backup_elements) and `mime_types`, in one
    pass. Once an action has run, seen has what that pass met: messages, broken elements, media parts, and
    those of them whose payload can't be decoded.
    """
    empty = F.array().cast(f"array<{PART}>")
    both = _with_parts(backup_elements(spark, path), "rowid").select("attributes", "whole", F.coalesce("_parts", empty).alias("_parts"), F.col("kind").alias("_kind"), "rowid")
    media = F.filter("_parts", _is_media)
    digests = F.transform(media, lambda p: F.struct(p["_ct"].alias("type"), F.sha2(_content(p), 256).alias("hash")))
    # Digests are made once: what follows goes by these columns.
    both = both.select("attributes", "whole", "_parts", "_kind", "rowid", F.inline(F.array(F.struct(digests.alias("_media")))))
    fine = F.filter("_media", lambda x: x["hash"].isNotNull())
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    both = both.observe(
        seen, count(F.col("whole")).alias("messages"), count(~F.col("whole")).alias("broken"), count(F.size("_media")).alias("media"), count(F.size("_media") - F.size(fine)).alias("undecodable")
    )
    text = F.when(F.col("_kind") == 2, F.get(F.filter("_parts", lambda p: (p["_ct"] == "text/plain") & p["_text"].isNotNull()), 0)["_text"])
    hashes = F.array_sort(F.transform(fine, lambda x: x["hash"]))
    types = F.transform(fine, lambda x: F.coalesce(x["type"], F.lit("application/octet-stream")))
    rows = _messages(both.where("whole"), F.col("_kind"), F.struct(types.alias("types"), hashes.alias("hashes"), "rowid"), text)
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = [*map(given, ("address", "timestamp_ms", "body", "thread_id")), F.size("parts.hashes").cast("string"), F.array_join("parts.hashes", ",")]
    key = F.coalesce("message_id", F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256))
    return rows.select(key.alias("key"), F.col("parts.rowid").alias("rowid"), *[c for c in rows.columns if c != "parts"], F.col("parts.types").alias("mime_types"))


def attachments(messages: DataFrame, key: str = "key", files: DataFrame | None = None) -> DataFrame:
    """Decoded parts of multimedia messages: bytes, their digest and the path <first two digits>/<digest><extension>.

    Layout and text parts are no attachments; payloads that aren't base64 are left out (see undecodable_parts). With
    files (path, content, as the binaryFile source gives them), parts without a payload take that of the file they name,
    wherever it lies.
    """
    rows = _payloads(messages, key, files is not None)
    if files is not None:
        base = lambda path: F.regexp_extract(path, r"([^/\\]*)$", 1)
        beside = files.groupBy(base(F.col("path")).alias("_file")).agg(F.min_by("content", "path").alias("_content"))
        rows = rows.join(beside, ~F.col("given") & (base(F.col("name")) == F.col("_file")), "left").withColumn("content", F.coalesce("content", "_content"))
    rows = rows.where("content is not null")
    extension = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.lower("mime_type")),
        F.nullif(F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), r"\.[A-Za-z0-9]{1,5}$", 0)), F.lit("")),
        F.lit(".bin"),
    )
    digest = F.sha2("content", 256)
    path = F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, extension)
    return rows.select("message_key", "mime_type", "name", "content", F.unhex(digest).alias("file_hash"), path.alias("file_path"))


def undecodable_parts(messages: DataFrame, key: str = "key") -> DataFrame:
    return _payloads(messages, key).where("content is null").select("message_key", "mime_type", "name")


def _payloads(messages: DataFrame, key: str, without: bool = False) -> DataFrame:
    """Media parts with a payload, and those without one if asked for."""
    parts = messages.select(F.col(key).alias("message_key"), F.explode("parts").alias("p"))
    given = F.coalesce(F.trim("p._data"), F.lit("")) != ""
    media = parts.where(~F.coalesce(F.col("p._ct"), F.lit("")).isin("application/smil", "text/plain") & (F.lit(without) | F.col("p._data").isNotNull()))
    content = F.when(given, F.try_to_binary(F.regexp_replace("p._data", r"\s", ""), F.lit("base64")))
    return media.select("message_key", F.col("p._ct").alias("mime_type"), F.coalesce("p._name", "p._cl").alias("name"), content.alias("content"), given.alias("given"))


def utf16_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that start with a UTF-16 mark and can't be imported. Tasks read two bytes of each file of the listing."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(name)
                with store.open_input_file(place) as f:
                    if f.read(2) in (b"\xff\xfe", b"\xfe\xff"):
                        found.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(marked, "path string")


def media_audit(attachments: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that only the table or only the folder (column path) has."""
    listed = attachments.select(F.col("file_path").alias("path")).distinct()
    here = files.select("path").distinct()
    missing = listed.join(here, "path", "left_anti").withColumn("problem", F.lit("no file"))
    return missing.unionByName(here.join(listed, "path", "left_anti").withColumn("problem", F.lit("not listed")))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
