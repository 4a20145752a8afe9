"""Attachments' bytes as files, through a data source writer with a commit.

``write_media`` puts every row of (file_path, content) at folder/<file_path>, which names the content's digest. A task writes
beside the place and then moves the file there, so no reader and no later attempt meets half a file; a file that is there
already is left, since its name says what it holds. If the job fails, the files that it has added are taken away again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Placed(ds.WriterCommitMessage):
    """Files that a task has added."""

    paths: list[str]


class MediaWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Placed:
        store, folder = fs.FileSystem.from_uri(self.path)
        mark, added, beside = uuid.uuid4().hex, [], ""
        try:
            for batch in iterator:
                for name, content in zip(batch.column("file_path"), batch.column("content"), strict=True):
                    place, data = f"{folder}/{name.as_py()}", content.as_py()
                    digest = place.rpartition("/")[2].partition(".")[0]
                    if hashlib.sha256(data).hexdigest() != digest:
                        raise ValueError(f"{name.as_py()} is not named by its digest")
                    there = store.get_file_info(place)
                    if there.type == fs.FileType.File and there.size == len(data):
                        continue
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    beside = f"{place}.{mark}.part"
                    with store.open_output_stream(beside, compression=None) as out:
                        out.write(data)
                    store.move(beside, place)
                    beside = ""
                    added.append(place)
        except BaseException:
            _gone(store, [*added, beside] if beside else added)
            raise
        return Placed(added)

    def commit(self, messages: list[Placed | None]) -> None:
        """Nothing is left to do: every file is in its place."""

    def abort(self, messages: list[Placed | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        _gone(store, [p for m in messages if m for p in m.paths])


def _gone(store: fs.FileSystem, paths: list[str]) -> None:
    for p in paths:
        if store.get_file_info(p).type == fs.FileType.File:
            store.delete_file(p)


class MediaSink(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return "file_path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> MediaWriter:
        return MediaWriter(dict(self.options))


def write_media(attachments: DataFrame, folder: str) -> None:
    """Write the content of attachments (file_path, content) below the folder; rows of one path are one file."""
    spark = attachments.sparkSession
    spark.dataSource.register(MediaSink)
    rows = attachments.select("file_path", "content").groupBy("file_path").agg(F.any_value("content").alias("content"))
    rows.write.format("media_files").mode("append").save(folder)


def media_files(spark, folder: str) -> DataFrame:
    """path (below the folder) and length of every file there, as media_audit takes them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "length")
