"""Token-id output: canonical length-limited Huffman coding of ids from global counts.

Layout of an archive (a folder of Parquet files in storage that all executors reach):

* ``codebook``: (id, bits), the code length of every id that occurs. Codes are canonical: ascending by (bits, id).
* ``blocks``: (file, block, first, n_tokens, payload). Files are numbered in ascending doc_id order, blocks within a
  file in the same order, ``first`` counts the file's ids before the block.

A payload stands alone given the codebook, all numbers little-endian: magic, u32 number of documents, u64 number of
ids, u32 checkpoint interval; i64 doc_id, u8 null flag and u64 number of ids for each document; u64 bit offset of every
``interval``-th id; then the code bits, most significant first. Decoding reads all checkpoints' runs side by side, an
id a step, through one table of 2^(longest code) entries.

Defined results: a null or empty text is the end id alone; null doc_ids stand first; rows of one doc_id are ordered by
their ids' first 32 bytes, those that agree in these in no particular order; equal rows are coded each; texts of any length are one document
of a block; columns other than doc_id and text are ignored, whatever their names; an empty table gives an archive
without blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missivelake.llm.common import shared_folder, stored
from missivelake.llm.tokens import mapped

MAGIC = b"MLHUFF1\0"
MIN_LIMIT = 16
BLOCK_TOKENS = 1 << 20
INTERVAL = 512
BLOCKS = "file int, block int, first long, n_tokens long, payload binary"


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of least total size with none over the limit, by package-merge."""
    ids = sorted(counts, key=lambda k: (counts[k], k))
    n = len(ids)
    if n < 2:
        return dict.fromkeys(ids, 1)
    limit = max(MIN_LIMIT, (n - 1).bit_length())
    leaves = np.array([counts[k] for k in ids], np.int64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < n)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    return dict(zip(ids, bits.tolist(), strict=True))


class Codebook:
    """Canonical codes of the ids, for encoding and for table-driven decoding."""

    def __init__(self, lengths: dict[int, int]):
        order = sorted(lengths, key=lambda k: (lengths[k], k))
        size = max(lengths, default=0) + 1
        self.bits, self.codes = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.longest = max(lengths.values(), default=1)
        self.table_id, self.table_bits = np.zeros(1 << self.longest, np.int64), np.ones(1 << self.longest, np.int64)
        code = previous = 0
        for k in order:
            code <<= lengths[k] - previous
            previous = lengths[k]
            self.bits[k], self.codes[k] = previous, code
            low = code << (self.longest - previous)
            self.table_id[low : low + (1 << (self.longest - previous))] = k
            self.table_bits[low : low + (1 << (self.longest - previous))] = previous
            code += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The code bits, and the bit offset of every INTERVAL-th id."""
        bits, codes = self.bits[ids], self.codes[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        words = np.zeros(int(ends[-1] >> 6) + 2 if len(ids) else 1, np.uint64)
        if len(ids):
            word, room = at >> 6, 64 - (at & 63) - bits
            spill = room < 0
            high = np.where(spill, codes >> np.maximum(-room, 0).astype(np.uint64), codes << np.maximum(room, 0).astype(np.uint64))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] = np.add.reduceat(high, first)
            words[word[spill] + 1] += codes[spill] << (64 + room[spill]).astype(np.uint64)
            ends = int(ends[-1])
        else:
            ends = 0
        return words.astype(">u8").tobytes()[: (ends + 7) // 8], at[::INTERVAL]

    def decode(self, data: bytes, n: int, offsets: np.ndarray, interval: int) -> np.ndarray:
        """n ids; the runs that start at the checkpoints are decoded side by side."""
        d = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
        at = offsets.astype(np.int64)
        out = np.zeros((interval, len(at)), np.int64)
        last = n - (len(at) - 1) * interval  # ids of the last run
        mask = (1 << self.longest) - 1
        for k in range(min(n, interval)):
            if k == last:
                at = at[:-1]
            p = at >> 3
            window = (d[p] << 24) | (d[p + 1] << 16) | (d[p + 2] << 8) | d[p + 3]
            found = (window >> (32 - self.longest - (at & 7))) & mask
            out[k, : len(at)] = self.table_id[found]
            at = at + self.table_bits[found]
        return out.T.reshape(-1)[:n]


def payload(docs: list[tuple[int | None, np.ndarray]], book: Codebook) -> bytes:
    counts = np.array([len(x) for _, x in docs], "<u8")
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.int64)
    bits, offsets = book.encode(ids.astype(np.int64))
    keys = np.array([k or 0 for k, _ in docs], "<i8")
    nulls = np.array([k is None for k, _ in docs], "u1")
    head = MAGIC + struct.pack("<IQI", len(docs), len(ids), INTERVAL)
    return b"".join([head, keys.tobytes(), nulls.tobytes(), counts.tobytes(), offsets.astype("<u8").tobytes(), bits])


def documents_of(data: bytes, book: Codebook) -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a payload, in order."""
    if data[:8] != MAGIC:
        raise ValueError("not a block of this format")
    n_docs, n, interval = struct.unpack_from("<IQI", data, 8)
    at = 24
    keys = np.frombuffer(data, "<i8", n_docs, at)
    nulls = np.frombuffer(data, "u1", n_docs, at := at + 8 * n_docs)
    counts = np.frombuffer(data, "<u8", n_docs, at := at + n_docs).astype(np.int64)
    offsets = np.frombuffer(data, "<u8", -(-n // interval), at := at + 8 * n_docs)
    ids = book.decode(data[at + 8 * len(offsets) :], n, offsets, interval)
    ends = np.cumsum(counts)
    return [(None if z else int(k), ids[e - c : e]) for k, z, c, e in zip(keys, nulls, counts, ends, strict=True)]


def write(docs: DataFrame, folder: str, *, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode docs (doc_id, text) into an archive at folder."""
    spark = docs.sparkSession

    def keep(part: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        small = []
        for x in ids:
            a = np.frombuffer(x, "<u4")
            small.append(a.astype("<u2").tobytes() if a.max() < 65536 else b"\0" + x)  # an odd length marks 32 bits
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(small, pa.binary())], ["doc_id", "ids"])

    def ids_of(x: bytes) -> np.ndarray:
        return np.frombuffer(x, "<u2") if len(x) % 2 == 0 else np.frombuffer(x, "<u4", offset=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for start in range(0, batch.num_rows, 500):
                own = np.bincount(np.concatenate([ids_of(x) for x in batch.column("ids").slice(start, 500).to_pylist()]))
                if len(own) > len(total):
                    total = np.append(total, np.zeros(len(own) - len(total), np.int64))
                total[: len(own)] += own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["id", "n"])

    ids = stored(mapped(docs, keep, "doc_id long, ids binary", tokenizer), "huffman-ids")
    counts = ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    lengths = code_lengths({r.id: r.n for r in counts})
    spark.createDataFrame([(k, b) for k, b in sorted(lengths.items())], "id int, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    book = spark.sparkContext.broadcast(Codebook(lengths))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        block = first = size = 0

        def out() -> pa.RecordBatch:
            cols = [[file], [block], [first], [size], [payload(held, book.value)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["file", "block", "first", "n_tokens", "payload"])

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                own = ids_of(x.as_py())
                if size and size + len(own) > block_tokens:
                    yield out()
                    block, first, size, held = block + 1, first + size, 0, []
                held.append((doc_id, own))
                size += len(own)
        if held:
            yield out()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id are told apart by their ids' first bytes, and rows alike in these by chance, so that an id, or null,
    # that many rows have doesn't meet in one task.
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_head"), F.col("_any")]
    salted = ids.withColumns({"_head": F.substring("ids", 1, 32), "_any": F.rand(7)})
    ranged = salted.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    ranged.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of an archive, decoded from its files."""
    lengths = {r.id: r.bits for r in spark.read.parquet(f"{folder}/codebook").collect()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    base, total = {}, 0
    for r in sorted(blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()):
        base[r.file] = total
        total += r.n
    shared = spark.sparkContext.broadcast((Codebook(lengths), base))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, before = shared.value
        for batch in batches:
            for file, first, data in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), batch.column("payload"), strict=True):
                docs = documents_of(data.as_py(), book)
                counts = np.array([len(x) for _, x in docs], np.int64)
                cols = [
                    pa.array([k for k, _ in docs], pa.int64()),
                    pa.array(before[file] + first + np.cumsum(counts) - counts),
                    pa.array(counts),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("file", "first", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Write an archive of docs to the shared folder and read it back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/huffman-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer=tokenizer)
    return read_back(spark, folder)
