"""A stored positional index for keyword search: the same rows as search.keyword_search, without reading the texts.

Layout of the folder, Parquet in any storage that Spark reaches: ``gen=G/postings/batch=N/bucket=B`` holds, for each term and
block of documents, the documents with their lengths and the term's positions, sorted by key, beside their number, the highest
frequency and the least length. A task makes blocks of BLOCK documents at most as it meets them, so a row's size is bounded
however common its term is, and what is shuffled are a block's lists, each term once. (So a task that is run again must meet
its rows in the same order, as those of files are.) Terms are dealt into buckets, so a query opens the folders of its own terms only;
within a file, rows are sorted by term, so most row groups are passed over too. A batch counts once its file in
``commits`` is there, which also says how many documents and tokens it has; a batch that died is written anew, and one
that is committed is not added again. Appending batches gives the results of an index built at once.

A search of single words first reads the blocks' numbers alone: document frequencies, and for each block what its best
document can score at most. Blocks are then scored from the best down; those that cannot reach the last wanted score of the
first ones are never opened. Phrases of several words need all their blocks, since their frequency is the number of
documents that hold them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missivelake.operators.search import K1, B, query_phrases
from missivelake.sources.commits import Commits

BUCKETS = 32
#: Documents of a block, and blocks that are scored before others are held against their scores.
BLOCK, FIRST = 4096, 16
#: Tokens at which a block is full, whatever its documents.
BLOCK_TOKENS = 4 << 20
#: A block's number: its batch, the task that made it and its place there.
BATCH_BITS, TASK_BITS = 40, 20
#: A term's documents in a block, as they are shuffled: ends are those of the documents' runs in positions.
FLAT = "term string, block long, n_docs int, max_tf int, min_length int, lengths array<int>, ends array<int>, positions array<int>"


def tokens(columns: list[str]) -> Column:
    """Lower-cased runs of letters, digits and marks of the columns, with a null between columns, which no phrase crosses."""
    lists = [F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), lambda x: x != "") for c in columns]
    gap = F.array(F.lit(None).cast("string"))
    return reduce(lambda a, b: F.concat(a, gap, b), lists)


def _bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def _flat_lists(first: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that makes blocks of key, length and tokens as they come, and puts out each block's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first + (TaskContext.get().partitionId() << TASK_BITS)
        held: list[pa.RecordBatch] = []
        n = size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - n)
                at, n, size = at + part.num_rows, n + part.num_rows, size + len(part.column("tokens").flatten())
                held.append(part)
                if n >= block or size >= BLOCK_TOKENS:
                    yield from _block_lists(held, number)
                    number, held, n, size = number + 1, [], 0, 0
        yield from _block_lists(held, number)

    return run


def _block_lists(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """A row for each term of a block's documents, these in the order of their keys."""
    if not held:
        return
    docs = pa.Table.from_batches(held).combine_chunks()
    docs = docs.take(pc.sort_indices(docs["key"])).combine_chunks()
    keys, lists = (docs[c].combine_chunks() for c in ("key", "tokens"))
    length = docs["length"].to_numpy()
    said = lists.flatten().dictionary_encode()
    codes = said.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    position = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.argsort(codes, kind="stable")  # documents and positions stay in order
    order = order[np.searchsorted(codes[order], 0) :]  # gaps are no terms
    if not len(order):
        return
    codes, doc, position = codes[order], doc[order], position[order]
    new = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])])
    tf = np.diff(np.r_[new, len(codes)])
    term, own = codes[new], doc[new]
    top = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    n_docs = np.diff(np.r_[top, len(term)])
    ends = np.cumsum(tf) - np.repeat(new[top], n_docs)
    ints = lambda x: pa.array(x.astype(np.int32))
    each = lambda values: pa.ListArray.from_arrays(ints(np.r_[top, len(term)]), values)
    columns = {
        "term": said.dictionary.take(pa.array(term[top])),
        "block": pa.array(np.full(len(top), number, dtype=np.int64)),
        "n_docs": ints(n_docs),
        "max_tf": ints(np.maximum.reduceat(tf, top)),
        "min_length": ints(np.minimum.reduceat(length[own], top)),
        "lengths": each(ints(length[own])),
        "ends": each(ints(ends)),
        "positions": pa.ListArray.from_arrays(ints(np.r_[new[top], len(codes)]), ints(position)),
        "keys": each(keys.take(pa.array(own))),
    }
    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class Postings:
    def __init__(self, spark: SparkSession, folder: str, key_type: str = "long", buckets: int = BUCKETS):
        self.spark, self.buckets, self.key_type = spark, buckets, key_type
        self.files = Commits(spark, folder)
        self._opened: tuple[DataFrame, int, int] | None = None

    def _schema(self) -> str:
        return f"term string, block long, n_docs int, max_tf int, min_length int, docs array<struct<key: {self.key_type}, length: int, positions: array<int>>>"

    def commits(self) -> dict[int, tuple[int, int]]:
        """Documents and tokens of every batch that counts."""
        found = (name.split("-") for name in self.files.names("commits"))
        return {int(batch): (int(n), int(total)) for batch, n, total in found}

    def add(self, docs: DataFrame, batch_id: int, key: str, column: str | list[str] = "text", block: int = BLOCK) -> None:
        """Index documents that the index does not have yet; keys are unique."""
        if batch_id in self.commits():
            return
        columns = [column] if isinstance(column, str) else column
        rows = docs.select(F.col(key).cast(self.key_type).alias("key"), tokens(columns).alias("tokens"))
        length = (F.size("tokens") - (len(columns) - 1)).cast("int")
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
        flat = rows.select("key", length.alias("length"), "tokens").mapInArrow(_flat_lists(batch_id << BATCH_BITS, block), f"{FLAT}, keys array<{self.key_type}>")
        start = lambda i: F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
        document = lambda k, i: F.struct(k.alias("key"), F.get("lengths", i).alias("length"), F.slice("positions", start(i) + 1, F.get("ends", i) - start(i)).alias("positions"))
        self._write(flat, f"gen={self.files.generation()}/postings/batch={batch_id}", F.transform("keys", document))
        self.files.mark(f"commits/{batch_id}-{n}-{total}")
        self._opened = None

    def _write(self, lists: DataFrame, folder: str, docs: str | Column = "docs") -> None:
        """Deal lists out by bucket, the one shuffle that an index takes, and put their documents together after it."""
        placed = lists.withColumn("bucket", _bucket(F.col("term"), self.buckets))
        dealt = placed.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(4)))  # a bucket with a third of all postings is four tasks' work
        whole = dealt.sortWithinPartitions("bucket", "term", "block").select("term", "block", "n_docs", "max_tf", "min_length", F.col(docs).alias("docs") if isinstance(docs, str) else docs.alias("docs"), "bucket")
        whole.write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(f"{self.files.folder}/{folder}")

    def _open(self) -> tuple[DataFrame, int, int]:
        """The rows of all batches that count, the number of documents, and of tokens."""
        if self._opened is None:
            commits = self.commits()
            rows = self.spark.read.schema(f"{self._schema()}, batch long, bucket int").parquet(self.files.folder_of(f"gen={self.files.generation()}/postings"))
            rows = rows.where(F.col("batch").isin(*commits)) if commits else rows.where("false")
            self._opened = rows, sum(n for n, _ in commits.values()), sum(t for _, t in commits.values())
        return self._opened

    def compact(self) -> None:
        """Write the postings of all batches as those of the last one, in a new generation; blocks stay as they are."""
        rows, _, _ = self._open()
        if not self.commits():
            return
        gen, last = self.files.generation() + 1, max(self.commits())
        self._write(rows.drop("batch", "bucket"), f"gen={gen}/postings/batch={last}")
        self.files.mark(f"generations/{gen}")
        self._opened = None

    def search(self, query: str, limit: int | None = 20) -> DataFrame:
        """key and BM25 score of the documents that hold every phrase of the query, best first."""
        rows, n, total = self._open()
        phrases = query_phrases(query)
        terms = sorted({t for p in phrases for t in p})
        nothing = self.spark.createDataFrame([], f"key {self.key_type}, score double")
        if not phrases or not n:
            return nothing
        wanted = {zlib.crc32(t.encode()) % self.buckets for t in terms}
        rows = rows.where(F.col("bucket").isin(*wanted) & F.col("term").isin(*terms))
        mean = total / n
        if any(len(p) > 1 for p in phrases):
            found = self._frequencies(rows, phrases, terms)
            df = found.agg(*[F.sum((F.col(f"f{i}") > 0).cast("long")) for i in range(len(phrases))]).first()
            if not all(df):
                return nothing
            scored = self._scored(found, df, n, mean)
            return scored.limit(limit) if limit else scored

        which = [terms.index(p[0]) for p in phrases]
        numbers = rows.groupBy("term").agg(F.sum("n_docs").alias("df"), F.count("*").alias("blocks")).collect()
        by_term = {r.term: r for r in numbers}
        if len(by_term) < len(terms):
            return nothing
        df = [by_term[terms[k]].df for k in which]
        if limit and min(r.blocks for r in numbers) > FIRST:
            rows = self._promising(rows, phrases, terms, df, n, mean, limit)
        scored = self._scored(self._frequencies(rows, phrases, terms), df, n, mean)
        return scored.limit(limit) if limit else scored

    def _promising(self, rows: DataFrame, phrases: list[list[str]], terms: list[str], df: list[int], n: int, mean: float, limit: int) -> DataFrame:
        """rows without the blocks that cannot hold one of the best documents."""
        most = [F.max(F.when(F.col("term") == t, F.struct("max_tf", "min_length"))).alias(f"m{k}") for k, t in enumerate(terms)]
        best = rows.groupBy("block").agg(F.min("n_docs").alias("held"), *most).where(reduce(lambda a, b: a & b, [F.col(f"m{k}").isNotNull() for k in range(len(terms))]))
        bound = [_score(F.col(f"m{terms.index(p[0])}.max_tf"), F.col(f"m{terms.index(p[0])}.min_length"), d, n, mean) for p, d in zip(phrases, df, strict=True)]
        best = best.select("block", "held", reduce(lambda a, b: a + b, bound).alias("bound"))
        first, held = [], 0
        for r in best.orderBy(F.desc("bound"), "block").limit(max(FIRST, limit)).collect():
            if len(first) >= FIRST and held >= limit:
                break
            first.append(r.block)
            held += r.held  # blocks may be small
        there = self._scored(self._frequencies(rows.where(F.col("block").isin(*first)), phrases, terms), df, n, mean).limit(limit).collect()
        if len(there) < limit:
            return rows
        least = there[-1].score - 1e-6  # scores are rounded
        return rows.join(best.where(F.col("bound") >= least).select("block"), "block", "left_semi")

    def _frequencies(self, rows: DataFrame, phrases: list[list[str]], terms: list[str]) -> DataFrame:
        """key, length and the frequency of each phrase (f0, f1 ...) in every document that has one of the terms."""
        each = rows.select("term", "block", F.explode("docs").alias("d"))
        own = [F.max(F.when(F.col("term") == t, F.col("d.positions"))).alias(f"p{k}") for k, t in enumerate(terms)]
        docs = each.groupBy("block", "d.key", "d.length").agg(*own) if len(terms) > 1 else each.select("d.key", "d.length", F.col("d.positions").alias("p0"))
        none = F.array().cast("array<int>")
        places = [F.coalesce(F.col(f"p{k}"), none) for k in range(len(terms))]
        return docs.select("key", "length", *[_frequency([places[terms.index(t)] for t in p]).alias(f"f{i}") for i, p in enumerate(phrases)])

    def _scored(self, found: DataFrame, df: list[int], n: int, mean: float) -> DataFrame:
        hits = found.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(df))]))
        score = reduce(lambda a, b: a + b, [_score(F.col(f"f{i}"), F.col("length"), d, n, mean) for i, d in enumerate(df)])
        return hits.select("key", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "key")


def _score(tf: Column, length: Column, df: int, n: int, mean: float) -> Column:
    """A phrase's share of a document's score; it rises with tf and falls with length."""
    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _frequency(places: list[Column]) -> Column:
    """How often a phrase stands in a document, given its words' positions; occurrences don't overlap."""
    if len(places) == 1:
        return F.size(places[0])
    starts = places[0]
    before = lambda p, k: F.transform(p, lambda x: x - k)
    for k, p in enumerate(places[1:], 1):
        starts = F.array_intersect(starts, before(p, k))
    size = len(places)
    none = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("free"))
    take = lambda acc, x: F.when(x >= acc["free"], F.struct((acc["n"] + 1).alias("n"), (x + size).alias("free"))).otherwise(acc)
    return F.aggregate(starts, none, take, lambda acc: acc["n"])
