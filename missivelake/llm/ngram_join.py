"""N-gram Jaccard join by MinHash banding, with exact verification and exact link counts.

1. Every text becomes its set of hashed word five-grams (a shorter text, if it has words, is one gram). Texts with
   equal sets are one *set* from here on, known by a digest; their documents are counted, not paired.
2. Each set has BANDS x ROWS minimum hashes; bands are hashed and shuffled. 24 bands of 6 rows find a pair at the
   threshold of 0.8 with probability 0.9993, and more similar ones nearly always.
3. Sets that share a band hash, directly or through others, form a family (connected components over the edges from
   each bucket's smallest member, so a bucket of m sets gives m - 1 edges).
4. Within a family every pair is verified on the full sets: the family, ordered by size, is cut into blocks and each
   pair of blocks that sizes allow is one group. Groups return link counts and spanning edges, never pairs, so a large
   family costs rows in proportion to its members times its blocks. No bucket, family or set has a cap.
5. Classes are the components of verified links. A document's links are all other documents at the threshold: its own
   copies and all copies of every linked set.

Defined results: texts without words (null, empty, marks only) have no grams, no links and are classes of their own;
rows of equal doc_id and text are one document with that many copies; a class is named by its smallest doc_id and a
class whose ids are all null by null; other columns are carried by ``keep_one``, whatever their names, and ignored by ``join``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missivelake.llm.common import chunks, stored, texts, unused, words_of
from missivelake.llm.components import components

N = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
#: A pair of blocks takes some 200 MB of a worker at most.
MIN_BLOCK, MAX_BLOCK, BLOCKS = 64, 2048, 64
#: Keys of sets to verify are broadcast up to this many (some 150 bytes each), and joined by a shuffle beyond it.
BROADCAST_SETS = 200_000

_MASK = (1 << 64) - 1


class GramHasher:
    """Sets of 64-bit hashes of word n-grams; hashes of words are remembered up to a bound."""

    def __init__(self, n: int):
        self.n = n
        self.known: dict[bytes, int] = {}
        rng = np.random.default_rng(11)
        self.factors = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        n = min(self.n, len(h))
        grams = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            grams += h[k : len(h) - n + 1 + k] * self.factors[k]
            grams ^= grams >> np.uint64(29)
        return np.unique(grams * np.uint64(0x9E3779B97F4A7C15))


class MinHasher:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(5)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.mix = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The band hashes of a non-empty set."""
        least = np.full(len(self.a), _MASK, np.uint64)
        for k in range(0, len(grams), 2048):
            h = grams[k : k + 2048, None] ^ (grams[k : k + 2048, None] >> np.uint64(31))
            np.minimum(least, (h * self.a + self.b).min(axis=0), out=least)
        least = (least >> np.uint64(8)).reshape(self.bands, self.rows)
        band = (least * self.mix).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)
        return (band ^ (band >> np.uint64(33))).view(np.int64)


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that banding finds a pair of this similarity."""
    return 1 - (1 - similarity**rows) ** bands


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def digests(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, set (null without words), grams and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, minhash = GramHasher(n), MinHasher(bands, rows)
        for batch in batches:
            for part in chunks(batch):
                sets = [grams_of(x) for x in texts(part)]
                cols = [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([minhash(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "set", "grams", "bands"])

    return keyed(docs).mapInArrow(run, "doc_id long, text_key long, set binary, grams int, bands array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _ratio(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction of whole numbers, so that a pair exactly on it is told without rounding."""
    return Fraction(threshold).limit_denominator(1_000_000).as_integer_ratio()


def _verifier(threshold: float):
    """Link counts and spanning edges of one pair of blocks of a family."""
    over, under = _ratio(threshold)

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "set"], kind="stable")
        sets = [np.frombuffer(x, np.uint64) for x in group["items"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        values, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
        column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[at]
        row = np.repeat(np.arange(len(sets)), sizes)
        row, column = row[column >= 0], column[column >= 0]
        n, width = len(sets), int(column.max()) + 1 if len(column) else 0
        common = np.zeros((n, n), np.float32)
        step = max(1, (16 << 20) // max(1, n))
        for low in range(0, width, step):
            own = (column >= low) & (column < low + step)
            dense = np.zeros((n, min(step, width - low)), np.float32)
            dense[row[own], column[own] - low] = 1
            common += dense @ dense.T
        linked = np.empty((n, n), bool)
        for k in range(0, n, 256):  # common / (a + b - common) >= over / under, a few rows of whole numbers at a time
            linked[k : k + 256] = common[k : k + 256].astype(np.int64) * (over + under) >= over * (sizes[k : k + 256, None] + sizes)
        side = group["side"].to_numpy()
        two = side.max() > side.min()
        linked &= (side[:, None] != side[None, :]) if two else ~np.eye(n, dtype=bool)
        copies = group["copies"].to_numpy().astype(np.float64)
        links = (linked @ copies).astype(np.int64)
        # spanning edges: breadth-first within the group
        parent, todo = np.full(n, -1), np.ones(n, bool)
        for root in range(n):
            if not todo[root]:
                continue
            todo[root], queue = False, [root]
            for q in queue:
                new = np.flatnonzero(linked[q] & todo)
                todo[new], parent[new] = False, q
                queue.extend(new.tolist())
        keys = group["set"].to_numpy()
        return pd.DataFrame({"set": keys, "links": links, "parent": [keys[p] if p >= 0 else None for p in parent]})

    return verify


def classify(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, rows (equal rows), class_key (doc_id and text_key of its first document), class_id, n_links."""
    all_rows = stored(digests(docs, n, bands, rows), "ngram-digests")
    own = all_rows.groupBy("doc_id", "text_key", "set").agg(F.count("*").alias("rows"))
    worded = all_rows.where("set is not null")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    sets = stored(worded.groupBy("set").agg(first, F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.any_value("grams").alias("grams"), F.any_value("bands").alias("bands")), "ngram-sets")

    # Families: star edges from the smallest member of every bucket of two sets or more.
    banded = sets.select("set", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("set").alias("b"), F.max("set").alias("most")).where("b <> most").select("band", "hash", "b")
    edges = banded.join(buckets, ["band", "hash"]).where("set <> b").select(F.col("set").alias("a"), "b")
    family = components(edges).withColumnsRenamed({"node": "set", "component": "family"})
    members = stored(family.join(sets.select("set", "first", "copies", "grams"), "set"), "ngram-members")

    # Blocks: places by size within the family; a block's smallest and largest sizes decide which pairs of blocks can link.
    counts = members.groupBy("family").agg(F.count("*").alias("n"))
    sized = members.groupBy("family", "grams").agg(F.count("*").alias("k"))
    block = F.least(F.lit(MAX_BLOCK), F.greatest(F.lit(MIN_BLOCK), F.ceil(F.col("n") / BLOCKS)))
    ordered = _places(members, sized).join(counts, "family").withColumn("block", F.floor(F.col("place") / block).cast("int"))
    ordered = stored(ordered.select("set", "family", "first", "copies", "grams", "block"), "ngram-blocks")
    spans = ordered.groupBy("family", "block").agg(F.min("grams").alias("low"), F.max("grams").alias("high"))
    after = spans.select("family", F.col("block").alias("other"), F.col("low").alias("other_low"))
    over, under = (F.lit(x).cast("long") for x in _ratio(threshold))
    pairs = spans.join(after, "family").where((F.col("other") >= F.col("block")) & (F.col("high") * under >= F.col("other_low") * over))
    jobs = pairs.select("family", F.col("block").alias("i"), F.col("other").alias("j"))
    jobs = jobs.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))

    items = _items(docs, ordered, n)
    work = jobs.join(items, ["family", "block"]).select("family", "i", "j", (F.col("block") == F.col("j")).cast("int").alias("side"), "set", "copies", "items")
    found = work.groupBy("family", "i", "j").applyInPandas(_verifier(threshold), "set binary, links long, parent binary")
    found = stored(found, "ngram-found")
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    classes = components(found.where("parent is not null").select(F.col("set").alias("a"), F.col("parent").alias("b"))).withColumnsRenamed({"node": "set", "component": "class"})

    named = sets.join(classes, "set", "left").join(links, "set", "left")
    named = named.select("set", "first", "least_id", "copies", F.coalesce("class", "set").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    named = stored(named, "ngram-classes")
    heads = named.groupBy("class").agg(F.min("first").alias("class_key"), F.min("least_id").alias("class_id"))
    by_set = named.join(heads, "class").select("set", "class_key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    with_set = own.where("set is not null").join(by_set, "set").drop("set")
    alone = own.where("set is null").select("doc_id", "text_key", "rows", F.struct("doc_id", "text_key").alias("class_key"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_set.unionByName(alone)


def _places(members: DataFrame, sized: DataFrame) -> DataFrame:
    """members with each row's place in its family by ascending number of grams (any order among equals).

    Ranks run within hash buckets of each (family, size), after the counts before them, so no family meets in one task.
    """
    bucketed = members.withColumn("_b", F.pmod(F.xxhash64("set"), F.lit(64)))
    counts = bucketed.groupBy("family", "grams", "_b").agg(F.count("*").alias("k"))
    w = Window.partitionBy("family").orderBy("grams", "_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("family", "grams", "_b", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("family", "grams", "_b").orderBy("set")) - 1
    return bucketed.withColumn("_rank", rank).join(before, ["family", "grams", "_b"]).withColumn("place", F.col("_rank") + F.col("_before"))


def _items(docs: DataFrame, ordered: DataFrame, n: int) -> DataFrame:
    """The full gram sets of the sets in families, built anew from one document of each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of = GramHasher(n)
        for batch in batches:
            for part in chunks(batch):
                sets = pa.array([grams_of(x).tobytes() for x in texts(part)], pa.binary())
                cols = [part.column(c) for c in ("set", "family", "block", "copies")]
                yield pa.RecordBatch.from_arrays([*cols, sets], ["set", "family", "block", "copies", "items"])

    wanted = ordered.select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"), "set", "family", "block", "copies")
    wanted = F.broadcast(wanted) if ordered.count() <= BROADCAST_SETS else wanted
    rows = keyed(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    rows = rows.select("set", "family", "block", "copies", "text")
    out = stored(rows.mapInArrow(build, "set binary, family binary, block int, copies long, items binary"), "ngram-items")
    return out.dropDuplicates(["set"]) if out.count() > ordered.count() else out


def join(docs: DataFrame, **options: float) -> DataFrame:
    """One row per document: doc_id, class_id and n_links."""
    found = classify(docs, **options)
    return found.select("doc_id", "class_id", "n_links", F.explode(F.expr("array_repeat(0, cast(rows as int))")).alias("_")).drop("_")


def keep_one(docs: DataFrame, **options: float) -> DataFrame:
    """The first document of every class (smallest doc_id, then text hash), with all columns; equal rows are one."""
    found = stored(classify(docs, **options), "ngram-kept")
    gone_id, gone_key = unused(docs, "_id", "_key")
    gone = found.where(~F.col("class_key").eqNullSafe(F.struct("doc_id", "text_key"))).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
    key = F.xxhash64(F.col("text").cast("string"))
    kept = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id)) & (key == F.col(gone_key)), "left_anti")
    if found.where("rows > 1").limit(1).count():
        kept = kept.withColumn(gone_key, key).dropDuplicates(["doc_id", gone_key]).drop(gone_key)
    return kept


#: Brute force over all pairs that share a gram.
ORACLE_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
gram AS (
  SELECT DISTINCT r, array_to_string(w[s:s + least(5, len(w)) - 1], ' ') AS g
  FROM doc, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS u(s) WHERE len(w) > 0),
size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
link AS (
  SELECT a.r AS a, b.r AS b FROM gram a JOIN gram b ON a.g = b.g AND a.r <> b.r
  JOIN size sa ON sa.r = a.r JOIN size sb ON sb.r = b.r
  GROUP BY a.r, b.r, sa.n, sb.n HAVING 9 * count(*) >= 4 * (sa.n + sb.n)),
reach AS (SELECT r AS a, r AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT a AS r, min(doc_id) AS class_id FROM reach JOIN doc ON doc.r = reach.b GROUP BY a),
links AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM doc JOIN class USING (r) LEFT JOIN links USING (r)
"""
