"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Every block of vectors keeps, for each dimension, its rows sorted by that component. A query reads the lists in rounds,
each from the end that the sign of its component favours (lists of a zero component are not read), and further the
heavier its component is; rows met for the first time are scored in full (random access). No unseen row beats in any
list what was read last there, and none is longer than the block's longest vector, so the bound is the highest inner
product under these limits: the sum of the threshold algorithm, tightened by the length. Once it falls below the query's
k-th score no unseen row can enter (ties go to the smaller id, so a bound that equals the k-th score does not stop the
scan). ``threshold_scan`` returns how many rows were scored, and ``top_k`` can log it.

Components are whole numbers, and scores are exact: they are taken in floats only where no sum can pass 2^53, in 64-bit
integers where none can pass 2^63, and in Python's integers beyond; between tasks a score is two decimals.

Vectors and queries are stored, and dealt by chance into blocks of at most ``block_bytes`` each. One job holds every block
of queries against every block of vectors: both sides of a cell of that grid meet in one co-grouped task, so its memory is
two blocks whatever the number of queries, nothing passes through the driver, and a row that many copies share is dealt out
like others. Each cell returns k rows a query, and one shuffle by query merges them.

Defined results: vectors that are null or hold null or non-finite components take no part; a component that a shorter
vector lacks counts as 0; components whose scaled value is beyond the range of a long are held at its ends, and so are
returned scores, after ranking; of rows that share an id each is a query with rows of its own, and none is the other's candidate; a null id is
no query and is not returned; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import logging
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missivelake.llm.common import stored

SCALE = 1024
K = 10
BLOCK_BYTES = 8 << 20
#: Scores between tasks are a high part and LOW bits.
LOW = 80
#: Part of a block's rows that a list of average weight gives in the first round.
FIRST = 1 / 256


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and its components as floor(scale * x); rows that take no part are gone."""
    x = F.col("embedding")
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<long>").alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A row for each vector, zeros where it is shorter."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _most(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def bound(query: np.ndarray, limits: np.ndarray, longest: float) -> float:
    """An upper bound of query . x over all x of at most this length with query_d * x_d <= query_d * limits_d for all d.

    The best x is s * query, cut at the limits, with the greatest s that its length allows; a small excess covers rounding.
    """
    q, most = np.abs(query), np.where(query < 0, -limits, limits)
    with np.errstate(divide="ignore"):
        order = np.argsort(most / q)
    q, most = q[order], most[order]
    capped = np.concatenate([[0.0], np.cumsum(most * most)])  # squared length of the k components that are at their limits
    free = np.concatenate([np.cumsum((q * q)[::-1])[::-1], [0.0]])  # of the others, for s = 1
    room = longest * longest - capped
    s = np.sqrt(np.maximum(room[:-1], 0) / np.maximum(free[:-1], 1e-300))
    fits = np.flatnonzero((s * q <= most) & (room[:-1] >= 0))  # the first component that stays below its limit
    k = int(fits[0]) if len(fits) else len(q)
    total = float(np.dot(q[:k], most[:k]) + (s[k] * free[k] if k < len(q) else 0.0))
    return min(total, float(np.dot(q, most))) + 1e-9 * (float(np.dot(q, np.abs(most))) + 1)


class Block:
    """A block of vectors with its sorted lists."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)  # ascending; read from the end for positive components
        self.most = _most(rows)
        self.floats = rows.astype(np.float64)
        self.longest = float(np.sqrt((self.floats**2).sum(1).max(initial=0.0))) * (1 + 1e-12)

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products of the query and the rows at these places."""
        top = self.most * _most(query) * len(query)
        if top < 1 << 53:
            return (self.floats[at] @ query.astype(np.float64)).astype(np.int64)
        if top < 1 << 63:
            return self.rows[at] @ query
        return self.rows[at].astype(object) @ query.astype(object)


Best = list[tuple[int, int]]  # (-score, id) of the k best rows, best first


def threshold_scan(best: Best, k: int, query: np.ndarray, query_id: int, block: Block) -> int:
    """Take a block's rows into the query's best; returns how many rows were scored."""
    n = len(block.rows)
    dims = np.flatnonzero(query)
    seen = block.ids == query_id
    own = int(seen.sum())

    def take(fresh: np.ndarray) -> None:
        if len(fresh):
            scores = block.scores(query, fresh)
            if len(best) == k:
                fine = np.flatnonzero(scores >= -best[-1][0])
                fresh, scores = fresh[fine], scores[fine]
            if len(fresh) > 4 * k and scores.dtype != object:
                fine = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                fresh, scores = fresh[fine], scores[fine]
            best.extend(zip((-int(s) for s in scores), block.ids[fresh].tolist(), strict=True))
            best.sort()
            del best[k:]

    if not len(dims):
        take(np.flatnonzero(~seen))
        return n - own
    q = query[dims].astype(np.float64)
    weight = np.abs(q) / np.abs(q).mean()
    depth, step = np.zeros(len(dims), np.int64), max(1.0, n * FIRST)
    up = q > 0
    while True:
        end = np.minimum(n, depth + np.maximum(1, (step * weight).astype(np.int64)))
        reads = end - depth
        each = np.arange(int(reads.sum())) - np.repeat(np.cumsum(reads) - reads, reads) + np.repeat(depth, reads)
        lists = np.repeat(np.arange(len(dims)), reads)
        met = np.unique(block.order[np.where(up[lists], n - 1 - each, each), dims[lists]])
        fresh = met[~seen[met]]
        seen[fresh] = True
        take(fresh)
        depth, step = end, step * 2
        if seen.all():  # at the latest at the end of any list
            return n - own
        last = block.order[np.where(up, n - np.maximum(depth, 1), np.maximum(depth, 1) - 1), dims]
        if len(best) == k and bound(q, block.floats[last, dims], block.longest) < -best[-1][0]:
            return int(seen.sum()) - own


SCORED = "query long, query_id long, vec_id long, high decimal(38,0), low decimal(38,0)"


def top_k(vectors: DataFrame, is_query: Column, *, k: int = K, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product for every row that is_query picks."""
    sc = vectors.sparkSession.sparkContext
    numbered = integers(vectors, scale).withColumns({"query": F.when(F.coalesce(is_query, F.lit(False)), F.monotonically_increasing_id()), "deal": F.rand(7)})
    rows = stored(numbered, "topk-vectors")
    n, n_queries, dims = rows.agg(F.count("*"), F.count("query"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(1, dims)
    size = max(1, block_bytes // (8 * dims))
    across = max(1, -(-n // size), min(n, 2 * sc.defaultParallelism))  # small tables are still dealt over the cores
    down = max(1, -(-n_queries // size))
    block = lambda blocks: F.floor(F.col("deal") * blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select(block(across).alias("across"), every(down).alias("down"), "vec_id", "v")
    right = rows.where("query is not null").select(every(across).alias("across"), block(down).alias("down"), "query", F.col("vec_id").alias("query_id"), "v")
    scored, all_pairs = sc.accumulator(0), sc.accumulator(0)

    def cell(own: pa.Table, asked: pa.Table) -> pa.Table:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0)]
        names = [x.split()[0] for x in SCORED.split(", ")]
        cells: list[tuple] = []
        if own.num_rows and asked.num_rows:
            lists = Block(_matrix(own.column("v").combine_chunks(), dims), own.column("vec_id").to_numpy())
            queries = _matrix(asked.column("v").combine_chunks(), dims)
            for i, (query, query_id) in enumerate(zip(asked.column("query").to_pylist(), asked.column("query_id").to_pylist(), strict=True)):
                best: Best = []
                scored.add(threshold_scan(best, k, queries[i], query_id, lists))
                cells += [(query, query_id, vec, Decimal(-s >> LOW), Decimal(-s & ((1 << LOW) - 1))) for s, vec in best]
            all_pairs.add(own.num_rows * asked.num_rows)
        columns = zip(*cells, strict=True) if cells else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    found = stored(left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(cell, SCORED), "topk")
    logging.getLogger(__name__).info("%d of %d pairs were scored", scored.value, all_pairs.value)
    w = Window.partitionBy("query").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    most, least = (F.lit(x).cast("decimal(38,0)") for x in ((1 << 63) - 1, -(1 << 63)))
    score = F.when(F.col("high") > 0, most).when(F.col("high") < -1, least).when(F.col("high") == 0, F.least("low", most)).otherwise(F.greatest(F.col("low") - F.lit(str(1 << LOW)).cast("decimal(38,0)"), least))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.cast("long").alias("score"))


ORACLE_SQL = """
WITH t AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM t q JOIN t c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
WHERE rank <= 10
"""
