"""Vector code compression: product codebooks fitted in rounds, their entries found through a GNAT.

Vectors of whole numbers are cut into equal parts; each part has a codebook, and a vector's code is the number of the
nearest entry (squared Euclidean distance, ties to the lower number) in each part. The nearest entry is found in a GNAT
(geometric near-neighbour access tree) over the codebook: a node has split points among its entries, every other entry
belongs to the nearest of them, and each split point keeps the range of its distances to every child's entries. A child is
left out if some split point's range proves that all of its entries are strictly farther away than the best one so far;
bounds are rounded outward, and what is left is compared in whole numbers, so equal distances are never lost. Queries go
down the tree together, a block at a time: first each into the child of its nearest split point, then into the others.

A round of the fit is one scan of all vectors with the codebooks (parts x entries, whatever the table's size) broadcast:
tasks return a row of sums and a count for each entry they meet, and one aggregation adds them up. Coding is one scan
without a shuffle; sums by label are aggregated and joined, by broadcast where labels are few.

Defined results: vectors that are null or hold null or non-finite components take no part; a component that a shorter
vector lacks counts as 0, and so do those that fill up parts of unequal size; scaled components beyond 2^40 in size are held
at 2^40, with exact distances, and errors beyond a long are held at its end; rows of one vec_id are ordered by their
vectors; a null vec_id comes last among the starting entries and is coded; with fewer vectors than entries, there are as
many entries as vectors; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missivelake.llm.common import stored
from missivelake.llm.topk import _matrix

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Split points of a node, rows that go down the tree together, and the size that scaled components are held at.
DEGREE, TOGETHER, HELD = 16, 4096, 1 << 40
#: Rows whose sums a task holds before it returns them: 2^22 components of 2^40 stay within a long.
SUMMED = 1 << 22
#: Labels (a number and a sum each) that are broadcast; more are joined by a shuffle, whose skew Spark splits.
BROADCAST_LABELS = 100_000
LONGEST = (1 << 63) - 1


def _most(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and of b: as 64-bit integers, or as Python's beyond their range."""
    top = a.shape[1] * (2 * max(_most(a), _most(b))) ** 2
    if top < 1 << 53:  # every partial sum is a whole number that a double holds
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    kind = np.int64 if top < 1 << 63 else object
    x, y = a.astype(kind), b.astype(kind)
    out = np.zeros((len(a), len(b)), kind)
    for k in range(a.shape[1]):
        gap = x[:, k, None] - y[:, k]
        out += gap * gap
    return out


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Gnat:
    """A node: its split points, and for each a child with the entries nearest to it. ``compared`` counts distances."""

    def __init__(self, entries: np.ndarray, numbers: np.ndarray | None = None, degree: int = DEGREE):
        self.entries = entries
        self.numbers = np.arange(len(entries)) if numbers is None else numbers
        self.children: list[Gnat | None] = []
        self.compared = 0
        if len(entries) <= 2 * degree:
            return  # all are split points
        chosen = [0]
        away = squared(entries, entries[:1])[:, 0]
        while len(chosen) < degree and away.max() > 0:  # the farthest from those chosen
            chosen.append(int(away.argmax()))
            away = np.minimum(away, squared(entries, entries[chosen[-1:]])[:, 0])
        splits = np.array(chosen)
        d = squared(entries, entries[splits])
        home = d.argmin(1)
        home[splits] = np.arange(len(splits))
        rest = np.setdiff1d(np.arange(len(entries)), splits)
        roots = _roots(d)
        self.low, self.high = np.full((len(splits),) * 2, np.inf), np.full((len(splits),) * 2, -np.inf)
        for j in range(len(splits)):
            own = rest[home[rest] == j]
            self.children.append(Gnat(entries[own], self.numbers[own], degree) if len(own) and len(own) < len(entries) - 1 else None)
            if len(own) and not self.children[-1]:  # all entries but one are alike: no tree tells them apart
                self.children = []
                return
            if len(own):
                self.low[:, j], self.high[:, j] = roots[own].min(0), roots[own].max(0)
        self.entries, self.numbers = entries[splits], self.numbers[splits]

    def _visit(self, q: np.ndarray, rows: np.ndarray, best: np.ndarray, number: np.ndarray) -> int:
        """Take this subtree's entries into best and number of these rows of q; returns how many distances were computed."""
        d = squared(q[rows], self.entries)
        least = d.min(1)
        at = np.where(d == least[:, None], self.numbers, LONGEST).min(1)
        better = (least < best[rows]) | ((least == best[rows]) & (at < number[rows]))
        best[rows[better]], number[rows[better]] = least[better], at[better]
        done = d.size
        if not self.children:
            return done
        roots = _roots(d)
        slack = 1e-12 * (1 + roots.max(1))
        beyond = np.full(d.shape, -np.inf)  # what the ranges prove of every child's distance
        for i in range(len(self.entries)):
            mine = roots[:, i, None]
            np.maximum(beyond, self.low[i] * (1 - 1e-12) - mine, out=beyond)
            np.maximum(beyond, mine - self.high[i] * (1 + 1e-12), out=beyond)
        beyond -= slack[:, None]
        nearest = d.argmin(1)
        for first in (True, False):
            for j, child in enumerate(self.children):
                if child:
                    open_ = (nearest == j) if first else (nearest != j) & (beyond[:, j] <= _roots(best[rows]) * (1 + 1e-12))
                    if open_.any():
                        done += child._visit(q, rows[open_], best, number)
        return done

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry and squared distance to it for every row of q."""
        numbers, distances = [], []
        for s in range(0, len(q), TOGETHER):
            part = q[s : s + TOGETHER]
            # A squared distance of held components is below 2^83 times their number.
            wide = part.shape[1] * (2 * max(_most(part), self._size())) ** 2 >= 1 << 63
            best = np.full(len(part), 1 << 200 if wide else LONGEST, object if wide else np.int64)
            number = np.full(len(part), LONGEST, np.int64)
            self.compared += self._visit(part, np.arange(len(part)), best, number)
            numbers.append(number)
            distances.append(best)
        return np.concatenate(numbers), np.concatenate(distances)

    def _size(self) -> int:
        return max([_most(self.entries), *(c._size() for c in self.children if c)])


Books = list[np.ndarray]  # for each part the entries, a row each


def integers(vectors: DataFrame, scale: int = SCALE, *columns: str) -> DataFrame:
    """vec_id, the given columns, and v, the components as floor(scale * x); rows that take no part are gone."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    held = lambda c: F.greatest(F.lit(-HELD), F.least(F.lit(HELD), F.floor(F.lit(float(scale)) * c.cast("double"))))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), *columns, F.transform(x, held).cast("array<long>").alias("v"))


def _parts(column: pa.Array, width: int, parts: int) -> Iterator[np.ndarray]:
    v = _matrix(column, width * parts)
    return (v[:, p * width : (p + 1) * width] for p in range(parts))


def fit(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Books:
    """Codebooks after so many rounds, from the parts of the vectors of smallest vec_id; no books for an empty table."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    spark = vectors.sparkSession
    rows = integers(vectors, scale).select("vec_id", "v")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return []
    width = max(1, -(-longest // parts))
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    matrix = np.zeros((len(start), width * parts), np.int64)
    for i, r in enumerate(start):
        matrix[i, : len(r.v)] = r.v
    books = [matrix[:, p * width : (p + 1) * width] for p in range(parts)]
    schema = "part int, entry int, n long, sums array<long>"
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Gnat(b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            def fresh() -> tuple[np.ndarray, np.ndarray]:
                return np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)

            def out(n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
                p, e = np.nonzero(n)
                cols = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))]
                return pa.RecordBatch.from_arrays(cols, ["part", "entry", "n", "sums"])

            (n, total), rows = fresh(), 0
            for batch in batches:
                for p, x in enumerate(_parts(batch.column("v"), width, parts)):
                    at, _ = trees.value[p].nearest(x) if len(x) else (np.zeros(0, np.int64), None)
                    n[p] += np.bincount(at, minlength=entries)
                    np.add.at(total[p], at, x)
                rows += batch.num_rows
                if rows > SUMMED:
                    yield out(n, total)
                    (n, total), rows = fresh(), 0
            if rows:
                yield out(n, total)

        found = rows.select("v").mapInArrow(sums, schema)
        each = [F.sum(F.get("sums", k).cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():
            books[r.part] = books[r.part].copy()
            books[r.part][r.entry] = [int(r[f"s{k}"]) // r.n for k in range(width)]
    return books


def encode(vectors: DataFrame, books: Books, *columns: str, scale: int = SCALE) -> DataFrame:
    """vec_id, the given columns, code (two hex digits a part) and error (squared distance to the coded vector)."""
    rows = integers(vectors, scale, *columns)
    if not books:
        return rows.drop("v").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).where("false")
    sc = vectors.sparkSession.sparkContext
    trees = sc.broadcast([Gnat(b) for b in books])
    parts, width, entries = len(books), books[0].shape[1], len(books[0])
    compared, every = sc.accumulator(0), sc.accumulator(0)
    kept = [f for f in rows.schema if f.name != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in trees.value:
            tree.compared = 0
        for batch in batches:
            n = batch.num_rows
            code, error = np.full(n, "", object), np.zeros(n, object)
            for p, x in enumerate(_parts(batch.column("v"), width, parts)):
                at, d = trees.value[p].nearest(x) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                code += np.array([f"{k:02x}" for k in at], object)
                error += d.astype(object)
            held = [min(e, LONGEST) for e in error]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(code, pa.string()), pa.array(held, pa.int64())], [*(f.name for f in kept), "code", "error"])
            every.add(n * parts * entries)
        compared.add(sum(tree.compared for tree in trees.value))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = stored(rows.mapInArrow(run, f"{schema}, code string, error long"), "vector-codes")
    logging.getLogger(__name__).info("%d of %d distances to entries were computed", compared.value, every.value)
    return out


def decode(codes: DataFrame, books: Books) -> DataFrame:
    """codes with v, the scaled vectors that the codes stand for."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<long>")
    def vector(code):
        return code.map(lambda c: [x for p, b in enumerate(shared.value) for x in b[int(c[2 * p : 2 * p + 2], 16)].tolist()])

    return codes.withColumn("v", vector("code"))


def digest(books: Books) -> str:
    """sha256 of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, the error summed over rows of one label, and the codebooks' digest, for every row that takes part."""
    books = fit(vectors)
    codes = encode(vectors, books, "label")
    total = F.least(F.lit(LONGEST).cast("decimal(38,0)"), F.sum(F.col("error").cast("decimal(38,0)"))).cast("long")
    sums = stored(codes.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "vector-labels")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    rows = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Every round as a table of assignments and one of entries."""
    sql = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
wide AS (SELECT max(len(v)) // 4 AS w FROM kept),
part AS MATERIALIZED (SELECT r, vec_id, p, v[p * w + 1:(p + 1) * w] AS x FROM kept, wide, unnest(range(0, 4)) AS u(p)),
e0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS e, x AS c FROM part QUALIFY e < 256)"""
    for k in range(5):
        sql += f""",
a{k} AS MATERIALIZED (
  SELECT r, part.p, part.x, arg_min({{'e': e, 'd': d}}, {{'d': d, 'e': e}}) AS b
  FROM part JOIN e{k} USING (p), LATERAL (SELECT list_sum(list_transform(list_zip(part.x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) GROUP BY ALL)"""
        if k < 4:
            sql += f""",
m{k} AS (SELECT p, b.e AS e, i, floor(sum(x[i]) / count(*)) AS c FROM a{k}, wide, unnest(range(1, w + 1)) AS u(i) GROUP BY ALL),
e{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, e{k}.c) AS c FROM e{k} LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS c FROM m{k} GROUP BY p, e) AS n USING (p, e))"""
    return (
        sql
        + """,
coded AS (SELECT vec_id, label, string_agg(format('{:02x}', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a4 JOIN kept USING (r) GROUP BY r, vec_id, label),
book AS (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM e4, wide, unnest(range(1, w + 1)) AS u(i))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, book"""
    )


ORACLE_SQL = _oracle()
