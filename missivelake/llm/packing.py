"""Best-fit packing of documents into sequences of at most SIZE tokens, improved by swap-based local search.

Only lengths decide how well pieces fit, and there are at most SIZE different ones, so the plan is made on the global
histogram of lengths (one aggregated row for each length, whatever the corpus): best fit by decreasing length fills
bins, held as bin contents with a multiplicity; then local search exchanges pieces one for one and two for one, and
moves pieces, between underfull bins, always raising the sum of squared fills, until no exchange is left or there are
no more bins than all pieces together fill.

The corpus itself never leaves the executors: every piece learns its rank among the pieces of its length (ranks within
hash buckets of each length, plus the counts of the buckets before, so that a length held by a third of all rows is
still spread), and the rank decides its bin and its place in it.

Defined results: a null or empty text is a document of the end id alone; rows with the same doc_id and text are ranked
apart (by partition and row); a text of more than SIZE tokens is cut into SIZE-token pieces, the first being shorter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missivelake.llm.common import stored
from missivelake.llm.tokens import mapped

SIZE = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- plan on the histogram ---------------------------------------------------------------------------------------

Bin = tuple[int, ...]  # lengths, longest first


def best_fit(histogram: dict[int, int], size: int) -> Counter[Bin]:
    """Best fit decreasing: bin contents with how many bins have them."""
    left = {k: n for k, n in histogram.items() if n > 0}
    lengths = sorted(left)
    bins: Counter[Bin] = Counter()
    while lengths:
        room, content = size, []
        used: Counter[int] = Counter()
        while True:
            at = bisect_right(lengths, room) - 1
            while at >= 0 and used[lengths[at]] >= left[lengths[at]]:
                at -= 1
            if at < 0:
                break
            content.append(lengths[at])
            used[lengths[at]] += 1
            room -= lengths[at]
        times = min(left[k] // n for k, n in used.items())
        bins[tuple(content)] += times
        for k, n in used.items():
            left[k] -= n * times
        lengths = [k for k in lengths if left[k] > 0]
    return bins


def _takes(b: Bin) -> list[Bin]:
    """What can be taken out of a bin: one item, or two."""
    have = Counter(b)
    kinds = sorted(have)
    return [*[(x,) for x in kinds], *[(x, y) for i, x in enumerate(kinds) for y in kinds[i:] if x != y or have[x] > 1]]


def _exchanged(a: Bin, b: Bin, out: Bin, into: Bin) -> tuple[Bin, Bin]:
    """Both bins after out went from a to b, and into from b to a."""
    ca, cb = Counter(a), Counter(b)
    ca.subtract(out)
    ca.update(into)
    cb.subtract(into)
    cb.update(out)
    order = lambda c: tuple(sorted(c.elements(), reverse=True))
    return order(ca), order(cb)


def local_search(bins: Counter[Bin], size: int) -> Counter[Bin]:
    """Empty underfull bins, the emptiest first: of all moves, one-for-one and two-for-one exchanges with fuller bins the
    one that raises the squared fill most is made, for as many bins of the same contents as there are. It ends when no
    exchange is left, or with as few bins as their items can fill at all. The squared fill grows with every exchange."""
    full = Counter({b: n for b, n in bins.items() if sum(b) == size})
    under = Counter({b: n for b, n in bins.items() if 0 < sum(b) < size})
    least = -(-sum(sum(b) * n for b, n in bins.items()) // size) - sum(full.values())
    untried: dict[Bin, set[Bin]] = {}  # for sources that found no exchange: the contents that have come up since
    fills = {b: (sum(b), b) for b in under}
    while sum(under.values()) > least:
        source = min((b for b in under if untried.get(b, True)), key=fills.__getitem__, default=None)
        if source is None:
            break
        takes, fill = _takes(source), sum(source)
        # What each target gives back, nothing at first: its place among the targets and the sum.
        targets = sorted(b for b in untried.get(source, under) if fills[b][0] >= fill and under[b] > (b == source))
        gives = [(k, out) for k, b in enumerate(targets) for out in ((), *[(x,) for x in sorted(set(b))])]
        moved = False
        if gives:
            at, given = np.array([k for k, _ in gives]), np.array([sum(out) for _, out in gives])
            filled = np.array([fills[b][0] for b in targets])[at][:, None]
            d = np.array([sum(t) for t in takes]) - given[:, None]
            gain = np.where((d > 0) & (d <= size - filled), d * (filled - fill + d), 0)
            g, t = divmod(int(gain.argmax()), len(takes))
            moved = bool(gain[g, t] > 0)
        if not moved:
            untried[source] = set()
            continue
        target = targets[gives[g][0]]
        times = under[source] // 2 if target == source else min(under[source], under[target])
        for b in (source, target):
            under[b] -= times
            if not under[b]:
                del under[b]
                untried.pop(b, None)
        for b in _exchanged(target, source, gives[g][1], takes[t]):
            if sum(b) == size:
                full[b] += times
                least -= times
            elif b:
                under[b] += times
                fills[b] = (sum(b), b)
                for new in untried.values():
                    new.add(b)
    return full + under


def plan(histogram: dict[int, int], size: int = SIZE) -> Counter[Bin]:
    return local_search(best_fit(histogram, size), size)


def layout(bins: Counter[Bin]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by rank: first rank of every run, first sequence of the run, offset in the sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for content in sorted(bins):
        offset = 0
        for length in content:
            runs.setdefault(length, []).append((ranks[length], sequence, offset))
            ranks[length] += bins[content]
            offset += length
        sequence += bins[content]
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


# --- Spark jobs --------------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, *, size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document's ids (PIECES, and with_ids the ids themselves as little-endian 32-bit bytes)."""

    def cut(part: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], [], []]
        for doc_id, x in zip(part.column("doc_id").to_pylist(), ids, strict=True):
            n = len(x) // 4
            cuts = [0, *range(n % size or size, n, size), n] if n > size else [0, n]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                own = x[4 * a : 4 * b]
                for col, value in zip(cols, (doc_id, k, a, b - a, zlib.crc32(own), own), strict=True):
                    col.append(value)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        keep = 6 if with_ids else 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:keep], types, strict=False)], names[:keep])

    return mapped(docs, cut, PIECES + ", ids binary" * with_ids, tokenizer)


def place(cut: DataFrame, *, size: int = SIZE, buckets: int | None = None) -> DataFrame:
    """Every row of a stored table of pieces, with its sequence_id and its offset there."""
    spark = cut.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [c for c in cut.columns if c != "ids"]
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    counts = stored(cut.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(layout(plan(histogram, size)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(*keys)
    ranked = cut.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["length", "_bucket"])
    ranked = ranked.select(*cut.columns[:-1], (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def put(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for k in np.unique(lengths):
            first, start, at = shared.value[int(k)]
            own = lengths == k
            run = np.searchsorted(first, ranks[own], side="right") - 1
            sequence[own] = start[run] + ranks[own] - first[run]
            offset[own] = at[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("_put", put("length", "_rank"))
    return placed.select(*cut.columns[:-1], "_put.sequence_id", "_put.offset")


def pack(docs: DataFrame, *, size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; with_ids also their ids, so that sorting by (sequence_id, offset) gives the sequences."""
    return place(stored(pieces(docs, size=size, tokenizer=tokenizer, with_ids=with_ids), "packing-pieces"), size=size)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and its ids (little-endian 32-bit), from pieces placed with their ids. A sequence is of bounded size."""
    by = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = placed.groupBy("sequence_id").agg(by.alias("p"))
    return rows.select("sequence_id", F.expr("aggregate(p, binary(''), (a, x) -> concat(a, x.ids))").alias("ids"))
