"""Benchmark decontamination by a prefix-filtered containment join.

Every benchmark item is cut into windows of ``window`` consecutive words (an item of fewer words, but not none, is one
window). A window must be contained whole, so the necessary prefix of its tokens, taken in ascending order of their
document frequency over *all* documents, is its single rarest token. Documents are joined on those prefix tokens; the
token's place in the window gives the only start at which the window can stand (positional bound), which must leave
room for all of its words (length bound), and the words there must equal the window's (exact verification).

The item side is read in blocks of at most ``block_words`` windows, each broadcast on its own, so what is broadcast has a
fixed bound however many or long the items are; the documents are never shuffled.

Defined results: a null or empty text has no words, hits or items; an item without words or without an id has no
window; repeated items count once per id; repeated document rows are judged each on its own; extra columns of either
table are ignored by ``contamination`` and carried untouched by ``drop_contaminated``.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missivelake.llm.common import chunks, stored, texts, words_of

WINDOW = 13
BLOCK_WORDS = 1_000_000
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20

FOUND, SPANS = "_found_items", "_found_spans"
REPORT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
)


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    size = min(window, len(words))
    return (tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size)


def _blocks(items: DataFrame, window: int, block_words: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """Windows with the ids of the items they belong to, block_words of them at a time; an item may go on in the next block."""
    block: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    total = 0
    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null")
    for item, text in rows.toLocalIterator():
        for w in windows_of(words_of((text or "").encode()), window):
            block[w].add(item)
            total += 1
            if total >= block_words:
                yield dict(block)
                block, total = defaultdict(set), 0
    if block:
        yield dict(block)


def document_frequency(docs: DataFrame, vocabulary: Broadcast) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary occurs, over all documents. Bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for part in chunks(batch):
                for text in texts(part):
                    found.update(vocabulary.value.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def _prefix_index(block: dict[tuple[bytes, ...], set[str]], frequency: dict[bytes, int]) -> tuple[dict, dict]:
    """Prefix token -> the (place in the window, window length) pairs to try; window -> item ids."""
    places: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
    for w in block:
        at = min(range(len(w)), key=lambda i: (frequency.get(w[i], 0), w[i], i))
        places[w[at]].add((at, len(w)))
    return {k: sorted(v) for k, v in places.items()}, {b" ".join(w): sorted(ids) for w, ids in block.items()}


def _matches(words: list[bytes], places: dict, windows: dict) -> tuple[set[tuple[int, int]], set[str]]:
    """Spans (start, length) of words that equal a window, and the items these windows belong to."""
    spans: set[tuple[int, int]] = set()
    items: set[str] = set()
    if places.keys().isdisjoint(words):
        return spans, items
    for i in [i for i, w in enumerate(words) if w in places]:
        for at, size in places[words[i]]:
            start = i - at
            if start >= 0 and start + size <= len(words):
                ids = windows.get(b" ".join(words[start : start + size]))
                if ids is not None:
                    spans.add((start, size))
                    items.update(ids)
    return spans, items


def _covered(spans: set[tuple[int, int]]) -> int:
    covered = end = 0
    for start, size in sorted(spans):
        covered += max(0, start + size - max(start, end))
        end = max(end, start + size)
    return covered


def _joined(docs: DataFrame, items: DataFrame, window: int, block_words: int) -> tuple[DataFrame, Callable]:
    """The documents with what every block but the last found in them, and how to judge one with the last block.

    Blocks run one after another, each over the stored outcome of those before it, so a task holds one block at a time.
    """
    sc = docs.sparkSession.sparkContext
    state = docs.withColumns({FOUND: F.array().cast("array<string>"), SPANS: F.array().cast("array<long>")})
    last = sc.broadcast(({}, {}))
    for k, block in enumerate(_blocks(items, window, block_words)):
        if k:
            state = stored(state.mapInArrow(_noting(last), state.schema), "decontamination")
        vocabulary = sc.broadcast({x for w in block for x in w})
        last = sc.broadcast(_prefix_index(block, document_frequency(docs, vocabulary)))
        vocabulary.unpersist()
    return state, _judging(last)


def _judging(index: Broadcast) -> Callable:
    def judge(part: pa.RecordBatch) -> list[tuple[int, set[tuple[int, int]], set[str]]]:
        rows = []
        for text, flat, before in zip(texts(part), part.columns[-1].to_pylist(), part.columns[-2].to_pylist(), strict=True):
            words = words_of(text)
            spans, found = _matches(words, *index.value)
            spans.update(zip(flat[::2], flat[1::2], strict=True))
            found.update(before)
            rows.append((len(words), spans, found))
        return rows

    return judge


def _noting(index: Broadcast) -> Callable:
    judge = _judging(index)

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = judge(part)
                found = pa.array([sorted(f) for _, _, f in rows], pa.list_(pa.string()))
                spans = pa.array([[x for span in sorted(s) for x in span] for _, s, _ in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], found, spans], part.schema.names)

    return note


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document with its words, hit words and the items whose windows occur in it (see REPORT)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    state, judge = _joined(rows, items, window, block_words)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = [(n, _covered(spans), sorted(found)) for n, spans, found in judge(part)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([n for n, _, _ in rows], pa.int64()),
                        pa.array([hit for _, hit, _ in rows], pa.int64()),
                        pa.array([len(found) for _, _, found in rows], pa.int64()),
                        pa.array([hashlib.sha256(",".join(found).encode()).hexdigest() for _, _, found in rows], pa.string()),
                        pa.array([contaminated(n, hit) for n, hit, _ in rows], pa.bool_()),
                        pa.array([found for _, _, found in rows], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
                )

    return state.mapInArrow(report, REPORT)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    names = docs.columns
    # Columns go by their places, so that no name is in the way.
    state, judge = _joined(docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(names)]), items, window, block_words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                kept = pa.array([not contaminated(n, _covered(spans)) for n, spans, _ in judge(part)], pa.bool_())
                yield pa.RecordBatch.from_arrays(part.columns[: len(names)], names).filter(kept)

    return state.mapInArrow(keep, docs.schema)


#: Fixed words per window as in the query; slices of each occurring item length are compared with the windows.
ORACLE_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
item AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
  FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
cut AS (
  SELECT r, size, s, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM doc, sizes, unnest(range(1, len(w) - size + 2)) AS u(s)),
hit AS (SELECT r, cut.size, s, item_id FROM cut JOIN win USING (size, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + size)) AS u(p) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
