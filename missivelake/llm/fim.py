"""Fill-in-middle transformation with a piecewise-linear learned rank index over unit boundaries.

A text's units are runs of ASCII letters and single other characters; its boundaries are the code point offsets before,
between and after them. ``RankIndex`` maps a boundary's rank to its offset: segments, grown as far as one line stays within
``error`` of every offset (a shrinking cone of slopes through the segment's first point), predict it, and a stored residual
of one byte corrects the prediction exactly. Slopes are fixed-point numbers, so predictions are whole numbers and the same
everywhere; segments end after 2^20 ranks, so rounding adds 2 at most to the error.

Two hashed ranks cut a text in prefix, middle and suffix, which are put out plain, as prefix-suffix-middle (psm) or as
suffix-prefix-middle (spm); ``restored`` rebuilds the text from an output and its form. One task handles a text at a time;
nothing is shuffled.

Defined results: a null text is an empty one, and an empty text is plain with no units; a text that contains a tag is plain,
so outputs can always be taken apart; a null doc_id is hashed as an empty number; rows that are repeated are transformed
each, alike if their doc_ids are; columns other than doc_id and text are ignored, whatever their names; an empty table
gives no rows. Memory for a text is some 40 bytes a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missivelake.llm.common import chunks, sha256_hex

TAGS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
#: Greatest distance of a segment's line from an offset, and the bits behind the point of its slope.
ERROR, SHIFT = 125, 20
LONGEST = 1 << SHIFT
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def boundaries(text: str) -> np.ndarray:
    """Offsets before, between and after the units of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.zeros(1, np.int64)
    letter = (codes | 32) - np.uint32(97) < 26
    inner = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], inner, [len(codes)]])


class RankIndex:
    """Exact offsets of ranks from segments (first rank, its offset, slope) and residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        firsts, slopes, at, n = [], [], 0, len(offsets)
        while at < n:
            low, high, end, width = -np.inf, np.inf, at + 1, 4096
            stop = min(n, at + LONGEST)
            while end < stop:
                part = offsets[end : min(stop, end + width)] - offsets[at]
                x = np.arange(end - at, end - at + len(part))
                lows = np.maximum.accumulate(np.maximum((part - error) / x, low))
                highs = np.minimum.accumulate(np.minimum((part + error) / x, high))
                fits = int(np.searchsorted(lows > highs, True))  # the cone never opens again
                if fits:
                    low, high = lows[fits - 1], highs[fits - 1]
                end += fits
                if fits < len(part):
                    break
                width *= 2
            firsts.append(at)
            slopes.append(0 if end == at + 1 else round((low + high) / 2 * (1 << SHIFT)))
            at = end
        self.firsts = np.array(firsts, np.int64)
        self.slopes = np.array(slopes, np.int64)
        self.bases = offsets[self.firsts]
        left = offsets - self.predicted(np.arange(n))
        self.residuals = left.astype(np.int8 if error + 2 < 128 else np.int64)

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.firsts, ranks, "right") - 1
        return self.bases[k] + ((self.slopes[k] * (ranks - self.firsts[k])) >> SHIFT)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        return self.predicted(ranks) + self.residuals[ranks]


def transform(docs: DataFrame, *, tags: tuple[str, str, str] = TAGS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, error: int = ERROR) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output of every row of docs (doc_id, text)."""
    before, between, after = tags

    def one(doc_id: int | None, text: str) -> tuple:
        index = RankIndex(boundaries(text), error)
        n = len(index.residuals) - 1
        digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
        if not text or any(t in text for t in tags) or h3 % 100 >= plain_from:
            return n, "plain", None, None, text
        a, b = index.offsets(np.sort(np.array([h1 % (n + 1), h2 % (n + 1)]))).tolist()
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_below:
            return n, "spm", a, b - a, f"{between}{suffix}{before}{prefix}{after}{middle}"
        return n, "psm", a, b - a, f"{before}{prefix}{between}{suffix}{after}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for part in chunks(batch):
                found = [one(i, t or "") for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                cols = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)] if found else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], [x.split()[0] for x in OUT.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, OUT)


def restored(output: Column, form: Column, tags: tuple[str, str, str] = TAGS) -> Column:
    """The text that an output was made of."""
    pieces = F.split(output, "|".join(rf"\Q{t}\E" for t in tags), -1)
    piece = lambda k: F.get(pieces, k)
    psm, spm = F.concat(piece(1), piece(3), piece(2)), F.concat(piece(2), piece(3), piece(1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def report(docs: DataFrame) -> DataFrame:
    """transform with digests of every output and of the text that is rebuilt from it."""
    rows = transform(docs)
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_hex(F.col("output")).alias("output_sha256"), sha256_hex(back).alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w,
    list_transform([1, 9, 17, 25], lambda s: list_reduce(list_transform(range(0, 8), lambda k: (instr('0123456789abcdef', substr(h, s + k, 1)) - 1)::BIGINT), lambda x, y: 16 * x + y)) AS r FROM d),
c AS (SELECT *, len(w) AS n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS a, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS b FROM u),
p AS (
  SELECT doc_id, text, n, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
