"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line (its white space trimmed at both ends) is dropped if an earlier line, in the order of (doc_id, text hash,
position), equals it or, for lines of at least ``near_chars`` characters each, is within one edit of it; so the earliest
always stays, and whether a line goes does not depend on what else goes. The edit bound thus is none for short lines, in
which one edit makes another word, and one for others. Blank lines are no lines and stay.

1. Equal lines become one by two 64-bit hashes, with their earliest place.
2. Pigeonhole filter: one edit touches one third of a line and leaves the other two as they are. Lines of neighbouring
   lengths that share no two thirds with another cannot be near one, and go no further.
3. The rest emit every variant with one character deleted, as a hash of what stands before and after the gap, and
   themselves whole, as a hash of what stands before and after each place. Two lines that share a variant differ by one
   substitution; a line whose variant is another whole line is one insertion away from it. Both halves' hashes come from
   chunks of CHUNK characters, so that a variant costs the same in a line of any length. Lines meet in one shuffle on the
   variant's hash; lines of one variant differ in one character only, so groups are bounded, and no pairs are listed:
   each line looks at the earliest of its group and at the whole line.
4. A pair found is verified before the later line goes: the lines themselves must agree before and after the gap, which
   is an edit distance of one, in time proportional to their length.
5. Each document keeps, in place, its blank lines and those that are the earliest of their kind.

Defined results: a null text stays null, an empty text stays empty; rows of equal doc_id and text count as one document
and are treated alike; null ids come first; carriage returns and tabs at line ends do not distinguish lines; lines of
any length are compared whole; extra columns are carried by ``drop_repeated_lines`` and ignored by ``report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missivelake.llm.common import carried, stored, unused

#: Least length of lines that are compared within one edit; shorter ones are compared for equality.
NEAR_CHARS = 20
BLANKS = " \t\r"
CHUNK = 64
#: Lines to look at again are broadcast up to this many (some 100 bytes each), else joined by a shuffle.
BROADCAST_LINES = 200_000


def _line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, pos and line of every line, blank ones too."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    return rows.select("doc_id", "text_key", "pos", F.btrim("raw", F.lit(BLANKS)).alias("line"))


def _thirds(line: Column, size: Column) -> Column:
    """Hashes of what one edit in each third would leave, for pairs whose longer line has this size, or one more."""
    keys = []
    for longer in (size, size + 1):
        a, b = F.floor(longer / 3).cast("int"), F.floor(2 * longer / 3).cast("int")
        left = lambda n: F.substring(line, F.lit(1), n)
        keys += [
            F.xxhash64(longer, F.lit(0), left(b)),
            F.xxhash64(longer, F.lit(1), left(a), F.right(line, longer - b)),
            F.xxhash64(longer, F.lit(2), F.right(line, longer - a)),
        ]
    return F.array(*keys)


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_LINES else df


def kept_lines(docs: DataFrame, near_chars: int) -> DataFrame:
    """doc_id, text_key and the positions of the lines, blank ones aside, that stay, in order."""
    size = F.char_length("line")
    occurrences = _lines(docs).where(size > 0)
    place = F.struct("doc_id", "text_key", "pos")
    thirds = F.when(size >= near_chars, _thirds(F.col("line"), size))
    keyed = occurrences.select(place.alias("first"), *_line_hashes(F.col("line")), thirds.alias("thirds"))
    distinct = keyed.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.any_value("thirds").alias("thirds"))
    distinct = stored(distinct, "lines")

    thirds = distinct.select("h1", "h2", F.explode("thirds").alias("key"))
    shared = thirds.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
    near = stored(thirds.join(shared, "key").select("h1", "h2").distinct(), "lines-near")
    n = near.count()
    if n:
        gone = _dominated(docs, distinct, near, n)
        distinct = distinct.join(_small(gone, gone.count()), ["h1", "h2"], "left_anti")
    return distinct.select("first.*").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("pos")).alias("kept"))


def _chunked(line: Column) -> Column:
    """A line's chunks of CHUNK characters, and for each the hash of all chunks before it."""
    chunks = F.regexp_extract_all(line, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    start = F.array(F.lit(0).cast("long"))
    before = F.aggregate(chunks, start, lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), x))))
    return F.struct(chunks.alias("chunks"), before.alias("before"))


def _head(chunked: Column, n: Column) -> Column:
    """Hash of a line's first n characters."""
    at = F.floor(n / CHUNK).cast("int")
    rest = F.substr(F.get(chunked["chunks"], at), F.lit(1), n % CHUNK)
    return F.xxhash64(F.get(chunked["before"], at), F.coalesce(rest, F.lit("")))


def _dominated(docs: DataFrame, distinct: DataFrame, near: DataFrame, n: int) -> DataFrame:
    """h1 and h2 of the lines that an earlier line is within one edit of."""
    firsts = distinct.select("h1", "h2", "first").join(_small(near, n), ["h1", "h2"])
    wanted = firsts.select("h1", "h2", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"), F.col("first.pos").alias("_pos"), "first")
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")) & (F.col("pos") == F.col("_pos"))
    lines = _lines(docs).join(_small(wanted, n), here).select("h1", "h2", "first", "line").dropDuplicates(["h1", "h2"])
    lines = stored(lines, "lines-texts").withColumn("size", F.char_length("line"))

    # A variant is known by how much stands before and after the gap, and the hashes of both.
    chunked = lines.select(F.struct("first", "h1", "h2").alias("me"), "size", _chunked(F.col("line")).alias("ahead"), _chunked(F.reverse("line")).alias("behind"))

    def variants(i: Column) -> Column:
        """With i characters before the gap: the line whole, and without the next character."""
        left, after = _head(F.col("ahead"), i), F.col("size") - i
        whole = F.xxhash64(i, after, left, _head(F.col("behind"), after))
        return F.when(after > 0, F.array(whole, F.xxhash64(i, after - 1, left, _head(F.col("behind"), after - 1)))).otherwise(F.array(whole))

    keys = F.transform(F.sequence(F.lit(0), F.col("size")), variants)
    rows = chunked.select("me", F.posexplode(keys).alias("i", "v")).select("me", "i", F.posexplode("v").alias("gone", "variant"))
    group = Window.partitionBy("variant")
    earliest = F.min(F.when(F.col("gone") == 1, F.col("me"))).over(group)
    full = F.min(F.when(F.col("gone") == 0, F.col("me"))).over(group)
    rows = rows.withColumns({"_earliest": earliest, "_full": full}).where("gone = 1")
    found = rows.select("me", "i", F.explode(F.array("_earliest", "_full")).alias("other")).where("me.first <> other.first")
    later, earlier = F.greatest("me", "other"), F.least("me", "other")
    found = found.groupBy(later.alias("later"), earlier.alias("earlier")).agg(F.min("i").alias("i"))
    a = lines.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("a"), F.col("size").alias("na"))
    b = lines.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("b"), F.col("size").alias("nb"))
    texts = found.join(a, (F.col("later.h1") == F.col("a1")) & (F.col("later.h2") == F.col("a2")))
    texts = texts.join(b, (F.col("earlier.h1") == F.col("b1")) & (F.col("earlier.h2") == F.col("b2")))
    # One edit apart: equal before the gap and after it, which is one character wide in the longer line, or in both.
    rest = lambda line, n, other: F.right(line, F.col(n) - F.col("i") - (F.col(n) >= F.col(other)).cast("int"))
    near = (F.left("a", "i") == F.left("b", "i")) & (rest("a", "na", "nb") == rest("b", "nb", "na"))
    return stored(texts.where(near).select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).distinct(), "lines-gone")


def _cleaned(docs: DataFrame, near_chars: int, left: str) -> DataFrame:
    """docs with a column of this name, the lines of the text that stay, in place; null for a null text."""
    doc, key, kept = unused(docs, "_id", "_key", "_kept")
    found = kept_lines(docs, near_chars).withColumnsRenamed({"doc_id": doc, "text_key": key, "kept": kept})
    text = F.col("text").cast("string")
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(key)), "left")
    # Whether each line stays, as a list beside the lines: a run of those that go before each one that stays.
    gap = lambda p, i: p - F.coalesce(F.get(F.col(kept), i - 1), F.lit(-1)) - 1
    stays = F.flatten(F.transform(F.col(kept), lambda p, i: F.concat(F.array_repeat(F.lit(False), gap(p, i)), F.array(F.lit(True)))))
    lines = F.arrays_zip(F.split(text, "\n").alias("line"), F.coalesce(stays, F.array().cast("array<boolean>")).alias("stays"))
    fits = lambda x: (F.btrim(x["line"], F.lit(BLANKS)) == "") | F.coalesce(x["stays"], F.lit(False))
    return joined.withColumn(left, F.transform(F.filter(lines, fits), lambda x: x["line"])).drop(doc, key, kept)


def _line_count(text: Column) -> Column:
    return (F.coalesce(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))).cast("long")


def report(docs: DataFrame, *, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, for every row of docs."""
    rows = _cleaned(docs.select("doc_id", F.col("text").cast("string").alias("text")), near_chars, "_left")
    n = _line_count(F.col("text"))
    left = F.when(F.col("_left").isNull(), 0).otherwise(F.size("_left")).cast("long")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_lines"), (n - left).alias("n_removed"), F.array_join("_left", "\n").alias("text"))


def drop_repeated_lines(docs: DataFrame, *, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with the text that is left and all other columns; documents of which repeated lines leave nothing are gone."""
    left, n = unused(docs, "_left", "_n")
    rows = _cleaned(docs, near_chars, left).withColumns({n: _line_count(F.col("text").cast("string")), "text": F.array_join(left, "\n")})
    emptied = (F.size(left) < F.col(n)) & (F.btrim("text", F.lit(BLANKS + "\n")) == "")
    rows = rows.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*carried(docs))


ORACLE_SQL = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS w FROM documents),
line AS (
  SELECT r, doc_id, p, trim(w[p], ' ' || chr(9) || chr(13)) AS line
  FROM doc, unnest(range(1, len(w) + 1)) AS u(p)),
long AS (SELECT *, length(line) AS size, row_number() OVER (ORDER BY doc_id, p) AS place FROM line WHERE line <> ''),
firsts AS (SELECT line, any_value(size) AS size, min(place) AS place FROM long GROUP BY line),
sides AS (SELECT line, place, size, unnest([size, size + 1]) AS longer FROM firsts WHERE size >= 20),
halves AS (
  SELECT line, place, longer, unnest([
    '<' || substr(line, 1, ((longer - 1) // 2)::INTEGER),
    '>' || right(line, (longer - 1 - (longer - 1) // 2)::INTEGER)]) AS half FROM sides),
gone AS (
  SELECT DISTINCT a.line FROM halves a JOIN halves b ON a.longer = b.longer AND a.half = b.half AND b.place < a.place
  WHERE levenshtein(a.line, b.line) <= 1),
stay AS (SELECT f.place FROM firsts f ANTI JOIN gone USING (line)),
kept AS (
  SELECT r, p FROM line WHERE line = ''
  UNION ALL SELECT r, p FROM long JOIN stay USING (place)),
text AS (SELECT r, string_agg(w[p], chr(10) ORDER BY p) AS text, count(*) AS n FROM kept JOIN doc USING (r) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_lines, (coalesce(len(w), 0) - coalesce(n, 0))::BIGINT AS n_removed,
  CASE WHEN w IS NOT NULL THEN coalesce(text, '') END AS text
FROM doc LEFT JOIN text USING (r)
"""
