"""Keyword and vector search."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def padded(text: Column) -> Column:
    """Lower-cased runs of letters and digits, with their combining marks, two spaces apart and one at both ends."""
    runs = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", "  ")
    return F.concat(F.lit(" "), F.trim(runs), F.lit(" "))


def query_phrases(query: str) -> list[list[str]]:
    """Each white-space separated piece of a query is a phrase of its letters and digits; all phrases must occur."""
    word = lambda c: c.isalnum() or unicodedata.category(c).startswith("M")
    pieces = ("".join(c.lower() if word(c) else " " for c in piece).split() for piece in query.split())
    return [p for p in pieces if p]


def keyword_search(docs: DataFrame, query: str, key: str, column: str | list[str] = "text", limit: int | None = 20) -> DataFrame:
    """key and BM25 score of the documents that hold every phrase of the query, best first.

    A phrase may stand in any of the columns, not across them. Document frequencies and the mean length come from one
    aggregation over all documents.
    """
    phrases = query_phrases(query)
    if not phrases:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    # A text of tokens between doubled spaces lets a phrase be counted without overlap between neighbours.
    columns = [column] if isinstance(column, str) else column
    base = docs.select(key, *[padded(F.col(c)).alias(f"_t{i}") for i, c in enumerate(columns)])
    lengths = [F.when(F.col(f"_t{i}") == "  ", 0).otherwise(((F.length(f"_t{i}") - F.length(F.replace(F.col(f"_t{i}"), F.lit("  "), F.lit("")))) / 2).cast("int") + 1) for i in range(len(columns))]
    rows = base.select(key, reduce(lambda a, b: a + b, lengths).alias("_len"), F.concat_ws("|", *[f"_t{i}" for i in range(len(columns))]).alias("_p"))
    counts = {}
    for i, phrase in enumerate(phrases):
        needle = " " + "  ".join(phrase) + " "
        counts[f"_f{i}"] = ((F.length("_p") - F.length(F.replace(F.col("_p"), F.lit(needle), F.lit("")))) / len(needle)).cast("int")
    # Through a generator, so that filters on the counts aren't pushed to where they'd split the text again for each use.
    rows = rows.select(key, F.inline(F.array(F.struct("_len", *[c.alias(name) for name, c in counts.items()]))))
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((F.col(c) > 0).cast("long")).alias(f"_d{c}") for c in counts])
    hits = rows.where(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in counts])).join(F.broadcast(stats), F.lit(True))

    def term(c: str) -> Column:
        df, tf = F.col(f"_d{c}"), F.col(c)
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))

    score = reduce(lambda a, b: a + b, [term(c) for c in counts])
    found = hits.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key)
    return found.limit(limit) if limit else found


def message_search(messages: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """Messages (id and score) by keywords in their searchable text, which is in normal form, and their address."""
    return keyword_search(messages, unicodedata.normalize("NFKD", query), "id", ["body_searchable", "address"], limit)


def substring_search(messages: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Messages whose text or searchable text holds the needle, newest first: what to try when a keyword search finds nothing."""
    holds = [F.col(c).ilike(f"%{needle}%") for c in ("body", "body_searchable") if c in messages.columns]
    return messages.where(reduce(lambda a, b: a | b, holds)).orderBy(F.desc("timestamp_ms"), "rowid").limit(limit)


def find_messages(messages: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """id and score by keywords, best first; if they find nothing, messages that hold the query as it is, newest first, score null."""
    hits = message_search(messages, query, limit)
    some = hits.limit(1).agg(F.count("*").alias("_some"))
    other = substring_search(messages, query.strip(), limit).join(F.broadcast(some), F.col("_some") == 0)
    return hits.select("id", "score").unionByName(other.select("id", F.lit(None).cast("double").alias("score")))


def semantic_search(messages: DataFrame, embeddings: DataFrame, model_id: str, query: list[float], k: int) -> DataFrame:
    """The k messages whose vectors of one model are nearest to the query, with their texts; vectors without a message don't count."""
    own = embeddings.where(F.col("model_id") == model_id).join(messages.select(F.col("id").alias("_id")), F.col("message_id") == F.col("_id"), "left_semi")
    hits = vector_search(own, query, k, "message_id", "vector").select(F.col("message_id").alias("_hit"), "score")
    rows = messages.join(F.broadcast(hits), F.col("id") == F.col("_hit"))  # k rows
    return rows.select("id", "timestamp_ms", "address", "body", "score").orderBy(F.desc("score"), "id")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(F.transform(v, lambda x: x.cast("double")))


def vector_search(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows of highest cosine with the query; other lengths are skipped, a zero vector scores 0, a zero query finds nothing."""
    if k <= 0 or not any(query):
        return vectors.select(key, F.lit(0.0).alias("score")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(x * x for x in query) ** 0.5
    v = F.col(column)
    score = F.when(norm(v) > 0, dot(v, q) / (norm(v) * length)).otherwise(0.0)
    return vectors.where(F.size(v) == len(query)).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def frame_search(frames: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k attachments whose best frame is nearest to the query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(x * x for x in query) ** 0.5
    v = F.col("vector")
    score = F.when(norm(v) > 0, dot(v, q) / (norm(v) * (length or 1.0))).otherwise(0.0)
    rows = frames.where(F.size(v) == len(query)).groupBy("attachment_id").agg(F.round(F.max(score), 6).alias("score"))
    return rows.orderBy(F.desc("score"), "attachment_id").limit(k if any(query) else 0)
