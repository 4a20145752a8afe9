"""Counts, daily and hourly activity, streaks and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missivelake.config import DEFAULT, Config
from missivelake.functions import text as T
from missivelake.operators.messages import local_day, local_timestamp, sides

CATEGORIES = ("image", "video", "audio", "gif")


def _media(category: str | None = None) -> Column:
    kinds = F.transform("mime_types", T.media_category)
    return F.size(F.filter(kinds, lambda k: k == category if category else k.isin(*CATEGORIES)))


def contact_counts(messages: DataFrame) -> DataFrame:
    """Per contact and side: messages, words, characters, distinct words, media, kinds of messages and emoji."""
    body = F.col("body")
    tests = {"link": T.contains_link, "laugh": T.is_laugh, "apology": T.is_apology, "question": T.is_question, "encouragement": T.is_encouragement}
    one = F.lit(1)
    features = messages.withColumns({"_words": F.size(T.words(body)), "_emojis": F.size(T.emojis(body)), **{f"_{c}": _media(c) for c in CATEGORIES}})
    tallies = [
        *sides(None, one, "messages"),
        *sides(None, F.col("_words"), "words"),
        *sides(None, F.char_length("body"), "chars"),
        *sides(None, F.col("_emojis"), "emojis"),
        *[x for c in CATEGORIES for x in sides(None, F.col(f"_{c}"), c)],
        *[x for name, test in tests.items() for x in sides(test(body), one, name)],
    ]
    counts = features.groupBy("contact_id").agg(*tallies)
    # Distinct words by a two-step count: first one row for each (contact, side, word), then their number.
    words = messages.select("contact_id", "sender", F.explode(T.words(F.lower(body))).alias("word")).groupBy("contact_id", "sender", "word").agg(F.count("*"))
    unique = words.groupBy("contact_id").agg(*sides(None, one, "unique_words"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("my_unique_words", "their_unique_words")}
    return counts.join(unique, "contact_id", "left").withColumns(zero)


def word_sketches(messages: DataFrame, cfg: Config = DEFAULT, log_k: int = 13) -> DataFrame:
    """Per contact, side and day a sketch of its distinct lower-cased words, of 2^log_k bytes at most (error about 1.04 / 2^(log_k / 2))."""
    rows = messages.select("contact_id", "sender", local_day(F.col("timestamp_ms"), cfg).alias("day"), F.explode(T.words(F.lower("body"))).alias("word"))
    return rows.groupBy("contact_id", "sender", "day").agg(F.hll_sketch_agg("word", log_k).alias("words"))


def approximate_words(sketches: DataFrame, *keys: str) -> DataFrame:
    """keys and the estimated number of distinct words of all their sketches, whichever days or batches these are of."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("words")).alias("unique_words"))


def top_emojis(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The most used emoji of each contact and side, ties by the emoji's bytes."""
    counts = messages.select("contact_id", "sender", F.explode(T.emojis(F.col("body"))).alias("emoji")).groupBy("contact_id", "sender", "emoji").agg(F.count("*").alias("n"))
    w = Window.partitionBy("contact_id", "sender").orderBy(F.desc("n"), "emoji")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.top_emojis)


def daily_activity(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    rows = messages.select("contact_id", "sender", local_day(F.col("timestamp_ms"), cfg).alias("day"), F.size(T.words(F.col("body"))).alias("_words"), _media().alias("_media"))
    one = F.lit(1)
    return rows.groupBy("contact_id", "day").agg(*sides(None, one, "messages"), *sides(None, F.col("_words"), "words"), *sides(None, F.col("_media"), "media"))


def hourly_activity(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Messages by local weekday (Sunday is 0) and hour."""
    at = local_timestamp(F.col("timestamp_ms"), cfg)
    return messages.groupBy("contact_id", (F.dayofweek(at) - 1).alias("weekday"), F.hour(at).alias("hour")).agg(F.count("*").alias("n"))


def heatmap_days(daily: DataFrame, limit: int = 500) -> DataFrame:
    """The last active days of each contact with their share of its busiest day."""
    n = F.col("my_messages") + F.col("their_messages")
    w = Window.partitionBy("contact_id")
    recent = daily.withColumns({"n": n, "_r": F.row_number().over(w.orderBy(F.desc("day")))}).where((F.col("_r") <= limit) & (F.col("n") > 0))
    return recent.select("contact_id", "day", "n", (F.col("n") / F.max("n").over(w)).alias("intensity"))


def heatmap_hours(hourly: DataFrame) -> DataFrame:
    """All 7 x 24 cells of each contact, zero where nothing was sent, with their share of its busiest cell."""
    most = hourly.groupBy("contact_id").agg(F.max("n").alias("_most"))
    grid = most.select("contact_id", "_most", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday")).select("contact_id", "_most", "weekday", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    joined = grid.join(hourly, ["contact_id", "weekday", "hour"], "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("contact_id", "weekday", "hour", n.alias("n"), (n / F.col("_most")).alias("intensity"))


def streaks(daily: DataFrame, as_of: str) -> DataFrame:
    """Longest and current runs of active and of silent days, up to as_of or the last active day if later."""
    active = daily.where(F.col("my_messages") + F.col("their_messages") > 0).select("contact_id", F.to_date("day").alias("d")).distinct()
    w = Window.partitionBy("contact_id").orderBy("d")
    runs = active.withColumn("_run", F.date_sub("d", F.row_number().over(w))).withColumn("_gap", F.datediff("d", F.lag("d").over(w)) - 1)
    lengths = runs.groupBy("contact_id", "_run").agg(F.count("*").alias("n"), F.max("d").alias("last"), F.max("_gap").alias("gap"))
    end = F.greatest(F.max("last"), F.to_date(F.lit(as_of)))
    out = lengths.groupBy("contact_id").agg(
        F.max("n").alias("longest_active"),
        F.max_by("n", "last").alias("_final"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("_gap"),
        F.datediff(end, F.max("last")).alias("current_silent"),
    )
    current = F.when(F.col("current_silent") == 0, F.col("_final")).otherwise(F.lit(0).cast("long"))
    longest = F.greatest("_gap", "current_silent")
    return out.select("contact_id", "longest_active", longest.cast("long").alias("longest_silent"), current.alias("current_active"), F.col("current_silent").cast("long").alias("current_silent"))


def timeline(messages: DataFrame, unit: str = "week", address_like: str | None = None) -> DataFrame:
    """Messages by time bucket, of the addresses that match if a pattern is given."""
    rows = messages.where(F.col("address").ilike(T.like_pattern(address_like))) if address_like else messages
    bucket = F.date_format(F.date_trunc(unit, F.timestamp_millis("timestamp_ms")), "yyyy-MM-dd")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def writing_totals(counts: DataFrame, book_chars: int = 440_000) -> DataFrame:
    """Characters and words written by both, and how many books of book_chars characters they fill."""
    chars = F.col("my_chars") + F.col("their_chars")
    return counts.select("contact_id", chars.alias("chars"), (F.col("my_words") + F.col("their_words")).alias("words"), (chars / book_chars).alias("books"))


