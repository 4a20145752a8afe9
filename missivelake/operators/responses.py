"""Response times, first responses, double messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missivelake.config import DEFAULT, Config
from missivelake.operators.messages import ME, THEM, exact_median, local_timestamp


def responses(enriched: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row for each reply: sender, response_ms, bucket, is_rapid, is_overnight, is_first.

    A reply is a message after one of the other side within the longest response gap, also across conversations. It is
    a first response if it is its sender's first reply in a conversation that the other side started.
    """
    by = enriched.groupBy("contact_id", "conv_seq").agg(F.min_by("sender", F.struct("timestamp_ms", "rowid")).alias("started_by"))
    replies = enriched.where(F.col("is_flip") & (F.col("gap_ms") <= cfg.max_response_gap_ms)).join(by, ["contact_id", "conv_seq"])
    gap = F.col("gap_ms")
    hour = F.hour(local_timestamp(F.col("prev_ts"), cfg))
    start, end = cfg.overnight_hours
    asleep = (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)
    overnight = (gap >= cfg.overnight_force_gap_ms) | ((gap >= cfg.overnight_evening_gap_ms) & asleep)
    bucket = F.lit(len(cfg.histogram_edges_ms))
    for k in reversed(range(len(cfg.histogram_edges_ms))):
        bucket = F.when(gap < cfg.histogram_edges_ms[k], k).otherwise(bucket)
    w = Window.partitionBy("contact_id", "conv_seq", "sender").orderBy("timestamp_ms", "rowid")
    first = (F.col("started_by") != F.col("sender")) & (F.row_number().over(w) == 1)
    return replies.select(
        "contact_id", "rowid", "sender", gap.alias("response_ms"), bucket.alias("bucket"), (gap <= cfg.rapid_response_ms).alias("is_rapid"), overnight.alias("is_overnight"), first.alias("is_first")
    )


def response_stats(replies: DataFrame) -> DataFrame:
    """Per contact and side: replies, medians and means (whole milliseconds) of all and first replies, awake and overnight medians, rapid share."""
    key = ["contact_id", "sender"]
    first = F.when(F.col("is_first"), F.col("response_ms"))
    out = replies.groupBy(*key).agg(
        F.count("*").alias("n_replies"),
        F.expr("sum(response_ms) div count(*)").alias("mean_ms"),
        F.when(F.count(first) > 0, F.floor(F.sum(first) / F.greatest(F.count(first), F.lit(1)))).alias("mean_first_ms"),
        (F.sum(F.col("is_rapid").cast("long")) / F.count("*")).alias("rapid_share"),
    )
    # Every reply counts in the medians of all kinds that it is of; one pass gives them all.
    kinds = F.array(F.lit("all"), F.when(F.col("is_first"), "first"), F.when(F.col("is_overnight"), "overnight").otherwise("awake"))
    rows = replies.select(*key, "response_ms", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    medians = exact_median(rows, [*key, "kind"], "response_ms", "m")
    names = {"all": "median_ms", "first": "median_first_ms", "awake": "median_awake_ms", "overnight": "median_overnight_ms"}
    wide_medians = medians.groupBy(*key).agg(*[F.max(F.when(F.col("kind") == k, F.col("m"))).alias(n) for k, n in names.items()])
    return out.join(wide_medians, key)


def response_histogram(replies: DataFrame) -> DataFrame:
    return replies.groupBy("contact_id", "sender", "bucket").agg(F.count("*").alias("n"))


def double_messages(enriched: DataFrame) -> DataFrame:
    """Messages that follow one of the same side in the same conversation."""
    again = enriched.where(~F.col("is_flip") & ~F.col("new_conversation"))
    count = lambda who: F.sum((F.col("sender") == who).cast("long"))
    return again.groupBy("contact_id").agg(count(ME).alias("my_doubles"), count(THEM).alias("their_doubles"))


def wide(stats: DataFrame) -> DataFrame:
    """One row per contact with my_ and their_ columns of response_stats."""
    names = [c for c in stats.columns if c not in ("contact_id", "sender")]
    pick = lambda who, side: [F.max(F.when(F.col("sender") == who, F.col(c))).alias(f"{side}_{c}") for c in names]
    return stats.groupBy("contact_id").agg(*pick(ME, "my"), *pick(THEM, "their"))
