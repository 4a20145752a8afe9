"""Conversations, their flow and their per-contact roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missivelake.config import DEFAULT, Config
from missivelake.operators.messages import ME, THEM


def conversations(enriched: DataFrame) -> DataFrame:
    """One row for each silence-bounded conversation, with the sum of points if the messages have them."""
    order = F.struct("timestamp_ms", "rowid")
    count = lambda who: F.sum((F.col("sender") == who).cast("long"))
    rows = enriched.groupBy("contact_id", "conv_seq").agg(
        F.min("timestamp_ms").alias("start_ms"),
        F.max("timestamp_ms").alias("end_ms"),
        F.min_by("sender", order).alias("started_by"),
        F.max_by("sender", order).alias("final_reply_by"),
        count(ME).alias("my_count"),
        count(THEM).alias("their_count"),
        F.count("*").alias("total_count"),
        *([F.sum("points").alias("points")] if "points" in enriched.columns else []),
    )
    missed = (F.col("my_count") == 0) | (F.col("their_count") == 0)
    return rows.withColumns(
        {
            "major_contributor": F.when(F.col("my_count") >= F.col("their_count"), ME).otherwise(THEM),
            "is_missed": missed,
            "missed_by": F.when(missed, F.lit(3) - F.col("started_by")),
        }
    )


def with_moments(convs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """convs with static and dynamic big-moment flags, the gap since the conversation before and its reconnect tier.

    Windows hold one contact's conversations, all in one shuffle. Silence of the timeout parts them, so that a contact has
    at most six a day of four hours' timeout, however many messages it has: their number is bounded by time.
    """
    contact = Window.partitionBy("contact_id")
    gap = F.col("reconnect_gap_ms")
    rows = convs.withColumn("reconnect_gap_ms", F.col("start_ms") - F.lag("end_ms").over(contact.orderBy("conv_seq")))
    positive = F.when(gap > 0, gap)
    ranks = {
        "_by_count": F.row_number().over(contact.orderBy("total_count")),
        "_n": F.count("*").over(contact),
        "_by_gap": F.row_number().over(contact.orderBy(positive.asc_nulls_last())),
        "_gaps": F.count(positive).over(contact),
    }
    place = F.least(F.floor(F.col("_n") * cfg.big_moment_percentile / 100), F.col("_n") - 1) + 1
    cuts = {
        "_cut": F.greatest(F.max(F.when(F.col("_by_count") == place, F.col("total_count"))).over(contact), F.lit(cfg.big_moment_floor)),
        "_median": F.max(F.when(F.col("_by_gap") == F.floor(F.col("_gaps") / 2) + 1, positive)).over(contact),
    }
    joined = rows.withColumns(ranks).withColumns(cuts)
    t1, t2, t3 = cfg.reconnect_ms
    tier = (
        F.when(gap.isNull(), 0)
        .when((gap >= t3) & (gap >= cfg.reconnect_median_factor * F.col("_median")), 4)
        .when(gap >= t3, 3)
        .when(gap >= t2, 2)
        .when(gap >= t1, 1)
        .otherwise(0)
    )
    flags = {
        "is_big_moment_static": F.col("total_count") >= cfg.big_moment_static,
        "is_big_moment_dynamic": F.col("total_count") >= F.col("_cut"),
        "reconnect_tier": tier,
    }
    return joined.withColumns(flags).drop(*ranks, *cuts)


def _steps() -> list[F.Column]:
    side = lambda column, prefix: F.when(F.col(column) == ME, f"{prefix}_me").otherwise(f"{prefix}_them")
    kind = F.when(F.col("is_missed"), "no_reply").when(F.col("is_big_moment_static") | F.col("is_big_moment_dynamic"), "big_moment").otherwise("everyday")
    return [side("started_by", "started"), kind, side("major_contributor", "contrib"), side("final_reply_by", "final")]


def flow_nodes(convs: DataFrame) -> DataFrame:
    """contact_id, column, node and how many conversations pass it; a missed one ends at its kind."""
    a, b, c, d = _steps()
    path = F.when(F.col("is_missed"), F.array(a, b)).otherwise(F.array(a, b, c, d))
    rows = convs.select("contact_id", F.posexplode(path).alias("flow_column", "node"))
    return rows.groupBy("contact_id", "flow_column", "node").agg(F.count("*").alias("n"))


def flow_links(convs: DataFrame) -> DataFrame:
    a, b, c, d = _steps()
    link = lambda x, y: F.struct(x.alias("source"), y.alias("target"))
    links = F.when(F.col("is_missed"), F.array(link(a, b))).otherwise(F.array(link(a, b), link(b, c), link(c, d)))
    rows = convs.select("contact_id", F.explode(links).alias("link")).select("contact_id", "link.source", "link.target")
    return rows.groupBy("contact_id", "source", "target").agg(F.count("*").alias("n"))


def pair_metrics(convs: DataFrame) -> DataFrame:
    """Per contact: started, closed and missed by side, reconnects by tier, lengths, points and who contributes more.

    convs need `points`: conversations of messages that have them.
    """
    count = lambda cond, name: F.sum(cond.cast("long")).alias(name)
    kept = ~F.col("is_missed")
    mine, theirs = F.sum("my_count"), F.sum("their_count")
    return convs.groupBy("contact_id").agg(
        F.count("*").alias("n_conversations"),
        count(F.col("started_by") == ME, "started_by_me"),
        count(F.col("started_by") == THEM, "started_by_them"),
        count(kept & (F.col("final_reply_by") == ME), "closed_by_me"),
        count(kept & (F.col("final_reply_by") == THEM), "closed_by_them"),
        count(F.coalesce(F.col("missed_by") == ME, F.lit(False)), "missed_by_me"),
        count(F.coalesce(F.col("missed_by") == THEM, F.lit(False)), "missed_by_them"),
        *[count(F.col("reconnect_tier") == k, f"reconnects_{k}") for k in (1, 2, 3, 4)],
        (F.sum("total_count") / F.count("*")).alias("avg_length"),
        F.percentile("total_count", 0.5).alias("median_length"),
        (F.sum("points") / F.count("*")).alias("avg_points"),
        F.when(mine > theirs, ME).when(theirs > mine, THEM).alias("top_contributor"),
        F.min("start_ms").alias("first_ms"),
        F.max("end_ms").alias("last_ms"),
    )
