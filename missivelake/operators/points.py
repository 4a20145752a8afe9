"""Points of messages, conversations, days and sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missivelake.config import DEFAULT, Config
from missivelake.functions import text as T
from missivelake.operators.messages import ME, THEM, local_day


def message_points(enriched: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """enriched with points: text features, attachments, and bonuses for starting and for answering within a minute."""
    body = F.col("body")
    kinds = F.transform("mime_types", T.media_category)
    worth = {"image": cfg.image_weight, "video": cfg.video_weight, "audio": cfg.audio_weight, "gif": cfg.gif_weight}
    media = sum((F.size(F.filter(kinds, _equals(c))) * w for c, w in worth.items()), F.lit(0.0))
    flag = lambda cond, w: F.when(cond, w).otherwise(0.0)
    rapid = F.col("is_flip") & ~F.col("new_conversation") & (F.col("gap_ms") <= cfg.rapid_response_ms)
    points = (
        F.lit(cfg.base_point)
        + cfg.word_log_weight * F.log(F.size(T.words(body)) + F.lit(1.0))
        + cfg.emoji_weight * F.size(T.emojis(body))
        + flag(T.is_question(body), cfg.question_weight)
        + flag(T.is_apology(body), cfg.apology_weight)
        + flag(T.is_encouragement(body), cfg.encouragement_weight)
        + flag(T.contains_link(body), cfg.link_weight)
        + media
        + flag(F.col("is_starter"), cfg.starter_weight)
        + flag(rapid, cfg.rapid_weight)
    )
    return enriched.withColumn("points", points)


def _equals(value: str):
    return lambda k: k == value


def daily_points(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    side = lambda who: F.sum(F.when(F.col("sender") == who, F.col("points")).otherwise(0.0))
    return points.groupBy("contact_id", local_day(F.col("timestamp_ms"), cfg).alias("day")).agg(side(ME).alias("my_points"), side(THEM).alias("their_points"))


def growth(daily: DataFrame) -> DataFrame:
    """Points so far, day by day."""
    w = Window.partitionBy("contact_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("contact_id", "day", F.sum("my_points").over(w).alias("my_total"), F.sum("their_points").over(w).alias("their_total"))
