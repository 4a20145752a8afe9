"""The composite rating of a contact, from 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missivelake.config import DAY, DEFAULT, HOUR, MINUTE, Config


def _clamped(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _whole(x: Column) -> Column:
    return F.round(_clamped(x)).cast("int")


def evenness(a: Column, b: Column) -> Column:
    """1 for an even split, 0 for a one-sided one, 0.5 for none."""
    return F.when(a + b == 0, 0.5).otherwise(_clamped(F.least(a, b) / ((a + b) / 2), 0.0, 1.0))


def _both(name: str) -> tuple[Column, Column]:
    return F.col(f"my_{name}"), F.col(f"their_{name}")


def _mean_evenness(pairs: list[tuple[Column, Column]], least: int) -> Column:
    """Rounded mean evenness, out of 100, of the pairs whose sum is at least `least`; 50 if none is."""
    fits = [a + b >= least for a, b in pairs]
    total = sum((F.when(f, evenness(a, b)).otherwise(0.0) for f, (a, b) in zip(fits, pairs, strict=True)), F.lit(0.0))
    n = sum((f.cast("int") for f in fits), F.lit(0))
    return F.when(n == 0, 50).otherwise(_whole(100 * total / n))


# The bands, bounds and factors of the parts below, and the weights in Config.


def responsiveness(mine: Column, theirs: Column) -> Column:
    n = mine.isNotNull().cast("int") + theirs.isNotNull().cast("int")
    avg = F.floor((F.coalesce(mine, F.lit(0)) + F.coalesce(theirs, F.lit(0))) / F.greatest(n, F.lit(1)))
    score = (
        F.when(avg <= 0, 100.0)
        .when(avg <= 5 * MINUTE, 100 - avg / (5 * MINUTE) * 20)
        .when(avg <= HOUR, 80 - (avg - 5 * MINUTE) / (55 * MINUTE) * 30)
        .when(avg <= 6 * HOUR, 50 - (avg - HOUR) / (5 * HOUR) * 50)
        .otherwise(0.0)
    )
    return F.when(n == 0, 50).otherwise(F.floor(_clamped(score)).cast("int"))


def consistency(daily: DataFrame) -> DataFrame:
    """contact_id and how even the weekly counts are; silent weeks count, the first and last are scaled to seven days."""
    day = F.datediff(F.to_date("day"), F.to_date(F.lit("1970-01-01")))
    rows = daily.select("contact_id", day.alias("d"), (F.col("my_messages") + F.col("their_messages")).alias("n"))
    weeks = rows.withColumn("w", F.floor(F.col("d") / 7)).groupBy("contact_id", "w").agg(F.sum("n").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("days"))
    span = weeks.groupBy("contact_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("days").alias("days"), F.min("w").alias("first"), F.max("w").alias("last"))
    # Silent weeks add nothing to the sums but count among them, so they need no rows.
    scaled = F.col("n") * 7.0 / (F.least(7 * F.col("w") + 6, F.col("_hi")) - F.greatest(7 * F.col("w"), F.col("_lo")) + 1)
    ends = span.select("contact_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    sums = weeks.select("contact_id", "w", "n").join(ends, "contact_id").withColumn("_x", scaled).groupBy("contact_id").agg(F.sum("_x").alias("_sum"), F.sum(F.col("_x") * F.col("_x")).alias("_squares"))
    n = F.col("last") - F.col("first") + 1
    mean = F.col("_sum") / n
    cv = F.sqrt(F.greatest(F.col("_squares") / n - mean * mean, F.lit(0.0))) / mean
    score = F.when((F.col("days") < 7) | (n < 4) | (n > 5300), 50).when(mean <= 0, 0).otherwise(_whole((1 - cv / 2) * 100))
    return span.join(sums, "contact_id").select("contact_id", score.alias("consistency"))


def longevity(first_ms: Column, last_ms: Column) -> Column:
    days = (last_ms - first_ms) / F.lit(float(DAY))
    score = (
        F.when(days < 30, 10.0)
        .when(days < 180, 25.0)
        .when(days < 365, 25 + (days - 180) / 185 * 25)
        .when(days < 5 * 365, 50 + (days - 365) / (4 * 365) * 50)
        .otherwise(100.0)
    )
    return F.when((first_ms < 0) | (last_ms < 0) | (last_ms <= first_ms), 0).otherwise(_whole(score))


def rating(counts: DataFrame, pairs: DataFrame, responses: DataFrame, daily: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The seven components, their weighted overall score, its label and how far to trust it.

    responses: one row per contact with my_median_ms and their_median_ms (operators.responses.wide).
    """
    medians = responses.select("contact_id", F.col("my_median_ms").alias("_mine"), F.col("their_median_ms").alias("_theirs"))
    rows = counts.join(pairs, "contact_id").join(medians, "contact_id", "left").join(consistency(daily), "contact_id", "left")
    messages = F.col("my_messages") + F.col("their_messages")
    media = [sum((F.col(f"{side}_{c}") for c in ("image", "video", "audio", "gif")), F.lit(0)) for side in ("my", "their")]
    balance = 60 * evenness(*_both("messages")) + 40 * evenness(F.col("started_by_me"), F.col("started_by_them"))
    engagement = 0.7 * _clamped(3 * F.col("avg_length"), 0.0, 90.0) + 0.3 * F.when(messages > 0, _clamped(500 * (media[0] + media[1]) / messages)).otherwise(0.0)
    rows = rows.withColumns(
        {
            "responsiveness": responsiveness(F.col("_mine"), F.col("_theirs")),
            "balance": F.when(messages == 0, 50).otherwise(_whole(balance)),
            "engagement": _whole(engagement),
            "consistency": F.coalesce("consistency", F.lit(50)),
            "reciprocity": _mean_evenness([_both("question"), (media[0], media[1]), _both("encouragement")], 11),
            "longevity": longevity(F.col("first_ms"), F.col("last_ms")),
            "mutual_effort": _mean_evenness([_both("apology"), _both("encouragement"), _both("question")], 10),
        }
    )
    parts = ["responsiveness", "balance", "engagement", "consistency", "reciprocity", "longevity", "mutual_effort"]
    weights = [round(100 * w) for w in cfg.rating_weights]  # whole numbers, so that halves round as halves
    overall = _whole(sum((F.col(p) * w for p, w in zip(parts, weights, strict=True)), F.lit(0)) / sum(weights))
    trust = F.when(messages < 50, "hidden").when(messages <= 200, "limited").otherwise("full")
    return rows.select("contact_id", *parts, overall.alias("overall"), trust.alias("confidence"))
