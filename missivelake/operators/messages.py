"""Messages of contacts, with their conversation and response flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missivelake.config import DAY, DEFAULT, Config

ME, THEM = 1, 2


def contact_messages(messages: DataFrame, addresses: DataFrame) -> DataFrame:
    """contact_id, rowid, timestamp_ms, sender, body, mime_types of all one-to-one messages of known direction.

    messages: rowid, timestamp_ms, address, direction, body, mime_types. An address of two contacts gives both a row.
    """
    known = messages.where(F.col("direction").isin(1, 2) & ~F.contains("address", F.lit("~")))
    sender = F.when(F.col("direction") == 2, ME).otherwise(THEM)
    return known.join(addresses.select("contact_id", "address"), "address").select("contact_id", "rowid", "timestamp_ms", sender.alias("sender"), "body", "mime_types")


def with_mime_types(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """messages (id) with mime_types, the list of their attachments' types."""
    types = attachments.groupBy("message_id").agg(F.array_sort(F.collect_list("mime_type")).alias("mime_types"))
    joined = messages.join(types, messages["id"] == types["message_id"], "left").drop(types["message_id"])
    return joined.withColumn("mime_types", F.coalesce("mime_types", F.array().cast("array<string>")))


def enriched(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """messages with prev_ts, prev_sender, gap_ms, new_conversation, conv_seq (from 1), is_flip and is_starter.

    Order is (timestamp_ms, rowid) within a contact. Windows run within a contact's day only; what crosses midnight
    (the last message of the day before, the conversations so far) comes from one table of a row for each contact and day,
    so that a contact with any share of all messages is still spread over tasks. Messages are shuffled once.
    """
    m = messages.withColumn("_day", F.floor(F.col("timestamp_ms") / DAY))
    within = Window.partitionBy("contact_id", "_day").orderBy("timestamp_ms", "rowid")
    m = m.withColumns({"_ts": F.lag("timestamp_ms").over(within), "_sender": F.lag("sender").over(within)})
    # A day's first and last message, and the conversations that begin within it after the first.
    begins = F.coalesce(F.col("timestamp_ms") - F.col("_ts") > cfg.conversation_timeout_ms, F.lit(False)).cast("long")
    last = F.max_by(F.struct("timestamp_ms", "sender"), F.struct("timestamp_ms", "rowid"))
    days = m.groupBy("contact_id", "_day").agg(F.sum(begins).alias("_n"), F.min("timestamp_ms").alias("_first"), last.alias("_last"))
    w = Window.partitionBy("contact_id").orderBy("_day")
    days = days.withColumn("_before", F.lag("_last").over(w))
    fresh = F.coalesce(F.col("_first") - F.col("_before.timestamp_ms") > cfg.conversation_timeout_ms, F.lit(True)).cast("long")
    so_far = F.coalesce(F.sum(F.col("_n") + fresh).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.join(days.select("contact_id", "_day", "_before", so_far.alias("_so_far")), ["contact_id", "_day"])
    m = m.withColumns({"prev_ts": F.coalesce("_ts", "_before.timestamp_ms"), "prev_sender": F.coalesce("_sender", "_before.sender")})
    m = m.withColumn("gap_ms", F.col("timestamp_ms") - F.col("prev_ts"))
    m = m.withColumn("new_conversation", F.coalesce(F.col("gap_ms") > cfg.conversation_timeout_ms, F.lit(True)))
    running = F.sum(F.col("new_conversation").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0))
    flags = {
        "conv_seq": F.col("_so_far") + running,
        "is_flip": F.coalesce(F.col("sender") != F.col("prev_sender"), F.lit(False)),
        "is_starter": F.col("new_conversation"),
    }
    return m.withColumns(flags).drop("_day", "_ts", "_sender", "_before", "_so_far")


def local_timestamp(ms: Column, cfg: Config = DEFAULT) -> Column:
    """The local wall clock as a timestamp of a UTC session."""
    return F.timestamp_millis(ms + cfg.tz_offset_secs * 1000)


def local_day(ms: Column, cfg: Config = DEFAULT) -> Column:
    return F.date_format(local_timestamp(ms, cfg), "yyyy-MM-dd")


def sides(condition: Column | None, value: Column, name: str) -> list[Column]:
    """Sums of value over my and over their messages, as my_<name> and their_<name>."""
    out = []
    for who, side in ((ME, "my"), (THEM, "their")):
        mine = F.col("sender") == who
        out.append(F.sum(F.when(mine if condition is None else mine & condition, value).otherwise(0)).cast("long").alias(f"{side}_{name}"))
    return out


#: Bits of a value that each step of a selection tells apart.
STEP = 12


def selected(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """keys and, by name, the values at places (1-based, computed from `_n`, the group's size) of each group's sorted values.

    A selection by steps in which no task holds a group's values, though all of them may differ. Values are counted by their leading bits (all but 2 * STEP), by all but STEP, and whole. Of a group's leading counts, one row
    for each 2^24 of the range, the one with a wanted place is found, and the place within it is carried on to the
    2^STEP counts below, and from there to the 2^STEP values below that. Windows run over these bounded counts only.
    """
    high, low = f"_{value}_h", f"_{value}_m"
    whole = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    middle = whole.groupBy(*keys, F.shiftright(value, STEP).alias(low)).agg(F.sum("_c").alias("_c"))
    top = middle.groupBy(*keys, F.shiftright(low, STEP).alias(high)).agg(F.sum("_c").alias("_c"))

    def found(counts: DataFrame, within: list[str], bucket: str, wanted: Column) -> DataFrame:
        """The rows of counts that hold a wanted place, with the place that is left in them as `_place`."""
        w = Window.partitionBy(*within).orderBy(bucket)
        upto = counts.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        rest = wanted - (F.col("_upto") - F.col("_c"))
        return upto.withColumn("_place", rest).where((F.col("_place") > 0) & (F.col("_place") <= F.col("_c")))

    w = Window.partitionBy(*keys)
    top = top.withColumn("_n", F.sum("_c").over(w))
    named = top.select("*", F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), place.cast("long").alias("_wanted")) for name, place in places.items()])))
    first = found(named, [*keys, "_name"], high, F.col("_wanted")).select(*keys, "_name", high, F.col("_place").alias("_wanted"))
    second = middle.withColumn(high, F.shiftright(low, STEP)).join(first, [*keys, high])
    second = found(second, [*keys, "_name"], low, F.col("_wanted")).select(*keys, "_name", low, F.col("_place").alias("_wanted"))
    third = whole.withColumn(low, F.shiftright(value, STEP)).join(second, [*keys, low])
    third = found(third, [*keys, "_name"], value, F.col("_wanted"))
    return third.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in places])


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the median of a whole-number column; the mean of two middles is rounded towards zero."""
    middles = selected(df, keys, value, {"_low": F.floor((F.col("_n") + 1) / 2), "_high": F.floor(F.col("_n") / 2) + 1})
    return middles.select(*keys, F.expr("(_low + _high) div 2").alias(name))
