"""Rule-based observations about a contact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missivelake.config import DEFAULT, Config
from missivelake.functions.text import duration_label

# The rules' names and texts.
MORE = ("slightly more", "more", "much more", "far more")
FASTER = ("slightly faster", "faster", "much faster", "far faster")
COMPARED = {
    "laughs": ("laugh", "my_laugh", "their_laugh"),
    "apologies": ("apologize", "my_apology", "their_apology"),
    "encouragement": ("send encouragement", "my_encouragement", "their_encouragement"),
    "questions": ("ask questions", "my_question", "their_question"),
    "messages_volume": ("send messages", "my_messages", "their_messages"),
    "initiation": ("initiate conversations", "started_by_me", "started_by_them"),
}
CATEGORIES = ("your_side", "their_side", "shared")
CONFIDENCE = ("low", "medium", "high")
FIELDS = "struct<id:string,category:int,confidence:int,tier:int,headline:string,detail:string>"


def _tier(ratio: Column, cfg: Config) -> Column:
    out = F.lit(None).cast("int")
    for k, edge in enumerate(cfg.insight_ratios, 1):
        out = F.when(ratio >= edge, k).otherwise(out)
    return out


def count_tier(mine: Column, theirs: Column, cfg: Config = DEFAULT) -> Column:
    """1 to 4 for counts that differ in ratio and by at least 50 and one in a hundred; null otherwise."""
    low, high = F.least(mine, theirs), F.greatest(mine, theirs)
    floor = F.floor(F.greatest(F.lit(50.0), (mine + theirs) * 0.01))
    ratio = F.when(low == 0, F.lit(float("inf"))).otherwise(high / F.greatest(low, F.lit(1)))
    return F.when((mine + theirs > 0) & (high - low >= floor), _tier(ratio, cfg))


def confidence(sample: Column, cfg: Config = DEFAULT) -> Column:
    """0 low, 1 medium, 2 high; null for too small a sample."""
    low, medium, high = cfg.insight_samples
    return F.when(sample < low, None).when(sample < medium, 0).when(sample < high, 1).otherwise(2)


def _places(x: Column, n: int) -> Column:
    """x with n decimals, rounded as the double that it is, halves to even; format_string rounds its shortest digits, so 1.005 goes up."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * n))


def _word(words: tuple[str, ...], tier: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), tier)


def _insight(name: str, cond: Column, category: Column, trust: Column, tier: Column, headline: Column, detail: Column) -> Column:
    row = F.struct(F.lit(name).alias("id"), category.cast("int").alias("category"), trust.cast("int").alias("confidence"), tier.cast("int").alias("tier"), headline.alias("headline"), detail.alias("detail"))
    return F.when(cond & trust.isNotNull() & tier.isNotNull(), row)


def _compare(name: str, cfg: Config) -> Column:
    verb, a, b = COMPARED[name]
    mine, theirs = F.col(a), F.col(b)
    low, high = F.least(mine, theirs), F.greatest(mine, theirs)
    tier, more = count_tier(mine, theirs, cfg), mine > theirs
    text = F.concat(F.when(more, "You").otherwise("They"), F.lit(f" {verb} "), _word(MORE, tier), F.lit(" than "), F.when(more, "they do").otherwise("you do"))
    counts = F.concat(mine.cast("string"), F.lit(" vs "), theirs.cast("string"))
    growth = F.round((high - low) * 100 / F.greatest(low, F.lit(1))).cast("long").cast("string")
    ratio = _places(high / F.greatest(low, F.lit(1)), 2)
    detail = F.when(low == 0, F.concat(counts, F.lit(" (entirely one-sided)"))).otherwise(F.concat(ratio, F.lit("× as often ("), counts, F.lit(", +"), growth, F.lit("%)")))
    return _insight(name, F.lit(True), F.when(more, 0).otherwise(1), confidence(mine + theirs, cfg), tier, text, detail)


def _speed(name: str, measure: str, sample: Column, tail: Column | None, label: str, cfg: Config) -> Column:
    mine, theirs = F.col(f"my_{measure}"), F.col(f"their_{measure}")
    there = (mine > 0) & (theirs > 0)
    ratio = F.when(there, F.greatest(mine, theirs) / F.least(mine, theirs))
    faster = mine < theirs
    tier = _tier(ratio, cfg)
    end = tail if tail is not None else F.concat(F.lit(" than "), F.when(faster, "they do").otherwise("you do"))
    text = F.concat(F.when(faster, "You").otherwise("They"), F.lit(" respond "), _word(FASTER, tier), end)
    detail = F.concat(_places(ratio, 2), F.lit(f"× faster ({label} "), duration_label(mine), F.lit(" vs "), duration_label(theirs), F.lit(")"))
    return _insight(name, F.coalesce(there, F.lit(False)), F.when(faster, 0).otherwise(1), confidence(sample, cfg), tier, text, detail)


def _even(name: str, a: str, b: str, text: str, verb: str, cfg: Config) -> Column:
    mine, theirs = F.col(a), F.col(b)
    detail = F.concat(F.lit(f"You {verb} "), mine.cast("string"), F.lit(f", they {verb} "), theirs.cast("string"))
    return _insight(name, count_tier(mine, theirs, cfg).isNull(), F.lit(2), confidence(mine + theirs, cfg), F.lit(2), F.lit(text), detail)


def _rarely(cfg: Config) -> Column:
    n = F.col("n_conversations")
    back = sum((F.col(f"reconnects_{k}") for k in (1, 2, 3, 4)), F.lit(0))
    share = back / F.greatest(n, F.lit(1))
    detail = F.concat(back.cast("string"), F.when(back == 1, " reconnect").otherwise(" reconnects"), F.lit(" out of "), n.cast("string"), F.lit(" conversations ("), _places(back * 100 / F.greatest(n, F.lit(1)), 1), F.lit("%)"))
    return _insight("rarely_reconnect", share < 0.05, F.lit(2), confidence(n, cfg), F.lit(2), F.lit("You rarely reconnect after long silences"), detail)


def insights(counts: DataFrame, pairs: DataFrame, responses: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Every rule that fires, ranked within its category by confidence, tier and name."""
    rows = counts.join(pairs, "contact_id").join(responses, "contact_id", "left")
    messages = F.col("my_messages") + F.col("their_messages")
    started = F.col("started_by_me") + F.col("started_by_them")
    rules = [
        *[_compare(name, cfg) for name in COMPARED],
        _speed("response_speed", "median_ms", messages, None, "median", cfg),
        _speed("first_response_speed", "median_first_ms", started, F.lit(" when new conversations begin"), "first-response median", cfg),
        _even("endings_even", "closed_by_me", "closed_by_them", "Conversation endings are evenly shared", "closed", cfg),
        _even("missed_even", "missed_by_me", "missed_by_them", "Your missed conversations are evenly matched", "missed", cfg),
        _rarely(cfg),
    ]
    fired = rows.select("contact_id", F.explode(F.filter(F.array(*[r.cast(FIELDS) for r in rules]), lambda x: x.isNotNull())).alias("i")).select("contact_id", "i.*")
    w = Window.partitionBy("contact_id", "category").orderBy(F.desc("confidence"), F.desc("tier"), "id")
    ranked = fired.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.insight_max_per_category)
    name = lambda words, c: F.element_at(F.array(*[F.lit(x) for x in words]), F.col(c) + 1)
    return ranked.withColumns({"category": name(CATEGORIES, "category"), "confidence": name(CONFIDENCE, "confidence")})
