"""Phrases, sentiment and what the talk is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missivelake.config import DEFAULT, Config
from missivelake.functions import text as T
from missivelake.operators.messages import ME, THEM, local_day


def phrase_counts(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """How often each contact's messages hold each phrase of two or three tokens."""
    tokens = messages.select("contact_id", T.phrase_tokens(F.col("body"), cfg.phrase_min_token_bytes).alias("_t"))
    rows = tokens.select("contact_id", F.explode(T.phrases(F.col("_t"))).alias("phrase"))
    return rows.groupBy("contact_id", "phrase").agg(F.count("*").alias("n"))


def recurring_phrases(counts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    w = Window.partitionBy("contact_id").orderBy(F.desc("n"), "phrase")
    ranked = counts.where(F.col("n") >= cfg.phrase_min_count).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= cfg.recurring_top)


def text_counts(messages: DataFrame) -> DataFrame:
    """How many of each contact's messages have a text."""
    return messages.where(F.col("body") != "").groupBy("contact_id").agg(F.count("*").alias("n"))


def distinctive_phrases(counts: DataFrame, texts: DataFrame, all_counts: DataFrame, all_texts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Phrases that a contact uses more than all others: n * ln((N + 1) / (f + 1)).

    N and f count the other contacts' non-empty messages and uses of the phrase, exactly: totals less the contact's own.
    counts and texts (see phrase_counts and text_counts) are those of the contacts that are asked for, all_counts and
    all_texts those of all contacts, these included; both are additive, so they may come from earlier runs.
    """
    total = all_texts.agg(F.sum("n").alias("_all"))
    background = texts.join(F.broadcast(total), F.lit(True)).select("contact_id", F.greatest(F.col("_all") - F.col("n"), F.lit(1)).alias("_messages"))
    often = counts.where(F.col("n") >= cfg.phrase_min_count)
    uses = all_counts.groupBy("phrase").agg(F.sum("n").alias("_uses"))
    rows = often.join(uses, "phrase").join(background, "contact_id")
    score = F.col("n") * F.log((F.col("_messages") + 1) / (F.col("_uses") - F.col("n") + F.lit(1.0)))
    w = Window.partitionBy("contact_id").orderBy(F.desc("score"), "phrase")
    ranked = rows.select("contact_id", "phrase", "n", F.round(score, 6).alias("score")).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= cfg.distinctive_top)


def sentiment_daily(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    rows = messages.select("contact_id", "sender", local_day(F.col("timestamp_ms"), cfg).alias("day"), T.sentiment(F.col("body")).alias("_s"))
    side = lambda who: F.avg(F.when(F.col("sender") == who, F.col("_s")))
    return rows.groupBy("contact_id", "day").agg(side(ME).alias("my_sentiment"), side(THEM).alias("their_sentiment"))


def sentiment_overall(messages: DataFrame) -> DataFrame:
    rows = messages.select("contact_id", "sender", T.sentiment(F.col("body")).alias("_s"))
    side = lambda who: F.avg(F.when(F.col("sender") == who, F.col("_s")))
    return rows.groupBy("contact_id").agg(side(ME).alias("my_sentiment"), side(THEM).alias("their_sentiment"), F.avg("_s").alias("sentiment"))


def focus(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Shares of talk about me, about them and about others.

    First and second persons count by speaker. Others are first names of all contacts, matched as whole words; a
    contact's own first name does not count in its messages unless another contact shares it.
    """
    names = contacts.select("contact_id", F.lower(T.first_name(F.col("display_name"))).alias("name")).where("name is not null").distinct()
    shared = names.groupBy("name").agg(F.count("*").alias("_owners"))
    body = F.col("body")
    i, you = F.regexp_count(body, F.lit(T.ABOUT_ME)), F.regexp_count(body, F.lit(T.ABOUT_YOU))
    mine = F.col("sender") == ME
    persons = messages.groupBy("contact_id").agg(F.sum(F.when(mine, i).otherwise(you)).alias("_me"), F.sum(F.when(mine, you).otherwise(i)).alias("_them"))
    # Words are counted per contact before they meet the names, so the join sees a contact's vocabulary, not its messages.
    said = messages.select("contact_id", F.explode(F.split(F.lower(body), r"[^\p{L}\p{N}_']+")).alias("word")).groupBy("contact_id", "word").agg(F.count("*").alias("n"))
    hits = said.join(shared, said["word"] == shared["name"]).join(names.withColumnRenamed("contact_id", "_owner"), ["name"])
    own = F.max((F.col("_owner") == F.col("contact_id")).cast("int"))
    others = hits.groupBy("contact_id", "name").agg(F.max("n").alias("n"), F.max("_owners").alias("_owners"), own.alias("_own"))
    others = others.where((F.col("_own") == 0) | (F.col("_owners") > 1)).groupBy("contact_id").agg(F.sum("n").alias("_other"))
    rows = persons.join(others, "contact_id", "left").withColumn("_other", F.coalesce("_other", F.lit(0)))
    total = F.col("_me") + F.col("_them") + F.col("_other")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(0.0)
    return rows.select("contact_id", share("_me").alias("focus_me"), share("_them").alias("focus_them"), share("_other").alias("focus_other"))
