"""The whole analysis of all contacts, and its incremental refresh."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missivelake.config import DEFAULT, Config
from missivelake.operators import activity, conversations, insights, language, messages, points, rating, responses
from missivelake.sources.commits import Commits

#: Contacts are dealt into folders of every table, by a hash: one for so many contacts, within these bounds. A refresh rewrites
#: the folders of its contacts.
CONTACTS_A_FOLDER, FEWEST, MOST = 200, 64, 10_000
FOLDER = "_folder"


@dataclass
class Background:
    """Additive counts of all contacts, planned when they are asked for: uses of each phrase (contact_id, phrase, n) and messages
    with text (contact_id, n)."""

    phrases: Callable[[], DataFrame]
    texts: Callable[[], DataFrame]


class Analysis:
    """Lazy tables over one set of contact messages; each is planned when it is first asked for.

    background: what a contact's phrases are held against; by default the same set. See refresh.
    stale: for a refresh, the contacts (contact_id) whose rows it replaces.
    """

    def __init__(self, contact_messages: DataFrame, contacts: DataFrame, cfg: Config = DEFAULT, background: Background | None = None, stale: DataFrame | None = None):
        self.contact_messages, self.contacts, self.cfg = contact_messages, contacts, cfg
        self.background, self.stale = background, stale

    def materialised(self, folder: str) -> Analysis:
        """The same analysis over its messages with flags and points written to a folder, which all tables then share."""
        out = Analysis(self.contact_messages, self.contacts, self.cfg, self.background, self.stale)
        out.points = out.enriched = out.contact_messages = _written(self.points, f"{folder}/messages")
        return out

    @cached_property
    def enriched(self) -> DataFrame:
        return messages.enriched(self.contact_messages, self.cfg)

    @cached_property
    def points(self) -> DataFrame:
        return points.message_points(self.enriched, self.cfg)

    @cached_property
    def conversations(self) -> DataFrame:
        return conversations.with_moments(conversations.conversations(self.points), self.cfg)

    @cached_property
    def counts(self) -> DataFrame:
        return activity.contact_counts(self.contact_messages)

    @cached_property
    def daily(self) -> DataFrame:
        return activity.daily_activity(self.contact_messages, self.cfg)

    @cached_property
    def replies(self) -> DataFrame:
        return responses.responses(self.enriched, self.cfg)

    @cached_property
    def response_stats(self) -> DataFrame:
        return responses.response_stats(self.replies)

    @cached_property
    def pairs(self) -> DataFrame:
        return conversations.pair_metrics(self.conversations)

    @cached_property
    def daily_points(self) -> DataFrame:
        return points.daily_points(self.points, self.cfg)

    @cached_property
    def phrases(self) -> DataFrame:
        return language.phrase_counts(self.contact_messages, self.cfg)

    def rating(self) -> DataFrame:
        return rating.rating(self.counts, self.pairs, responses.wide(self.response_stats), self.daily, self.cfg)

    def insights(self) -> DataFrame:
        return insights.insights(self.counts, self.pairs, responses.wide(self.response_stats), self.cfg)

    @cached_property
    def texts(self) -> DataFrame:
        return language.text_counts(self.contact_messages)

    def distinctive_phrases(self) -> DataFrame:
        if self.background is None:
            return language.distinctive_phrases(self.phrases, self.texts, self.phrases, self.texts, self.cfg)
        # The other contacts' counts are as they were; those of the contacts of this run are taken anew.
        others = lambda old, new: old.join(self.stale, "contact_id", "left_anti").unionByName(new)
        uses, texts = others(self.background.phrases(), self.phrases), others(self.background.texts(), self.texts)
        return language.distinctive_phrases(self.phrases, self.texts, uses, texts, self.cfg)

    def headline(self) -> DataFrame:
        """A contact's messages, words and conversations at a glance."""
        counts = self.counts.select("contact_id", "my_messages", "their_messages", "my_words", "their_words")
        pairs = self.pairs.select("contact_id", "n_conversations", "started_by_me", "started_by_them")
        names = self.contacts.select("contact_id", "display_name")
        return names.join(counts, "contact_id").join(pairs, "contact_id")

    def tables(self) -> dict[str, Callable[[], DataFrame]]:
        m, cfg = self.contact_messages, self.cfg
        return {
            "conversations": lambda: self.conversations,
            "contact_counts": lambda: self.counts,
            "daily_activity": lambda: self.daily,
            "hourly_activity": lambda: activity.hourly_activity(m, cfg),
            "response_stats": lambda: self.response_stats,
            "response_histogram": lambda: responses.response_histogram(self.replies),
            "double_messages": lambda: responses.double_messages(self.enriched),
            "flow_nodes": lambda: conversations.flow_nodes(self.conversations),
            "flow_links": lambda: conversations.flow_links(self.conversations),
            "pair_metrics": lambda: self.pairs,
            "daily_points": lambda: self.daily_points,
            "growth": lambda: points.growth(self.daily_points),
            "top_emojis": lambda: activity.top_emojis(m, cfg),
            "recurring_phrases": lambda: language.recurring_phrases(self.phrases, cfg),
            "phrase_counts": lambda: self.phrases,
            "text_counts": lambda: self.texts,
            "distinctive_phrases": self.distinctive_phrases,
            "sentiment_daily": lambda: language.sentiment_daily(m, cfg),
            "focus": lambda: language.focus(m, self.contacts),
            "rating": self.rating,
            "insights": self.insights,
        }


#: Tables that others are made of, by the attribute that holds them.
SHARED = {"conversations": "conversations", "contact_counts": "counts", "daily_activity": "daily", "response_stats": "response_stats", "pair_metrics": "pairs", "daily_points": "daily_points", "phrase_counts": "phrases", "text_counts": "texts"}


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(df: DataFrame, folders: int) -> DataFrame:
    return df.withColumn(FOLDER, F.pmod(F.xxhash64("contact_id"), F.lit(folders)).cast("int"))


def _folders(analysis: Analysis, files: Commits) -> int:
    """How many folders the stored tables have; a whole analysis settles it, by the number of contacts."""
    if analysis.stale is None:
        n = max(FEWEST, min(MOST, -(-analysis.contacts.count() // CONTACTS_A_FOLDER)))
        files.mark(f"_folders/{len(files.names('_folders')) + 1:06d}-{n}")
        return n
    return int(max(files.names("_folders")).split("-")[1])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that persist has written."""
    return spark.read.parquet(f"{folder}/{name}").drop(FOLDER)


def persist(analysis: Analysis, folder: str, names: list[str] | None = None) -> DataFrame:
    """Write every table (or those named); returns contact_id and had_data for the contacts of the run.

    A whole analysis replaces the last run's tables. A refresh replaces its own contacts' rows: they are written aside
    together with the rows that share their folders, and these folders then take the place of the old ones, so that a run
    that is stopped loses nothing and can be done again.
    """
    spark = analysis.contact_messages.sparkSession
    work, folders = f"{folder}/_work", _folders(analysis, Commits(spark, folder))
    shared = analysis.materialised(work)
    shared.replies = _written(shared.replies, f"{work}/replies")
    tables = shared.tables()
    for name in names or tables:
        target = f"{folder}/{name}"
        rows = _written(tables[name](), f"{work}/{name}")
        if name in SHARED:
            setattr(shared, SHARED[name], rows)
        if analysis.stale is None:
            _dealt(rows, folders).write.mode("overwrite").partitionBy(FOLDER).parquet(target)
            continue
        touched = _dealt(analysis.stale, folders).select(FOLDER).distinct()
        old = spark.read.parquet(target).join(F.broadcast(touched), FOLDER, "left_semi").join(analysis.stale, "contact_id", "left_anti")
        merged = _written(old.unionByName(_dealt(rows, folders)), f"{work}/{name}-merged")
        emptied = touched.join(merged.select(FOLDER).distinct(), FOLDER, "left_anti")
        if emptied.limit(1).count():  # a folder without rows is not replaced by itself: write the whole table anew
            rest = spark.read.parquet(target).join(F.broadcast(touched), FOLDER, "left_anti")
            merged = _written(rest.unionByName(merged.select(rest.columns)), f"{work}/{name}-whole")
            merged.write.mode("overwrite").partitionBy(FOLDER).parquet(target)
        else:
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(target)
    seen = analysis.contact_messages.select("contact_id").distinct().withColumn("had_data", F.lit(True))
    contacts = analysis.contacts if analysis.stale is None else analysis.contacts.join(analysis.stale, "contact_id", "left_semi")
    return contacts.select("contact_id").join(seen, "contact_id", "left").select("contact_id", F.coalesce("had_data", F.lit(False)).alias("had_data"))


def refresh(contact_messages: DataFrame, contacts: DataFrame, status: DataFrame, cfg: Config = DEFAULT, folder: str | None = None) -> Analysis:
    """The analysis of the stale contacts only, against the background of all.

    With the folder of a persisted analysis, the other contacts' phrases and messages are taken from its stored counts,
    so that none of their bodies is read; without one they are counted again.
    """
    stale = status.where("is_stale = 1").select("contact_id").distinct()
    spark = contact_messages.sparkSession
    if folder is None:
        background = Background(lambda: language.phrase_counts(contact_messages, cfg), lambda: language.text_counts(contact_messages))
    else:
        background = Background(lambda: read_table(spark, folder, "phrase_counts"), lambda: read_table(spark, folder, "text_counts"))
    return Analysis(contact_messages.join(stale, "contact_id", "left_semi"), contacts, cfg, background, stale)
