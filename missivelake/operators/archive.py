"""Contacts, duplicates, freshness and consistency of an archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missivelake.config import DAY
from missivelake.functions import text as T
from missivelake.operators import search


# --- filters and exports ------------------------------------------------------------------------------------------


def filtered(
    messages: DataFrame, *, since: int | None = None, until: int | None = None, address: str | None = None, address_like: str | None = None, body_like: str | None = None, thread: str | None = None, kind: int | None = None
) -> DataFrame:
    """Messages that meet every filter that is given; an address is normalised first."""
    tests: list[Column] = []
    if since is not None:
        tests.append(F.col("timestamp_ms") >= since)
    if until is not None:
        tests.append(F.col("timestamp_ms") <= until)
    if address is not None:
        tests.append(T.normalize_address(F.col("address")) == T.normalize_address(F.lit(address)))
    if address_like is not None:
        tests.append(F.col("address").ilike(T.like_pattern(address_like)))
    if body_like is not None:
        tests.append(F.col("body").ilike(T.like_pattern(body_like)))
    if thread is not None:
        tests.append(F.col("thread_id") == thread)
    if kind is not None:
        tests.append(F.col("message_type") == kind)
    return reduce(lambda df, t: df.where(t), tests, messages)


def export_messages(messages: DataFrame, attachments: DataFrame, **filters: object) -> DataFrame:
    """Filtered messages with their type's label, their number of attachments and these' paths, in order."""
    files = attachments.groupBy("message_id").agg(F.count("*").alias("n_attachments"), F.array_join(F.array_sort(F.collect_list("file_path")), ";").alias("paths"))
    rows = filtered(messages, **filters).join(files.withColumnRenamed("message_id", "_id"), F.col("id") == F.col("_id"), "left")
    return rows.select(
        "id", "timestamp_ms", "address", "body", "thread_id", T.message_type_label(F.col("message_type")).alias("type"), F.coalesce("n_attachments", F.lit(0)).alias("n_attachments"), F.coalesce("paths", F.lit("")).alias("paths")
    )


def export_search(messages: DataFrame, attachments: DataFrame, query: str, **filters: object) -> DataFrame:
    """Exported messages (see export_messages) that hold all phrases of a keyword query, with their scores, best first."""
    hits = search.message_search(messages, query, None)
    rows = export_messages(messages, attachments, **filters).join(hits.select(F.col("id").alias("_hit"), "score"), F.col("id") == F.col("_hit")).drop("_hit")
    return rows.orderBy(F.desc("score"), "id")


def export_attachments(messages: DataFrame, attachments: DataFrame, mime: str | None = None, **filters: object) -> DataFrame:
    rows = attachments if mime is None else attachments.where(F.col("mime_type") == mime)
    owner = filtered(messages, **filters).select(F.col("id").alias("_id"), "timestamp_ms", "address")
    joined = rows.join(owner, F.col("message_id") == F.col("_id"))
    return joined.select(F.col("id").alias("attachment_id"), "message_id", "timestamp_ms", "address", "mime_type", "file_path", F.lower(F.hex("file_hash")).alias("hash"))


def page(messages: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return messages.orderBy(F.desc("timestamp_ms"), "id").offset(offset).limit(limit)


# --- identity -----------------------------------------------------------------------------------------------------


def with_dedupe_key(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """messages with `key`: the message_id if there is one, else a digest of address, time, body, thread and attachments."""
    hashes = attachments.groupBy("message_id").agg(F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_list(F.lower(F.hex("file_hash")))), ",").alias("_hashes"))
    rows = messages.join(hashes.withColumnRenamed("message_id", "_id"), F.col("id") == F.col("_id"), "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = [*map(text, ("address", "timestamp_ms", "body", "thread_id")), F.coalesce("_n", F.lit(0)).cast("string"), F.coalesce("_hashes", F.lit(""))]
    digest = F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)
    return rows.withColumn("key", F.coalesce("message_id", digest)).drop("_id", "_n", "_hashes")


def first_of(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dedupe_messages(keyed: DataFrame) -> DataFrame:
    return first_of(keyed, ["key"], ["rowid"])


def dedupe_attachments(attachments: DataFrame) -> DataFrame:
    return first_of(attachments, ["message_id", "file_hash"], ["id"])


def reparented(attachments: DataFrame, keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """Attachments of dropped duplicates, moved to the message that was kept: the one of the same key, else of the same
    message_id, else of the same time and address (the first of several). kept may be an archive of before."""
    order = F.struct("rowid", "id")
    owners = keyed.select(F.col("id").alias("_old"), "key", "message_id", "timestamp_ms", "address")
    found = [owners.select("_old")]
    for k, keys in enumerate((["key"], ["message_id"], ["timestamp_ms", "address"])):
        known = kept.dropna(subset=keys).groupBy(*keys).agg(F.min_by("id", order).alias(f"_new{k}"))
        found.append(owners.join(known, keys).select("_old", f"_new{k}"))
    survivor = reduce(lambda a, b: a.join(b, "_old", "left"), found)
    survivor = survivor.select("_old", F.coalesce("_new0", "_new1", "_new2").alias("_new"))
    moved = attachments.join(survivor, F.col("message_id") == F.col("_old"), "left")
    return moved.withColumn("message_id", F.coalesce("_new", "message_id")).drop("_old", "_new")


def duplicate_media(attachments: DataFrame) -> DataFrame:
    """Content hashes that more than one attachment has."""
    rows = attachments.groupBy(F.lower(F.hex("file_hash")).alias("hash")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return rows.where("n > 1")


def duplicate_contacts(addresses: DataFrame) -> DataFrame:
    """Phone keys that more than one contact has."""
    rows = addresses.groupBy(T.phone_key(F.col("address")).alias("phone")).agg(F.count_distinct("contact_id").alias("n"), F.array_join(F.array_sort(F.collect_set("contact_id")), ",").alias("contacts"))
    return rows.where("n > 1")


# --- contacts -----------------------------------------------------------------------------------------------------


def contact_list(contacts: DataFrame, addresses: DataFrame, messages: DataFrame, at_least: int = 0) -> DataFrame:
    """Every contact with its number of messages, contacts of none included."""
    per_address = messages.groupBy("address").agg(F.count("*").alias("_n"))
    counts = addresses.join(per_address, "address").groupBy("contact_id").agg(F.sum("_n").alias("_n"))
    rows = contacts.join(counts, "contact_id", "left").select("contact_id", "display_name", F.coalesce("_n", F.lit(0)).alias("n_messages"))
    return rows.where(F.col("n_messages") >= at_least)


def latest_names(messages: DataFrame) -> DataFrame:
    """Each address's last contact name that isn't empty."""
    named = messages.where(F.col("contact_name").isNotNull() & (F.trim("contact_name") != ""))
    return named.groupBy("address").agg(F.max_by("contact_name", F.struct("timestamp_ms", "rowid")).alias("name"))


def auto_contacts(messages: DataFrame, addresses: DataFrame) -> DataFrame:
    """New contacts for one-to-one addresses that no contact has, named by the latest name or else the address."""
    unseen = messages.where(~F.contains("address", F.lit("~")) & (F.col("address") != "")).select("address").distinct().join(addresses.select("address"), "address", "left_anti")
    rows = unseen.join(latest_names(messages), "address", "left")
    return rows.select(F.sha2(F.col("address").cast("binary"), 256).alias("contact_id"), "address", F.coalesce("name", "address").alias("display_name"), F.lit("auto").alias("source"))


def renamed_contacts(contacts: DataFrame, addresses: DataFrame, messages: DataFrame) -> DataFrame:
    """contacts with the latest name that a message of theirs carries."""
    named = addresses.join(latest_names(messages), "address").groupBy("contact_id").agg(F.min("name").alias("_name"))
    return contacts.join(named, "contact_id", "left").withColumn("display_name", F.coalesce("_name", "display_name")).drop("_name")


def thread(messages: DataFrame, addresses: DataFrame, contacts: DataFrame, name_like: str | None = None, limit: int = 50, phone: str | None = None) -> DataFrame:
    """The latest messages with the contacts whose name matches, and with those of a phone number's key."""
    known = contacts.where(F.col("display_name").ilike(T.like_pattern(name_like)) if name_like is not None else F.lit(False)).join(addresses, "contact_id").select("address").distinct()
    rows = messages.join(known, "address", "left_semi")
    if phone is not None:
        rows = messages.join(known, "address", "left_anti").where(T.phone_key(F.col("address")) == T.phone_key(F.lit(phone))).unionByName(rows)
    return rows.orderBy(F.desc("timestamp_ms"), "rowid").limit(limit).select("rowid", "timestamp_ms", "address", T.preview(F.col("body")).alias("preview"))


def context(messages: DataFrame, anchors: DataFrame, n: int = 5) -> DataFrame:
    """The messages up to n before and after each anchor (rowid) in its thread.

    Places are counted within a thread's day, after the counts of the days before, so that one long thread is spread over
    its days; bodies are joined to the places that are asked for.
    """
    keys = messages.select("rowid", "thread_id", "timestamp_ms", F.floor(F.col("timestamp_ms") / DAY).alias("_day"))
    days = keys.groupBy("thread_id", "_day").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("thread_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("thread_id", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("thread_id", "_day").orderBy("timestamp_ms", "rowid")
    placed = keys.withColumn("_k", F.row_number().over(within)).join(days, ["thread_id", "_day"])
    placed = placed.select("rowid", "thread_id", (F.col("_before") + F.col("_k")).alias("_place"))
    at = placed.join(anchors.select("rowid"), "rowid", "left_semi").select(F.col("rowid").alias("anchor"), "thread_id", F.explode(F.sequence(F.col("_place") - n, F.col("_place") + n)).alias("_place"))
    near = at.join(placed, ["thread_id", "_place"]).select("anchor", "rowid")
    return near.join(messages.select("rowid", "timestamp_ms", "body"), "rowid").select("anchor", "rowid", "timestamp_ms", "body")


# --- freshness and checks -----------------------------------------------------------------------------------------


def stale_contacts(status: DataFrame, addresses: DataFrame, messages: DataFrame, since_ms: int) -> DataFrame:
    """status with is_stale set for every contact of a message since a time; contacts without a row get one."""
    touched = messages.where(F.col("timestamp_ms") >= since_ms).select("address").distinct().join(addresses, "address").select("contact_id").distinct().withColumn("_touched", F.lit(1))
    rows = status.join(touched, "contact_id", "full_outer")
    return rows.select("contact_id", "computed_at", F.when(F.col("_touched") == 1, 1).otherwise(F.coalesce("is_stale", F.lit(1))).alias("is_stale"))


def computed(status: DataFrame, done: DataFrame, at: int) -> DataFrame:
    """status after a run over the contacts of done (contact_id, had_data): fresh, with the time of the run."""
    fresh = done.select("contact_id", F.lit(at).cast("long").alias("computed_at"), F.lit(0).alias("is_stale"), "had_data")
    kept = status.join(done.select("contact_id"), "contact_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def all_stale(status: DataFrame) -> DataFrame:
    return status.withColumn("is_stale", F.lit(1))


def orphan_attachments(attachments: DataFrame, messages: DataFrame) -> DataFrame:
    return attachments.join(messages.select(F.col("id").alias("_id")), F.col("message_id") == F.col("_id"), "left_anti")


def unprocessed_media(attachments: DataFrame, media_embeddings: DataFrame) -> DataFrame:
    """Images and videos that lack an embedding or a label."""
    media = attachments.where(F.col("mime_type").startswith("image/") | F.col("mime_type").startswith("video/"))
    done = media_embeddings.select(F.col("attachment_id").alias("_done")).distinct()
    return media.join(done, F.col("id") == F.col("_done"), "left").where("_done is null or nsfw_label is null").drop("_done")


def flagged_media(attachments: DataFrame, at_least: float, score: str = "nsfw_score") -> DataFrame:
    """Attachments whose score is at least so high, highest first; those without a score are left out."""
    return attachments.where(F.col(score) >= at_least).orderBy(F.desc(score), "id")


def summary_checks(summary: DataFrame, messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """check, expected, actual and ok: an import's summary (see import_summary) against what the archive holds."""
    count = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    row = summary.join(count(messages, "_messages"), F.lit(True)).join(count(attachments, "_attachments"), F.lit(True))
    check = lambda name, expected, actual: F.struct(F.lit(name).alias("check"), expected.alias("expected"), F.col(actual).alias("actual"))
    checks = F.array(check("messages", F.col("inserted"), "_messages"), check("attachments", F.col("attachments"), "_attachments"))
    return row.select(F.explode(checks).alias("c")).select("c.*", (F.col("c.expected") == F.col("c.actual")).alias("ok"))


def quality_checks(messages: DataFrame, attachments: DataFrame, keyed: DataFrame) -> DataFrame:
    """check, expected, actual and ok: unique keys, owned attachments, dated and addressed messages."""
    one = messages.agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum((F.col("timestamp_ms") > 0).cast("long")).alias("dated"), F.sum((F.coalesce("address", F.lit("")) != "").cast("long")).alias("addressed")
    )
    keys = keyed.agg(F.count_distinct("key").alias("keys"))
    orphans = orphan_attachments(attachments, messages).agg(F.count("*").alias("orphans"))
    row = one.join(F.broadcast(keys), F.lit(True)).join(F.broadcast(orphans), F.lit(True))
    check = lambda name, expected, actual: F.struct(F.lit(name).alias("check"), expected.cast("long").alias("expected"), F.col(actual).alias("actual"))
    n = F.col("n")
    checks = F.array(check("unique_ids", n, "ids"), check("unique_keys", n, "keys"), check("dated", n, "dated"), check("addressed", n, "addressed"), check("orphan_attachments", F.lit(0), "orphans"))
    return row.select(F.explode(checks).alias("c")).select("c.*", (F.col("c.expected") == F.col("c.actual")).alias("ok"))


def import_summary(parsed: DataFrame, kept: DataFrame, attachments: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: messages seen, inserted and skipped, attachments, parse errors."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    row = count(parsed, "seen").join(F.broadcast(count(kept, "inserted")), F.lit(True)).join(F.broadcast(count(attachments, "attachments")), F.lit(True)).join(F.broadcast(count(errors, "errors")), F.lit(True))
    return row.select("seen", "inserted", (F.col("seen") - F.col("inserted")).alias("skipped"), "attachments", "errors")
