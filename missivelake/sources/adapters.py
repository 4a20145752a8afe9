"""Messages, contacts and attachments out of the event and conversation tables, for queries over given data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bodies that the events' messages carry in turn; together they meet every kind of text.
PHRASES = (
    "hello world", "are you coming tonight?", "haha that was great", "sorry I am late", "you got this", "see https://example.com/page now",
    "lol I love this happy song", "my bad, I forgot your book", "what do you think about the weekend trip?", "not happy with this terrible weather",
    "good job on the project", "I will call Alice tomorrow", "great fun at the beach party \U0001F602", "thanks ❤️ you are kind",
    "never sad when Bob sings", "the weekend trip was wonderful", "me and my friend will visit you", "well done \U0001F44F\U0001F3FD",
    "coffee break soon?", "hehe ok", "I hate traffic jams", "pizza movie night again", "pizza movie night was fun", "let's go hiking",
    "sick and tired today", "is your sister Cara home", "www.example.org has the map", "rofl \U0001F923\U0001F923", "proud of you", "no problem at all",
    "beach party photos attached", "do you remember the beach party?", "apologise to mine", "fine, I'm ready", "you're amazing friend", "12345 numbers 678",
    "flag \U0001F1EB\U0001F1F7 day", "weekend trip plans are nice", "your turn to cook", "worst day, not good",
)
NAMES = ("Alice Stone", "Bob Reed", "Alice Park", "Cara Lind", "D Short", "Eve Holt", "Finn O'Hara", "Gus Vale", "Hana Moor", "Ivo Kern")
MIMES = {3: ("image/jpeg",), 5: ("video/mp4", "image/gif"), 7: ("audio/ogg",), 8: ("image/png", "image/png")}
CONTACTS = len(NAMES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One whose files give fewer splits than there are cores is dealt over the cores before text work;
    larger ones are read as they are, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > cores else df.repartition(cores)


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each event: users fold into ten contacts; every third contact is written to more than it writes."""
    return messages_of(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_messages as a stream of the table's files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return messages_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))  # a pattern may name one file


def messages_of(e: DataFrame) -> DataFrame:
    """A message for each row of events."""
    n = F.col("user_id") % CONTACTS
    kind = F.col("event_type")
    direction = F.when(kind.isin("purchase", "signup"), 2).when(kind == "error", 0).when((kind == "click") & (n % 3 == 0), 2).otherwise(1)
    number = F.concat(F.lit("+1555000"), F.lpad(n.cast("string"), 4, "0"))
    group = (n % 7 == 3) & (F.col("event_id") % 5 == 0)
    mime = F.array().cast("array<string>")
    for k, v in MIMES.items():
        mime = F.when(F.col("event_id") % 11 == k, F.array(*[F.lit(x) for x in v])).otherwise(mime)
    body = _pick(PHRASES, F.col("event_id") + direction * 7)
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("m"), F.floor(F.col("event_id") / 2).cast("string"))).alias("message_id"),
        F.col("event_id").alias("rowid"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.when(group, F.concat(number, F.lit("~+15559999999"))).otherwise(number).alias("address"),
        body.alias("body"),
        body.alias("body_searchable"),
        (F.col("event_id") % 3 + 1).cast("int").alias("message_type"),
        direction.alias("direction"),
        F.concat(F.lit("t"), n.cast("string")).alias("thread_id"),
        F.when(F.col("event_id") % 6 != 0, _pick(NAMES, n)).alias("contact_name"),
        mime.alias("mime_types"),
        n.alias("contact_no"),
        "user_id",
    )


def user_messages(messages: DataFrame) -> DataFrame:
    """contact_messages with a contact for every user, so that contacts grow with the events."""
    known = messages.where(F.col("direction").isin(1, 2) & ~F.contains("address", F.lit("~")))
    contact = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("contact_id")
    return known.select(contact, "rowid", "timestamp_ms", F.when(F.col("direction") == 2, 1).otherwise(2).alias("sender"), "body", "mime_types")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contact_id and display_name of the contacts that any event folds into."""
    n = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % CONTACTS).alias("n")).distinct()
    return n.select(F.concat(F.lit("c"), F.col("n").cast("string")).alias("contact_id"), _pick(NAMES, F.col("n")).alias("display_name"), "n")


def contact_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat(F.lit("+1555000"), F.lpad(F.col("n").cast("string"), 4, "0"))
    return contacts(spark, sf_dir).select("contact_id", number.alias("address"))


def event_attachments(messages: DataFrame) -> DataFrame:
    rows = messages.select("id", "rowid", F.posexplode("mime_types").alias("k", "mime_type"))
    content = F.concat(F.col("mime_type"), F.lit("/"), (F.col("rowid") % 500).cast("string"))
    return rows.select(
        F.concat(F.lit("a"), F.col("rowid").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("id"),
        F.col("id").alias("message_id"),
        "mime_type",
        F.concat(F.lit("media/"), F.substring(F.sha2(content.cast("binary"), 256), 1, 8)).alias("file_path"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("file_hash"),
        F.when(F.col("rowid") % 2 == 0, "safe").alias("nsfw_label"),
    )


#: Of the backup that is written from events, every so-manieth element is broken, and every so-manieth's payloads are no base64.
BROKEN, UNDECODABLE = 97, 13


def write_backup(messages: DataFrame, folder: str) -> None:
    """The events' messages as an XML backup with damage, in the events' order: short messages, and multimedia ones where there are
    attachments."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    given = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), c, F.lit('"')), F.lit(""))
    common = [given("address", escaped("address")), given("date", F.col("timestamp_ms").cast("string")), given("body", escaped("body")), given("msg_id", escaped("message_id")), given("thread_id", escaped("thread_id")), given("contact_name", escaped("contact_name"))]
    direction = F.col("direction").cast("string")
    content = lambda m: F.concat(m, F.lit("/"), (F.col("rowid") % 500).cast("string")).cast("binary")
    data = lambda m: F.when(F.col("rowid") % UNDECODABLE == 0, "@@@").otherwise(F.base64(content(m)))
    parts = F.array_join(F.transform("mime_types", lambda m: F.concat(F.lit('<part ct="'), m, F.lit('" data="'), data(m), F.lit('"/>'))), "")
    fine = F.col("rowid") % BROKEN != 0
    sms = F.concat(F.lit("<sms"), given("type", direction), *common, F.when(fine, " />").otherwise(""))
    mms = F.concat(F.lit("<mms"), given("msg_box", direction), *common, F.when(fine, ">").otherwise(""), F.lit("<parts>"), parts, F.lit("</parts></mms>"))
    messages.orderBy("rowid").select(F.when(F.size("mime_types") > 0, mms).otherwise(sms).alias("value")).write.mode("overwrite").text(folder)


def talk_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contact_messages of the conversations table: users are me, assistants are them, ten conversations a contact."""
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select(
        F.concat(F.lit("k"), F.floor(F.col("conv_id") / 10).cast("string")).alias("contact_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("rowid"),
        (F.col("conv_id") * 86_400_000 + F.col("turn") * 60_000).alias("timestamp_ms"),
        F.when(F.col("role") == "user", 1).otherwise(2).alias("sender"),
        F.coalesce("text", F.lit("")).alias("body"),
        F.array().cast("array<string>").alias("mime_types"),
    )
