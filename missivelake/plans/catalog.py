"""Every analytics query over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missivelake.functions import lexicon
from missivelake.functions import text as T
from missivelake.operators import activity, archive, conversations, language, messages, points, responses, search, vectors
from missivelake.operators.postings import Postings
from missivelake.plans.analytics import Analysis
from missivelake.sources import adapters as A
from missivelake.sources import backup, media_sink
from missivelake.sources.commits import shared_folder
from missivelake.streaming import sessions
from missivelake.streaming.importing import Imported, import_backup
from missivelake.streaming.merge import Archive

AS_OF = "2024-02-15"
KEYWORDS = "the and"
SINCE = 1_705_000_000_000
LATE = 1_706_658_000_000
DELAY_MS = 3_600_000


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, since sums depend on their order in the last digit."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return A.event_messages(spark, d)


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return messages.contact_messages(_raw(spark, d), A.contact_addresses(spark, d))


def _analysis(spark: SparkSession, d: str) -> Analysis:
    return Analysis(_dense(spark, d), A.contacts(spark, d))


#: Tables that are made of several others; for these, messages with their flags and points are written once and read again.
STORED = ("rating", "insights", "headline")


def _table(analysis: Analysis, name: str) -> DataFrame:
    if name in STORED:
        analysis = analysis.materialised(f"{shared_folder(analysis.contact_messages.sparkSession)}/analysis-{uuid.uuid4().hex}")
    return analysis.headline() if name == "headline" else rounded(analysis.tables()[name]())


def _of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _table(_analysis(spark, d), name)


#: Tables that are also made with a contact for every user, as user_<name>.
BY_USER = (
    "conversations", "contact_counts", "response_stats", "flow_links", "pair_metrics", "daily_points", "sentiment_daily", "rating", "insights", "recurring_phrases", "distinctive_phrases", "top_emojis",
)


def _of_users(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = A.user_messages(_raw(spark, d))
        names = rows.select("contact_id", F.col("contact_id").alias("display_name")).distinct()
        return _table(Analysis(rows, names), name)

    return run


def _files(spark: SparkSession, d: str) -> DataFrame:
    return A.event_attachments(_raw(spark, d))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return archive.with_dedupe_key(_raw(spark, d), _files(spark, d))


def _status(spark: SparkSession, d: str) -> DataFrame:
    return A.contacts(spark, d).where("n % 2 = 0").select("contact_id", F.lit(1).cast("long").alias("computed_at"), F.lit(0).alias("is_stale"))


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).where("rowid % 3 = 0").select(F.col("id").alias("message_id"), F.lit("m1").alias("model_id"))


def _query(spark: SparkSession, d: str) -> list[float]:
    row = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


def address_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = _raw(spark, d).select("address").distinct()
    return rows.select("address", T.normalize_address(F.col("address")).alias("normal"), T.phone_key(F.col("address")).alias("phone"))


def media_categories(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy(T.media_category(F.col("mime_type")).alias("category")).agg(F.count("*").alias("n"))


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_search(A.table(spark, d, "documents"), KEYWORDS, "doc_id", limit=None)


def stored_search(spark: SparkSession, d: str) -> DataFrame:
    """keyword_search by an index that is built of the documents first."""
    index = Postings(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    index.add(A.table(spark, d, "documents"), 0, "doc_id")
    return index.search(KEYWORDS, None).withColumnRenamed("key", "doc_id")


def _imported(spark: SparkSession, d: str) -> tuple[Archive, Imported]:
    """An archive with a damaged backup that is written of the events, and what its import met."""
    folder = f"{shared_folder(spark)}/import-{uuid.uuid4().hex}"
    A.write_backup(_raw(spark, d), f"{folder}/backup")
    archive = Archive(spark, f"{folder}/archive")
    return archive, import_backup(spark, f"{folder}/backup", archive, 0)


def import_summary(spark: SparkSession, d: str) -> DataFrame:
    _, done = _imported(spark, d)
    row = (done.seen, done.inserted, done.skipped, done.media - done.undecodable, done.broken, done.undecodable)
    return spark.createDataFrame([row], "seen long, inserted long, skipped long, attachments long, errors long, undecodable long")


def imported_messages(spark: SparkSession, d: str) -> DataFrame:
    archive, _ = _imported(spark, d)
    return archive.messages().select("message_id", "timestamp_ms", "address", "body", "message_type", "direction", "thread_id", "contact_name", F.array_join("mime_types", ",").alias("mimes"))


def imported_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts made by the import, all of them stale until they are analysed."""
    archive, _ = _imported(spark, d)
    return archive.contacts().join(archive.stale(), "contact_id").select("contact_id", "address", "display_name")


def live_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Conversations that a stream of the events has put out by its end: those over by the watermark."""
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    stream = messages.contact_messages(A.event_stream(spark, d), A.contact_addresses(spark, d))
    rows = sessions.live_conversations(stream, f"{DELAY_MS} milliseconds")
    query = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(sessions.OUT).parquet(f"{folder}/rows")


def merged_messages(spark: SparkSession, d: str) -> DataFrame:
    """The messages of an archive that three batches were merged into, one of them twice."""
    keyed = _keyed(spark, d)
    archive = Archive(spark, f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}")
    most = keyed.agg(F.max("rowid")).first()[0] or 0
    for k in (0, 1, 1, 2):
        archive.merge(keyed.where(F.floor(F.col("rowid") * 3 / (most + 1)) == k), k)
    return archive.messages().select("key", "id", "timestamp_ms")


def media_files(spark: SparkSession, d: str) -> DataFrame:
    """Attachments of a backup as files, by their paths and lengths; none is missing, and none is there that isn't listed."""
    folder = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    A.write_backup(_raw(spark, d).where(F.size("mime_types") > 0), f"{folder}/backup")
    parts = backup.attachments(backup.read_mms(spark, f"{folder}/backup"), "timestamp_ms")
    media_sink.write_media(parts, f"{folder}/files")
    files = media_sink.media_files(spark, f"{folder}/files")
    problems = backup.media_audit(parts, files)
    return files.join(problems.select("path", "problem"), "path", "full_outer")


def embedded_messages(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of texts' lengths and numbers of spaces, by an embedding run in two parts."""
    folder = f"{shared_folder(spark)}/embedded-{uuid.uuid4().hex}"
    load = lambda: lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]
    vectors.run_embeddings(_raw(spark, d), folder, load, "lengths", until=SINCE)
    vectors.run_embeddings(_raw(spark, d), folder, load, "lengths")
    return vectors.embeddings_of(spark, folder).select("message_id", F.col("vector")[0].cast("int").alias("length"), F.col("vector")[1].cast("int").alias("spaces"))


def talk_distinctive(spark: SparkSession, d: str) -> DataFrame:
    m = A.talk_messages(spark, d)
    counts, texts = language.phrase_counts(m), language.text_counts(m)
    return rounded(language.distinctive_phrases(counts, texts, counts, texts))


def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def probe_labels(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    head = [[0.5 if k % 2 else -0.25 for k in range(64)], [0.1] * 64]
    return vectors.probe_scores(v, head, [0.3, 0.0])


def talk_counts(spark: SparkSession, d: str) -> DataFrame:
    return activity.contact_counts(A.talk_messages(spark, d)).select("contact_id", *[f"{s}_{c}" for s in ("my", "their") for c in ("messages", "words", "chars", "unique_words")])


def attachment_labels(spark: SparkSession, d: str) -> DataFrame:
    v = probe_labels(spark, d).select(F.floor(F.col("vec_id") / 4).alias("attachment_id"), "score", "label")
    return vectors.attachment_labels(v)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Message vectors of two models: every embedding stands for the event message of its number."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    model = F.when(F.col("vec_id") % 4 == 3, "m2").otherwise("m1")
    return v.select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("message_id"), model.alias("model_id"), F.col("embedding").alias("vector"))


def frame_topk(spark: SparkSession, d: str) -> DataFrame:
    frames = spark.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 4).alias("attachment_id"), F.col("embedding").alias("vector"))
    return search.frame_search(frames, _query(spark, d), 20)


def message_mimes(spark: SparkSession, d: str) -> DataFrame:
    rows = messages.with_mime_types(_raw(spark, d).drop("mime_types"), _files(spark, d))
    return rows.select("id", F.array_join("mime_types", ",").alias("mimes"))


def flagged_media(spark: SparkSession, d: str) -> DataFrame:
    scored = _files(spark, d).withColumn("nsfw_score", F.conv(F.substring(F.hex("file_hash"), 1, 2), 16, 10).cast("double") / 255)
    return rounded(archive.flagged_media(scored, 0.7).select("id", "nsfw_score"))


def summary_checks(spark: SparkSession, d: str) -> DataFrame:
    kept = archive.dedupe_messages(_keyed(spark, d))
    summary = archive.import_summary(_raw(spark, d), kept, _files(spark, d), _raw(spark, d).where("direction = 0"))
    return archive.summary_checks(summary, kept, archive.dedupe_attachments(_files(spark, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{
        name: _of(name)
        for name in (
            "conversations", "contact_counts", "daily_activity", "hourly_activity", "response_stats", "response_histogram", "double_messages", "flow_nodes", "flow_links",
            "pair_metrics", "daily_points", "growth", "top_emojis", "recurring_phrases", "distinctive_phrases", "sentiment_daily", "focus", "rating", "insights",
        )
    },
    **{f"user_{name}": _of_users(name) for name in BY_USER},
    "sentiment_overall": lambda s, d: rounded(language.sentiment_overall(_dense(s, d))),
    "message_points": lambda s, d: rounded(points.message_points(messages.enriched(_dense(s, d))).select("contact_id", "rowid", "points")),
    "first_responses": lambda s, d: responses.responses(messages.enriched(_dense(s, d))).where("is_first").select("contact_id", "rowid", "sender", "response_ms"),
    "streaks": lambda s, d: activity.streaks(activity.daily_activity(_dense(s, d)), AS_OF),
    "heatmap_days": lambda s, d: rounded(activity.heatmap_days(activity.daily_activity(_dense(s, d)))),
    "heatmap_hours": lambda s, d: rounded(activity.heatmap_hours(activity.hourly_activity(_dense(s, d)))),
    "writing_totals": lambda s, d: rounded(activity.writing_totals(activity.contact_counts(_dense(s, d)))),
    "timeline": lambda s, d: activity.timeline(_raw(s, d), "week", "+1555"),
    "talk_counts": talk_counts,
    "talk_phrases": lambda s, d: language.recurring_phrases(language.phrase_counts(A.talk_messages(s, d))),
    "address_normalise": address_normalise,
    "media_categories": media_categories,
    "contact_list": lambda s, d: archive.contact_list(A.contacts(s, d), A.contact_addresses(s, d), _raw(s, d), 50),
    "auto_contacts": lambda s, d: archive.auto_contacts(_raw(s, d), A.contact_addresses(s, d).where("contact_id <> 'c1' and contact_id <> 'c4'")),
    "renamed_contacts": lambda s, d: archive.renamed_contacts(A.contacts(s, d).drop("n"), A.contact_addresses(s, d), _raw(s, d)),
    "duplicate_contacts": lambda s, d: archive.duplicate_contacts(A.contact_addresses(s, d).unionByName(A.contact_addresses(s, d).select(F.concat(F.lit("x"), "contact_id").alias("contact_id"), F.concat(F.lit(" "), F.substring("address", 3, 20)).alias("address")))),
    "stale_contacts": lambda s, d: archive.stale_contacts(_status(s, d), A.contact_addresses(s, d), _raw(s, d), LATE),
    "export_messages": lambda s, d: archive.export_messages(_raw(s, d), _files(s, d), since=SINCE, body_like="trip", address_like="+1555"),
    "export_attachments": lambda s, d: archive.export_attachments(_raw(s, d), _files(s, d), "image/png", since=SINCE),
    "latest_page": lambda s, d: archive.page(_raw(s, d), 50, 10).select("id", "timestamp_ms", "body"),
    "thread_messages": lambda s, d: archive.thread(_raw(s, d), A.contact_addresses(s, d), A.contacts(s, d), "alice"),
    "message_context": lambda s, d: archive.context(_raw(s, d), _raw(s, d).where("rowid % 97 = 0"), 2),
    "substring_search": lambda s, d: search.substring_search(_raw(s, d), "PIZZA movie").select("rowid", "timestamp_ms", "body"),
    "keyword_search": keyword_search,
    "vector_topk": lambda s, d: search.vector_search(s.read.parquet(f"{d}/embeddings.parquet"), _query(s, d), 20),
    "vector_stats": lambda s, d: vectors.vector_stats(s.read.parquet(f"{d}/embeddings.parquet")),
    "probe_labels": probe_labels,
    "attachment_labels": attachment_labels,
    "hash_embed": lambda s, d: _raw(s, d).select("id", F.transform(vectors.hash_vector(F.col("body"), 16), lambda x: F.round(x, 5)).alias("vector")).withColumn("vector", F.array_join(F.transform("vector", lambda x: F.format_string("%.5f", x)), ",")),
    "embed_backlog": lambda s, d: vectors.embed_backlog(_raw(s, d), _embedded(s, d), "m1", since=SINCE).select("id"),
    "model_coverage": lambda s, d: rounded(vectors.model_coverage(_raw(s, d), _embedded(s, d))),
    "dedupe_messages": lambda s, d: archive.dedupe_messages(_keyed(s, d)).select("id", "message_id"),
    "dedupe_attachments": lambda s, d: archive.dedupe_attachments(_files(s, d)).select("id", "message_id", "mime_type"),
    "reparented_attachments": lambda s, d: archive.reparented(_files(s, d), _keyed(s, d), archive.dedupe_messages(_keyed(s, d))).select("id", "message_id"),
    "duplicate_media": lambda s, d: archive.duplicate_media(_files(s, d)),
    "orphan_attachments": lambda s, d: archive.orphan_attachments(_files(s, d), _raw(s, d).where("rowid % 5 <> 0")).select("id", "message_id"),
    "unprocessed_media": lambda s, d: archive.unprocessed_media(_files(s, d), _files(s, d).where("mime_type = 'image/jpeg'").select(F.col("id").alias("attachment_id"))).select("id"),
    "quality_checks": lambda s, d: archive.quality_checks(_raw(s, d), _files(s, d), _keyed(s, d)),
    "import_summary": import_summary,
    "imported_messages": imported_messages,
    "imported_contacts": imported_contacts,
    "stored_search": stored_search,
    "live_conversations": live_conversations,
    "merged_messages": merged_messages,
    "media_files": media_files,
    "embedded_messages": embedded_messages,
    "talk_distinctive": talk_distinctive,
    "talk_sentiment": lambda s, d: rounded(language.sentiment_overall(A.talk_messages(s, d))),
    "exact_copies": exact_copies,
    "headline": _of("headline"),
    "message_mimes": message_mimes,
    "semantic_messages": lambda s, d: search.semantic_search(_raw(s, d), _vectors(s, d), "m1", _query(s, d), 20),
    "frame_topk": frame_topk,
    "message_search": lambda s, d: search.message_search(_raw(s, d), "weekend trip", None),
    "find_messages": lambda s, d: search.find_messages(_raw(s, d), "izza mov"),
    "export_search": lambda s, d: archive.export_search(_raw(s, d), _files(s, d), "weekend trip", since=SINCE).select("id", "timestamp_ms", "body", "type", "n_attachments", "score"),
    "flagged_media": flagged_media,
    "thread_by_phone": lambda s, d: archive.thread(_raw(s, d), A.contact_addresses(s, d), A.contacts(s, d), phone="1 (555) 000-0004", limit=1000).select("rowid", "timestamp_ms", "address"),
    "summary_checks": summary_checks,
    "purged_vectors": lambda s, d: vectors.purged(_vectors(s, d), vectors.without_model(_vectors(s, d).select("model_id", F.col("model_id").alias("name"), F.lit("1").alias("version")), "m2")).select("message_id", "model_id"),
}


# --- SQL ----------------------------------------------------------------------------------------------------------


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def _valence(tokens: str) -> str:
    """Sum of the valences of a list of words, turned after a negator."""
    lex = "MAP {" + ", ".join(f"{_lit(k)}: {v}" for k, v in lexicon.SENTIMENT.items()) + "}"
    neg = _list(lexicon.NEGATORS)
    return f"coalesce(list_sum(list_transform(range(1, len({tokens}) + 1), lambda i: coalesce(({lex})[{tokens}[i]], 0) * CASE WHEN i > 1 AND list_has_any({tokens}[greatest(1, i - 3):i - 1], {neg}) THEN -1 ELSE 1 END)), 0)::DOUBLE"


def _prefix(contact: str = "'c' || n") -> str:
    mime = " ".join(f"WHEN event_id % 11 = {k} THEN {_list(v)}" for k, v in A.MIMES.items())
    e = T.emoji_class()
    cluster = rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[{e}]\x{{FE0F}}?[\x{{1F3FB}}-\x{{1F3FF}}]?(?:\x{{200D}}[{e}]\x{{FE0F}}?)*"
    match = lambda pattern: f"regexp_matches(body, {_lit(pattern)})"
    stop = _list(lexicon.STOPWORDS)
    grams = lambda n: f"list_transform(list_filter(range(1, len(t) - {n} + 2), lambda i: NOT list_has_any(t[i:i + {n - 1}], {stop})), lambda i: array_to_string(t[i:i + {n - 1}], ' '))"
    cat = lambda x: f"CASE WHEN {x} = 'image/gif' THEN 'gif' WHEN {x} = 'application/ogg' THEN 'audio' WHEN {x} LIKE 'image/%' THEN 'image' WHEN {x} LIKE 'video/%' THEN 'video' WHEN {x} LIKE 'audio/%' THEN 'audio' ELSE 'other' END"
    return f"""
WITH raw AS (
  SELECT 'e' || event_id AS id, CASE WHEN event_id % 4 <> 0 THEN 'm' || (event_id // 2) END AS message_id, event_id AS rowid, epoch_us(ts) // 1000 AS timestamp_ms,
    '+1555000' || lpad((user_id % 10)::VARCHAR, 4, '0') || CASE WHEN user_id % 10 % 7 = 3 AND event_id % 5 = 0 THEN '~+15559999999' ELSE '' END AS address,
    event_id % 3 + 1 AS message_type, 't' || (user_id % 10) AS thread_id, user_id % 10 AS n, user_id,
    CASE WHEN event_id % 6 <> 0 THEN ({_list(A.NAMES)})[user_id % 10 + 1] END AS contact_name,
    CASE {mime} ELSE []::VARCHAR[] END AS mime,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 2 WHEN event_type = 'error' THEN 0 WHEN event_type = 'click' AND user_id % 10 % 3 = 0 THEN 2 ELSE 1 END AS direction,
    ({_list(A.PHRASES)})[(event_id + 7 * direction) % {len(A.PHRASES)} + 1] AS body
  FROM events),
person AS (SELECT 'c' || n AS contact_id, ({_list(A.NAMES)})[n + 1] AS display_name, n, '+1555000' || lpad(n::VARCHAR, 4, '0') AS address FROM (SELECT DISTINCT n FROM raw)),
file AS (
  SELECT 'a' || rowid || '-' || (k - 1) AS id, id AS message_id, rowid, mime[k] AS mime_type, sha256(mime[k] || '/' || (rowid % 500)) AS hash FROM raw, unnest(range(1, len(mime) + 1)) AS u(k)),
keyed AS (
  SELECT raw.*, coalesce(message_id, sha256(concat_ws(chr(31), address, timestamp_ms::VARCHAR, body, thread_id, coalesce(c, 0)::VARCHAR, coalesce(h, '')))) AS key
  FROM raw LEFT JOIN (SELECT message_id AS fid, count(*) AS c, string_agg(hash, ',' ORDER BY hash) AS h FROM file GROUP BY 1) ON fid = id),
kept AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY rowid) = 1),
msg AS (SELECT {contact} AS contact_id, rowid, timestamp_ms, CASE WHEN direction = 2 THEN 1 ELSE 2 END AS sender, body, mime FROM raw WHERE direction > 0 AND address NOT LIKE '%~%'),
feat AS (
  SELECT *, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') AS w, regexp_extract_all(body, {_lit(cluster)}) AS em, list_transform(mime, lambda x: {cat("x")}) AS cats,
    {match(T.LAUGH)} AS laugh, {match(T.APOLOGY)} AS apology, {match(T.QUESTION)} AS question, {match(T.ENCOURAGEMENT)} AS encouragement, {match(T.LINK)} AS link,
    strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d') AS day FROM msg),
lag1 AS (SELECT *, lag(timestamp_ms) OVER o AS prev_ts, lag(sender) OVER o AS prev_sender FROM feat WINDOW o AS (PARTITION BY contact_id ORDER BY timestamp_ms, rowid)),
lag2 AS (SELECT *, timestamp_ms - prev_ts AS gap, prev_ts IS NULL OR timestamp_ms - prev_ts > 14400000 AS fresh, coalesce(sender <> prev_sender, false) AS flip FROM lag1),
enr AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY contact_id ORDER BY timestamp_ms, rowid)::BIGINT AS conv_seq FROM lag2),
pts AS (
  SELECT *, 1 + 0.1 * ln(len(w) + 1) + 0.2 * len(em) + CASE WHEN question THEN 0.5 ELSE 0 END + CASE WHEN apology THEN 2 ELSE 0 END + CASE WHEN encouragement THEN 3 ELSE 0 END + CASE WHEN link THEN 2 ELSE 0 END
    + 3 * len(list_filter(cats, lambda x: x = 'image')) + 5 * len(list_filter(cats, lambda x: x = 'video')) + 4 * len(list_filter(cats, lambda x: x = 'audio')) + 2 * len(list_filter(cats, lambda x: x = 'gif'))
    + CASE WHEN fresh THEN 5 ELSE 0 END + CASE WHEN flip AND NOT fresh AND gap <= 60000 THEN 2 ELSE 0 END AS points FROM enr),
conv0 AS (
  SELECT contact_id, conv_seq, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, first(sender ORDER BY timestamp_ms, rowid) AS started_by, last(sender ORDER BY timestamp_ms, rowid) AS final_reply_by,
    count(*) FILTER (sender = 1) AS my_count, count(*) FILTER (sender = 2) AS their_count, count(*) AS total_count, sum(points) AS points FROM pts GROUP BY 1, 2),
conv1 AS (
  SELECT *, CASE WHEN my_count >= their_count THEN 1 ELSE 2 END AS major_contributor, my_count = 0 OR their_count = 0 AS is_missed, CASE WHEN my_count = 0 OR their_count = 0 THEN 3 - started_by END AS missed_by,
    start_ms - lag(end_ms) OVER (PARTITION BY contact_id ORDER BY conv_seq) AS reconnect_gap_ms FROM conv0),
cuts AS (SELECT contact_id, list_sort(list(total_count)) AS l, list_sort(list(reconnect_gap_ms) FILTER (reconnect_gap_ms > 0)) AS g FROM conv1 GROUP BY 1),
conv AS (
  SELECT conv1.*, total_count >= 20 AS is_big_moment_static, total_count >= greatest(10, l[least(len(l) * 90 // 100, len(l) - 1) + 1]) AS is_big_moment_dynamic,
    CASE WHEN reconnect_gap_ms IS NULL THEN 0 WHEN reconnect_gap_ms >= 2592000000 AND reconnect_gap_ms >= 3 * g[len(g) // 2 + 1] THEN 4 WHEN reconnect_gap_ms >= 2592000000 THEN 3
      WHEN reconnect_gap_ms >= 604800000 THEN 2 WHEN reconnect_gap_ms >= 86400000 THEN 1 ELSE 0 END AS reconnect_tier
  FROM conv1 JOIN cuts USING (contact_id)),
daily AS (
  SELECT contact_id, day, {", ".join(f"{f} AS {s}_{n}" for s, k in (("my", 1), ("their", 2)) for n, f in (("messages", f"count(*) FILTER (sender = {k})"), ("words", f"coalesce(sum(len(w)) FILTER (sender = {k}), 0)::BIGINT"), ("media", f"coalesce(sum(len(list_filter(cats, lambda x: x <> 'other'))) FILTER (sender = {k}), 0)::BIGINT")))} FROM feat GROUP BY 1, 2),
hourly AS (SELECT contact_id, dayofweek(make_timestamp(timestamp_ms * 1000))::INT AS weekday, hour(make_timestamp(timestamp_ms * 1000))::INT AS hour, count(*) AS n FROM msg GROUP BY 1, 2, 3),
counts0 AS (
  SELECT contact_id, {", ".join(f"{f} AS {s}_{n}" for s, k in (("my", 1), ("their", 2)) for n, f in [("messages", f"count(*) FILTER (sender = {k})"), *[(c, f"coalesce(sum({x}) FILTER (sender = {k}), 0)::BIGINT") for c, x in [("words", "len(w)"), ("chars", "length(body)"), ("emojis", "len(em)"), *[(c, f"len(list_filter(cats, lambda x: x = '{c}'))") for c in ("image", "video", "audio", "gif")], *[(c, f"{c}::INT") for c in ("link", "laugh", "apology", "question", "encouragement")]]]])} FROM feat GROUP BY 1),
uniq AS (SELECT contact_id, count(DISTINCT x) FILTER (sender = 1) AS my_unique_words, count(DISTINCT x) FILTER (sender = 2) AS their_unique_words FROM (SELECT contact_id, sender, unnest(list_transform(w, lambda x: lower(x))) AS x FROM feat) GROUP BY 1),
counts AS (SELECT * FROM counts0 JOIN uniq USING (contact_id)),
starts AS (SELECT contact_id, conv_seq, started_by FROM conv0),
reply0 AS (
  SELECT contact_id, rowid, sender, gap AS response_ms, started_by, row_number() OVER (PARTITION BY contact_id, conv_seq, sender ORDER BY timestamp_ms, rowid) AS k, hour(make_timestamp(prev_ts * 1000)) AS h
  FROM enr JOIN starts USING (contact_id, conv_seq) WHERE flip AND gap <= 86400000),
reply AS (
  SELECT *, CASE WHEN response_ms < 30000 THEN 0 WHEN response_ms < 60000 THEN 1 WHEN response_ms < 300000 THEN 2 WHEN response_ms < 900000 THEN 3 WHEN response_ms < 3600000 THEN 4 WHEN response_ms < 21600000 THEN 5 WHEN response_ms < 86400000 THEN 6 ELSE 7 END AS bucket,
    response_ms <= 60000 AS is_rapid, response_ms >= 28800000 OR (response_ms >= 14400000 AND (h >= 23 OR h < 7)) AS is_overnight, started_by <> sender AND k = 1 AS is_first FROM reply0),
lists AS (
  SELECT contact_id, sender, count(*) AS n_replies, sum(response_ms)::BIGINT // count(*) AS mean_ms, sum(response_ms) FILTER (is_first)::BIGINT // count(*) FILTER (is_first) AS mean_first_ms, avg(is_rapid::INT) AS rapid_share,
    list_sort(list(response_ms)) AS a, list_sort(list(response_ms) FILTER (is_first)) AS b, list_sort(list(response_ms) FILTER (NOT is_overnight)) AS c, list_sort(list(response_ms) FILTER (is_overnight)) AS d FROM reply GROUP BY 1, 2),
stats AS (
  SELECT contact_id, sender, n_replies, mean_ms, mean_first_ms, rapid_share, {", ".join(f"({x}[(len({x}) + 1) // 2] + {x}[len({x}) // 2 + 1])::BIGINT // 2 AS {n}" for x, n in (("a", "median_ms"), ("b", "median_first_ms"), ("c", "median_awake_ms"), ("d", "median_overnight_ms")))} FROM lists),
resp AS (SELECT contact_id, {", ".join(f"max(median{m}_ms) FILTER (sender = {k}) AS {s}_median{m}_ms" for s, k in (("my", 1), ("their", 2)) for m in ("", "_first"))} FROM stats GROUP BY 1),
pair AS (
  SELECT contact_id, count(*) AS n_conversations, count(*) FILTER (started_by = 1) AS started_by_me, count(*) FILTER (started_by = 2) AS started_by_them, count(*) FILTER (NOT is_missed AND final_reply_by = 1) AS closed_by_me,
    count(*) FILTER (NOT is_missed AND final_reply_by = 2) AS closed_by_them, count(*) FILTER (missed_by = 1) AS missed_by_me, count(*) FILTER (missed_by = 2) AS missed_by_them,
    {", ".join(f"count(*) FILTER (reconnect_tier = {k}) AS reconnects_{k}" for k in (1, 2, 3, 4))}, avg(total_count) AS avg_length, median(total_count)::DOUBLE AS median_length, avg(points) AS avg_points,
    CASE WHEN sum(my_count) > sum(their_count) THEN 1 WHEN sum(their_count) > sum(my_count) THEN 2 END AS top_contributor, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM conv GROUP BY 1),
dpts AS (SELECT contact_id, day, coalesce(sum(points) FILTER (sender = 1), 0) AS my_points, coalesce(sum(points) FILTER (sender = 2), 0) AS their_points FROM pts GROUP BY 1, 2),
talk AS (
  SELECT 'k' || (conv_id // 10) AS contact_id, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS sender, coalesce(text, '') AS body FROM conversations WHERE role IN ('user', 'assistant')),
tok AS (SELECT 'e' AS src, contact_id, body FROM msg UNION ALL SELECT 't', contact_id, body FROM talk),
tok2 AS (SELECT src, contact_id, list_filter(list_transform(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '[^\\pL\\pN'']', '', 'g'))), lambda x: strlen(x) >= 3 AND NOT regexp_full_match(x, '\\pN+')) AS t FROM tok),
phr AS (SELECT src, contact_id, phrase, count(*) AS n FROM (SELECT src, contact_id, unnest(list_concat({grams(2)}, {grams(3)})) AS phrase FROM tok2) GROUP BY 1, 2, 3),
bare AS (SELECT contact_id, sender, day, list_filter(list_transform(w, lambda x: lower(regexp_replace(x, '[^\\pL'']', '', 'g'))), lambda x: x <> '') AS t FROM feat),
sent AS (
  SELECT contact_id, sender, day, {_valence('t')} AS s FROM bare)
"""


def _six(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _flow(select: str) -> str:
    return f"""
, step AS (
  SELECT contact_id, is_missed, CASE WHEN started_by = 1 THEN 'started_me' ELSE 'started_them' END AS a, CASE WHEN is_missed THEN 'no_reply' WHEN is_big_moment_static OR is_big_moment_dynamic THEN 'big_moment' ELSE 'everyday' END AS b,
    CASE WHEN major_contributor = 1 THEN 'contrib_me' ELSE 'contrib_them' END AS c, CASE WHEN final_reply_by = 1 THEN 'final_me' ELSE 'final_them' END AS d FROM conv)
{select}"""


_MEDIA = {s: f"({s}_image + {s}_video + {s}_audio + {s}_gif)" for s in ("my", "their")}


def _even(a: str, b: str) -> str:
    return f"(CASE WHEN {a} + {b} = 0 THEN 0.5 ELSE least(1.0, least({a}, {b}) / (({a} + {b}) / 2.0)) END)"


def _mean_even(pairs: list[tuple[str, str]], least: int) -> str:
    n = " + ".join(f"({a} + {b} >= {least})::INT" for a, b in pairs)
    total = " + ".join(f"CASE WHEN {a} + {b} >= {least} THEN {_even(a, b)} ELSE 0 END" for a, b in pairs)
    return f"CASE WHEN {n} = 0 THEN 50 ELSE round(100 * ({total}) / ({n}))::INT END"


def _rating_sql() -> str:
    parts = ["responsiveness", "balance", "engagement", "consistency", "reciprocity", "longevity", "mutual_effort"]
    weights = (20, 15, 15, 15, 10, 10, 15)
    both = lambda n: (f"my_{n}", f"their_{n}")
    return f"""
, dd AS (SELECT contact_id, (day::DATE - DATE '1970-01-01')::BIGINT AS d, my_messages + their_messages AS n FROM daily),
ends AS (SELECT contact_id, min(d) AS lo, max(d) AS hi, count(*) AS days FROM dd GROUP BY 1),
wk AS (SELECT contact_id, unnest(range(lo // 7, hi // 7 + 1)) AS w FROM ends),
wk2 AS (SELECT wk.contact_id, w, coalesce(sum(n), 0) * 7.0 / (least(7 * w + 6, any_value(hi)) - greatest(7 * w, any_value(lo)) + 1) AS x, any_value(days) AS days FROM wk JOIN ends USING (contact_id) LEFT JOIN dd ON dd.contact_id = wk.contact_id AND dd.d // 7 = w GROUP BY 1, 2),
cons AS (SELECT contact_id, CASE WHEN any_value(days) < 7 OR count(*) < 4 OR count(*) > 5300 THEN 50 WHEN avg(x) <= 0 THEN 0 ELSE round(greatest(0, least(100, (1 - stddev_pop(x) / avg(x) / 2) * 100)))::INT END AS consistency FROM wk2 GROUP BY 1),
j AS (
  SELECT *, (my_median_ms IS NOT NULL)::INT + (their_median_ms IS NOT NULL)::INT AS k, my_messages + their_messages AS total, {_MEDIA["my"]} AS my_media, {_MEDIA["their"]} AS their_media, (last_ms - first_ms) / 86400000.0 AS age
  FROM counts JOIN pair USING (contact_id) LEFT JOIN resp USING (contact_id) JOIN cons USING (contact_id)),
j2 AS (SELECT *, (coalesce(my_median_ms, 0) + coalesce(their_median_ms, 0))::BIGINT // greatest(k, 1) AS m FROM j),
r AS (
  SELECT contact_id, total, consistency,
    CASE WHEN k = 0 THEN 50 ELSE floor(greatest(0, CASE WHEN m <= 0 THEN 100 WHEN m <= 300000 THEN 100 - m / 300000.0 * 20 WHEN m <= 3600000 THEN 80 - (m - 300000) / 3300000.0 * 30 WHEN m <= 21600000 THEN 50 - (m - 3600000) / 18000000.0 * 50 ELSE 0 END))::INT END AS responsiveness,
    CASE WHEN total = 0 THEN 50 ELSE round(60 * {_even(*both("messages"))} + 40 * {_even("started_by_me", "started_by_them")})::INT END AS balance,
    round(least(100, 0.7 * least(90, 3 * avg_length) + 0.3 * CASE WHEN total > 0 THEN least(100, 500.0 * (my_media + their_media) / total) ELSE 0 END))::INT AS engagement,
    {_mean_even([both("question"), both("media"), both("encouragement")], 11)} AS reciprocity,
    CASE WHEN last_ms <= first_ms THEN 0 ELSE round(CASE WHEN age < 30 THEN 10 WHEN age < 180 THEN 25 WHEN age < 365 THEN 25 + (age - 180) / 185 * 25 WHEN age < 1825 THEN 50 + (age - 365) / 1460 * 50 ELSE 100 END)::INT END AS longevity,
    {_mean_even([both("apology"), both("encouragement"), both("question")], 10)} AS mutual_effort FROM j2)
SELECT contact_id, {", ".join(parts)}, round(({" + ".join(f"{p} * {w}" for p, w in zip(parts, weights, strict=True))}) / 100.0)::INT AS overall, CASE WHEN total < 50 THEN 'hidden' WHEN total <= 200 THEN 'limited' ELSE 'full' END AS confidence FROM r"""


def _insights_sql() -> str:
    from missivelake.operators.insights import COMPARED, FASTER, MORE

    tier = lambda r: f"CASE WHEN {r} >= 3 THEN 4 WHEN {r} >= 2 THEN 3 WHEN {r} >= 1.5 THEN 2 WHEN {r} >= 1.2 THEN 1 END"
    trust = lambda n: f"CASE WHEN {n} < 50 THEN NULL WHEN {n} < 100 THEN 0 WHEN {n} < 500 THEN 1 ELSE 2 END"
    span = lambda ms: f"CASE WHEN {ms} // 1000 < 60 THEN {ms} // 1000 || 's' WHEN {ms} // 1000 < 3600 THEN {ms} // 60000 || 'm' WHEN {ms} // 1000 < 86400 THEN {ms} // 3600000 || 'h' ELSE {ms} // 86400000 || 'd' END"
    count = lambda a, b: f"CASE WHEN abs({a} - {b}) >= floor(greatest(50, ({a} + {b}) * 0.01)) THEN CASE WHEN least({a}, {b}) = 0 THEN 4 ELSE {tier(f'(greatest({a}, {b}) / least({a}, {b}))')} END END"
    rules = []
    for name, (verb, a, b) in COMPARED.items():
        detail = f"CASE WHEN least({a}, {b}) = 0 THEN {a} || ' vs ' || {b} || ' (entirely one-sided)' ELSE printf('%.2f', greatest({a}, {b}) / least({a}, {b})) || '× as often (' || {a} || ' vs ' || {b} || ', +' || round(abs({a} - {b}) * 100.0 / least({a}, {b}))::BIGINT || '%)' END"
        text = f"CASE WHEN {a} > {b} THEN 'You' ELSE 'They' END || ' {verb} ' || ({_list(MORE)})[tier] || ' than ' || CASE WHEN {a} > {b} THEN 'they do' ELSE 'you do' END"
        rules.append(f"SELECT contact_id, '{name}' AS id, CASE WHEN {a} > {b} THEN 0 ELSE 1 END AS category, {trust(f'({a} + {b})')} AS confidence, tier, {text} AS headline, {detail} AS detail FROM (SELECT *, {count(a, b)} AS tier FROM j)")
    for name, m, sample, label, tail in (
        ("response_speed", "median", "(my_messages + their_messages)", "median", None),
        ("first_response_speed", "median_first", "(started_by_me + started_by_them)", "first-response median", "' when new conversations begin'"),
    ):
        a, b = f"my_{m}_ms", f"their_{m}_ms"
        end = tail or f"' than ' || CASE WHEN {a} < {b} THEN 'they do' ELSE 'you do' END"
        text = f"CASE WHEN {a} < {b} THEN 'You' ELSE 'They' END || ' respond ' || ({_list(FASTER)})[tier] || {end}"
        detail = f"printf('%.2f', greatest({a}, {b}) / least({a}, {b})) || '× faster ({label} ' || {span(a)} || ' vs ' || {span(b)} || ')'"
        rules.append(f"SELECT contact_id, '{name}', CASE WHEN {a} < {b} THEN 0 ELSE 1 END, {trust(sample)}, tier, {text}, {detail} FROM (SELECT *, CASE WHEN {a} > 0 AND {b} > 0 THEN {tier(f'(greatest({a}, {b}) / least({a}, {b}))')} END AS tier FROM j)")
    for name, a, b, text, verb in (("endings_even", "closed_by_me", "closed_by_them", "Conversation endings are evenly shared", "closed"), ("missed_even", "missed_by_me", "missed_by_them", "Your missed conversations are evenly matched", "missed")):
        rules.append(f"SELECT contact_id, '{name}', 2, {trust(f'({a} + {b})')}, CASE WHEN {count(a, b)} IS NULL THEN 2 END, '{text}', 'You {verb} ' || {a} || ', they {verb} ' || {b} FROM j")
    back = "(reconnects_1 + reconnects_2 + reconnects_3 + reconnects_4)"
    rules.append(f"SELECT contact_id, 'rarely_reconnect', 2, {trust('n_conversations')}, CASE WHEN {back} / n_conversations < 0.05 THEN 2 END, 'You rarely reconnect after long silences', {back} || CASE WHEN {back} = 1 THEN ' reconnect' ELSE ' reconnects' END || ' out of ' || n_conversations || ' conversations (' || printf('%.1f', {back} * 100.0 / n_conversations) || '%)' FROM j")
    return f"""
, j AS (SELECT * FROM counts JOIN pair USING (contact_id) LEFT JOIN resp USING (contact_id)),
i AS ({" UNION ALL ".join(rules)}),
k AS (SELECT *, row_number() OVER (PARTITION BY contact_id, category ORDER BY confidence DESC, tier DESC, id)::INT AS rank FROM i WHERE tier IS NOT NULL AND confidence IS NOT NULL)
SELECT contact_id, id, (['your_side', 'their_side', 'shared'])[category + 1] AS category, (['low', 'medium', 'high'])[confidence + 1] AS confidence, tier, headline, detail, rank FROM k"""


def _focus_sql() -> str:
    hits = lambda p: f"len(regexp_extract_all(body, {_lit(p)}))"
    return f"""
, first_name AS (SELECT contact_id, lower(regexp_replace(split_part(display_name, ' ', 1), '[^\\pL\\pN'']', '', 'g')) AS name FROM person),
names AS (SELECT contact_id, name FROM first_name WHERE strlen(name) >= 2),
owners AS (SELECT name, count(*) AS k FROM names GROUP BY 1),
said AS (SELECT contact_id, unnest(regexp_split_to_array(lower(body), '[^\\pL\\pN_'']+')) AS name FROM msg),
other AS (SELECT s.contact_id, count(*) AS o FROM said s JOIN owners USING (name) LEFT JOIN names n ON n.name = s.name AND n.contact_id = s.contact_id WHERE n.name IS NULL OR k > 1 GROUP BY 1),
me AS (SELECT contact_id, sum(CASE WHEN sender = 1 THEN {hits(T.ABOUT_ME)} ELSE {hits(T.ABOUT_YOU)} END) AS a, sum(CASE WHEN sender = 1 THEN {hits(T.ABOUT_YOU)} ELSE {hits(T.ABOUT_ME)} END) AS b FROM msg GROUP BY 1)
SELECT contact_id, round(CASE WHEN a + b + coalesce(o, 0) > 0 THEN a / (a + b + coalesce(o, 0)) ELSE 0 END, 6) AS focus_me, round(CASE WHEN a + b + coalesce(o, 0) > 0 THEN b / (a + b + coalesce(o, 0)) ELSE 0 END, 6) AS focus_them,
  round(CASE WHEN a + b + coalesce(o, 0) > 0 THEN coalesce(o, 0) / (a + b + coalesce(o, 0)) ELSE 0 END, 6) AS focus_other FROM me LEFT JOIN other USING (contact_id)"""


def _keyword_sql() -> str:
    terms = KEYWORDS.split()
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(terms)))
    return f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda x: x <> '') AS t FROM documents),
f AS (SELECT doc_id, len(t) AS l, {tf} FROM t),
s AS (SELECT count(*) AS n, avg(l) AS a, {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))} FROM f)
SELECT doc_id, round({score}, 6) AS score FROM f, s WHERE {" AND ".join(f"f{i} > 0" for i in range(len(terms)))}"""


def _probe_sql() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE len(embedding) = 64),
u AS (SELECT vec_id, CASE WHEN list_dot_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS u FROM v),
z AS (SELECT vec_id, list_dot_product(u, list_transform(range(0, 64), lambda k: CASE WHEN k % 2 = 1 THEN 0.5 ELSE -0.25 END::DOUBLE)) + 0.3 - list_dot_product(u, list_transform(range(0, 64), lambda k: 0.1::DOUBLE)) AS z FROM u),
p AS (SELECT vec_id, round(1 / (1 + exp(-z)), 6) AS score FROM z),
probe AS (SELECT *, CASE WHEN score >= 0.85 THEN 'EXPLICIT' WHEN score >= 0.7 THEN 'NSFW' WHEN score >= 0.55 THEN 'SUGGESTIVE' WHEN score >= 0.4 THEN 'QUESTIONABLE' ELSE 'SAFE' END AS label FROM p)
"""


def oracles() -> dict[str, str]:
    p = _prefix()
    conv_columns = "contact_id, conv_seq, start_ms, end_ms, started_by, final_reply_by, my_count, their_count, total_count, major_contributor, is_missed, missed_by, reconnect_gap_ms, is_big_moment_static, is_big_moment_dynamic, reconnect_tier, round(points, 6) AS points"
    label = "CASE message_type WHEN 2 THEN 'mms' WHEN 3 THEN 'rcs' ELSE 'sms' END"
    near = """, v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 0),
best AS (
  SELECT vec_id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 6) AS score FROM v, q
  WHERE vec_id % 4 <> 3 AND 'e' || vec_id IN (SELECT id FROM raw) ORDER BY score DESC, vec_id::VARCHAR LIMIT 20)"""
    cut = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '')"
    tf = lambda w: f"len(list_filter(t, lambda x: x = '{w}'))"
    part = lambda k: f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * size / mean))"
    found = f""", tk AS (SELECT id, {cut("body")} || {cut("address")} AS t FROM raw),
tf AS (SELECT id, len(t) AS size, {tf("weekend")} AS f0, {tf("trip")} AS f1 FROM tk),
st AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM tf),
found AS (SELECT id, round({part(0)} + {part(1)}, 6) AS score FROM tf, st WHERE f0 > 0 AND f1 > 0)"""
    on_p = {
        "conversations": f"SELECT {conv_columns} FROM conv",
        "contact_counts": "SELECT * FROM counts",
        "daily_activity": "SELECT * FROM daily",
        "hourly_activity": "SELECT * FROM hourly",
        "response_stats": f"SELECT * REPLACE ({_six('rapid_share')}) FROM stats",
        "response_histogram": "SELECT contact_id, sender, bucket, count(*) AS n FROM reply GROUP BY 1, 2, 3",
        "double_messages": "SELECT contact_id, count(*) FILTER (sender = 1) AS my_doubles, count(*) FILTER (sender = 2) AS their_doubles FROM enr WHERE NOT flip AND NOT fresh GROUP BY 1",
        "flow_nodes": _flow("SELECT contact_id, (k - 1)::INT AS flow_column, l[k] AS node, count(*) AS n FROM (SELECT contact_id, CASE WHEN is_missed THEN [a, b] ELSE [a, b, c, d] END AS l FROM step), unnest(range(1, len(l) + 1)) AS u(k) GROUP BY 1, 2, 3"),
        "flow_links": _flow("SELECT contact_id, source, target, count(*) AS n FROM (SELECT contact_id, a AS source, b AS target FROM step UNION ALL SELECT contact_id, b, c FROM step WHERE NOT is_missed UNION ALL SELECT contact_id, c, d FROM step WHERE NOT is_missed) GROUP BY 1, 2, 3"),
        "pair_metrics": f"SELECT * REPLACE ({_six('avg_length', 'median_length', 'avg_points')}) FROM pair",
        "daily_points": f"SELECT contact_id, day, {_six('my_points', 'their_points')} FROM dpts",
        "growth": "SELECT contact_id, day, round(sum(my_points) OVER w, 6) AS my_total, round(sum(their_points) OVER w, 6) AS their_total FROM dpts WINDOW w AS (PARTITION BY contact_id ORDER BY day)",
        "top_emojis": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contact_id, sender ORDER BY n DESC, emoji)::INT AS rank FROM (SELECT contact_id, sender, emoji, count(*) AS n FROM (SELECT contact_id, sender, unnest(em) AS emoji FROM feat) GROUP BY 1, 2, 3)) WHERE rank <= 10",
        "recurring_phrases": "SELECT * FROM (SELECT contact_id, phrase, n, row_number() OVER (PARTITION BY contact_id ORDER BY n DESC, phrase)::INT AS rank FROM phr WHERE src = 'e' AND n >= 3) WHERE rank <= 20",
        "talk_phrases": "SELECT * FROM (SELECT contact_id, phrase, n, row_number() OVER (PARTITION BY contact_id ORDER BY n DESC, phrase)::INT AS rank FROM phr WHERE src = 't' AND n >= 3) WHERE rank <= 20",
        "distinctive_phrases": ", own AS (SELECT contact_id, count(*) AS o FROM msg WHERE body <> '' GROUP BY 1), uses AS (SELECT phrase, sum(n) AS u FROM phr WHERE src = 'e' GROUP BY 1), sc AS (SELECT contact_id, phrase, n, round(n * ln((greatest((SELECT sum(o) FROM own) - o, 1) + 1) / (u - n + 1)), 6) AS score FROM phr JOIN uses USING (phrase) JOIN own USING (contact_id) WHERE src = 'e' AND n >= 3) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY score DESC, phrase)::INT AS rank FROM sc) WHERE rank <= 30",
        "sentiment_daily": "SELECT contact_id, day, round(avg(s) FILTER (sender = 1), 6) AS my_sentiment, round(avg(s) FILTER (sender = 2), 6) AS their_sentiment FROM sent GROUP BY 1, 2",
        "sentiment_overall": "SELECT contact_id, round(avg(s) FILTER (sender = 1), 6) AS my_sentiment, round(avg(s) FILTER (sender = 2), 6) AS their_sentiment, round(avg(s), 6) AS sentiment FROM sent GROUP BY 1",
        "focus": _focus_sql(),
        "rating": _rating_sql(),
        "insights": _insights_sql(),
        "message_points": "SELECT contact_id, rowid, round(points, 6) AS points FROM pts",
        "first_responses": "SELECT contact_id, rowid, sender, response_ms FROM reply WHERE is_first",
        "streaks": f", a AS (SELECT DISTINCT contact_id, day::DATE AS d FROM daily), lastd AS (SELECT contact_id, min(d) AS lo, max(d) AS hi FROM a GROUP BY 1), al AS (SELECT contact_id, unnest(generate_series(lo, greatest(hi, DATE '{AS_OF}'), INTERVAL 1 DAY))::DATE AS d FROM lastd), fl AS (SELECT al.contact_id, al.d, a.d IS NOT NULL AS act FROM al LEFT JOIN a ON a.contact_id = al.contact_id AND a.d = al.d), gr AS (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY d) - row_number() OVER (PARTITION BY contact_id, act ORDER BY d) AS g FROM fl), ru AS (SELECT contact_id, act, g, count(*) AS n, max(d) AS e FROM gr GROUP BY 1, 2, 3) SELECT contact_id, max(n) FILTER (act) AS longest_active, coalesce(max(n) FILTER (NOT act), 0) AS longest_silent, CASE WHEN arg_max(act, e) THEN arg_max(n, e) ELSE 0 END AS current_active, CASE WHEN arg_max(act, e) THEN 0 ELSE arg_max(n, e) END AS current_silent FROM ru GROUP BY 1",
        "heatmap_days": "SELECT contact_id, day, n, round(n / max(n) OVER (PARTITION BY contact_id), 6) AS intensity FROM (SELECT contact_id, day, my_messages + their_messages AS n, row_number() OVER (PARTITION BY contact_id ORDER BY day DESC) AS r FROM daily) WHERE r <= 500 AND n > 0",
        "heatmap_hours": ", mx AS (SELECT contact_id, max(n) AS m FROM hourly GROUP BY 1) SELECT mx.contact_id, d::INT AS weekday, h::INT AS hour, coalesce(n, 0) AS n, round(coalesce(n, 0) / m, 6) AS intensity FROM mx, range(7) AS a(d), range(24) AS b(h) LEFT JOIN hourly y ON y.contact_id = mx.contact_id AND y.weekday = d AND y.hour = h",
        "writing_totals": "SELECT contact_id, my_chars + their_chars AS chars, my_words + their_words AS words, round((my_chars + their_chars) / 440000, 6) AS books FROM counts",
        "timeline": "SELECT strftime(date_trunc('week', make_timestamp(timestamp_ms * 1000)), '%Y-%m-%d') AS bucket, count(*) AS n FROM raw WHERE address ILIKE '%+1555%' GROUP BY 1",
        "talk_counts": ", tw AS (SELECT contact_id, sender, body, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') AS w FROM talk), tu AS (SELECT contact_id, count(DISTINCT x) FILTER (sender = 1) AS my_unique_words, count(DISTINCT x) FILTER (sender = 2) AS their_unique_words FROM (SELECT contact_id, sender, unnest(list_transform(w, lambda x: lower(x))) AS x FROM tw) GROUP BY 1) SELECT contact_id, count(*) FILTER (sender = 1) AS my_messages, coalesce(sum(len(w)) FILTER (sender = 1), 0)::BIGINT AS my_words, coalesce(sum(length(body)) FILTER (sender = 1), 0)::BIGINT AS my_chars, any_value(my_unique_words) AS my_unique_words, count(*) FILTER (sender = 2) AS their_messages, coalesce(sum(len(w)) FILTER (sender = 2), 0)::BIGINT AS their_words, coalesce(sum(length(body)) FILTER (sender = 2), 0)::BIGINT AS their_chars, any_value(their_unique_words) AS their_unique_words FROM tw LEFT JOIN tu USING (contact_id) GROUP BY 1",
        "address_normalise": ", d AS (SELECT DISTINCT address, regexp_replace(address, '[^0-9+]', '', 'g') AS b, regexp_replace(address, '[^0-9]', '', 'g') AS k FROM raw) SELECT address, CASE WHEN regexp_full_match(b, '\\+1[0-9]{10}') THEN b[3:] ELSE b END AS normal, CASE WHEN length(k) = 11 AND k LIKE '1%' THEN k[2:] WHEN address LIKE '+%' THEN '+' || k ELSE k END AS phone FROM d",
        "media_categories": "SELECT CASE WHEN mime_type = 'image/gif' THEN 'gif' WHEN mime_type = 'application/ogg' THEN 'audio' ELSE split_part(mime_type, '/', 1) END AS category, count(*) AS n FROM file GROUP BY 1",
        "contact_list": "SELECT contact_id, display_name, count(raw.id) AS n_messages FROM person LEFT JOIN raw USING (address) GROUP BY 1, 2 HAVING count(raw.id) >= 50",
        "auto_contacts": "SELECT sha256(address) AS contact_id, address, coalesce(arg_max(contact_name, (timestamp_ms, rowid)) FILTER (contact_name IS NOT NULL), address) AS display_name, 'auto' AS source FROM raw WHERE address NOT LIKE '%~%' AND n IN (1, 4) GROUP BY address",
        "renamed_contacts": "SELECT contact_id, coalesce(arg_max(contact_name, (timestamp_ms, raw.rowid)) FILTER (contact_name IS NOT NULL), any_value(display_name)) AS display_name FROM person LEFT JOIN raw USING (address) GROUP BY 1",
        "duplicate_contacts": "SELECT substr(address, 3) AS phone, 2::BIGINT AS n, contact_id || ',x' || contact_id AS contacts FROM person",
        "stale_contacts": f", tc AS (SELECT DISTINCT 'c' || n AS contact_id FROM raw WHERE address NOT LIKE '%~%' AND timestamp_ms >= {LATE}) SELECT contact_id, CASE WHEN n % 2 = 0 THEN 1::BIGINT END AS computed_at, CASE WHEN tc.contact_id IS NOT NULL THEN 1 ELSE 0 END AS is_stale FROM person LEFT JOIN tc USING (contact_id) WHERE n % 2 = 0 OR tc.contact_id IS NOT NULL",
        "export_messages": f"SELECT id, timestamp_ms, address, body, thread_id, {label} AS type, coalesce(c, 0) AS n_attachments, coalesce(paths, '') AS paths FROM raw LEFT JOIN (SELECT message_id AS fid, count(*) AS c, string_agg('media/' || hash[:8], ';' ORDER BY hash[:8]) AS paths FROM file GROUP BY 1) ON fid = id WHERE timestamp_ms >= {SINCE} AND body ILIKE '%trip%' AND address ILIKE '%+1555%'",
        "export_attachments": f"SELECT file.id AS attachment_id, file.message_id, timestamp_ms, address, mime_type, 'media/' || hash[:8] AS file_path, hash FROM file JOIN raw ON raw.id = file.message_id WHERE mime_type = 'image/png' AND timestamp_ms >= {SINCE}",
        "latest_page": "SELECT id, timestamp_ms, body FROM raw ORDER BY timestamp_ms DESC, id LIMIT 50 OFFSET 10",
        "thread_messages": "SELECT rowid, timestamp_ms, address, body AS preview FROM raw WHERE n IN (0, 2) AND address NOT LIKE '%~%' ORDER BY timestamp_ms DESC, rowid LIMIT 50",
        "message_context": ", pl AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY timestamp_ms, rowid) AS k FROM raw) SELECT a.rowid AS anchor, b.rowid, b.timestamp_ms, b.body FROM pl a JOIN pl b ON a.thread_id = b.thread_id AND b.k BETWEEN a.k - 2 AND a.k + 2 WHERE a.rowid % 97 = 0",
        "substring_search": "SELECT rowid, timestamp_ms, body FROM raw WHERE body ILIKE '%PIZZA movie%' ORDER BY timestamp_ms DESC, rowid LIMIT 20",
        "embed_backlog": f"SELECT id FROM raw WHERE rowid % 3 <> 0 AND body <> '' AND timestamp_ms >= {SINCE}",
        "model_coverage": "SELECT 'm1' AS model_id, count(*) FILTER (rowid % 3 = 0) AS embedded, round(100.0 * count(*) FILTER (rowid % 3 = 0) / count(*), 6) AS percent FROM raw",
        "dedupe_messages": "SELECT id, message_id FROM kept",
        "dedupe_attachments": "SELECT id, message_id, mime_type FROM file QUALIFY row_number() OVER (PARTITION BY message_id, hash ORDER BY id) = 1",
        "reparented_attachments": "SELECT file.id, kept.id AS message_id FROM file JOIN keyed ON keyed.id = file.message_id JOIN kept USING (key)",
        "duplicate_media": "SELECT hash, count(*) AS n, min(id) AS first_id FROM file GROUP BY 1 HAVING count(*) > 1",
        "orphan_attachments": "SELECT id, message_id FROM file WHERE rowid % 5 = 0",
        "unprocessed_media": "SELECT id FROM file WHERE (mime_type LIKE 'image/%' OR mime_type LIKE 'video/%') AND (mime_type <> 'image/jpeg' OR rowid % 2 <> 0)",
        "quality_checks": ", q AS (SELECT count(*) AS n, count(DISTINCT id) AS i, count(DISTINCT key) AS k, count(*) FILTER (timestamp_ms > 0) AS d, count(*) FILTER (address <> '') AS a FROM keyed) SELECT *, expected = actual AS ok FROM (SELECT 'unique_ids' AS \"check\", n AS expected, i AS actual FROM q UNION ALL SELECT 'unique_keys', n, k FROM q UNION ALL SELECT 'dated', n, d FROM q UNION ALL SELECT 'addressed', n, a FROM q UNION ALL SELECT 'orphan_attachments', 0, 0)",
        "headline": "SELECT contact_id, display_name, my_messages, their_messages, my_words, their_words, n_conversations, started_by_me, started_by_them FROM person JOIN counts USING (contact_id) JOIN pair USING (contact_id)",
        "message_mimes": "SELECT id, array_to_string(list_sort(mime), ',') AS mimes FROM raw",
        "semantic_messages": f"{near} SELECT id, timestamp_ms, address, body, score FROM best JOIN raw ON id = 'e' || vec_id",
        "message_search": f"{found} SELECT id, score FROM found",
        "find_messages": "SELECT id, NULL::DOUBLE AS score FROM raw WHERE body ILIKE '%izza mov%' ORDER BY timestamp_ms DESC, rowid LIMIT 20",
        "export_search": f"{found} SELECT id, timestamp_ms, body, {label} AS type, coalesce(c, 0) AS n_attachments, score FROM found JOIN raw USING (id) LEFT JOIN (SELECT message_id AS fid, count(*) AS c FROM file GROUP BY 1) ON fid = id WHERE timestamp_ms >= {SINCE}",
        "flagged_media": "SELECT id, round(('0x' || hash[:2])::BIGINT / 255.0, 6) AS nsfw_score FROM file WHERE ('0x' || hash[:2])::BIGINT / 255.0 >= 0.7",
        "thread_by_phone": "SELECT rowid, timestamp_ms, address FROM raw WHERE n = 4 AND address NOT LIKE '%~%' ORDER BY timestamp_ms DESC, rowid LIMIT 1000",
        "summary_checks": ", s AS (SELECT (SELECT count(*) FROM kept) AS k, (SELECT count(*) FROM file) AS f, (SELECT count(*) FROM (SELECT DISTINCT message_id, hash FROM file)) AS d) SELECT 'messages' AS \"check\", k AS expected, k AS actual, true AS ok FROM s UNION ALL SELECT 'attachments', f, d, f = d FROM s",
        "purged_vectors": ", pv AS (SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 3) SELECT 'e' || vec_id AS message_id, 'm1' AS model_id FROM pv",
    }
    # A message without an id is known by what it holds, as in archive.with_dedupe_key; a backup has no numbers of rows.
    holds = f"CASE WHEN rowid % {A.UNDECODABLE} = 0 THEN '' ELSE array_to_string(list_transform(list_sort(mime), lambda x: x || '/' || (rowid % 500)), ',') END"
    imp = f""", fine AS (SELECT * FROM raw WHERE rowid % {A.BROKEN} <> 0),
digits AS (SELECT *, regexp_replace(address, '[^0-9+]', '', 'g') AS bare FROM fine),
numbered AS (SELECT *, CASE WHEN regexp_full_match(bare, '\\+1[0-9]{{10}}') THEN bare[3:] ELSE bare END AS number FROM digits),
known AS (SELECT *, coalesce(message_id, concat_ws(chr(31), number, timestamp_ms::VARCHAR, body, thread_id, {holds})) AS k FROM numbered),
once AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY k ORDER BY timestamp_ms, rowid) = 1)"""
    on_p["import_summary"] = f"{imp} SELECT (SELECT count(*) FROM fine) AS seen, (SELECT count(*) FROM once) AS inserted, (SELECT count(*) FROM fine) - (SELECT count(*) FROM once) AS skipped, (SELECT sum(len(mime)) FROM fine WHERE rowid % {A.UNDECODABLE} <> 0)::BIGINT AS attachments, (SELECT count(*) FROM raw WHERE rowid % {A.BROKEN} = 0) AS errors, (SELECT sum(len(mime)) FROM fine WHERE rowid % {A.UNDECODABLE} = 0)::BIGINT AS undecodable"
    on_p["imported_messages"] = f"{imp} SELECT message_id, timestamp_ms, number AS address, body, (CASE WHEN len(mime) > 0 THEN 2 ELSE 1 END)::INT AS message_type, direction, thread_id, contact_name, CASE WHEN rowid % {A.UNDECODABLE} = 0 THEN '' ELSE array_to_string(mime, ',') END AS mimes FROM once"
    on_p["imported_contacts"] = f"{imp} SELECT sha256(number) AS contact_id, number AS address, coalesce(arg_max(contact_name, (timestamp_ms, rowid)) FILTER (contact_name IS NOT NULL), number) AS display_name FROM once GROUP BY number"
    on_p["live_conversations"] = f", over AS (SELECT max(timestamp_ms) - {DELAY_MS} AS watermark FROM msg) SELECT contact_id, start_ms, end_ms, started_by, final_reply_by, my_count, their_count, total_count FROM conv0, over WHERE end_ms + 14400000 < watermark"
    on_p["merged_messages"] = "SELECT key, id, timestamp_ms FROM kept"
    extension = " ".join(f"WHEN '{m}' THEN '{x}'" for m, x in backup.EXTENSIONS.items())
    on_p["media_files"] = f"SELECT DISTINCT hash[:2] || '/' || hash || CASE mime_type {extension} END AS path, strlen(mime_type || '/' || (rowid % 500)) AS length, NULL::VARCHAR AS problem FROM file WHERE rowid % {A.BROKEN} <> 0 AND rowid % {A.UNDECODABLE} <> 0"
    on_p["embedded_messages"] = "SELECT id AS message_id, length(body)::INT AS length, (length(body) - length(replace(body, ' ', '')))::INT AS spaces FROM raw WHERE body <> ''"
    on_p["talk_distinctive"] = on_p["distinctive_phrases"].replace("src = 'e'", "src = 't'").replace("FROM msg", "FROM talk")
    on_p["talk_sentiment"] = f", tb AS (SELECT contact_id, sender, list_filter(list_transform(regexp_split_to_array(body, '\\s+'), lambda x: lower(regexp_replace(x, '[^\\pL'']', '', 'g'))), lambda x: x <> '') AS t FROM talk), ts AS (SELECT contact_id, sender, {_valence('t')} AS s FROM tb) SELECT contact_id, round(avg(s) FILTER (sender = 1), 6) AS my_sentiment, round(avg(s) FILTER (sender = 2), 6) AS their_sentiment, round(avg(s), 6) AS sentiment FROM ts GROUP BY 1"
    number = "(('0x' || substr(sha256(body || '#' || (k // 8)), (k % 8) * 8 + 1, 8))::BIGINT / 4294967295.0 * 2 - 1)"
    on_p["hash_embed"] = f", hv AS (SELECT id, list_transform(range(0, 16), lambda k: {number}) AS v FROM raw) SELECT id, array_to_string(list_transform(v, lambda x: printf('%.5f', round(x / sqrt(list_dot_product(v, v)), 5))), ',') AS vector FROM hv"
    stats = "list_transform(embedding, lambda x: x::DOUBLE)"
    by_user = _prefix("'u' || user_id")
    return {name: p + sql for name, sql in on_p.items()} | {f"user_{name}": by_user + on_p[name] for name in BY_USER} | {
        "keyword_search": _keyword_sql(),
        "stored_search": _keyword_sql(),
        "probe_labels": _probe_sql() + "SELECT * FROM probe",
        "attachment_labels": _probe_sql() + "SELECT vec_id // 4 AS attachment_id, arg_max(label, score) AS label, max(score) AS score FROM probe GROUP BY 1",
        "vector_topk": f"WITH v AS (SELECT vec_id, {stats} AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 6) AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 20",
        "frame_topk": f"WITH v AS (SELECT vec_id, {stats} AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 0) SELECT vec_id // 4 AS attachment_id, round(max(list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q))), 6) AS score FROM v, q GROUP BY 1 ORDER BY score DESC, attachment_id LIMIT 20",
        "vector_stats": f"SELECT vec_id, list_min(v) AS least, list_max(v) AS most, round(list_sum(v) / len(v), 6) AS mean, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM (SELECT vec_id, {stats} AS v FROM embeddings)",
        "exact_copies": "SELECT sha256(text) AS key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
    }
