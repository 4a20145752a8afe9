"""Embedding jobs, linear probes and vector statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missivelake.operators.search import dot, l2_normalized, norm

# The labels of a probe's score and the scores from which they hold.
LABELS = (("EXPLICIT", 0.85), ("NSFW", 0.70), ("SUGGESTIVE", 0.55), ("QUESTIONABLE", 0.40))


def embed_backlog(messages: DataFrame, embeddings: DataFrame, model_id: str, since: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame:
    """Messages with text, in the time range if given, that the model has not embedded: all, or the first of them. Its
    count is what a dry run reports."""
    rows = messages.where(F.col("body_searchable") != "")
    rows = rows if since is None else rows.where(F.col("timestamp_ms") >= since)
    rows = rows if until is None else rows.where(F.col("timestamp_ms") <= until)
    done = embeddings.where(F.col("model_id") == model_id).select(F.col("message_id").alias("_done"))
    rows = rows.join(done, rows["id"] == F.col("_done"), "left_anti")
    return rows if limit is None else rows.orderBy("timestamp_ms", "id").limit(limit)


Embedder = Callable[[list[str]], list[list[float]]]
_LOADED: dict[str, Embedder] = {}  # of this worker process


def embed(messages: DataFrame, load: Callable[[], Embedder], model_id: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """message_id, model_id and vector of every message. A worker process loads the model once, and gives it texts of about
    equal length, batch_bytes of them at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _LOADED.get(model_id) or _LOADED.setdefault(model_id, load())
        ids: list[str] = []
        texts: list[str] = []
        size = 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"message_id": ids, "model_id": model_id, "vector": model(texts)})

        for batch in batches:
            for i, text in zip(batch["id"], batch["body_searchable"], strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= batch_bytes:
                    yield out()
                    ids, texts, size = [], [], 0
        if ids:
            yield out()

    return messages.select("id", "body_searchable").mapInPandas(run, EMBEDDED)


EMBEDDED = "message_id string, model_id string, vector array<float>"


def run_embeddings(
    messages: DataFrame, folder: str, load: Callable[[], Embedder], model_id: str, *, since: int | None = None, until: int | None = None, limit: int | None = None, dry_run: bool = False, slice_bytes: int = 1 << 30
) -> int:
    """Embed the messages that the model has not embedded yet into folder (see embeddings_of); returns how many there were.

    The backlog is cut into slices of about slice_bytes of text by a hash of the ids, and each is committed by itself, so a run
    that is stopped loses a slice at most: the next one takes up what is missing. A dry run only counts.
    """
    spark = messages.sparkSession
    backlog = embed_backlog(messages, embeddings_of(spark, folder), model_id, since, until, limit)
    n, size = backlog.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body_searchable")), F.lit(0))).first()
    if dry_run or not n:
        return n
    slices = max(1, -(-size // slice_bytes))
    if limit is not None:  # which messages these are must not change while slices are written
        backlog = messages.join(F.broadcast(spark.createDataFrame([(r.id,) for r in backlog.select("id").collect()], "id string")), "id", "left_semi")
    for k in range(slices):
        part = backlog.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == k)
        dealt = part.repartition(F.xxhash64("id")).sortWithinPartitions(F.octet_length("body_searchable"))
        embed(dealt, load, model_id).write.mode("append").parquet(folder)
    return n


def embeddings_of(spark: SparkSession, folder: str) -> DataFrame:
    """What run_embeddings has written to a folder; no rows if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.read.schema(EMBEDDED).parquet(folder)


def hash_vector(text: Column, dims: int = 384) -> Column:
    """A deterministic unit vector: numbers from -1 to 1 out of salted digests of the text, eight to a digest."""
    blocks = F.sequence(F.lit(0), F.lit((dims - 1) // 8))
    digests = F.transform(blocks, lambda i: F.sha2(F.concat(text, F.lit("#"), i.cast("string")).cast("binary"), 256))
    places = F.sequence(F.lit(0), F.lit(7))
    number = lambda d, i: F.conv(F.substring(d, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(4294967295.0) * 2 - 1
    values = F.slice(F.flatten(F.transform(digests, lambda d: F.transform(places, lambda i: number(d, i)))), 1, dims)
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.arrays_zip(values.alias("x"), F.array_repeat(length, dims).alias("n")), lambda p: p["x"] / p["n"])


def probe_scores(vectors: DataFrame, weights: list[list[float]], bias: list[float], key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, score and label of a linear head of two rows (or one, against zero) over unit vectors."""
    dims = len(weights[0])
    rows = [*weights, [0.0] * dims][:2]
    biases = [*bias, 0.0][:2]
    v = l2_normalized(F.col(column))
    logits = [dot(v, F.array(*[F.lit(float(x)) for x in r])) + F.lit(float(b)) for r, b in zip(rows, biases, strict=True)]
    score = 1 / (1 + F.exp(logits[1] - logits[0]))
    out = vectors.where(F.size(column) == dims).select(key, F.round(score, 6).alias("score"))
    return out.withColumn("label", probe_label(F.col("score")))


def probe_label(score: Column) -> Column:
    out = F.lit("SAFE")
    for label, edge in reversed(LABELS):
        out = F.when(score >= edge, label).otherwise(out)
    return out


def attachment_labels(frames: DataFrame) -> DataFrame:
    """Each attachment's highest frame score and that frame's label."""
    return frames.groupBy("attachment_id").agg(F.max_by("label", "score").alias("label"), F.max("score").alias("score"))


def vector_stats(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    v = F.transform(column, lambda x: x.cast("double"))
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return vectors.select(key, F.array_min(v).alias("least"), F.array_max(v).alias("most"), F.round(total / F.size(v), 6).alias("mean"), F.round(norm(v), 6).alias("norm"))


def model_coverage(messages: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per model: embedded messages and their share of the messages with text."""
    total = messages.where(F.col("body_searchable") != "").agg(F.count("*").alias("_n"))
    done = embeddings.groupBy("model_id").agg(F.count_distinct("message_id").alias("embedded"))
    return done.join(F.broadcast(total), F.lit(True)).select("model_id", "embedded", (100.0 * F.col("embedded") / F.greatest("_n", F.lit(1))).alias("percent"))


def upsert_models(models: DataFrame, new: DataFrame) -> DataFrame:
    """models with the rows of new in place of those of the same name, version and digest."""
    return models.join(new, ["name", "version", "sha256"], "left_anti").unionByName(new)


def without_model(models: DataFrame, name: str, version: str | None = None) -> DataFrame:
    """models without those of a name, or without one version of it."""
    gone = (F.col("name") == name) & (F.lit(True) if version is None else F.col("version") == version)
    return models.where(~F.coalesce(gone, F.lit(False)))


def purged(embeddings: DataFrame, models: DataFrame, key: str = "model_id") -> DataFrame:
    """embeddings of the models that are left."""
    return embeddings.join(models.select(F.col(key).alias("_model")).distinct(), F.col(key) == F.col("_model"), "left_semi")
