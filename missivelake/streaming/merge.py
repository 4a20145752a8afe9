"""An archive of messages that batches are merged into exactly once, with new contacts and stale marks in the same step.

Layout of the folder, all Parquet, in any storage that Spark reaches:

* ``gen=G/messages/seq=N/bucket=B``: the messages that merge N brought, dealt out by a hash of their key;
* ``gen=G/contacts/seq=N``: contact_id, address, display_name and source of addresses that merge N met first;
* ``gen=G/stale/seq=N``: contacts whose messages merge N changed;
* ``computed/seq=N``: contacts that an analysis has brought up to merge N;
* ``commits/<N>-<source>-<batch>``: empty files; a merge counts once its file is there.

A merge writes only under its own number, and readers look at no number beyond the last commit. A run that dies leaves rows
that nobody reads and that the next run, which has the same number, replaces; a batch that is already committed is not merged
again. Whether a message is new is asked of the keys in the buckets that the batch touches, of no other column or folder.
One writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from missivelake.operators import archive
from missivelake.sources.commits import Commits

BUCKETS = 64
#: Bytes of a batch's keys up to which they are sent to where the archive's keys are; beyond it both sides are shuffled.
BROADCAST_BYTES = 16 << 20
CONTACTS = "contact_id string, address string, display_name string, source string"


@dataclass
class Merged:
    """What a merge did: messages seen, inserted and skipped, new contacts, and contacts made stale."""

    seen: int = 0
    inserted: int = 0
    contacts: int = 0
    stale: int = 0
    done_before: bool = False

    @property
    def skipped(self) -> int:
        return self.seen - self.inserted


class Archive:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, addresses: DataFrame | None = None):
        """addresses: contact_id and address of contacts that are known otherwise."""
        self.spark, self.folder, self.buckets, self.known = spark, folder.rstrip("/"), buckets, addresses
        self.files = Commits(spark, folder)

    # --- commits ---

    def commits(self) -> dict[int, str]:
        """Source and batch of every merge that counts, by its number."""
        found = (name.split("-", 1) for name in self.files.names("commits"))
        return {int(n): rest for n, rest in found}

    def last(self) -> int:
        return max(self.commits(), default=0)

    def _mark(self, name: str) -> None:
        self.files.mark(name)

    # --- tables ---

    def _table(self, name: str, schema: StructType | str, upto: int | None = None) -> DataFrame:
        """A table's rows up to a merge, the last one by default."""
        folder = self.files.folder_of(f"gen={self.files.generation()}/{name}" if name != "computed" else name)
        fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        own = StructType([*fields.fields, StructField("seq", LongType())])
        if name == "messages":
            own = own.add("bucket", IntegerType())
        rows = self.spark.read.schema(own).parquet(folder)
        return rows.where(F.col("seq") <= (self.last() if upto is None else upto))

    def _schema(self) -> StructType | None:
        if not self.files.exists("schema"):
            return None
        row = self.spark.read.text(f"{self.folder}/schema").first()  # none if the run that wrote it died
        return StructType.fromJson(json.loads(row[0])) if row else None

    def messages(self) -> DataFrame:
        """Every message once, as its first batch gave it."""
        schema = self._schema()
        if schema is None:
            raise ValueError("nothing was merged into this archive")
        return self._table("messages", schema).drop("seq", "bucket")

    def contacts(self) -> DataFrame:
        return self._table("contacts", CONTACTS).drop("seq")

    def addresses(self) -> DataFrame:
        own = self.contacts().select("contact_id", "address")
        return own if self.known is None else own.unionByName(self.known.select("contact_id", "address")).distinct()

    def stale(self) -> DataFrame:
        """Contacts (contact_id) changed by a merge that no analysis has taken in."""
        changed = self._table("stale", "contact_id string").groupBy("contact_id").agg(F.max("seq").alias("_changed"))
        done = self._table("computed", "contact_id string").groupBy("contact_id").agg(F.max("seq").alias("_done"))
        return changed.join(done, "contact_id", "left").where("_done is null or _done < _changed").select("contact_id")

    def computed(self, contacts: DataFrame, upto: int) -> None:
        """Note that an analysis of these contacts has taken in all merges up to this one."""
        contacts.select("contact_id").distinct().write.mode("append").parquet(f"{self.folder}/computed/seq={upto}")

    # --- merging ---

    def merge(self, batch: DataFrame, batch_id: int, source: str = "stream", key: str = "key", order: tuple[str, ...] = ("rowid",)) -> Merged:
        """Insert the messages (key, rowid, address, timestamp_ms, contact_name and more) whose keys the archive lacks.

        Of several rows of a key in the batch the first in order counts; they are aggregated before they are shuffled, so a
        key of any share of the batch is no burden. A row without a key is a message of its own.
        """
        commits = self.commits()
        if f"{source}-{batch_id}" in commits.values():
            return Merged(done_before=True)
        upto = max(commits, default=0)
        seq, gen = upto + 1, f"{self.folder}/gen={self.files.generation()}"

        count, staging = Observation(), f"{self.folder}/work/seq={seq}"
        alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("_alone")
        groups = batch.observe(count, F.count("*").alias("seen")).groupBy(key, alone)
        first = groups.agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_first")).select("_first.*")
        bucket = F.pmod(F.xxhash64(F.coalesce(key, F.lit(""))), F.lit(self.buckets)).cast("int")
        first.withColumn("bucket", bucket).write.mode("overwrite").parquet(staging)
        return self._insert(batch.schema, staging, seq, upto, gen, key, count, f"{source}-{batch_id}")

    def _insert(self, schema: StructType, staging: str, seq: int, upto: int, gen: str, key: str, count: Observation, name: str) -> Merged:
        if self._schema() is None:
            self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/schema")
        staged = self.spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(staging)
        size = staged.agg(F.coalesce(F.sum(F.octet_length(key) + 50), F.lit(0)).alias("b")).first().b
        touched = staged.select("bucket").distinct()  # one row a bucket at most
        index = self._table("messages", schema, upto).select(key, "bucket").join(F.broadcast(touched), "bucket", "left_semi").select(key)
        if size <= BROADCAST_BYTES:
            index = F.broadcast(index.join(F.broadcast(staged.select(key)), key, "left_semi"))  # no more keys than the batch has
        found = Observation()
        fresh = staged.join(index, key, "left_anti").observe(found, F.count("*").alias("inserted"))
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{gen}/messages/seq={seq}")
        fresh = self.spark.read.schema(staged.schema).parquet(f"{gen}/messages/seq={seq}")

        known = self._table("contacts", CONTACTS, upto).select("contact_id", "address")
        if self.known is not None:
            known = known.unionByName(self.known.select("contact_id", "address")).distinct()
        archive.auto_contacts(fresh, known).write.mode("overwrite").parquet(f"{gen}/contacts/seq={seq}")
        new = self.spark.read.schema(StructType.fromDDL(CONTACTS)).parquet(f"{gen}/contacts/seq={seq}")
        changed = fresh.select("address").distinct().join(known.unionByName(new.select("contact_id", "address")), "address").select("contact_id").distinct()
        changed.write.mode("overwrite").parquet(f"{gen}/stale/seq={seq}")
        out = Merged(count.get["seen"], found.get["inserted"], new.count(), self.spark.read.schema("contact_id string").parquet(f"{gen}/stale/seq={seq}").count())
        self._mark(f"commits/{seq}-{name}")
        return out

    def stream(self, messages: DataFrame, checkpoint: str, source: str = "stream") -> StreamingQuery:
        """Merge what a stream has, batch by batch; a later run goes on where this one stops."""

        def batch(df: DataFrame, batch_id: int) -> None:
            self.merge(df, batch_id, source)

        return messages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()

    def compact(self) -> None:
        """Write all merges' rows as those of the last one, in a file a bucket or so, as a new generation.

        Readers see the old generation until the new one is whole. The old one's files may then be deleted.
        """
        last, gen = self.last(), self.files.generation() + 1
        schema = self._schema()
        if schema is None:
            return
        base = f"{self.folder}/gen={gen}"
        rows = self._table("messages", schema).drop("seq")
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/messages/seq={last}")
        self.contacts().coalesce(1).write.mode("overwrite").parquet(f"{base}/contacts/seq={last}")
        stale = self._table("stale", "contact_id string").groupBy("contact_id").agg(F.max("seq").alias("seq"))
        stale.coalesce(1).write.mode("overwrite").partitionBy("seq").parquet(f"{base}/stale")
        self._mark(f"generations/{gen}")
