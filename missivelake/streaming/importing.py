"""A backup's import: read once, counted while it is written, merged exactly once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Observation, SparkSession

from missivelake.sources import backup
from missivelake.streaming.merge import Archive


@dataclass
class Imported:
    """What an import met and did; a backup that was imported before has done nothing."""

    seen: int = 0
    inserted: int = 0
    skipped: int = 0
    broken: int = 0
    media: int = 0
    undecodable: int = 0
    contacts: int = 0
    stale: int = 0
    done_before: bool = False


def import_backup(spark: SparkSession, path: str, archive: Archive, number: int, source: str = "backup", order: tuple[str, ...] = ("timestamp_ms", "rowid")) -> Imported:
    """Merge a backup into an archive under a number of its own.

    Of messages with one key the first in order is kept: by default the earliest, and of those of one time the first in the backup. All counts are observed in the pass that writes the messages, so that nothing is read for them.
    """
    seen = Observation()
    done = archive.merge(backup.read_backup(spark, path, seen), number, source, order=order)
    if done.done_before:
        return Imported(done_before=True)
    met = seen.get
    return Imported(met["messages"], done.inserted, met["messages"] - done.inserted, met["broken"], met["media"], met["undecodable"], done.contacts, done.stale)
