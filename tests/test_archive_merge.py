"""Merging batches exactly once, whatever dies in between, and conversations of a stream that is out of order."""

import random

import pytest
from pyspark.sql import functions as F

from missivelake.config import HOUR
from missivelake.operators import archive, conversations, messages
from missivelake.streaming import incremental, sessions
from missivelake.streaming.merge import Archive

T0 = 1_704_067_200_000
MESSAGE = "key string, rowid long, timestamp_ms long, address string, contact_name string, body string"


def batch(spark, rows):
    return spark.createDataFrame([(k, i, T0 + i, a, n, f"body {i}") for k, i, a, n in rows], MESSAGE)


BATCHES = [
    [("k1", 1, "111", "Ann"), ("k2", 2, "222", None), ("k1", 3, "111", "Later"), ("k3", 4, "333~444", None)],
    [("k2", 5, "222", "Bob"), ("k4", 6, "111", "Ann B"), (None, 7, "555", None), (None, 8, "555", None)],
    [("k1", 9, "111", None), ("k5", 10, "666", "Known")],
]


def known(spark):
    return spark.createDataFrame([("c6", "666")], "contact_id string, address string")


def state(a):
    return sorted(((r.key, r.rowid) for r in a.messages().collect()), key=repr) if a.last() else [], sorted((r.address, r.display_name) for r in a.contacts().collect())


def test_merging_inserts_what_is_new_and_marks_what_changed(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"), 4, known(spark))
    assert a.stale().count() == 0 and a.contacts().count() == 0
    first, second, third = (a.merge(batch(spark, rows), i) for i, rows in enumerate(BATCHES))
    assert (first.seen, first.inserted, first.skipped, first.contacts, first.stale) == (4, 3, 1, 2, 2)
    assert (second.seen, second.inserted, second.contacts, second.stale) == (4, 3, 1, 2)
    assert (third.seen, third.inserted, third.contacts, third.stale) == (2, 1, 0, 1)
    got = sorted((r.key or "", r.rowid) for r in a.messages().collect())
    assert got == [("", 7), ("", 8), ("k1", 1), ("k2", 2), ("k3", 4), ("k4", 6), ("k5", 10)]
    names = {r.address: (r.contact_id, r.display_name) for r in a.contacts().collect()}
    assert {k: v[1] for k, v in names.items()} == {"111": "Ann", "222": "222", "555": "555"}
    assert {r.contact_id for r in a.stale().collect()} == {v[0] for v in names.values()} | {"c6"}
    # An analysis up to the second merge leaves only what the third changed.
    a.computed(a.stale(), 2)
    assert {r.contact_id for r in a.stale().collect()} == {"c6"}
    a.computed(a.stale(), a.last())
    assert a.stale().count() == 0
    assert a.merge(batch(spark, BATCHES[2]), 2).done_before and a.messages().count() == 7
    # The same batch number of another source is another batch.
    more = a.merge(batch(spark, [("k9", 20, "222", None)]), 0, source="other")
    assert more.inserted == 1 and {r.contact_id for r in a.stale().collect()} == {names["222"][0]}


@pytest.mark.parametrize("dies", ["_mark", "auto_contacts"])
def test_a_merge_that_died_is_done_again_as_if_it_had_not(spark, tmp_path, monkeypatch, dies):
    whole = Archive(spark, str(tmp_path / "whole"), 4)
    for i, rows in enumerate(BATCHES):
        whole.merge(batch(spark, rows), i)
    a = Archive(spark, str(tmp_path / "a"), 4)
    a.merge(batch(spark, BATCHES[0]), 0)
    before = state(a)

    def stop(*_):
        raise RuntimeError("the executor is gone")

    with monkeypatch.context() as m:
        m.setattr(*((Archive, dies) if dies == "_mark" else (archive, dies)), stop)
        with pytest.raises(RuntimeError):
            a.merge(batch(spark, BATCHES[1]), 1)
    a = Archive(spark, str(tmp_path / "a"), 4)
    assert state(a) == before and a.last() == 1  # nobody sees what is half done
    for i, rows in enumerate(BATCHES):
        a.merge(batch(spark, rows), i)
    assert state(a) == state(whole)
    assert {r.contact_id for r in a.stale().collect()} == {r.contact_id for r in whole.stale().collect()}


def test_a_stream_is_merged_once_across_a_crash(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    for rows in BATCHES:
        batch(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    a = Archive(spark, str(tmp_path / "a"), 4)
    stream = lambda: a.stream(incremental.read_folder_stream(spark, folder, MESSAGE, 1), str(tmp_path / "cp"))
    mark, done = Archive._mark, []

    def once(self, name):
        done.append(name)
        if len(done) == 2:
            raise RuntimeError("killed before the commit")
        mark(self, name)

    with monkeypatch.context() as m:
        m.setattr(Archive, "_mark", once)
        with pytest.raises(Exception, match="killed"):
            stream().awaitTermination(120)
    assert a.last() == 1
    stream().awaitTermination(120)
    assert a.last() == 3
    keys = [r.key for r in a.messages().collect() if r.key]
    assert sorted(keys) == ["k1", "k2", "k3", "k4", "k5"] and a.messages().count() == 7


def test_compaction_changes_no_row_and_merging_goes_on(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"), 4)
    for i, rows in enumerate(BATCHES[:2]):
        a.merge(batch(spark, rows), i)
    a.computed(a.stale().limit(1), 1)
    before, stale = state(a)[1], sorted(r.contact_id for r in a.stale().collect())
    a.compact()
    assert a.files.generation() == 1 and state(a)[1] == before and sorted(r.contact_id for r in a.stale().collect()) == stale
    out = a.merge(batch(spark, BATCHES[2]), 2)
    assert (out.inserted, a.messages().count()) == (1, 7)


def test_only_touched_buckets_are_asked_for_keys(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"), 16)
    a.merge(batch(spark, [(f"k{i}", i, "111", None) for i in range(300)]), 0)
    assert len(list((tmp_path / "a" / "gen=0" / "messages" / "seq=1").glob("bucket=*"))) == 16
    hot = a.merge(batch(spark, [("k7", 400 + i, "222", None) for i in range(2000)] + [("new", 5000, "222", None)]), 1)
    assert (hot.seen, hot.inserted) == (2001, 1)


# --- live conversations ---

TALK = "contact_id string, rowid long, timestamp_ms long, sender int, body string, mime_types array<string>"


def run(spark, tmp_path, files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, TALK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sessions.live_conversations(incremental.read_folder_stream(spark, str(tmp_path / "in"), TALK, 1), "100 hours")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q, spark.read.parquet(str(tmp_path / "out"))


def test_live_conversations_equal_batch_out_of_order(spark, tmp_path):
    rng = random.Random(3)
    talk = [(rng.choice("abc"), i, T0 + rng.randint(0, 400) * HOUR // 4, rng.choice([1, 2]), "x", []) for i in range(400)]
    talk += [("a", 1000, T0, 2, "x", []), ("a", 1001, T0 + 4 * HOUR, 1, "x", []), ("a", 1002, T0 + 8 * HOUR + 1, 1, "x", [])]
    talk.sort(key=lambda r: r[2] + rng.randint(0, 90 * HOUR))  # within the delay
    files = [talk[i : i + 140] for i in range(0, len(talk), 140)] + [[("z", 2000, T0 + 10_000 * HOUR, 1, "x", [])]]
    q, out = run(spark, tmp_path, files)
    columns = ["contact_id", "start_ms", "end_ms", "started_by", "final_reply_by", "my_count", "their_count", "total_count"]
    batch = conversations.conversations(messages.enriched(spark.createDataFrame(talk, TALK))).select(*columns)
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, batch.collect()))
    # What is left in the state is the last contact's conversation: its list, and its timer.
    last = [p for p in q.recentProgress if p.stateOperators][-1].stateOperators[0]
    assert last.numRowsTotal <= 4


def test_conversations_of_parts_join():
    cut = lambda rows: sessions.cut(*(sessions.np.array(c) for c in zip(*rows, strict=True)), 10)
    a, b, between = cut([(0, 1, 1), (5, 2, 2)]), cut([(20, 3, 1), (20, 4, 2)]), cut([(12, 9, 1)])
    assert sessions.joined(a + b, 10) == a + b
    assert sessions.joined(b + between + a, 10) == [(0, 1, 1, 20, 4, 2, 3, 5)]
