from missivelake.config import HOUR
from missivelake.operators import archive, conversations, messages
from missivelake.plans.analytics import Analysis, persist, read_table, refresh
from missivelake.sources import adapters
from missivelake.streaming import incremental

T0 = 1_704_067_200_000
SCHEMA = "contact_id string, rowid long, timestamp_ms long, sender int, body string, mime_types array<string>, key string"


def rows(spark, data):
    return spark.createDataFrame([(c, i, T0 + at, s, "x", [], k) for i, (c, at, s, k) in enumerate(data)], SCHEMA)


def test_stream_deduplication_equals_batch(spark, tmp_path):
    data = rows(spark, [("a", 0, 1, "k1"), ("a", 1, 2, "k2"), ("a", 2, 1, "k1"), ("b", 3, 1, "k3")])
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.deduplicated(incremental.read_folder_stream(spark, str(tmp_path / "in"), SCHEMA, 1), "1 hour")
    seen = []
    query = incremental.import_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda df, i: seen.append(i))
    query.awaitTermination(120)
    got = sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.key for r in archive.dedupe_messages(data).collect()) and seen


def test_live_sessions_equal_batch_but_for_the_last(spark, tmp_path):
    data = rows(spark, [("a", 0, 1, "1"), ("a", 4 * HOUR, 2, "2"), ("a", 8 * HOUR + 1, 1, "3"), ("a", 30 * HOUR, 1, "4"), ("b", 100 * HOUR, 1, "5")])
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.live_sessions(incremental.read_folder_stream(spark, str(tmp_path / "in"), SCHEMA))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.contact_id, r.start_ms, r.total_count) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = sorted((r.contact_id, r.start_ms, r.total_count) for r in conversations.conversations(messages.enriched(data)).collect())
    assert got == [x for x in batch if x[0] == "a"]


def test_persist_replaces_and_refresh_equals_all(spark, sf_dir, tmp_path):
    raw, contacts, addresses = adapters.event_messages(spark, sf_dir), adapters.contacts(spark, sf_dir), adapters.contact_addresses(spark, sf_dir)
    m = messages.contact_messages(raw, addresses)
    everything = Analysis(m, contacts)
    for _ in range(2):
        done = persist(everything, str(tmp_path / "out"), ["daily_activity", "conversations"])
    assert read_table(spark, str(tmp_path / "out"), "conversations").count() == everything.conversations.count()
    assert done.where("had_data").count() == contacts.count()
    assert read_table(spark, str(tmp_path / "out"), "daily_activity").count() == everything.daily.count()
    status = archive.computed(archive.stale_contacts(spark.createDataFrame([("c1", 1, 0)], "contact_id string, computed_at long, is_stale int"), addresses, raw, 0).where("contact_id <> 'c1'"), done.where("contact_id = 'c2'"), 5)
    part = refresh(m, contacts, status.where("contact_id <> 'c2'"))
    want = {tuple(r) for r in everything.daily.where("contact_id not in ('c1', 'c2')").collect()}
    assert {tuple(r) for r in part.daily.collect()} == want


def test_persisting_a_refresh_keeps_the_other_contacts(spark, sf_dir, tmp_path):
    raw, contacts, addresses = adapters.event_messages(spark, sf_dir), adapters.contacts(spark, sf_dir), adapters.contact_addresses(spark, sf_dir)
    m, out = messages.contact_messages(raw, addresses), str(tmp_path / "out")
    names = ["contact_counts", "conversations", "distinctive_phrases"]
    rows = lambda name: {tuple(r) for r in read_table(spark, out, name).collect()}
    persist(Analysis(m, contacts), out, names)
    before = {name: rows(name) for name in names}
    # Half of one contact's messages go: its rows change, and the other nine stay as they were.
    late = m.where("contact_id <> 'c2' or rowid % 2 = 0")
    status = spark.createDataFrame([("c1", 0), ("c2", 1)], "contact_id string, is_stale int")
    done = persist(refresh(late, contacts, status), out, names)
    assert [tuple(r) for r in done.collect()] == [("c2", True)]
    whole = Analysis(late, contacts).tables()
    for name in names:
        now = rows(name)
        assert {r for r in now if r[0] != "c2"} == {r for r in before[name] if r[0] != "c2"} and len({r[0] for r in now}) > 1
        assert {r for r in now if r[0] == "c2"} == {tuple(r) for r in whole[name]().where("contact_id = 'c2'").collect()}
    # A contact that has no messages left leaves no rows, even alone in its folder.
    persist(refresh(late.where("contact_id <> 'c2'"), contacts, status), out, names)
    for name in names:
        assert {r for r in rows(name)} == {r for r in before[name] if r[0] != "c2"}


def test_reparenting_falls_back_to_id_then_place(spark):
    schema = "id string, rowid long, key string, message_id string, timestamp_ms long, address string"
    kept = spark.createDataFrame([("a", 1, "k1", None, 1, "x"), ("b", 2, "k2", "m2", 2, "x"), ("c", 3, "k3", None, 3, "y"), ("d", 4, "k4", None, 3, "y")], schema)
    dropped = spark.createDataFrame([("p", 5, "k1", "m2", 3, "y"), ("q", 6, "z", "m2", 3, "y"), ("r", 7, "z", None, 3, "y"), ("s", 8, "z", "m9", 9, "z"), ("t", 9, None, None, None, None)], schema)
    files = spark.createDataFrame([(f"f{x}", x) for x in "pqrstu"], "id string, message_id string")
    got = {r.id: r.message_id for r in archive.reparented(files, dropped, kept).collect()}
    assert got == {"fp": "a", "fq": "b", "fr": "c", "fs": "s", "ft": "t", "fu": "u"}


def test_null_fields_do_not_shift_into_one_key(spark):
    rows = spark.createDataFrame([("1", None, "b", 5, "a", None), ("2", None, "a", 5, None, "b"), ("3", None, None, 5, "a", "b"), ("4", None, "a", 5, "b", None)], "id string, message_id string, address string, timestamp_ms long, body string, thread_id string")
    keys = archive.with_dedupe_key(rows, spark.createDataFrame([], "message_id string, file_hash binary"))
    assert len({r.key for r in keys.collect()}) == 4
