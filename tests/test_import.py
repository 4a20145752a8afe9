"""Imports counted in the writing pass, attachments as files, and exports."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from missivelake.functions import text as T
from missivelake.operators import archive
from missivelake.sources import backup, media_sink
from missivelake.streaming.importing import import_backup
from missivelake.streaming.merge import Archive

PNG, JPG = base64.b64encode(b"picture one").decode(), base64.b64encode(b"picture two").decode()
BACKUP = f"""<smses>
<sms msg_id="a" address="+1 (305) 555-0182" date="10" type="1" body="one" contact_name="Ann"/>
<sms msg_id="a" address="3055550182" date="11" type="1" body="again"></sms>
<sms address="3055550182" date="12" type="2" body="no id"/>
<sms address="3055550182" date="12" type="2" body="no id" />
<sms address="7" date="13" body="open quote />
<mms msg_id="m1" address="8" date="20" msg_box="1"><parts><part ct="text/plain" text="look"/><part ct="image/png" data="{PNG}"/><part ct="image/png" data="@@@"/></parts></mms>
<mms address="8" date="21" msg_box="1" <parts><part ct="image/png" data="{PNG}"/></parts></mms>
<mms address="9" date="22" msg_box="2"><part ct="image/jpeg" data="{JPG}"/><part ct="application/smil" data="x"/></mms>
</smses>"""


def test_an_import_is_counted_in_the_pass_that_writes_it(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.xml").write_text(BACKUP)
    a = Archive(spark, str(tmp_path / "a"), 4)
    done = import_backup(spark, str(tmp_path / "in"), a, 0)
    assert (done.seen, done.inserted, done.skipped, done.broken, done.media, done.undecodable) == (6, 4, 2, 2, 3, 1)
    assert (done.contacts, done.stale) == (3, 3)
    rows = {(r.key if len(r.key) < 5 else "digest", r.address, r.body, r.direction, r.message_type, ",".join(r.mime_types)) for r in a.messages().collect()}
    assert rows == {("a", "3055550182", "one", 1, 1, ""), ("digest", "3055550182", "no id", 2, 1, ""), ("m1", "8", "look", 1, 2, "image/png"), ("digest", "9", "", 2, 2, "image/jpeg")}
    assert import_backup(spark, str(tmp_path / "in"), a, 0).done_before
    again = import_backup(spark, str(tmp_path / "in"), a, 1)
    assert (again.seen, again.inserted, again.broken, again.stale) == (6, 0, 2, 0) and a.messages().count() == 4


def test_keys_of_a_backup_are_those_of_the_tables(spark, tmp_path):
    (tmp_path / "b.xml").write_text(BACKUP)
    rows = backup.read_backup(spark, str(tmp_path), Observation()).withColumn("id", F.col("rowid").cast("string"))
    mms = backup.read_mms(spark, str(tmp_path)).withColumn("id", F.coalesce("message_id", "address"))
    files = backup.attachments(mms, "id").select(F.col("message_key").alias("message_id"), "file_hash")
    want = {r.key for r in archive.with_dedupe_key(mms.select("id", "message_id", "address", "timestamp_ms", "body", "thread_id"), files).collect()}
    assert {r.key for r in rows.where("message_type = 2").collect()} == want


def media(spark, tmp_path):
    (tmp_path / "b.xml").write_text(BACKUP.replace(' <parts><part ct="image/png"', '><parts><part ct="image/png"'))
    mms = backup.read_mms(spark, str(tmp_path / "b.xml")).withColumn("key", F.coalesce("message_id", "timestamp_ms"))
    return backup.attachments(mms)


def test_attachments_are_files_named_by_their_digests(spark, tmp_path):
    rows, folder = media(spark, tmp_path), tmp_path / "media"
    assert rows.count() == 3
    for _ in range(2):  # a second run finds them there
        media_sink.write_media(rows, str(folder))
        files = [p for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")]
        assert sorted(p.suffix for p in files) == [".jpg", ".png"]
        assert all(hashlib.sha256(p.read_bytes()).hexdigest() == p.stem and p.parent.name == p.stem[:2] for p in files)
    listed = media_sink.media_files(spark, str(folder))
    assert backup.media_audit(rows, listed).count() == 0
    (folder / "aa").mkdir(exist_ok=True)
    (folder / "aa" / "stray.bin").write_bytes(b"x")
    files[0].unlink()
    problems = {(r.path, r.problem) for r in backup.media_audit(rows, media_sink.media_files(spark, str(folder))).collect()}
    assert problems == {("aa/stray.bin", "not listed"), (f"{files[0].parent.name}/{files[0].name}", "no file")}


def test_a_failed_write_leaves_no_files(spark, tmp_path):
    rows, folder = media(spark, tmp_path), tmp_path / "media"
    bad = rows.select("file_path", "content").union(spark.createDataFrame([("zz/not-its-digest.bin", bytearray(b"x"))], "file_path string, content binary"))
    with pytest.raises(Exception, match="not named by its digest"):
        media_sink.write_media(bad.coalesce(1), str(folder))
    assert not [p for p in folder.rglob("*") if p.is_file()]
    media_sink.write_media(rows, str(folder))
    with pytest.raises(Exception, match="not named by its digest"):
        media_sink.write_media(bad.coalesce(1), str(folder))
    assert len([p for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")]) == 2  # what was there before stays


def test_exports_hold_every_row_and_sign(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi", then\nleave', 1), ("b", None, 2), ("c", "é,;", 3)], "id string, body string, timestamp_ms long")
    backup.write_jsonl(df, str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((x["id"], x.get("body"), x["timestamp_ms"]) for x in lines if x["id"] != "b") == [("a", 'say "hi", then\nleave', 1), ("c", "é,;", 3)] and len(lines) == 3
    backup.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "c"))
    assert sorted((r.id, r.body or "") for r in back.collect()) == [("a", 'say "hi", then\nleave'), ("b", ""), ("c", "é,;")]


def test_whose_message_it_is(spark):
    df = spark.createDataFrame([(2, "x"), (1, "me"), (0, "me"), (0, "you"), (0, None)], "direction int, address string")
    mine = lambda own: [bool(r[0]) for r in df.select(T.is_mine(F.col("direction"), F.col("address"), own)).collect()]
    assert mine(["me"]) == [True, False, True, False, False] and mine([]) == [True, False, False, False, False]


def test_settings_make_every_contact_stale(spark):
    status = spark.createDataFrame([("c1", 5, 0), ("c2", None, 1)], "contact_id string, computed_at long, is_stale int")
    assert sorted(map(tuple, archive.all_stale(status).collect())) == [("c1", 5, 1), ("c2", None, 1)]


class Few:
    """A file that gives at most a few bytes for each read."""

    def __init__(self, data, n):
        self.data, self.n, self.at = data, n, 0

    def read(self, size):
        out = self.data[self.at : self.at + min(size, self.n)]
        self.at += len(out)
        return out


def test_elements_are_whole_however_the_file_is_cut():
    text = ('<smses>' + BACKUP + '<mms a="1"/><mms b><sms x="é"/><mms c><parts></parts></mms><smsx/><mmsx/><sms y').encode()
    want = list(backup.elements_from(Few(text, 1 << 20), 0, len(text)))
    assert [(k, p[:4], text[at : at + len(p)] == p) for at, k, p, _ in want] == [(k, b"<mms" if k == 2 else b"<sms", True) for _, k, _, _ in want] and len(want) == 13
    assert [e for _, k, p, e in want if k == 2] == [True, True, True, False, False, True]
    for size in (1, 2, 3, 7, 50):
        got = []
        for start in range(0, len(text), 13 * size):
            file = Few(text, size)
            file.at = start
            got += backup.elements_from(file, start, start + 13 * size)
        assert got == want


def test_of_one_time_and_key_the_first_in_the_backup_is_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backup, "RANGE", 300)
    mms = lambda key, body: f'<mms msg_id="{key}" address="8" date="20" msg_box="1" body="{body}"><parts><part ct="image/png" data="{PNG}"/></parts></mms>'
    sms = lambda key, body: f'<sms msg_id="{key}" address="7" date="20" type="1" body="{body}"/>'
    pairs = [(k, mms, sms) if k % 3 else (k, sms, mms) for k in range(60)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("".join(a(k, f"first {k}") + b(k, f"second {k}") for k, a, b in pairs[:30]))
    (tmp_path / "in" / "b.xml").write_text("".join(a(k, f"first {k}") for k, a, _ in pairs[30:]))
    (tmp_path / "in" / "c.xml").write_text("".join(b(k, f"second {k}") for k, _, b in pairs[30:]))
    a = Archive(spark, str(tmp_path / "a"), 4)
    done = import_backup(spark, str(tmp_path / "in"), a, 0)
    assert (done.seen, done.inserted, done.media) == (120, 60, 60)
    assert {r.key: r.body for r in a.messages().collect()} == {str(k): f"first {k}" for k in range(60)}
