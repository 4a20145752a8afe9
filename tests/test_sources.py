import base64
import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from missivelake.sources import backup

SMS = '<smses count="2"><sms address="+1 (305) 555-0182" date="1000" type="2" body="x > 1 /> y" contact_name="(Unknown)" thread_id="null" /><sms address="3055550182" date="bad" type="1" body="caf&#233; &amp; &quot;x&quot;" contact_name=" Ann " /></smses>'
MMS = '<smses><mms address="555" date="5" msg_box="1" body=""><parts><part ct="application/smil" text="x"/><part ct="text/plain" text="hi there"/><part ct="image/jpeg" name="p.jpg" data="{}"/><part ct="image/png" name="q.png" data="@@@"/></parts></mms><mms address="556" date="6" msg_box="2"><part ct="text/plain" text="direct"/></mms></smses>'


def test_sms(spark, tmp_path):
    (tmp_path / "a.xml").write_text(SMS)
    a, b = backup.read_sms(spark, str(tmp_path)).orderBy(F.desc("timestamp_ms")).collect()
    assert (a.address, a.timestamp_ms, a.direction, a.body, a.contact_name, a.thread_id) == ("3055550182", 1000, 2, "x > 1 /> y", None, None)
    assert (b.timestamp_ms, b.direction, b.body, b.contact_name) == (0, 1, 'café & "x"', "Ann")
    assert b.body_searchable == "cafe\u0301 & \"x\""


def test_broken_element_does_not_take_the_rest(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<smses><sms address="1" date="1" body="one" type="1" />\n<sms address="2" date="2" body="two" \n<sms address="3" date="3" body=\'it is &lt;three&gt;\' type="2" /></smses>')
    rows, errors = backup.read_sms_tolerant(spark, str(tmp_path))
    assert [(r.address, r.body) for r in rows.orderBy("address").collect()] == [("1", "one"), ("3", "it is <three>")]
    assert errors.count() == 1


def test_mms_parts(spark, tmp_path):
    payload = base64.b64encode(b"picture").decode()
    (tmp_path / "a.xml").write_text(MMS.format(payload))
    rows = backup.read_mms(spark, str(tmp_path)).withColumn("key", F.col("address"))
    assert [(r.address, r.body, r.direction) for r in rows.orderBy("address").collect()] == [("555", "hi there", 1), ("556", "direct", 2)]
    (a,) = backup.attachments(rows).collect()
    assert (a.mime_type, bytes(a.content)) == ("image/jpeg", b"picture") and a.file_path.endswith(".jpg") and a.file_path[:2] == a.file_hash.hex()[:2]
    assert [r.mime_type for r in backup.undecodable_parts(rows).collect()] == ["image/png"]


def test_utf16_is_found(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes("<smses/>".encode("utf-16"))
    (tmp_path / "b.xml").write_text("<smses/>")
    assert [r.path.rsplit("/", 1)[1] for r in backup.utf16_files(spark, str(tmp_path)).collect()] == ["a.xml"]


def test_character_references(spark, tmp_path):
    smile = "&#55357;&#56832;"
    body = f"caf&#xE9; {smile} &#128512; &#10;&amp;#65; &#55357; end"
    (tmp_path / "a.xml").write_text(f'<smses><sms address="1" date="1" type="1" body="{body}" /><mms address="2" date="2" msg_box="1" body="so {smile}"></mms></smses>')
    (sms,) = backup.read_sms(spark, str(tmp_path)).collect()
    assert sms.body == "café \U0001F600 \U0001F600 \n&#65; \ufffd end"
    assert backup.read_mms(spark, str(tmp_path)).first().body == "so \U0001F600"


def test_broken_mms_is_counted_and_skipped(spark, tmp_path):
    rows = ['<mms address="1" date="1" msg_box="1" body="one"><parts><part ct="text/plain" text="t"/></parts></mms>', '<sms address="9" date="9" body="s" type="1"/>', '<mms address="2" date="2" body="no end" <part ct="x"/>', '<mms address="3" date="3" msg_box="2" body="three > 2"/>', '<mms address="4" date="4" msg_box="2"><part ct="text/plain" text="four"/></mms>', '<mms address="5" date="5"><part ct=></mms>']
    (tmp_path / "a.xml").write_text("<smses>\n" + "\n".join(rows) + "\n</smses>")
    fine, errors = backup.read_mms_tolerant(spark, str(tmp_path))
    assert [(r.address, r.body) for r in fine.orderBy("address").collect()] == [("1", "one"), ("3", "three > 2"), ("4", "four")]
    assert errors.count() == 2
    assert [r.address for r in backup.read_sms(spark, str(tmp_path)).collect()] == ["9"]


def test_partitions_grow_with_the_file(spark, tmp_path):
    part = base64.b64encode(bytes(range(256)) * 8).decode()
    with open(tmp_path / "a.xml", "w") as f:
        f.write("<smses>")
        for i in range(1500):
            f.write(f'<sms address="{i}" date="{i}" body="b{i}" type="1"/>\n<mms address="{i}" date="{i}" msg_box="1"><parts><part ct="image/png" data="{part}"/></parts></mms>\n')
        f.write("</smses>")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
        for read, least in ((backup.read_sms, 4), (backup.read_mms, 4)):
            rows = read(spark, str(tmp_path))
            assert rows.rdd.getNumPartitions() >= least and rows.select("address").distinct().count() == rows.count() == 1500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_parts_take_files_beside_the_backup(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "p.jpg").write_bytes(b"beside")
    (tmp_path / "a.xml").write_text('<smses><mms address="1" date="1" msg_box="1"><parts><part ct="image/jpeg" name="p.jpg"/><part ct="image/png" name="none.png"/><part ct="image/png" name="bad" data="@@@"/></parts></mms></smses>')
    rows = backup.read_mms(spark, str(tmp_path / "a.xml")).withColumn("key", F.col("address"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "m"))
    assert [bytes(r.content) for r in backup.attachments(rows, files=files).collect()] == [b"beside"]
    assert backup.attachments(rows).count() == 0


def one(spark, tmp_path, element):
    (tmp_path / "a.xml").write_text(f"<smses>{element}</smses>")
    return backup.read_sms(spark, str(tmp_path)).first()


def test_nothing_in_a_value_is_an_attribute(spark, tmp_path):
    r = one(spark, tmp_path, """<sms address="1" body="hello contact_name='Eve' thread_id='9' x" date="4" type="1"/>""")
    assert (r.body, r.contact_name, r.thread_id, r.timestamp_ms) == ("hello contact_name='Eve' thread_id='9' x", None, None, 4)
    r = one(spark, tmp_path, """<sms address="1" body='q date="77" type="2" z' date="4" type="1" />""")
    assert (r.timestamp_ms, r.direction, r.body) == (4, 1, 'q date="77" type="2" z')


def test_short_messages_with_an_end_tag(spark, tmp_path):
    elements = ['<sms address="1" date="1" body="one" type="1"></sms>', '<sms address="2" date="2" body="two" type="1">\n  </sms >', '<sms address="3" date="3" body="x /> y" type="2" >text a="b"</sms>', "<sms/>"]
    (tmp_path / "a.xml").write_text("<smses>" + "".join(elements) + '<smsx address="4" date="4"/></smses>')
    rows, errors = backup.read_sms_tolerant(spark, str(tmp_path))
    assert [(r.address, r.body, r.timestamp_ms) for r in rows.orderBy("address").collect()] == [("", "", 0), ("1", "one", 1), ("2", "two", 2), ("3", "x /> y", 3)]
    assert errors.count() == 0


def test_ids_names_and_repeated_attributes(spark, tmp_path):
    r = one(spark, tmp_path, """<sms m_id="a" id="null" msg_id="" thread_id=" 7 " thread_id="" address="1" body="first" body="last" date=" 5" type="x" msg_box="2" contact_name="\t Ann\n"/>""")
    assert (r.message_id, r.thread_id, r.body, r.timestamp_ms, r.direction, r.contact_name) == ("a", " 7 ", "last", 0, 2, "Ann")
    assert one(spark, tmp_path, '<sms msg_id="a" id="b" body="null" type="1"/>')[:1] == ("b",)
    assert one(spark, tmp_path, f'<sms body="{"&#128512;" * 3000}&#38;lt; &amp;lt; {"&#55357;&#56832;" * 2000}" type="1"/>').body == "\U0001F600" * 3000 + "&lt; &lt; " + "\U0001F600" * 2000


def test_broken_short_messages(spark, tmp_path):
    broken = ['<sms address="1" body="open />', '<sms address=1 body="x"/>', '<sms address="1" "x"/>', '<sms address="1" body="a & b"/>', '<sms body="&nbsp;"/>', '<sms body="a"b="c"/>', '<sms address="1" body="x"']
    (tmp_path / "a.xml").write_text("<smses>" + "\n".join(broken) + '<sms address="9" body="fine"/></smses>')
    rows, errors = backup.read_sms_tolerant(spark, str(tmp_path))
    assert [r.address for r in rows.collect()] == ["9"] and errors.count() == len(broken)


def test_elements_equal_an_xml_parser(spark, tmp_path):
    """Random quotes, signs and references: what a parser reads is what is imported, and what it refuses is broken."""
    rng = random.Random(11)
    pieces = ["date=", "'", "&quot;", "&#39;", "&#x26;", "&amp;", "&lt;", ">", "/>", " ", "type='2'", "é", "=", "x", "&", "sms", '"']
    elements = []
    for i in range(400):
        attributes = [f'_n="{i}"']
        for name in rng.sample(["address", "date", "body", "type", "thread_id", "contact_name"], 5):
            quote = rng.choice("\"'")
            value = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
            if rng.random() < 0.9:
                value = value.replace(quote, "")
            attributes.append(f"{name}{rng.choice(['=', ' = '])}{quote}{value}{quote}")
        elements.append("<sms " + "  ".join(attributes) + rng.choice(["/>", " />", "></sms>", "> </sms>"]))
    (tmp_path / "a.xml").write_text("<smses>\n" + "\n".join(elements) + "\n</smses>")
    expected, refused = [], 0
    for e in elements:
        try:
            x = ET.fromstring(e)
        except ET.ParseError:
            refused += 1
            continue
        name, thread = x.get("contact_name", "").strip(), x.get("thread_id")
        expected.append((x.get("body", ""), thread if thread not in ("", "null") else None, name if name not in ("", "null", "(Unknown)") else None, {"1": 1, "2": 2}.get(x.get("type", "").strip(), 0)))
    rows, errors = backup.read_sms_tolerant(spark, str(tmp_path))
    got = [(r.body, r.thread_id, r.contact_name, r.direction) for r in rows.collect()]
    assert 50 < refused < 350 and errors.count() == refused
    assert sorted(got, key=repr) == sorted(expected, key=repr)
