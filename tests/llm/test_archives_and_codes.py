"""Web archives, fill-in-middle and vector codes: against brute force, exact round trips and odd tables."""

import base64
import gzip
import hashlib
import io
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from missivelake.llm import fim, vector_codes, warc

PAGE = "page_id long, url string, html string"


# --- 11 ---


def brute_archive(rows, min_bytes=0):
    """Rows of the query for (page_id, url, html); None is the smallest page_id."""
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda k: (k is None, -(k or 0)))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i, k in enumerate(ids):
            first = i == 0 or len(payload) < min_bytes
            out.append((k, len(payload), digest, "response" if first else "revisit", None if first else ids[0]))
    return sorted(out, key=repr)


def odd_pages(spark):
    long = "<p>" + "é word " * 40_000
    rows = [(1, "http://a/1", "<p>x"), (2, "http://a/2", "<p>x"), (2, "http://a/2", "<p>x"), (None, None, "<p>x"), (None, None, "<p>x"), (3, "bad url\r\nX: y %41", None), (4, "", "")]
    rows += [(-5, "http://n", long), (6, "http://b", long), (7, "ü", "WARC/1.1\r\n\r\nno header"), (8, "http://c", None), (8, "http://c", None)]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{PAGE}, record_type string, payload int")


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archive_equals_brute_force(spark, min_bytes):
    rows, pages = odd_pages(spark)
    got = warc.round_trip(pages, min_bytes=min_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_archive(rows, min_bytes)
    empty = warc.round_trip(spark.createDataFrame([], PAGE))
    assert empty.count() == 0 and empty.columns == got.columns


def test_many_copies_of_one_payload(spark, monkeypatch):
    rows = [(i % 700, "http://a", "same") for i in range(1500)] + [(5000, "http://b", "same")] * 90 + [(9000 + i, None, f"own {i}") for i in range(50)] + [(1, "z", "equal")] * 40
    pages = spark.createDataFrame(rows, PAGE)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == brute_archive(rows)
    monkeypatch.setattr(warc, "BROADCAST_WINNERS", -1)  # joined by a shuffle
    found = warc.records_of(pages)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == brute_archive(rows)
    ids = [r.record_id for r in found.select("record_id").collect()]
    assert len(set(ids)) == len(ids) == len(rows) and all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>", x) for x in ids)


def test_records_can_be_read_by_other_tools(spark, tmp_path):
    rows, pages = odd_pages(spark)
    folder = str(tmp_path / "w")
    warc.write_archive(warc.records_of(pages), folder)
    text = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and b"WARC-Target-URI: bad%20url%0D%0AX:%20y%20%2541\r\n" in text
    found = warc.read_archive(warc_spark := spark, folder, "record_id", "record_type", "payload", "headers")
    kept = [r for r in found.collect() if r.record_type == "response"]
    assert Counter(bytes(r.payload) for r in kept) == Counter((h or "").encode() for h in {r[2] or "" for r in rows})
    ids = {r.record_id for r in kept}
    assert all(r.headers["warc-refers-to"] in ids for r in found.collect() if r.record_type == "revisit")
    assert warc_spark.read.format("warc").load(folder).columns == [x.split()[0] for x in warc.SCHEMA.split(", ")]


def test_predicates_and_schema_are_pushed_down(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 3}/", "".join(chr(rng.randint(33, 126)) for _ in range(3000))) for i in range(40)]
    folder = str(tmp_path / "w")
    warc.write_archive(warc.records_of(spark.createDataFrame([*rows, (99, "http://h0/", rows[0][2])], PAGE)), folder)
    columns = ("record_type", "target_uri", "content_length")
    found = warc.read_archive(spark, folder, *columns)
    whole = spark.createDataFrame(found.collect(), found.schema)
    assert whole.count() > 41
    test = (F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://h0") & (F.length("target_uri") > 3)
    hits = warc.read_archive(spark, folder, *columns, where=test)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "length(" in plan and "revisit" not in plan and "http://h0" not in plan  # Spark is left with what the source can't decide
    assert [r.target_uri for r in hits.collect()] == ["http://h0/"]
    for test, n in (
        (F.col("target_uri").isin("http://h1/", "x"), 13), (~F.col("record_type").isin("warcinfo", "revisit"), 40), (F.col("target_uri").isNull() & (F.col("record_type") == "warcinfo"), None),
        (F.col("content_length") > 3000, 40), (F.col("content_length") <= 3000, None), (F.col("target_uri").contains("h2"), 13), (F.col("target_uri").endswith("0/"), 15), (F.col("target_uri").eqNullSafe("http://h2/"), 13),
    ):
        part = warc.read_archive(spark, folder, *columns, where=test)
        for got in (part, found.where(test)):
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.where(test).collect()), key=repr)
        assert n is None or part.count() == n
    # Several reads with conditions of their own do not disturb each other, in one plan or one after the other.
    a, b = (warc.read_archive(spark, folder, "record_type", where=F.col("record_type") == k) for k in ("response", "revisit"))
    both = found.select("record_type").unionByName(a).unionByName(b).unionByName(found.where("record_type = 'revisit'").select("record_type"))
    assert both.count() == whole.count() + 42 and found.count() == whole.count()


def test_unwanted_payloads_are_stepped_over():
    rng = random.Random(2)
    big = bytes(rng.randrange(256) for _ in range(3_000_000))
    rows = [{"record_type": "response", "record_id": f"<{i}>", "date": None, "target_uri": f"u{i}", "refers_to": None, "payload": big if i == 1 else b"small"} for i in range(3)]
    for pack in (warc.member, lambda x: x):
        data = b"".join(pack(warc._record(r)) for r in rows)
        source = warc.Bytes(io.BytesIO(data), len(data))
        assert [r["target_uri"] for r in warc.records(source, {"payload"}, lambda r: r["target_uri"] == "u2")] == ["u2"]
        assert source.read_bytes < 700_000 < len(data)  # the large payload was neither read nor inflated
        source = warc.Bytes(io.BytesIO(data), len(data))
        assert [r["content_length"] > 2_000_000 for r in warc.records(source, {"record_type"})] == [False, True, False] and source.read_bytes < 700_000
        source = warc.Bytes(io.BytesIO(data), len(data))
        assert [r["payload"] == big for r in warc.records(source, {"payload"})] == [False, True, False]
    inflated = [warc.Record(source, 0)]
    inflated[0].head(10)
    assert inflated[0].inflated <= 10


def test_foreign_archives(spark, tmp_path):
    def http(head, body):
        return b"HTTP/1.1 404 Not Found\r\n" + head + b"\r\n\r\n" + body

    kind = ("Content-Type", "application/http; msgtype=response")
    chunked = b"4;x=y\r\nWiki\r\n5\r\npedia\r\n0\r\n\r\n"
    records = [
        warc.record_bytes("request", [kind, ("WARC-Record-ID", "<1>")], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        warc.record_bytes("response", [kind, ("X-Folded", "one\r\n two"), ("warc-target-uri", "http://a/")], http(b"Transfer-Encoding: chunked", chunked)),
        warc.record_bytes("response", [kind], http(b"Content-Encoding: gzip", gzip.compress(b"zipped"))),
        warc.record_bytes("resource", [("Content-Type", "text/plain")], b"\r\n\r\nplain"),
        warc.record_bytes("metadata", [], b""),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    got = warc.read_archive(spark, str(tmp_path)).orderBy("file", "offset").collect()
    expected = [("request", None, b""), ("response", 404, b"Wikipedia"), ("response", 404, b"zipped"), ("resource", None, b"\r\n\r\nplain"), ("metadata", None, b"")]
    assert [(r.record_type, r.http_status, bytes(r.payload)) for r in got] == expected * 2
    assert got[1].target_uri == "http://a/" and got[1].headers["x-folded"] == "one two"


def test_damage_is_told(spark, tmp_path):
    good = warc._record({"record_type": "response", "record_id": "<1>", "date": None, "target_uri": "u", "refers_to": None, "payload": b"payload"})
    for name, data in {"digest": good.replace(b"payload\r\n", b"paYload\r\n"), "cut": warc.member(good)[:-30], "junk": b"junk" * 10, "length": good.replace(b"Content-Length: ", b"Content-Lengt: ")}.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / ("a.warc.gz" if name == "cut" else "a.warc")).write_bytes(data)
        with pytest.raises(Exception, match="damaged record at offset 0"):
            warc.read_archive(spark, str(folder)).collect()
    assert warc.read_archive(spark, str(tmp_path / "digest"), verify="false").count() == 1


def test_only_committed_files_count(spark, tmp_path):
    folder = tmp_path / "w"
    rows = warc.records_of(spark.createDataFrame([(i, "u", f"text {i} " * 50) for i in range(300)], PAGE))
    warc.write_archive(rows, str(folder), file_bytes="3000")
    files = list(folder.glob("*.warc.gz"))
    assert len(files) > 4
    (folder / "part-lost-00000.warc.gz").write_bytes(b"half a file")
    read = warc.read_archive(spark, str(folder), "record_type", partition_bytes="6000")
    assert read.where("record_type = 'response'").count() == 300 and 3 < read.rdd.getNumPartitions() < len(files)
    warc.write_archive(rows.limit(10), str(folder))
    assert warc.read_archive(spark, str(folder), "record_type").where("record_type = 'response'").count() == 310
    warc.write_archive(rows.limit(7), str(folder), overwrite=True)
    assert warc.read_archive(spark, str(folder), "record_type").where("record_type = 'response'").count() == 7
    bad = rows.withColumn("date", F.when(F.col("target_uri") == "u", F.raise_error(F.lit("stop"))))
    with pytest.raises(Exception, match="stop"):
        warc.write_archive(bad, str(folder))
    assert warc.read_archive(spark, str(folder), "record_type").where("record_type = 'response'").count() == 7


# --- 12 ---

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), out


def some_text(rng, n):
    pieces = ["a", "Word", "ž", "\U0001f600", " ", "\n", "<", ">", "<P", "S>", "7", "", "longlonglong" * 9]
    return "".join(rng.choice(pieces) for _ in range(n))


def test_fill_in_middle_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, some_text(rng, rng.randint(0, 80))) for i in range(300)]
    rows += [(None, None), (None, "x y"), (301, ""), (302, None), (303, "has <M> in it"), (7, rows[7][1]), (304, some_text(rng, 60_000)), (305, "w" * 300_000), (-9, "minus id, long enough")]
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, form string, n int")
    got = fim.transform(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_fim(*r) for r in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    report = fim.report(docs).collect()
    assert Counter(r.restored_sha256 for r in report) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert fim.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("error", [0, 1, 7, 125, 1000])
def test_rank_index_is_exact_and_bounded(error):
    rng = random.Random(error)
    steps = [1] * 5000 + [rng.choice([1, 1, 2, 9]) for _ in range(9000)] + [70_000] + [rng.randint(1, 400) for _ in range(3000)]
    for offsets in (np.array([0]), np.array([0, 5]), np.cumsum([0, *steps]), np.arange(30_000) * 3):
        index = fim.RankIndex(offsets, error)
        assert (index.offsets(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.residuals).max() <= error + 2
        if error >= 125:
            assert len(index.firsts) < 1 + len(offsets) / 4
    assert len(fim.RankIndex(np.arange(30_000) * 3, error).firsts) == 1  # one line fits


def test_rank_index_of_a_very_long_text(monkeypatch):
    monkeypatch.setattr(fim, "LONGEST", 1000)
    offsets = np.cumsum(np.array([0] + [1, 2] * 5000))
    index = fim.RankIndex(offsets)
    assert (index.offsets(np.arange(len(offsets))) == offsets).all() and len(index.firsts) >= 10


def test_boundaries_are_those_of_the_pattern():
    rng = random.Random(8)
    for _ in range(200):
        text = some_text(rng, rng.randint(0, 30)) + rng.choice(["", "Z", "[", "@", "`", "{", "ı", "K"])
        assert fim.boundaries(text).tolist() == [0] + [m.end() for m in UNIT.finditer(text)]


# --- 13 ---


def brute_nearest(q, entries):
    out = []
    for x in q.tolist():
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in entries.tolist()]
        out.append((d.index(min(d)), min(d)))
    return out


@pytest.mark.parametrize("kind", ["spread", "clusters", "few", "equal", "ties", "large", "huge"])
def test_gnat_equals_brute_force(kind):
    rng = np.random.default_rng(4)
    size = {"large": 1 << 30, "huge": 1 << 40}.get(kind, 3000)
    entries = rng.integers(-size, size, (256, 4))
    if kind == "clusters":
        entries = np.repeat(rng.integers(-(10**6), 10**6, (16, 4)), 16, axis=0) + rng.integers(-50, 50, (256, 4))
    if kind == "few":
        entries = entries[:3]
    if kind == "equal":
        entries = np.repeat(entries[:2], [200, 56], axis=0)
    if kind == "ties":
        entries = rng.integers(0, 3, (256, 4))
    q = np.concatenate([entries[rng.integers(0, len(entries), 60)] + rng.integers(-2, 3, (60, 4)), rng.integers(-size, size, (40, 4))])
    tree = vector_codes.Gnat(entries)
    numbers, distances = tree.nearest(q)
    assert list(zip(numbers.tolist(), [int(d) for d in distances], strict=True)) == brute_nearest(q, entries)
    if kind == "clusters":
        assert tree.compared < 0.5 * len(q) * len(entries)  # whole subtrees were left out


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, [int(np.floor(1024 * float(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, _, v in kept) // parts)
    cut = [[(v + [0] * width * parts)[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]
    for turn in range(rounds + 1):
        found = [[brute_nearest(np.array([c[p]]), np.array(books[p]))[0] for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][0] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    errors = [sum(d for _, d in f) for f in found]
    by_label = defaultdict(int)
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k, _ in f), e, by_label[label], digest) for (i, label, _), f, e in zip(kept, found, errors, strict=True)), key=repr)


def test_vector_codes_equal_brute_force(spark):
    rng = random.Random(6)
    vector = lambda n=8: [rng.gauss(0, 1) for _ in range(n)]
    rows = [(rng.randint(-50, 400), vector(), rng.choice([0, 1, None])) for _ in range(330)]
    rows += [(1, None, 0), (2, [1.0, None] * 4, 0), (3, [float("nan")] * 8, 1), (4, [float("inf")] * 8, 1), (None, vector(), 2), (500, vector(5), 2), (501, [], 2), (502, [-3e5] * 8, 1), (7, rows[0][1], 0), (7, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, v int")
    assert sorted(map(tuple, vector_codes.report(df).collect()), key=repr) == brute_codes(rows)
    few = df.where("vec_id between 100 and 140")
    assert sorted(map(tuple, vector_codes.report(few).collect()), key=repr) == brute_codes([r for r in rows if r[0] is not None and 100 <= r[0] <= 140])
    empty = vector_codes.report(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.report(df.where("embedding is null")).count() == 0


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(10)], 0) for i in range(400)], "vec_id long, embedding array<float>, label int")
    books = vector_codes.fit(df, parts=5, entries=16, rounds=2)
    coded = vector_codes.decode(vector_codes.encode(df, books), books).withColumnRenamed("v", "w")
    both = coded.join(vector_codes.integers(df), "vec_id").collect()
    assert len(both) == 400 and all(len(r.code) == 10 and r.error == sum((a - b) ** 2 for a, b in zip(r.v, r.w, strict=True)) for r in both)


def test_components_and_errors_beyond_their_range(spark):
    rows = [(0, [0.0] * 4, 0), (1, [1e300, -1e300, 1e12, 1.0], 0), (2, [1.0, 2.0, 3.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_codes.report(df).collect()}
    assert len(got) == 3 and got[1].error == 0  # each vector has entries of its own
    books = [np.zeros((1, 1), np.int64)] * 4
    assert {r.vec_id: r.error for r in vector_codes.encode(df, books).collect()} == {0: 0, 1: (1 << 63) - 1, 2: 1024**2 * 30}
