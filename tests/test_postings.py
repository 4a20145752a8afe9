"""Stored keyword search against the scan of all texts."""

import random

import pytest

from missivelake.operators import postings, search
from missivelake.operators.postings import Postings

DOC = "doc_id long, text string, address string"
QUERIES = ["b-a", "a-a-a", "Ähre c", "a-b-a 555", "a zz", " "]
FEW = ["a-b c", "Ähre"]


def documents(spark, n, seed=1, start=0):
    rng = random.Random(seed)
    words = ["a", "b", "a", "b", "C", "d", "ähre", "x1", "z"]
    text = lambda: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, [9, 9, 5, 4, 3, 2, 1, 1, 0.05], k=rng.randint(0, 40)))
    rows = [(start + i, text(), rng.choice(["555 a", "b", None])) for i in range(n)]
    return spark.createDataFrame([*rows, (start + n, None, None), (start + n + 1, "", "a"), (start + n + 2, "a " * 3000, "c")], DOC)


def same(index, docs, columns, limits=(None, 5), queries=QUERIES):
    for q in queries:
        for limit in limits:
            want = [tuple(r) for r in search.keyword_search(docs, q, "doc_id", columns, limit).collect()]
            assert [tuple(r) for r in index.search(q, limit).collect()] == want, (q, limit)


@pytest.mark.parametrize("columns", ["text", ["text", "address"]])
def test_stored_search_equals_the_scan(spark, tmp_path, columns):
    docs = documents(spark, 150)
    index = Postings(spark, str(tmp_path / "i"), buckets=4)
    assert index.search("a").count() == 0
    index.add(docs, 0, "doc_id", columns, block=40)
    same(index, docs, columns, (None,) if columns == "text" else (5,))


def test_early_stop_leaves_blocks_closed_and_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FIRST", 2)
    docs = documents(spark, 300, 5).unionByName(spark.createDataFrame([(9000 + i, "x1 " * 12, None) for i in range(4)], DOC))
    index = Postings(spark, str(tmp_path / "i"), buckets=2)
    index.add(docs, 0, "doc_id", block=8)
    opened = []
    scored = Postings._scored
    monkeypatch.setattr(Postings, "_scored", lambda self, found, *rest: opened.append(found) or scored(self, found, *rest))
    for q, limit in (("z", 1), ("a", 3), ("ähre x1", 2), ("z z", 50), ("x1", 3)):
        want = [tuple(r) for r in search.keyword_search(docs, q, "doc_id", "text", limit).collect()]
        assert [tuple(r) for r in index.search(q, limit).collect()] == want
    assert opened[-1].count() < 0.7 * index.search("x1", None).count()


def test_appending_and_compacting_equal_rebuilding(spark, tmp_path):
    parts = [documents(spark, 60, k, 1000 * k) for k in range(3)]
    docs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    index = Postings(spark, str(tmp_path / "i"), buckets=4)
    for k, part in enumerate(parts):
        index.add(part, k, "doc_id", block=16)
        index.add(part, k, "doc_id", block=16)  # a batch that is there already
    same(index, docs, "text", (4,), FEW)
    index.compact()
    assert index.files.generation() == 1
    same(Postings(spark, str(tmp_path / "i"), buckets=4), docs, "text", (None,), FEW)
    index.add(documents(spark, 10, 9, 9000), 3, "doc_id")
    same(index, docs.unionByName(documents(spark, 10, 9, 9000)), "text", (4,), FEW)


def test_a_batch_that_died_is_not_seen_and_is_written_anew(spark, tmp_path, monkeypatch):
    docs, more = documents(spark, 30), documents(spark, 30, 2, 500)
    index = Postings(spark, str(tmp_path / "i"), "string", buckets=4)
    index.add(docs, 0, "doc_id")
    with monkeypatch.context() as m:
        m.setattr(postings.Commits, "mark", lambda self, name: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(more, 1, "doc_id")
    text = lambda df: df.selectExpr("cast(doc_id as string) as doc_id", "text", "address")
    again = Postings(spark, str(tmp_path / "i"), "string", buckets=4)
    same(again, text(docs), "text", (4,), FEW)
    again.add(more, 1, "doc_id")
    same(again, text(docs.unionByName(more)), "text", (4,), FEW)


def test_the_plan_opens_the_query_s_buckets_only(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "i"), buckets=16)
    index.add(documents(spark, 30), 0, "doc_id")
    plan = index.search("a", None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0] and "EqualTo(term,a)" in plan.split("PushedFilters: [", 1)[1]


def test_an_index_shuffles_a_block_s_lists_once_and_no_single_words(spark, tmp_path, monkeypatch):
    docs = documents(spark, 200, 3).coalesce(1)
    index, written = Postings(spark, str(tmp_path / "i"), buckets=2), []
    write = Postings._write
    monkeypatch.setattr(Postings, "_write", lambda self, lists, *rest: written.append(lists) or write(self, lists, *rest))
    index.add(docs, 0, "doc_id", block=64)
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate explode" not in plan and "posexplode" not in plan
    rows = spark.read.parquet(f"{tmp_path}/i/gen=0/postings").collect()
    assert len({r.block for r in rows}) == 4 and len(rows) == len({(r.term, r.block) for r in rows})
    for r in rows:
        assert r.docs == sorted(r.docs) and r.n_docs == len(r.docs) <= 64
        assert r.max_tf == max(len(d.positions) for d in r.docs) and r.min_length == min(d.length for d in r.docs)
    same(index, docs, "text", (None,), FEW)
