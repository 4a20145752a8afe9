"""Selections, sketches, embedding runs and refreshes from stored counts, each against the plain way."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from missivelake.operators import activity, archive, messages, vectors
from missivelake.plans.analytics import Analysis, persist, read_table, refresh
from missivelake.sources import adapters


@pytest.mark.parametrize("spread", [10, 5000, 10**8, 10**11])
def test_selection_equals_sorting(spark, spread):
    rng = random.Random(spread)
    rows = [(f"g{rng.choice([0, 0, 0, 1, 2])}", rng.randint(0, spread)) for _ in range(600)] + [("g3", 7), ("g4", -5), ("g4", 3 << 24), ("g4", 0), ("g5", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    places = {"first": F.lit(1), "mid": F.floor(F.col("_n") / 2) + 1, "p90": F.least(F.floor(F.col("_n") * 90 / 100), F.col("_n") - 1) + 1, "last": F.col("_n")}
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    want = [(g, s[0], s[len(s) // 2], s[min(len(s) * 90 // 100, len(s) - 1)], s[-1]) for g, s in sorted((g, sorted(v)) for g, v in groups.items())]
    assert sorted(map(tuple, messages.selected(df, ["g"], "v", places).collect())) == want
    medians = {g: (s[(len(s) - 1) // 2] + s[len(s) // 2]) for g, s in ((g, sorted(v)) for g, v in groups.items())}
    got = {r.g: r.m for r in messages.exact_median(df, ["g"], "v", "m").collect()}
    assert got == {g: int(m / 2) for g, m in medians.items()}


def test_sketches_of_days_merge_to_the_whole(spark, sf_dir):
    talk = adapters.talk_messages(spark, sf_dir)
    exact = {(r.contact_id, r.sender): r.n for r in talk.select("contact_id", "sender", F.explode(F.split(F.lower("body"), r"\s+")).alias("w")).where("w <> ''").groupBy("contact_id", "sender").agg(F.count_distinct("w").alias("n")).collect()}
    days = activity.word_sketches(talk).cache()
    got = {(r.contact_id, r.sender): r.unique_words for r in activity.approximate_words(days, "contact_id", "sender").collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - n) <= max(2, 0.03 * n) for k, n in exact.items())
    # A day more is merged without what came before being read again.
    last = days.agg(F.max("day")).first()[0]
    total = activity.approximate_words(days.where(F.col("day") < last).unionByName(days.where(F.col("day") == last)), "sender").collect()
    whole = {r.sender: r.n for r in talk.select("sender", F.explode(F.split(F.lower("body"), r"\s+")).alias("w")).where("w <> ''").groupBy("sender").agg(F.count_distinct("w").alias("n")).collect()}
    assert len(total) == len(whole) and all(abs(r.unique_words - whole[r.sender]) <= 0.03 * whole[r.sender] for r in total)


def embedder(broken=""):
    """Vectors of lengths; while a file is there, a text with 'stop' ends the run."""

    def load():
        def vectors_of(texts):
            if broken and os.path.exists(broken) and any("stop" in t for t in texts):
                raise RuntimeError("out of memory")
            return [[float(len(t)), 1.0] for t in texts]

        return vectors_of

    return load


def test_an_interrupted_embedding_run_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i:03d}", "x" * (i % 40) + ("stop" if i == 77 else ""), i) for i in range(200)], "id string, body_searchable string, timestamp_ms long")
    folder, broken = str(tmp_path / "e"), tmp_path / "broken"
    broken.touch()
    n = 195
    assert vectors.run_embeddings(rows, folder, embedder(), "v1", dry_run=True) == n and vectors.embeddings_of(spark, folder).count() == 0
    with pytest.raises(Exception, match="out of memory"):
        vectors.run_embeddings(rows, folder, embedder(str(broken)), "v1", slice_bytes=600)
    before = vectors.embeddings_of(spark, folder).count()
    assert 0 < before < n
    broken.unlink()
    assert vectors.run_embeddings(rows, folder, embedder(str(broken)), "v1", slice_bytes=600) == n - before
    got = vectors.embeddings_of(spark, folder).collect()
    assert len(got) == len({r.message_id for r in got}) == n and all(r.vector == [float(int(r.message_id[1:]) % 40 + 4 * (r.message_id == "m077")), 1.0] for r in got)
    assert vectors.run_embeddings(rows, folder, embedder(), "v1") == 0
    assert vectors.run_embeddings(rows, folder, embedder(), "v2", limit=5) == 5
    assert vectors.run_embeddings(rows, folder, embedder(), "v3", since=190, until=195) == 6
    assert {r.message_id for r in vectors.embeddings_of(spark, folder).where("model_id = 'v2'").collect()} == {f"m{i:03d}" for i in range(1, 6)}


def test_model_registry(spark):
    schema = "name string, version string, sha256 string, model_id string"
    old = spark.createDataFrame([("a", "1", "x", "m1"), ("a", "2", "y", "m2"), ("b", "1", "x", "m3")], schema)
    new = spark.createDataFrame([("a", "1", "x", "m9"), ("c", "1", "z", "m4")], schema)
    merged = vectors.upsert_models(old, new)
    assert sorted(r.model_id for r in merged.collect()) == ["m2", "m3", "m4", "m9"]
    assert sorted(r.model_id for r in vectors.without_model(merged, "a").collect()) == ["m3", "m4"]
    assert sorted(r.model_id for r in vectors.without_model(merged, "a", "2").collect()) == ["m3", "m4", "m9"]


def test_a_refresh_takes_other_contacts_from_stored_counts(spark, sf_dir, tmp_path):
    raw, contacts, addresses = adapters.event_messages(spark, sf_dir), adapters.contacts(spark, sf_dir), adapters.contact_addresses(spark, sf_dir)
    m, out = messages.contact_messages(raw, addresses), str(tmp_path / "out")
    names = ["contact_counts", "distinctive_phrases", "phrase_counts", "text_counts"]
    persist(Analysis(m, contacts), out, names)
    late = m.where("contact_id <> 'c2' or rowid % 2 = 0")
    status = spark.createDataFrame([("c1", 0), ("c2", 1)], "contact_id string, is_stale int")
    # The bodies of all contacts but c2 can't be read: a refresh that looked at them would fail.
    guarded = late.withColumn("body", F.when(F.col("contact_id") == "c2", F.col("body")).otherwise(F.raise_error(F.lit("another contact's body"))))
    with pytest.raises(Exception, match="another contact"):
        refresh(guarded, contacts, status).distinctive_phrases().collect()
    done = persist(refresh(guarded, contacts, status, folder=out), out, names)
    assert [tuple(r) for r in done.collect()] == [("c2", True)]
    whole = Analysis(late, contacts).tables()
    for name in names:
        got = {tuple(r) for r in read_table(spark, out, name).where("contact_id = 'c2'").collect()}
        assert got == {tuple(r) for r in whole[name]().where("contact_id = 'c2'").collect()} and got
    counts = {tuple(r) for r in read_table(spark, out, "phrase_counts").collect()}
    assert counts == {tuple(r) for r in whole["phrase_counts"]().collect()}


def test_status_of_contacts_after_a_run(spark):
    status = spark.createDataFrame([("c1", 1, 1), ("c2", 1, 1)], "contact_id string, computed_at long, is_stale int")
    done = spark.createDataFrame([("c1", True), ("c3", False)], "contact_id string, had_data boolean")
    assert sorted((r.contact_id, r.computed_at, r.is_stale, r.had_data) for r in archive.computed(status, done, 9).collect()) == [("c1", 9, 0, True), ("c2", 1, 1, None), ("c3", 9, 0, False)]
