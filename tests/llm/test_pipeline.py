"""Every pipeline stage against brute force over what the stage before kept, on a small corpus."""

import random
import zlib

import corpus_pipeline
from missivelake.llm import quality
from tests.llm.test_llm import brute_contamination, brute_lines, brute_links, ids  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, folder):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"{rng.choice('bcdfgm')}{rng.choice('aeiou')}{rng.randint(0, 99)}" for _ in range(n))
    item = prose(30)
    base = prose(150)
    texts = [prose(60) + "\n" + prose(40) for _ in range(30)] + ["$$$ %%% &&& " * 40 for _ in range(20)]
    near = base.split()
    near[70] = "changed"
    texts += [base, " ".join(near), "Intro of a repeated page header.\n" + prose(50), "Intro of a repeated page headers.\n" + prose(50), item + " " + prose(60), texts[3], "", None]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 30 <= i < 50), 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [(1, item), (2, None)]


def test_stages_equal_brute_force(spark, tmp_path, ids):  # noqa: F811
    items = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(({r.doc_id: r.text for r in before.collect()}, docs.collect()))
    (raw, good), (lines_in, lines), (near_in, near), (clean_in, clean), (packed_in, packed) = kept
    model = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = dict(zip(raw, model.scores([None if t is None else t.encode() for t in raw.values()]), strict=True))
    assert {r.doc_id for r in good} == {k for k, p in scores.items() if p >= 0.5} and not {r.doc_id for r in good} & set(range(30, 50))
    want = {k: t for k, t in brute_lines(list(lines_in.items())).items() if not (t is not None and not t.strip() and lines_in[k].strip())}
    assert {r.doc_id: r.text for r in lines} == want and 55 not in want and len(want) < len(lines_in)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines if r.text != lines_in[r.doc_id])
    assert {r.doc_id for r in near} == {c for _, c, _ in brute_links(list(near_in.items()))}
    assert {r.doc_id for r in clean} == {r[0] for r in brute_contamination(list(clean_in.items()), items) if not r[5]}
    for r in packed:
        whole = ids(packed_in[r.doc_id])
        assert zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert {r.doc_id for r in packed} == set(packed_in)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in again} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}
