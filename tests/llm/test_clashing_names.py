"""Columns of documents whose names the operators use themselves are carried unchanged; long documents keep their lines."""

import pytest
from pyspark.sql import functions as F

from missivelake.llm import common, decontamination, line_dedup, ngram_join

NAMES = ["_id", "_key", "_kept", "_left", "_n", "_found_items", "_found_spans", "_ID2", "rows", "set", "class_key", "gone", "line", "a.b"]
TEXTS = ["one two three four five six seven", "a line that is repeated here\nunlike this other one", "a line that is repeated here", "one two three four five six seven", None, "", "the benchmark item text"]
ITEMS = [(1, "the benchmark item text")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.mark.parametrize("name", ["op1", "op2", "op5"])
def test_clashing_columns_are_carried(spark, docs, name):
    step = {"op1": lambda d: decontamination.drop_contaminated(d, spark.createDataFrame(ITEMS, "item_id long, text string")), "op2": ngram_join.keep_one, "op5": line_dedup.drop_repeated_lines}[name]
    got, plain = step(docs), step(docs.select("doc_id", "text"))
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r.doc_id, r.text) for r in rows if r.text) == sorted((r.doc_id, r.text) for r in plain.collect() if r.text)
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)
    assert {"op1": 6, "op2": 6, "op5": 5}[name] == len(rows)


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_A int, __a int, b int")
    assert common.unused(df, "_a", "b", "c", "_a") == ["___a", "_b", "c", "____a"]


def test_lines_of_a_long_document_stay_in_place(spark):
    lines = [f"line number {i} of a long document" if i % 3 else "the same short line" if i % 2 else "" for i in range(30_000)]
    text = "\n".join(lines)
    (got,) = line_dedup.report(spark.createDataFrame([(1, text)], "doc_id long, text string"), near_chars=1000).collect()
    seen, want = set(), []
    for x in lines:
        if x == "" or x not in seen:
            want.append(x)
        seen.add(x)
    assert got.text == "\n".join(want) and (got.n_lines, got.n_removed) == (30_000, 30_000 - len(want))
    plan = line_dedup.report(spark.range(1).select(F.col("id").alias("doc_id"), F.lit(text[:50]).alias("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan  # which would look through all places for each line
