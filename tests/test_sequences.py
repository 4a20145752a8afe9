"""Conversations, responses, points, streaks and rating on tiny sequences."""

import math

import pytest
from pyspark.sql import functions as F

from missivelake.config import DAY, HOUR, MINUTE
from missivelake.operators import activity, conversations, insights, messages, points, rating, responses

T0 = 1_704_067_200_000  # 2024-01-01 00:00 UTC


def seq(spark, rows, contact="c"):
    """(offset ms, sender[, body]) in order."""
    data = [(contact, i, T0 + r[0], r[1], r[2] if len(r) > 2 else "x", []) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "contact_id string, rowid long, timestamp_ms long, sender int, body string, mime_types array<string>")


def convs(spark, rows):
    c = conversations.with_moments(conversations.conversations(messages.enriched(seq(spark, rows))))
    return c.orderBy("conv_seq").collect()


def test_empty_and_single(spark):
    assert convs(spark, []) == []
    (c,) = convs(spark, [(0, 1)])
    assert c.is_missed and c.missed_by == 2 and c.started_by == 1


def test_timeout_is_strict(spark):
    assert len(convs(spark, [(0, 1), (4 * HOUR, 2)])) == 1
    assert len(convs(spark, [(0, 1), (4 * HOUR + 1, 2)])) == 2


def test_order_crosses_midnight(spark):
    e = messages.enriched(seq(spark, [(23 * HOUR, 1), (25 * HOUR, 2), (49 * HOUR, 1), (49 * HOUR, 2)])).orderBy("rowid").collect()
    assert [r.conv_seq for r in e] == [1, 1, 2, 2]
    assert [r.gap_ms for r in e] == [None, 2 * HOUR, 24 * HOUR, 0]


def test_reconnect_tiers(spark):
    gaps = [DAY, 7 * DAY, 30 * DAY, 12 * HOUR, 12 * HOUR, 12 * HOUR, 12 * HOUR, 200 * DAY]
    at, rows = 0, [(0, 1)]
    for g in gaps:
        at += g
        rows.append((at, 1))
    assert [c.reconnect_tier for c in convs(spark, rows)] == [0, 1, 2, 4, 0, 0, 0, 0, 4]


def test_big_moments(spark):
    rows, at = [], 0
    for size in [2] * 9 + [12]:
        rows += [(at + k, 1 + k % 2) for k in range(size)]
        at += 5 * HOUR
    assert [c.is_big_moment_dynamic for c in convs(spark, rows)] == [False] * 9 + [True]


def test_responses(spark):
    e = messages.enriched(seq(spark, [(0, 1), (30_000, 2), (9 * HOUR, 1), (9 * HOUR + 1, 1), (33 * HOUR + 2, 2)]))
    r = responses.responses(e).orderBy("rowid").collect()
    assert [(x.sender, x.response_ms, x.is_rapid, x.is_overnight, x.is_first) for x in r] == [(2, 30_000, True, False, True), (1, 9 * HOUR - 30_000, False, True, False)]
    d = responses.double_messages(e).first()
    assert (d.my_doubles, d.their_doubles) == (1, 0)


def test_histogram_edges(spark):
    rows, at = [(0, 1)], 0
    for k, gap in enumerate([29_999, 30_000, DAY - 1, DAY]):
        at += gap
        rows.append((at, 2 - k % 2))
    assert [r.bucket for r in responses.responses(messages.enriched(seq(spark, rows))).orderBy("rowid").collect()] == [0, 1, 6, 7]


@pytest.mark.parametrize("values,median", [([5, 10], 7), ([1, 2, 3, 4], 2), ([3], 3), ([9, 1, 1], 1)])
def test_exact_median(spark, values, median):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v long")
    assert messages.exact_median(df, ["k"], "v", "m").first().m == median


def test_points(spark):
    p = points.message_points(messages.enriched(seq(spark, [(0, 1, "hello world"), (30_000, 2, "a"), (120_000, 1, "b")]))).orderBy("rowid").collect()
    assert p[0].points == pytest.approx(1 + 0.1 * math.log(3) + 5)
    assert p[1].points == pytest.approx(1 + 0.1 * math.log(2) + 2)
    assert p[2].points == pytest.approx(1 + 0.1 * math.log(2))


def test_streaks(spark):
    daily = spark.createDataFrame([("c", d, 1, 0) for d in ("2024-01-01", "2024-01-02", "2024-01-06")], "contact_id string, day string, my_messages long, their_messages long")
    s = activity.streaks(daily, "2024-01-08").first()
    assert (s.longest_active, s.longest_silent, s.current_active, s.current_silent) == (2, 3, 0, 2)
    s = activity.streaks(daily, "2024-01-01").first()
    assert (s.current_active, s.current_silent) == (1, 0)


def test_count_tiers(spark):
    pairs = [(51, 49), (1100, 1000), (600, 500), (750, 500), (1000, 500), (1500, 500), (100, 0)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
    got = [r[0] for r in rows.orderBy("i").select(insights.count_tier(F.col("a"), F.col("b"))).collect()]
    assert got == [None, None, 1, 2, 3, 4, 4]
    samples = spark.createDataFrame([(10,), (60,), (200,), (1000,)], "n int").orderBy("n").select(insights.confidence(F.col("n"))).collect()
    assert [r[0] for r in samples] == [None, 0, 1, 2]


def test_rating_parts(spark):
    def value(c):
        return spark.range(1).select(c).first()[0]

    lit = lambda x: F.lit(x).cast("long")
    assert [value(rating.evenness(lit(a), lit(b))) for a, b in ((5, 5), (5, 0), (25, 75), (0, 0))] == [1.0, 0.0, 0.5, 0.5]
    assert [value(rating.responsiveness(lit(m), lit(None))) for m in (0, 5 * MINUTE, HOUR, 6 * HOUR, 7 * HOUR, None)] == [100, 80, 50, 0, 0, 50]
    assert [value(rating.longevity(lit(0), lit(d * DAY))) for d in (0, 10, 100, 365, 5 * 365)] == [0, 10, 25, 50, 100]


def test_consistency_counts_silent_weeks(spark):
    days = [f"2024-{m:02d}-{d:02d}" for m in (1, 3) for d in range(1, 8)]
    daily = spark.createDataFrame([("c", d, 1, 1) for d in days], "contact_id string, day string, my_messages long, their_messages long")
    steady = spark.createDataFrame([("c", f"2024-01-{d:02d}", 1, 1) for d in range(1, 32)], "contact_id string, day string, my_messages long, their_messages long")
    assert rating.consistency(daily).first().consistency < 60
    assert rating.consistency(steady).first().consistency == 100


def test_ratios_of_insights_are_rounded_as_sql_rounds_them(spark):
    pairs = [(66, 16), (74, 16), (82, 16), (201, 200), (203, 200), (207, 200), (1001, 1000), (314, 200), (1257, 800), (3, 2), (10**9 + 5, 8)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", insights._places(F.col("a") / F.col("b"), 2).alias("x"), insights._places(F.col("b") * 100 / F.col("a"), 1).alias("y"))
    assert [(r.x, r.y) for r in df.orderBy("a", "b").collect()] == [(f"{a / b:.2f}", f"{b * 100 / a:.1f}") for a, b in sorted(pairs)]
    none = [F.lit(0).cast("long").alias(f"{s}_{c}") for s in ("my", "their") for c in ("laugh", "apology", "encouragement", "question")]
    counts = spark.createDataFrame([("u", 66, 16), ("v", 257, 200)], "contact_id string, my_messages long, their_messages long").select("*", *none)
    pairs = counts.select("contact_id", *[F.lit(n).cast("long").alias(c) for c, n in (("started_by_me", 1), ("started_by_them", 1), ("closed_by_me", 0), ("closed_by_them", 0), ("missed_by_me", 0), ("missed_by_them", 0), ("n_conversations", 2), ("reconnects_1", 0), ("reconnects_2", 0), ("reconnects_3", 0), ("reconnects_4", 0))])
    replies = counts.select("contact_id", *[F.lit(None).cast("long").alias(f"{s}_median{m}_ms") for s in ("my", "their") for m in ("", "_first")])
    said = {r.contact_id: r.detail for r in insights.insights(counts, pairs, replies).where("id = 'messages_volume'").collect()}
    # 57 / 200 * 100 is 28.499999999999996, 57 * 100 / 200 is 28.5
    assert said == {"u": "4.12× as often (66 vs 16, +313%)", "v": "1.28× as often (257 vs 200, +29%)"}
