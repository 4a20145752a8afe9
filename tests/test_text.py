from collections import Counter

from pyspark.sql import functions as F

from missivelake.functions import lexicon
from missivelake.functions import text as T


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def values(spark, rows, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, x {kind}").select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_kinds(spark):
    assert values(spark, ["lol", "LMAO ok", "hahah", "heheh", "\U0001F602", "hello", "ham", "lolz"], T.is_laugh) == [True, True, True, True, True, False, False, True]
    assert values(spark, ["Sorry!", "my bad", "apologised", "sorrynot"], T.is_apology) == [True, True, True, False]
    assert values(spark, ["ok? ", "why?", "what", "a ? b"], T.is_question) == [True, True, False, False]
    assert values(spark, ["you got this", "youre amazing", "let's go", "good jobs"], T.is_encouragement) == [True, True, True, False]
    assert values(spark, ["see https://a.b", "www.x.y", "a.com", "http://"], T.contains_link) == [True, True, False, False]


def test_emojis(spark):
    rows = ["\U0001F1EB\U0001F1F7", "\U0001F1EB", "❤️", "❤︎", "\U0001F44F\U0001F3FD", "\U0001F468‍\U0001F469‍\U0001F467", "1️⃣", "123 # ©", "→ 中"]
    assert [len(x) for x in values(spark, rows, T.emojis)] == [1, 0, 1, 0, 1, 1, 1, 1, 0]


def test_sentiment(spark):
    rows = ["love it", "not happy", "never ever really happy", "no one two three happy", "", "12 34", "terrible!"]
    assert values(spark, rows, T.sentiment) == [3.0, -2.0, -2.0, 2.0, 0.0, 0.0, -3.0]


def test_words_of_every_valence_and_negator(spark):
    assert len(lexicon.SENTIMENT) == 116 and Counter(lexicon.SENTIMENT.values()) == {3: 13, 2: 28, 1: 16, -1: 11, -2: 30, -3: 18}
    rows = ["thanks", "whatever", "yeah right", "grief", "hardly happy", "nowhere good", "kind", "Not sad, glad"]
    assert values(spark, rows, T.sentiment) == [2.0, -1.0, 2.0, -3.0, 2.0, -2.0, 0.0, 0.0]
    assert values(spark, ["up up", "no up"], lambda x: T.sentiment(x, {"up": 5}, ("no",))) == [10.0, -5.0]
    assert len(lexicon.STOPWORDS) == 197


def test_phrases(spark):
    tokens = lambda x: T.phrase_tokens(x)
    assert one(spark, "Pizza, at 123 the Movie-night", tokens) == ["pizza", "the", "movienight"]
    assert one(spark, "pizza movie snack", lambda x: T.phrases(T.phrase_tokens(x))) == ["pizza movie", "movie snack", "pizza movie snack"]
    assert one(spark, "pizza movie night", lambda x: T.phrases(T.phrase_tokens(x))) == ["pizza movie"]
    assert one(spark, "pizza the snack", lambda x: T.phrases(T.phrase_tokens(x))) == []


def test_addresses(spark):
    rows = ["+1 (305) 555-0182", "3055550182", "+44 20 1234", "+6789"]
    assert values(spark, rows, T.normalize_address) == ["3055550182", "3055550182", "+44201234", "+6789"]
    assert values(spark, ["1 305 555 0182", "+44 20", "(305) 555-0182"], T.phone_key) == ["3055550182", "+4420", "3055550182"]


def test_small_helpers(spark):
    assert values(spark, ["image/GIF ", "application/ogg", "image/heic", "text/plain", "video/mp4"], T.media_category) == ["gif", "audio", "image", "other", "video"]
    assert values(spark, [59_999, 60_000, 3_600_000, 86_400_000], T.duration_label, "long") == ["59s", "1m", "1h", "1d"]
    assert values(spark, [90, 75, 60, 45, 25, 0], T.rating_label, "int") == ["exceptional", "great", "solid", "casual", "loose tie", "infrequent"]
    assert values(spark, ["Anne-Marie Lee", " Bo ", "X", ""], T.first_name) == ["AnneMarie", "Bo", None, None]
    assert values(spark, ["short ", "é" * 100], T.preview) == ["short", "é" * 80 + "…"]
    assert values(spark, ["\u00e9", "abc"], lambda x: T.normal_form(x, "NFKD")) == ["e\u0301", "abc"]
    assert T.like_pattern("a%") == "a%" and T.like_pattern("a") == "%a%"
