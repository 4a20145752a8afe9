"""Column helpers over message texts, addresses and media types."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from missivelake.functions.lexicon import NEGATORS, SENTIMENT, STOPWORDS

# The texts that count as each kind of message.
LAUGH = r"(?i)\b(l(?:o+l)+l*z*|lmf?ao+|rofl|ha(?:ha)+h?|he(?:he)+h?)\b|[\x{1F602}\x{1F923}\x{1F480}]"
APOLOGY = r"(?i)\b(sorry|my bad|apologi[sz]e|apologi[sz]ed|my fault|forgive me)\b"
ENCOURAGEMENT = (
    r"(?i)\b(you got this|proud of you|believe in you|you can do it|good job|great job|well done|nice work|keep it up"
    r"|keep going|you'?re amazing|you'?re awesome|that'?s amazing|that'?s awesome|hell yeah|let'?s go|atta (?:boy|girl))\b"
)
LINK = r"(?i)\b(?:https?://|www\.)\S+"
QUESTION = r"\?\s*$"
ABOUT_ME = r"(?i)\b(i|me|my|mine|myself|i'?m|i'?ll|i'?ve|i'?d)\b"
ABOUT_YOU = r"(?i)\b(you|your|yours|yourself|you'?re|you'?ll|you'?ve|you'?d|u)\b"

#: Emoji code points and ranges of the public Unicode emoji data (hexadecimal).
EMOJI = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9 21AA 231A 231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA 25AB 25B6 25C0 "
    "25FB-25FE 2600-2604 260E 2611 2614 2615 2618 261D 2620 2622 2623 2626 262A 262E 262F 2638-263A 2640 2642 2648-2653 "
    "265F 2660 2663 2665 2666 2668 267B 267E 267F 2692-2697 2699 269B 269C 26A0 26A1 26AA 26AB 26B0 26B1 26BD 26BE 26C4 "
    "26C5 26C8 26CE 26CF 26D1 26D3 26D4 26E9 26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D "
    "2721 2728 2733 2734 2744 2747 274C 274E 2753-2755 2757 2763 2764 2795-2797 27A1 27B0 27BF 2934 2935 2B05-2B07 2B1B "
    "2B1C 2B50 2B55 3030 303D 3297 3299 200D 20E3 FE0F 1F004 1F0CF 1F170 1F171 1F17E 1F17F 1F18E 1F191-1F19A 1F201 1F202 "
    "1F21A 1F22F 1F232-1F23A 1F250 1F251 1F300-1F64F 1F680-1F6FF 1F7E0-1F7EB 1F90D-1F9FF 1FA70-1FAFF"
)


def emoji_class(spec: str = EMOJI) -> str:
    """The ranges as the inside of a regular-expression character class."""
    return "".join("-".join(rf"\x{{{end}}}" for end in part.split("-")) for part in spec.split())


_EMOJI_CLUSTER = rf"[{emoji_class()}]|[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}"


def is_laugh(body: Column) -> Column:
    return body.rlike(LAUGH)


def is_apology(body: Column) -> Column:
    return body.rlike(APOLOGY)


def is_encouragement(body: Column) -> Column:
    return body.rlike(ENCOURAGEMENT)


def is_question(body: Column) -> Column:
    return body.rlike(QUESTION)


def contains_link(body: Column) -> Column:
    return body.rlike(LINK)


def emojis(body: Column) -> Column:
    """The emoji of a text, one for each grapheme cluster; a text-style selector cancels one."""
    clusters = F.regexp_extract_all(body, F.lit(r"\X"), F.lit(0))
    found = F.filter(clusters, lambda x: x.rlike(_EMOJI_CLUSTER) & ~x.rlike(r"\x{FE0E}"))
    return F.when(body.rlike(r"[^\x00-\x7F]"), found).otherwise(F.array().cast("array<string>"))


def words(body: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(body, F.lit("")), r"\s+"), lambda x: x != "")


def phrase_tokens(body: Column, min_bytes: int = 3) -> Column:
    """Lower-cased letters, digits and apostrophes of each word; short and all-digit tokens are dropped."""
    bare = F.transform(words(body), lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}']", "")))
    return F.filter(bare, lambda x: (F.octet_length(x) >= min_bytes) & ~x.rlike(r"^\p{N}+$"))


def phrases(tokens: Column, sizes: tuple[int, ...] = (2, 3), stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """N-grams of a token list that hold no stopword."""
    def grams(n: int) -> Column:
        places = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        kept = F.filter(places, lambda i: ~F.exists(F.slice(tokens, i, n), lambda x: x.isin(*stopwords)))
        return F.transform(kept, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.concat(*[grams(n) for n in sizes])


def sentiment(body: Column, lexicon: dict[str, int] | None = None, negators: tuple[str, ...] = NEGATORS, window: int = 3) -> Column:
    """Sum of the valences of a text's words, each turned if a negator is among the window words before it."""
    by_value: dict[int, list[str]] = {}
    for word, value in (lexicon or SENTIMENT).items():
        by_value.setdefault(value, []).append(word)

    def valence(x: Column) -> Column:  # a set for each value, since a map is searched from its start
        out = F.lit(0)
        for value, known in by_value.items():
            out = F.when(x.isin(*known), value).otherwise(out)
        return out

    no = F.array(*[F.lit(w) for w in negators])
    bare = F.filter(F.transform(words(body), lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}']", ""))), lambda x: x != "")
    # Each token travels with the ones before it, so that the list itself is built once.
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        value = valence(x)
        signed = F.when(F.arrays_overlap(acc["last"], no), -value).otherwise(value)
        last = F.slice(F.concat(F.array(x), acc["last"]), 1, window)
        return F.struct((acc["sum"] + signed).alias("sum"), last.alias("last"))

    return F.aggregate(bare, F.struct(F.lit(0).alias("sum"), none.alias("last")), step, lambda acc: acc["sum"].cast("double"))


def first_name(name: Column) -> Column:
    """Letters, digits and apostrophes of the first word of a name; null if under two bytes."""
    token = F.regexp_replace(F.element_at(F.split(F.trim(name), r"\s+"), 1), r"[^\p{L}\p{N}']", "")
    return F.when(F.octet_length(token) >= 2, token)


def normalize_address(address: Column) -> Column:
    """Digits and plus signs; a leading +1 goes if ten digits follow it."""
    bare = F.regexp_replace(address, r"[^0-9+]", "")
    return F.when(bare.rlike(r"^\+1[0-9]{10}$"), F.substring(bare, 3, 10)).otherwise(bare)


def phone_key(address: Column) -> Column:
    """Digits for matching: eleven with a leading 1 become ten; a plus stays only where the text starts with one."""
    digits = F.regexp_replace(address, r"[^0-9]", "")
    folded = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    plus = F.trim(address).startswith("+") & ~((F.length(digits) == 11) & digits.startswith("1"))
    return F.when(plus, F.concat(F.lit("+"), folded)).otherwise(folded)


def media_category(mime: Column) -> Column:
    m = F.lower(F.trim(mime))
    return (
        F.when(m == "image/gif", "gif")
        .when(m == "application/ogg", "audio")
        .when(m.startswith("image/"), "image")
        .when(m.startswith("video/"), "video")
        .when(m.startswith("audio/"), "audio")
        .otherwise("other")
    )


def message_type_label(code: Column) -> Column:
    return F.when(code == 2, "mms").when(code == 3, "rcs").otherwise("sms")


def direction_code(kind: Column) -> Column:
    """1 incoming, 2 outgoing, 0 unknown, from a backup's type or msg_box text."""
    return F.when(F.trim(kind) == "1", 1).when(F.trim(kind) == "2", 2).otherwise(0)


def is_mine(direction: Column, address: Column, own: list[str]) -> Column:
    return F.when(direction == 2, True).when(direction == 1, False).otherwise(address.isin(*own) if own else F.lit(False))


def duration_label(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d")))
    )


def rating_label(score: Column) -> Column:
    return (
        F.when(score >= 90, "exceptional").when(score >= 75, "great").when(score >= 60, "solid").when(score >= 45, "casual").when(score >= 25, "loose tie").otherwise("infrequent")
    )


def preview(body: Column, max_bytes: int = 160) -> Column:
    """A trimmed text, cut on a character boundary within max_bytes bytes, with an ellipsis if cut."""
    trimmed = F.trim(body)
    chars = F.slice(F.filter(F.split(F.substring(trimmed, 1, max_bytes), ""), lambda x: x != ""), 1, max_bytes)

    def step(acc: Column, c: Column) -> Column:
        size = acc["size"] + F.octet_length(c)
        fits = size <= max_bytes
        return F.struct(size.alias("size"), F.when(fits, F.concat(acc["text"], c)).otherwise(acc["text"]).alias("text"))

    cut = F.aggregate(chars, F.struct(F.lit(0).alias("size"), F.lit("").alias("text")), step, lambda acc: F.concat(acc["text"], F.lit("…")))
    return F.when(F.octet_length(trimmed) <= max_bytes, trimmed).otherwise(cut)


def like_pattern(term: str) -> str:
    return term if "%" in term else f"%{term}%"


def _normal_form(form: str):
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return convert


def normal_form(body: Column, form: str = "NFC") -> Column:
    """Unicode normal form. Spark has no built-in; plain ASCII texts are their own form and go to the Arrow function as nulls."""
    other = F.when(~body.rlike(r"^\p{ASCII}*$"), body)
    return F.coalesce(F.pandas_udf(_normal_form(form), "string")(other), body)


def chi_square_2x2(observed_a: Column, total_a: Column, observed_b: Column, total_b: Column) -> Column:
    """Doubled one-column chi-square of two groups; 0 if either is empty."""
    share = (observed_a + observed_b) / (total_a + total_b)
    term = lambda o, t: F.when(share * t > 0, F.pow(o - share * t, F.lit(2)) / (share * t)).otherwise(0.0)
    return F.when((total_a == 0) | (total_b == 0), 0.0).otherwise(2 * (term(observed_a, total_a) + term(observed_b, total_b)))
