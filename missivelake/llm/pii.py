"""Personal data by weak supervision, in DataFrame operations only.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Beyond them a wider pattern proposes
candidates (numbers of seven digits or more, account codes, long hexadecimal secrets, handles). Four labelers vote on
each candidate, for, against or not at all: a *regex* one (national formats, check digits, dates), a *gazetteer* one
(issuer prefixes, country codes, words that are no handles), a *context* one (cue words before it, in four languages)
and a *shape* one (length, key-value marks). Expectation-maximisation over the counted vote patterns estimates how
reliable each labeler is and how probable each pattern makes personal data; a logistic span classifier is then fitted to
these probabilities on kind, votes and length, and decides which candidates become spans.

Counting patterns is one Spark aggregation; what reaches the driver is one row for each pattern, of which there are a
few thousand at most in any corpus. Texts are scanned once; every pattern is anchored so that long runs cost linear time.

Defined results: a null text counts as empty and has no spans; rows are judged each on its own; offsets count code
points, the end is exclusive; candidates that overlap a base span are not proposed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missivelake.llm.common import stored

# Fixed patterns of the contract, anchored at the start of a run of their first class (or where the last match ended),
# with possessive loops: the same matches without rescanning a run from each of its characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: Values that are summed up in one list.
STEP = 128
BASE = ("email", "ip", "card", "phone")
EXTRA = ("number", "account", "secret", "handle")

CANDIDATE = (
    r"(?<![A-Za-z0-9])(?:[A-Fa-f0-9]{24,64}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9][0-9 .()/-]{5,22}[0-9]|@[A-Za-z0-9_]{3,30})(?![A-Za-z0-9])"
)
FORMATS = r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9](?:[ .][0-9]{2}){4})$"
DATES = r"^(?:(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}|[0-9]{1,3}(?:[ .][0-9]{3})+|[0-9]+\.[0-9]+)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|00|0[1-9]|1[ .-]?[2-9])"
COUNTRIES = ("AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IT", "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK")
NO_HANDLES = ("media", "import", "param", "return", "returns", "override", "charset", "author", "see", "since", "version", "test", "property")
CUES = r"(?i)(?:tel|phone|call|mobile|cell|fax|sms|contact|card|visa|account|acct|iban|ssn|passport|licen[cs]e|e-?mail|mail|address|customer|client|patient|tax|login|user|token|key|secret|password|téléphone|compte|carte|telefon|handy|konto|ausweis|teléfono|cuenta|tarjeta|correo)[a-zé]{0,6}[ .:#=\"'(]{0,4}(?:(?:no|nr|num|number|is|id)\.?[ :=#]{0,2})?$"
AGAINST = r"(?i)(?:[$€£#§%]|\b(?:page|pages|version|chapter|isbn|issn|rfc|eur|usd|total|sum|build|p|v)\.?)[ :]{0,2}$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """The sum of all values before each place. Lists are grown by one STEP at a time only, and the sums of steps on their
    own, so that long arrays cost little more than in proportion. values is a plain reference."""
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    add = lambda acc, x: acc + x
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / STEP).cast("int")), lambda k: F.slice(values, k * STEP + 1, STEP))

    def sums(steps: Column) -> Column:
        before = F.aggregate(F.transform(steps, lambda s: F.aggregate(s, F.lit(0), add)), F.array(F.lit(0)), grow)
        return F.flatten(F.zip_with(steps, before, lambda s, b: F.when(s.isNotNull(), F.slice(F.aggregate(s, F.array(b), grow), 1, F.size(s))).otherwise(F.array().cast("array<int>"))))

    return let(steps, sums)


def spans_of(text: Column, pattern: str) -> Column:
    """start, end and value of the leftmost non-overlapping matches, and up to 48 characters before each.

    The pieces between matches and the matches alternate, so their lengths add up to the places in code points.
    """
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    cut = F.filter(found, lambda x: x["value"].isNotNull())

    def span(x: Column, before: Column) -> Column:
        start = before + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        return F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["gap"], F.lit(48)).alias("before"))

    def places(cut: Column) -> Column:
        lengths = F.transform(cut, lambda x: F.char_length(x["gap"]) + F.char_length(x["value"]))
        return F.zip_with(cut, let(lengths, running_sums), span)

    return let(cut, places)


def overlaps(x: Column, spans: Column | str) -> Column:
    """Whether a span shares characters with one of an ordered list without overlaps: found by bisection."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def halve(acc: Column, _: Column) -> Column:  # low of them start before x ends, and those from high on don't
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        starts = F.get(spans, middle)["start"] < x["end"]
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & starts, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~starts, middle).otherwise(acc["high"]).alias("high"))

    low = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda acc: acc["low"])
    return F.coalesce(F.get(spans, low - 1)["end"] > x["start"], F.lit(False))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    chars = F.filter(F.split(F.reverse(digits(value)), ""), lambda x: x != "")

    def worth(x: Column, i: Column) -> Column:
        v = x.cast("int")
        return F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))

    return F.aggregate(F.transform(chars, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Valid base spans by kind; patterns run only over texts that can hold a match."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    count = lambda x: F.char_length(digits(x["value"]))
    found = {
        "email": (F.contains(text, F.lit("@")), EMAIL, lambda x: F.lit(True)),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: x["value"].rlike(IP_PART)),
        "card": (text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), CARD, lambda x: count(x).between(16, 19) & luhn(x["value"])),
        "phone": (F.contains(text, F.lit("+")), PHONE, lambda x: count(x).between(8, 15)),
    }
    return {k: F.when(can, F.filter(spans_of(text, pattern), fine)).otherwise(none) for k, (can, pattern, fine) in found.items()}


def _candidates(text: Column) -> Column:
    """kind, start, end, the four votes and a length class of every candidate."""

    def features(x: Column) -> Column:
        value, before = x["value"], x["before"]
        n = F.char_length(digits(value))
        handle, hexes = value.startswith("@"), value.rlike("^[A-Fa-f0-9]{24,}$") & value.rlike("[A-Fa-f]")
        account = value.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
        kind = F.when(handle, "handle").when(account & ~hexes, "account").when(hexes, "secret").otherwise("number")
        regex = (
            F.when(handle, F.when(value.rlike("[0-9_]"), 1).otherwise(0))
            .when(hexes, F.when(F.char_length(value).isin(24, 32, 40, 48, 56, 64), 1).otherwise(0))
            .when(account, F.when(F.char_length(value) >= 15, 1).otherwise(-1))
            .when(value.rlike(DATES), -1)
            .when(value.rlike(FORMATS) | (n.between(13, 19) & luhn(value)), 1)
            .otherwise(0)
        )
        gazetteer = (
            F.when(handle, F.when(F.lower(F.substring(value, 2, 64)).isin(*NO_HANDLES), -1).otherwise(0))
            .when(account & ~hexes, F.when(F.substring(value, 1, 2).isin(*COUNTRIES), 1).otherwise(-1))
            .when(hexes, 0)
            .otherwise(F.when(value.rlike(ISSUERS), 1).otherwise(0))
        )
        context = F.when(before.rlike(CUES), 1).when(before.rlike(AGAINST), -1).otherwise(0)
        shape = F.when(before.rlike("[:=\"']\\s?$"), 1).when(handle | hexes | account, 0).when(n >= 9, 1).when(n < 8, -1).otherwise(0)
        length = F.least(F.lit(4), F.floor(F.char_length(value) / 8)).cast("int")
        votes = {"regex": regex, "gazetteer": gazetteer, "context": context, "shape": shape}
        return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *[v.cast("int").alias(k) for k, v in votes.items()], length.alias("length"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,regex:int,gazetteer:int,context:int,shape:int,length:int>>")
    return F.when(text.rlike(r"[0-9][0-9 .()/-]{5}|[A-Fa-f0-9]{24}|@[A-Za-z0-9_]{3}"), F.transform(spans_of(text, CANDIDATE), features)).otherwise(none)


VOTERS = ("regex", "gazetteer", "context", "shape")
Pattern = tuple[str, int, int, int, int, int]  # kind, votes, length


def expectation_maximisation(counts: dict[Pattern, int], rounds: int = 50) -> tuple[dict[Pattern, float], dict[str, dict[int, float]]]:
    """How probable each pattern makes personal data, and each labeler's log-odds for each of its votes.

    Labelers are taken as independent given the truth; each kind has its own prior. Started from the majority of votes.
    """
    p = {k: 0.5 + 0.4 * max(-1, min(1, sum(k[1:5]))) - 0.1 * (sum(k[1:5]) == 0) for k in counts}
    odds: dict[str, dict[int, float]] = {}
    for _ in range(rounds):
        prior = {}
        for kind in sorted({k[0] for k in counts}):
            own = [(p[k], n) for k, n in counts.items() if k[0] == kind]
            share = (sum(q * n for q, n in own) + 1) / (sum(n for _, n in own) + 2)
            prior[kind] = math.log(share / (1 - share))
        for i, voter in enumerate(VOTERS, 1):
            yes, no = dict.fromkeys((-1, 0, 1), 1.0), dict.fromkeys((-1, 0, 1), 1.0)
            for k, n in counts.items():
                yes[k[i]] += p[k] * n
                no[k[i]] += (1 - p[k]) * n
            ty, tn = sum(yes.values()), sum(no.values())
            odds[voter] = {v: math.log(yes[v] / ty) - math.log(no[v] / tn) for v in yes}
            if odds[voter][1] < odds[voter][-1]:  # a labeler counts for its own side
                odds[voter] = {v: 0.0 for v in yes}
        for k in counts:
            z = prior[k[0]] + sum(odds[v][k[i]] for i, v in enumerate(VOTERS, 1))
            p[k] = 1 / (1 + math.exp(-max(-30, min(30, z))))
    return p, odds


def _inputs(k: Pattern) -> list[str]:
    return ["bias", f"kind {k[0]}", f"length {k[5]}", *[f"{v} {k[i]}" for i, v in enumerate(VOTERS, 1) if k[i]]]


def fit_classifier(counts: dict[Pattern, int], p: dict[Pattern, float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic model of the probabilities on kind, length and votes; patterns weigh by the root of their count."""
    w = dict.fromkeys(sorted({x for k in counts for x in _inputs(k)}), 0.0)
    rows = [(_inputs(k), p[k], math.sqrt(n)) for k, n in sorted(counts.items())]
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(rounds):
        grad = {x: decay * v for x, v in w.items()}
        for names, y, n in rows:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[x] for x in names)))))
            for x in names:
                grad[x] += (q - y) * n / total
        for x in w:
            w[x] -= rate * grad[x]
    return w


def _logit(x: Column, w: dict[str, float]) -> Column:
    z = F.lit(w.get("bias", 0.0))
    for name, v in w.items():
        if name != "bias":
            field, value = name.split(" ")
            z = z + F.when(x[field] == (value if field == "kind" else int(value)), v).otherwise(0.0)
    return z


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind, and `extra`: kind, start and end of the candidates that the classifier takes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    place = "transform({0}, x -> named_struct('start', x.start, 'end', x.end))"
    scanned = rows.select("doc_id", *[v.alias(k) for k, v in base_spans(text).items()], _candidates(text).alias("candidates"))
    scanned = stored(scanned.select("doc_id", *[F.expr(place.format(k)).alias(k) for k in BASE], "candidates"), "pii-scan")
    free = F.filter("candidates", lambda x: ~reduce(lambda a, b: a | b, [(F.size(k) > 0) & overlaps(x, k) for k in BASE]))
    open_rows = scanned.where(F.size("candidates") > 0).select(F.explode(free).alias("c")).select("c.*")
    names = ("kind", *VOTERS, "length")
    counts = {tuple(r[k] for k in names): r.n for r in open_rows.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    weights = fit_classifier(counts, expectation_maximisation(counts)[0]) if counts else {}
    taken = F.filter(free, lambda x: _logit(x, weights) > 0)
    return scanned.select("doc_id", *BASE, F.transform(taken, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("extra"))


def _named(spans: Column | str, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and places of the spans of every document, and the number of all its spans."""
    found = find(docs)
    base = F.concat(*[_named(k, k) for k in BASE])
    extra = [_named(F.filter("extra", _is(k)), k) for k in EXTRA]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, *extra), ",").alias("spans"),
        (reduce(lambda a, b: a + b, [F.size(k) for k in BASE]) + F.size("extra")).cast("long").alias("n_spans"),
    )
