"""Toxicity: a counterfactually regularised classifier.

A text is scored by a logistic model over the words it holds and over word beginnings that several of its words share
(languages that build words from stems vary the rest): those whose presence in the labelled texts depends on the label
at MIN_CHI2 or more. A word counts once, in any length of text. A beginning counts by how densely its distinct words
stand in the text, at most once, since in long texts a few such words come by chance.

Identity terms are the rows of interchangeable names in ``identity`` (by default IDENTITY), which are always among the model's
words. They are given, not learnt: what a corpus itself says of a word is how its texts are labelled, and a word that leans
to toxic texts may be a group's name or a mild insult.

In training, every labelled text that names an identity term has a counterfactual twin: in each of its sentences the
terms are swapped for their counterparts. The loss holds, besides the log loss, ``penalty`` times the squared change of
the score between twins, taken before the logistic function so that it counts alike for low and high scores; so naming
a group does not by itself raise a score.

The model is fitted on at most ``max_train`` labelled documents (smallest hashes of ids, then of texts), a parameter. Defined results: a null
or empty text scores as a text without chosen words; texts are scored whole, whatever their length; repeated rows score
alike and are each returned; other columns are ignored, whatever their names; labels that are null or belong to no
document are ignored; with labels of fewer than two kinds every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missivelake.llm.common import chunks, fold, stored, texts, words_of
from missivelake.llm.quality import sample

MAX_TRAIN = 8000
MIN_CHI2 = 25.0
PENALTY = 0.25
#: Lengths in bytes of word beginnings, how many distinct words make one count, and the words of text for each of them
#: up to which it counts in full.
STEMS, LEVELS, SHARE = (4, 5, 6, 7, 8), (2, 3), 400

#: Neutral group names, each row a set of interchangeable terms (English, French, German, Spanish).
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)


def swaps(identity: tuple[tuple[str, ...], ...]) -> dict[bytes, bytes]:
    """Each term with the next of its row."""
    return {row[i].encode(): row[(i + 1) % len(row)].encode() for row in identity for i in range(len(row)) if len(row) > 1}


_SENTENCE = re.compile(rb"[.!?\n]+")

Features = dict[bytes, float]


def features(words: list[bytes], known: set[bytes] | None = None, stems: dict[int, set[bytes]] | None = None) -> Features:
    """A text's words, each with value 1, and <beginning>k for every beginning of k distinct words or more (k of LEVELS),
    with its density as value; only the known ones if given."""
    distinct = set(words)
    out = dict.fromkeys(distinct if known is None else distinct & known, 1.0)
    for n in STEMS if stems is None else stems:
        wanted = None if stems is None else stems[n]
        found = Counter([w[:n] for w in distinct if len(w) >= n] if wanted is None else [x for w in distinct if (x := w[:n]) in wanted])
        for x, c in found.items():
            value = min(1.0, c * SHARE / len(words))
            out.update((b"<%b>%d" % (x, k), value) for k in LEVELS if c >= k)
    return out


def stems_of(names: set[bytes]) -> dict[int, set[bytes]]:
    """The beginnings among features' names, by length."""
    stems: dict[int, set[bytes]] = {}
    for w in names:
        if w.startswith(b"<"):
            x = w[1 : w.rindex(b">")]
            stems.setdefault(len(x), set()).add(x)
    return stems


def twin(text: bytes | None, identity: dict[bytes, bytes]) -> list[bytes] | None:
    """The words of the text after the identity terms of each of its sentences were swapped; None if it names none."""
    out: list[bytes] = []
    named = False
    for sentence in _SENTENCE.split(text or b""):
        words = words_of(sentence)
        if not identity.keys().isdisjoint(words):
            named = True
            words = [identity.get(w, w) for w in words]
        out += words
    return out if named else None


@dataclass
class WordModel:
    bias: float
    weights: Features

    def __post_init__(self) -> None:
        self.words = {w for w in self.weights if not w.startswith(b"<")}
        self.stems = stems_of(self.weights.keys())

    def scores(self, rows: list[bytes | None]) -> list[float]:
        logits = []
        for x in rows:
            found = features(words_of(x), self.words, self.stems)
            logits.append(self.bias + sum(sorted(self.weights[w] * v for w, v in found.items() if w in self.weights)))
        return (1 / (1 + np.exp(-np.clip(logits, -30, 30)))).tolist()


def fit(rows: list[Features], twins: list[Features | None], y: np.ndarray, words: list[bytes], *, penalty: float = PENALTY, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> WordModel:
    """Full-batch Adam on log loss + penalty * (logit of the twin - logit)^2 + decay * weights^2."""
    at = {w: i for i, w in enumerate(words)}

    def entries(bags: list[Features]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, word and value of the entries of the texts' matrix, of which each row has few."""
        cells = [(i, at[w], v) for i, bag in enumerate(bags) for w, v in sorted(bag.items()) if w in at]
        row, word, value = zip(*cells, strict=True) if cells else ((), (), ())
        return np.array(row, np.int64), np.array(word, np.int64), np.array(value, float)

    x, other = entries(rows), entries([r if t is None else t for r, t in zip(rows, twins, strict=True)])
    w, b = np.zeros(len(words)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m = np.zeros(len(words) + 1)
    v = np.zeros(len(words) + 1)
    for k in range(1, steps + 1):
        z, twins_z = (np.bincount(row, w[word] * value, len(y)) + b for row, word, value in (x, other))
        gap = 2 * penalty * (twins_z - z) / len(y)
        gx, go = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y) - gap, gap
        up = sum(np.bincount(word, g[row] * value, len(words)) for (row, word, value), g in ((x, gx), (other, go)))
        grad = np.append(up + decay * w, gx.sum() + go.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return WordModel(float(b), {k: float(u) for k, u in zip(words, w, strict=True)})


def _name(feature: bytes) -> str:
    """A feature as a string column's value, a character for each byte, since a beginning may end within a character."""
    return feature.decode("latin-1")


def vocabulary(labelled: DataFrame, identity: tuple[tuple[str, ...], ...]) -> tuple[set[bytes], dict[bytes, bytes]] | None:
    """The model's features and the identity terms with their counterparts, by counts over all labelled texts (text, y)."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words, values, ys = [], [], []
                for x, y in zip(texts(part), part.column("y").to_pylist(), strict=True):
                    found = features(words_of(x))
                    words += map(_name, found)
                    values += found.values()
                    ys += [y] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(values, pa.float64()), pa.array(ys, pa.int32())], ["word", "value", "y"])

    kinds = {r.y: r.n for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return None
    n, pos = sum(kinds.values()), kinds[1]
    a, b = F.col("a"), F.col("n") - F.col("a")  # labelled texts with the feature, by value: toxic, other
    c, d = pos - a, (n - pos) - b
    chi2 = n * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * F.lit(float(pos)) * F.lit(float(n - pos)))
    value = F.round("value", 6).cast("decimal(20,6)")  # sums of decimals don't depend on their order
    cells = labelled.mapInArrow(bag, "word string, value double, y int")
    counts = cells.groupBy("word").agg(F.sum(value).cast("double").alias("n"), F.sum(value * F.col("y")).cast("double").alias("a"))
    counts = stored(counts.where((F.col("n") >= 3) & (F.col("n") < n)).withColumn("chi2", chi2), "toxicity-counts")
    chosen = {r.word.encode("latin-1") for r in counts.where(F.col("chi2") >= MIN_CHI2).select("word").collect()}
    terms = swaps(identity)
    return chosen | terms.keys(), terms


def train(docs: DataFrame, labels: DataFrame, *, identity: tuple[tuple[str, ...], ...] = IDENTITY, max_train: int = MAX_TRAIN, penalty: float = PENALTY) -> WordModel | None:
    labelled = stored(sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, max_train), "toxicity")
    if labelled.count() > max_train:  # ids with several rows
        labelled = stored(labelled.orderBy(F.xxhash64("text"), "y").limit(max_train), "toxicity")
    found = vocabulary(labelled, identity)
    if found is None:
        return None
    names, terms = found
    stems = stems_of(names)
    shared = docs.sparkSession.sparkContext.broadcast((names, terms, stems))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, stems = shared.value
        kind = pa.map_(pa.string(), pa.float64())
        for batch in batches:
            for part in chunks(batch):
                own, swapped = [], []
                for x in texts(part):
                    known = lambda words: sorted((_name(k), v) for k, v in features(words, names, stems).items() if k in names)
                    other = twin(x, terms)
                    own.append(known(words_of(x)))
                    swapped.append(None if other is None else known(other))
                yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array(swapped, kind), part.column("y")], ["own", "swapped", "y"])

    rows = labelled.mapInArrow(pairs, "own map<string,double>, swapped map<string,double>, y int").collect()
    back = lambda bag: None if bag is None else {k.encode("latin-1"): v for k, v in bag.items()}
    rows = sorted(((r.y, sorted(r.own.items()), r.swapped is not None, sorted((r.swapped or {}).items())) for r in rows))
    own = [back(dict(r[1])) for r in rows]
    twins = [back(dict(r[3])) if r[2] else None for r in rows]
    return fit(own, twins, np.array([r[0] for r in rows], float), sorted(names), penalty=penalty)


def score_documents(docs: DataFrame, model: WordModel | None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                p = shared.value.scores(texts(part)) if shared.value else [0.0] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
