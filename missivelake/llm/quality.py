"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE_BYTES bytes of its whole text. Each passage is described by how often each
pair of neighbouring byte classes occurs (letters by case, digits, marks, white space, other scripts) and by how
repetitive it is (compressed size, share of distinct words). A learned layer encodes every passage, gated attention
(tanh and sigmoid branches) weighs the codes within the document, and a logistic layer scores the weighted sum.
Only the document's label is known in training; passages have none.

The model is fitted on labelled documents, those of smallest id hash: ``max_train`` of them at most, and as many as
bring no more than ``max_passages`` passages together; both bounds are parameters. A document is taken with all of its
passages or not at all. Scores use every passage of every text.

Defined results: a null or empty text is one passage without bytes and has a score; labels that are null or belong to
no document are ignored; with labels of fewer than two kinds every score is 0.5; repeated rows score alike and are each
returned; columns other than doc_id and text are ignored, whatever their names, and ``keep_good`` carries them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missivelake.llm.common import chunks, fold, stored, texts

PASSAGE_BYTES = 1200
MAX_TRAIN = 6000
MAX_PASSAGES = 60_000
#: Passages whose byte pairs are counted at one time.
TOGETHER = 256
CODE, GATE = 24, 12
CLASSES = 16
START = 15


def _byte_classes() -> np.ndarray:
    lut = np.full(256, 13, np.uint8)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "#$%&*@^~=+<>\\_/`", "\"'()[]{};:-"]
    for k, chars in enumerate(groups):
        lut[np.frombuffer(chars.encode(), np.uint8)] = k
    lut[128:] = 12
    return lut


LUT = _byte_classes()
FEATURES = CLASSES * CLASSES + 3


def passages(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and how many passages each text has (one at least)."""
    rows = [x or b"" for x in rows]
    lengths = np.array([len(x) for x in rows], np.int64)
    counts = np.maximum(1, -(-lengths // PASSAGE_BYTES))
    first = np.cumsum(counts) - counts
    pairs = CLASSES * CLASSES
    out = np.zeros((int(counts.sum()), FEATURES), np.float32)
    text = np.frombuffer(b"".join(rows), np.uint8)
    within = (np.arange(len(out)) - np.repeat(first, counts)) * PASSAGE_BYTES
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + within
    ends = starts + np.minimum(PASSAGE_BYTES, np.repeat(lengths, counts) - within)
    for p in range(0, len(out), TOGETHER):
        q = min(p + TOGETHER, len(out))
        low, high = starts[p], ends[q - 1]
        kind = LUT[text[low:high]]
        before = np.empty_like(kind)
        before[1:] = kind[:-1]
        if high > low:
            before[0] = LUT[text[low - 1]] if within[p] else START
            heads = starts[p:q][(within[p:q] == 0) & (ends[p:q] > starts[p:q])]
            before[heads - low] = START
        at = np.repeat(np.arange(q - p, dtype=np.int32), ends[p:q] - starts[p:q])
        n = np.bincount(at * pairs + (before * np.uint8(CLASSES) + kind), minlength=(q - p) * pairs).reshape(q - p, pairs)
        out[p:q, :pairs] = np.sqrt(n / np.maximum(1, n.sum(1, keepdims=True)))
    i = 0
    for x in rows:
        for k in range(0, max(1, len(x)), PASSAGE_BYTES):
            piece = x[k : k + PASSAGE_BYTES]
            words = piece.split()
            out[i, pairs] = len(zlib.compress(piece, 1)) / (len(piece) + 12)
            out[i, pairs + 1] = len(set(words)) / (len(words) + 1)
            out[i, pairs + 2] = min(1.0, len(piece) / PASSAGE_BYTES)
            i += 1
    return out, counts


@dataclass
class AttentionModel:
    """Weights of the passage encoder, of both attention branches and of the scorer; mean and scale of the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts = np.cumsum(counts) - counts
        h = np.tanh(x @ w["encode"] + w["encode0"])
        t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-h @ w["gate"]))
        s = (t * g) @ w["attend"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), counts))
        a = s / np.repeat(np.add.reduceat(s, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score0"], -30, 30)))}

    def scores(self, rows: list[bytes | None]) -> np.ndarray:
        x, counts = passages(rows)
        return self.forward((x - self.mean) / self.scale, counts)["p"]


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, *, epochs: int = 25, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> AttentionModel:
    """Adam on the documents' log loss, in a fixed order from a fixed seed."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(0), x.std(0) + 0.02
    f = x.shape[1]
    shapes = {"encode": (f, CODE), "encode0": (CODE,), "tanh": (CODE, GATE), "gate": (CODE, GATE), "attend": (GATE,), "score": (CODE,), "score0": (1,)}
    w = {k: (rng.standard_normal(s) * (0.5 / np.sqrt(s[0])) * (not k.endswith("0"))).astype(np.float32) for k, s in shapes.items()}
    model = AttentionModel(mean, scale, w)
    x = ((x - mean) / scale).astype(np.float32)
    first = np.cumsum(counts) - counts
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(u) for k, u in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            docs = order[k : k + batch]
            n = counts[docs]
            rows = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            xb, starts = x[rows], np.cumsum(n) - n
            o = model.forward(xb, n)
            err = ((o["p"] - y[docs]) / len(docs)).astype(np.float32)
            dz = np.repeat(err[:, None] * w["score"], n, axis=0)
            da = (dz * o["h"]).sum(1)
            ds = o["a"] * (da - np.repeat(np.add.reduceat(o["a"] * da, starts), n))
            dtg = ds[:, None] * w["attend"]
            dt, dg = dtg * o["g"] * (1 - o["t"] ** 2), dtg * o["t"] * o["g"] * (1 - o["g"])
            dh = (o["a"][:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - o["h"] ** 2)
            grad = {"encode": xb.T @ dh, "encode0": dh.sum(0), "tanh": o["h"].T @ dt, "gate": o["h"].T @ dg, "attend": (o["t"] * o["g"]).T @ ds, "score": o["z"].T @ err, "score0": err.sum(keepdims=True)}
            step += 1
            for name, d in grad.items():
                d = d + decay * w[name]
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.999 * v[name] + 0.001 * d * d
                w[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_train: int) -> DataFrame:
    """(text, y) of at most max_train labelled documents that may be learnt from: those of smallest id hash."""
    ids = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_train)
    )
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, max_passages: int = MAX_PASSAGES) -> AttentionModel | None:
    """The model learnt from documents outside the held-out fold, or None if their labels are of one kind."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x, counts = passages(texts(part))
                bags = [b.astype("<f2").tobytes() for b in np.split(x, np.cumsum(counts)[:-1])]
                keys = [zlib.crc32(b) for b in bags]
                yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), pa.array(counts), pa.array(keys, pa.int64()), part.column("y")], ["x", "n", "key", "y"])

    found = sample(docs, labels, "quality", fold(F.col("doc_id"), 3) != 1, max_train)
    found = stored(found.mapInArrow(encode, "x binary, n long, key long, y int"), "quality")
    left, taken = max_passages, []
    for r in found.select("key", "n").orderBy("key", "n").collect():  # a crc32 of the features is as good as random
        if r.n <= left:
            left -= r.n
            taken.append((r.key, r.n))
    size = found.select(F.sum("n")).first()[0] or 0
    if size > max_passages:
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame(sorted(set(taken)), "key long, n long")), ["key", "n"])
    rows = found.select("x", "y").collect()
    rows.sort(key=lambda r: (r.y, bytes(r.x)))
    if len({r.y for r in rows}) < 2:
        return None
    bags = [np.frombuffer(r.x, "<f2").reshape(-1, FEATURES) for r in rows]
    x = np.concatenate(bags, dtype=np.float32)
    return fit(x, np.array([len(b) for b in bags]), np.array([r.y for r in rows], np.float32))


def score_documents(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                p = shared.value.scores(texts(part)) if shared.value else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p.astype(float), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """The rows of docs, with all their columns, whose score is 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                if shared.value:
                    part = part.filter(pa.array(shared.value.scores(texts(part)) >= 0.5))
                yield part

    return docs.mapInArrow(keep, docs.schema)
