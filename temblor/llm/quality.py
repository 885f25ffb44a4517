"""Operator 11: quality by attention-based multiple-instance learning.

A document is a bag of passages, ``WIDTH`` words each (the last one has the rest), and only documents have labels.  Every passage of the whole text is encoded: shares of
classes of bytes, shapes and repeats of words, and a signed bag of hashed words go through a learned layer, h = tanh(Ex + e).  Gated attention weighs the passages,
a = softmax(w . (tanh(Vh) * sigmoid(Uh))), and the weighted passage, the sum of a h, is scored by a logistic layer.  All weights
are learned together from the documents' labels; the model has a few thousand numbers, whatever the corpus, and is broadcast.

Training takes at most ``max_rows`` labelled rows, chosen by a hash of the id (the documented bound).  They are dealt to ``shards`` groups by that hash; in
each round every group goes through its rows ``epochs`` times (more often for fewer than ``least_steps`` batches) from the common weights, by Adam, and the weights are averaged by rows.  Groups, not partitions, are the
shards, so that the model is the same however Spark deals them out.  Scoring is one map without a shuffle.

Defined results: an empty or null text, or one without words, is one passage without words; rows with a null label are not
learned from; with no rows to learn from, every score is 0.5; repeated rows are scored alike and are each learned from; a very long text has
many passages, all of which are encoded and weighed; an empty table has no rows; other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_sample, map_batches
from .textkernel import U64, Words, slices, utf8

#: Words of a passage, buckets of the hashed bag, width of the encoding and of the attention.
WIDTH, BUCKETS, HIDDEN, GATE = 64, 32, 24, 12

#: A byte's class: 0 other, 1 small letter, 2 capital, 3 digit, 4 part of a longer code point, 5 blank, 6 end of line, 7 full stop or comma, 8 !?, 9 symbols, 10 quotes and brackets, 11 control.
KINDS = 12
KIND = np.zeros(256, np.int64)
KIND[:32] = 11
for kind, members in {1: range(97, 123), 2: range(65, 91), 3: range(48, 58), 4: range(128, 256), 5: (9, 32), 6: (10, 13), 7: b".,;:", 8: b"!?", 9: b"#$%&*|@~^+=<>/\\_", 10: b"\"'()[]{}-"}.items():
    KIND[list(members)] = kind
#: Numbers that describe a passage, beside the shares of classes and the bag.
SHAPES = 9
SIZE = KINDS + SHAPES + BUCKETS
Weights = dict[str, np.ndarray]


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passages x SIZE, index of each text's first passage); each text has one at least."""
    buf, offsets = utf8(column)
    words = Words(buf, offsets)
    per_text = np.maximum(-(-words.count // WIDTH), 1)
    first = np.concatenate([[0], np.cumsum(per_text)])
    text = np.repeat(np.arange(len(words.count)), words.count)
    place = np.arange(len(text)) - words.first[text]
    own = first[text] + place // WIDTH
    many = first[-1]
    n = np.bincount(own, minlength=many)
    # Where each passage begins: at its first word, or at the beginning of its text.
    edge = np.zeros(many + 1, np.int64)
    edge[-1] = len(buf)
    starts = np.flatnonzero(place % WIDTH == 0)
    edge[own[starts]] = words.start[starts]
    edge[first[:-1]] = offsets[:-1]
    size = np.diff(edge)
    kinds = np.bincount(np.repeat(np.arange(many) * KINDS, size) + KIND[buf], minlength=many * KINDS).reshape(many, KINDS)
    # One stable sort shows words that their text has had before, and whether in this passage.
    order = np.lexsort((words.hash, text))
    seen, here = np.zeros(len(text), bool), np.zeros(len(text), bool)
    a, b = order[:-1], order[1:]
    same = (words.hash[a] == words.hash[b]) & (text[a] == text[b])
    seen[b[same]] = True
    here[b[same & (own[a] == own[b])]] = True
    length = words.end - words.start
    last, head = (KIND[buf[at]] if len(text) else np.zeros(0, np.int64) for at in (words.end - 1, words.start))
    echo = np.zeros(len(text), bool)
    echo[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    share = lambda what: np.bincount(own, what, minlength=many) / np.maximum(n, 1)
    shapes = (n / WIDTH, share(np.minimum(length, 40)) / 10, share(length == 1), share(head == 2), share((last >= 7) & (last <= 10)), share(here), share(seen), share(echo), np.minimum(size / np.maximum(n, 1), 80) / 20)
    sign = np.where((words.hash >> U64(40)) & U64(1), 1.0, -1.0)
    bag = np.bincount(own * BUCKETS + (words.hash & U64(BUCKETS - 1)).astype(np.int64), sign, minlength=many * BUCKETS).reshape(many, BUCKETS)
    x = np.concatenate([kinds / np.maximum(size, 1)[:, None], np.stack(shapes, 1), bag / np.sqrt(np.maximum(n, 1))[:, None]], 1)
    return x.astype(np.float32), first


def start(seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    layer = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    return {"E": layer(SIZE, HIDDEN), "e": zero(HIDDEN), "V": layer(HIDDEN, GATE), "U": layer(HIDDEN, GATE), "w": layer(GATE, 1)[:, 0], "c": layer(HIDDEN, 1)[:, 0], "b": zero(1)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: Weights, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of the texts and what the gradient needs."""
    at = first[:-1]
    bag = np.repeat(np.arange(len(at)), np.diff(first))
    h = np.tanh(x @ m["E"] + m["e"])
    t, g = np.tanh(h @ m["V"]), sigmoid(h @ m["U"])
    s = (t * g) @ m["w"]
    s = np.exp(s - np.maximum.reduceat(s, at)[bag])
    a = s / np.add.reduceat(s, at)[bag]
    z = np.add.reduceat(a[:, None] * h, at, axis=0)
    return sigmoid(z @ m["c"] + m["b"]), (at, bag, h, t, g, a, z)


def gradient(m: Weights, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Weights:
    """Of the mean log loss."""
    p, (at, bag, h, t, g, a, z) = forward(m, x, first)
    d = (p - y) / len(y)
    dz = d[:, None] * m["c"]
    da = (dz[bag] * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, at)[bag])
    gate = ds[:, None] * m["w"]
    dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "b": d.sum(keepdims=True)}


def train(m: Weights, xs: list[np.ndarray], y: np.ndarray, epochs: int, batch: int, rate: float, decay: float, seed: int) -> Weights:
    """Adam over the bags in small batches, in an order that the seed fixes."""
    rng = np.random.default_rng(seed)
    m = {k: v.astype(np.float64) for k, v in m.items()}
    one, two, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            first = np.concatenate([[0], np.cumsum([len(xs[i]) for i in some])])
            found, step = gradient(m, np.concatenate([xs[i] for i in some]), first, y[some]), step + 1
            for k, d in found.items():
                one[k] += 0.1 * (d - one[k])
                two[k] += 0.001 * (d * d - two[k])
                m[k] = m[k] - rate * ((one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8) + decay * m[k])
    return m


@dataclass(frozen=True)
class Model:
    """Weights; none if there was nothing to learn from."""

    weights: Weights | None


def fit(labelled: DataFrame, label: str = "label", max_rows: int = 16_000, rounds: int = 6, epochs: int = 3, least_steps: int = 25, shards: int = 4, batch: int = 32, rate: float = 0.01, decay: float = 0.001, seed: int = 1) -> Model:
    """Weights from rows (doc_id, text, label of 0 or 1)."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(label).isNotNull()).select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(label).cast("double").alias("y"))
    rows = bounded_sample(rows, max_rows)

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for a, b in slices(batch.column(1), 1 << 20):
            x, first = passages(batch.column(1).slice(a, b - a))
            out += [x[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["h", "y", "x"])

    bags = map_batches(rows, encoded, "h long, y double, x binary").withColumn("shard", F.pmod(F.shiftright("h", 7), F.lit(shards))).persist()
    m, names = start(seed), list(start(seed))
    try:
        for r in range(rounds):
            shared = spark.sparkContext.broadcast(m)

            def learn(key: tuple, group: pa.Table) -> pa.Table:
                group = group.sort_by([("h", "ascending"), ("x", "ascending"), ("y", "ascending")])
                xs = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, SIZE) for x in group["x"]]
                # The rate falls from round to round.
                passes = max(epochs, -(-least_steps // -(-len(xs) // batch)))  # few rows are gone through more often
                got = train(shared.value, xs, group["y"].to_numpy(), passes, batch, rate / (1 + r / 2), decay, seed + 1000 * r + key[0].as_py())
                return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([group.num_rows], pa.int64()), "flat": pa.array([np.concatenate([got[k].ravel() for k in names])], pa.list_(pa.float64()))})

            found = sorted(bags.groupBy("shard").applyInArrow(learn, "shard long, n long, flat array<double>").collect())
            shared.unpersist()
            if not found:
                return Model(None)
            mean, at = np.average([f.flat for f in found], axis=0, weights=[f.n for f in found]), 0
            for k in names:
                m[k] = mean[at : at + m[k].size].reshape(m[k].shape).astype(np.float32)
                at += m[k].size
    finally:
        bags.unpersist()
    return Model(m)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) with score (0 to 1)."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out, m = batch.column(len(keep)), [], shared.value.weights
        for a, b in slices(texts, 1 << 20):
            out.append(forward(m, *passages(texts.slice(a, b - a)))[0] if m else np.full(b - a, 0.5))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(np.concatenate(out).astype(np.float64))], names=[*keep, "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    return map_batches(rows, score, schema)
