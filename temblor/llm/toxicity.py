"""Operator 10: toxicity by FTRL-proximal logistic regression.

Features are the distinct hashed words, bigrams and skip-grams (one or two
words left out) of a text, lower-cased A-Z and cut at punctuation; a word also
counts by its stems, its first 4, 5 and 6 bytes, so that inflected forms share
what is learned.  Coordinates in fewer than ``min_rows`` rows of the sample are left
out by a Spark aggregation, so that state is kept and sent for the others only.  FTRL-proximal keeps a learning rate for each coordinate and sets weak
coordinates to exactly zero (L1), so that the weights are few; they are
broadcast, bounded by ``dims``, and the score is one map over whole texts.

Training takes at most ``max_rows`` labelled rows, chosen by a hash of the id.
They are dealt to ``shards`` tasks, as many whatever the number of shuffle partitions; each round every task goes through its rows
from the common state; the changes, at most ``shards`` times ``dims`` coordinates of eight bytes, are averaged on the driver.

Defined results: an empty or null text has the score of the bias alone; rows
with a null label are not learned from; with no rows to learn from, every score
is 0.5; repeated rows are scored alike and are each learned from; a very long text is scanned whole, in blocks; an empty table has
no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_sample, map_batches
from .textkernel import FOLD, SPACE, Words, slices, utf8

U64 = np.uint64
#: Punctuation counts as white space here.
PLAIN = FOLD.copy()
PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
GAPS = (0, 1, 2)
STEMS = (4, 5, 6)
#: Coordinates of a piece of the state.
PIECE = 1 << 18


@dataclass(frozen=True)
class Model:
    """Non-zero ``weights`` at ``index`` (sorted); the last coordinate, ``dims``, is the bias."""

    index: np.ndarray
    weights: np.ndarray
    dims: int

    def dense(self) -> np.ndarray:
        w = np.zeros(self.dims + 1, np.float32)
        w[self.index] = self.weights
        return w


def features(buf: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, row) of each word, bigram and skip-gram, with repeats."""
    words = Words(PLAIN[buf], offsets, stems=STEMS)
    h, row = words.hash, np.repeat(np.arange(len(words.count)), words.count)
    coords, rows = [(h % U64(dims)).astype(np.int64)], [row]
    for stem in words.stem.values():
        there = stem != 0
        coords.append(((stem[there] >> U64(8)) % U64(dims)).astype(np.int64))
        rows.append(row[there])
    for gap in GAPS:
        step = gap + 1
        if len(h) > step:
            same = row[:-step] == row[step:]
            joined = (h[:-step] * U64(0x9E3779B97F4A7C15) + h[step:] * U64(0xC2B2AE3D27D4EB4F) + U64(gap)) * U64(0xFF51AFD7ED558CCD)
            coords.append(((joined >> U64(24)) % U64(dims)).astype(np.int64)[same])
            rows.append(row[:-step][same])
    return np.concatenate(coords), np.concatenate(rows)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ftrl:
    """State z, n of the coordinates; the last one is the bias, which has no L1 term."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.z = self.n = np.zeros(1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, l1 = self.z[i], np.where(i == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, label: float) -> None:
        """One row with distinct coordinates i, all of value 1."""
        w = self.weights(i)
        g = sigmoid(w.sum()) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def add(changes: pa.Table, state: tuple[np.ndarray, np.ndarray], shards: int) -> None:
    """Adds each piece of a task's change, over the number of tasks, to its place."""
    for batch in changes.to_batches():
        for at, *pieces in zip(*batch.columns, strict=True):
            for total, piece in zip(state, pieces, strict=True):
                x = np.frombuffer(piece.as_buffer(), np.float32)
                total[at.as_py() : at.as_py() + len(x)] += x / shards


def fit(labelled: DataFrame, label: str = "label", max_rows: int = 16_000, rounds: int = 4, shards: int = 4, dims: int = 1 << 21, min_rows: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 2.0, l2: float = 0.1) -> Model:
    """Weights from rows (doc_id, text, label of 0 or 1)."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(label).isNotNull()).select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(label).cast("double").alias("y"))
    rows = bounded_sample(rows, max_rows)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for a, b in slices(batch.column(1)):
            i, row = features(*utf8(batch.column(1).slice(a, b - a)), dims)
            order = np.argsort(row, kind="stable")
            out += [np.append(np.unique(x), dims).astype(np.int32) for x in np.split(i[order], np.cumsum(np.bincount(row, minlength=b - a))[:-1])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.int32()))], names=["h", "y", "x"])

    rows = map_batches(rows.repartitionById(shards, F.pmod("h", F.lit(shards)).cast("int")).sortWithinPartitions("h", "text"), hashed, "h long, y double, x array<int>").persist()
    try:
        if not rows.count():
            return Model(np.array([dims]), np.zeros(1, np.float32), dims)
        often = rows.select(F.explode("x").alias("i")).groupBy("i").count().where(F.col("count") >= min_rows).select("i").toArrow()["i"].to_numpy().astype(np.int64)
        # The state has a place for each usable coordinate only; the bias is the last.
        used = np.append(np.sort(often[often != dims]), dims).astype(np.int32)
        places = spark.sparkContext.broadcast(used)
        z, s = np.zeros(len(used)), np.zeros(len(used))
        for _ in range(rounds):
            # States travel as single floats, and the tasks' changes as packed pieces of them, so that the driver holds little more than the state.
            state = spark.sparkContext.broadcast((z.astype(np.float32), s.astype(np.float32)))

            def learn(batches):
                m, known = Ftrl(alpha, beta, l1, l2), places.value
                m.z, m.n = (x.astype(np.float64) for x in state.value)
                touched = False
                for batch in batches:
                    ys, xs = batch.column(1).to_pylist(), batch.column(2)
                    for k in range(len(xs)):  # in order of h, whichever way the rows came
                        x = xs[k].values.to_numpy()
                        i = np.searchsorted(known, x)
                        m.learn(i[known[i] == x], ys[k])
                        touched = True
                for at in range(0, len(known) if touched else 0, PIECE):
                    piece = [(new[at : at + PIECE] - old[at : at + PIECE]).astype(np.float32) for new, old in zip((m.z, m.n), state.value, strict=True)]
                    if piece[1].any():
                        yield pa.RecordBatch.from_arrays([pa.array([at]), *(pa.array([x.tobytes()], pa.binary()) for x in piece)], names=["at", "z", "n"])

            # The mean of the tasks' states; a task that did not meet a coordinate has not changed it.
            add(rows.mapInArrow(learn, "at long, z binary, n binary").toArrow(), (z, s), shards)
            pa.default_memory_pool().release_unused()
            state.destroy()
        places.destroy()
    finally:
        rows.unpersist()
    m = Ftrl(alpha, beta, l1, l2)
    m.z, m.n = z, s
    w = m.weights(np.arange(len(used))).astype(np.float32)
    i = np.flatnonzero(w)
    return Model(used[i].astype(np.int64), w[i], dims)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) with score (0 to 1)."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    dense: list[np.ndarray] = []

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not dense:
            dense.append(shared.value.dense())
        w, dims = dense[0], shared.value.dims
        texts, out = batch.column(len(keep)), []
        for a, b in slices(texts, 1 << 20):
            i, row = features(*utf8(texts.slice(a, b - a)), dims)
            hit = w[i] != 0
            # Each coordinate counts once a text; only those with a weight need to be told apart.
            both = np.unique(row[hit] * (dims + 1) + i[hit])
            out.append(w[dims] + np.bincount(both // (dims + 1), w[both % (dims + 1)], minlength=b - a))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(sigmoid(np.concatenate(out)), pa.float64())], names=[*keep, "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    return map_batches(rows, score, schema)
