"""Operator 2: language identification with bit-sliced Bloom filters of n-grams.

Each language has a Bloom filter of the character n-grams typical of it.  The
filters are bit-sliced: one table holds, for each bit position, the mask of the
languages whose filter has that bit (a word for each 64 languages), so that the
AND of an n-gram's few table entries gives all languages containing it at once.  For each language a text's
hits are counted (the popcount of its bit over the n-grams) and corrected for
the share of hits that the filter's fill alone would give; the largest
corrected share decides.

Learning takes a bounded sample (``max_rows`` rows, chosen by a hash of the id)
of the labelled rows; it and predictions read whole texts.  An n-gram belongs to each language in which its rate is at
least ``share`` times its highest rate in any language.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
ties go to the language first in alphabetical order; rows with a null language
are not learned from; without any row to learn from, every text is ``und``.  All
languages of the sample are learned, also from one short row; a text with letters always gets one of them.  Of a language's
typical n-grams the ``most`` most frequent are in its filter: what is left out has lower rates than all of those, and the bound keeps a filter
sparse and what the driver receives at ``most`` numbers a language.  Repeated rows are learned from each and predicted alike; very long texts are
read whole, in slices of rows; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import bounded_sample, map_batches
from .textkernel import mix, slices, utf8

NONE = "und"
SIZES = (2, 3, 4)
U64 = np.uint64
#: Bytes of text that are taken at a time; its arrays are some 250 times as large.
SLICE = 1 << 18
#: An n-gram counts in a language that has it LEAST times; in one of fewer than THIN n-grams once is enough, of twice as many two times.
LEAST, THIN = 3, 20_000
#: Letters keep their byte (A-Z folded), bytes of other characters too; all else is one border.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Filters:
    """``table[w, p]``: mask of the languages 64 w to 64 w + 63 whose filter has bit p; ``fill``: share of set bits of each."""

    langs: tuple[str, ...]
    table: np.ndarray
    fill: np.ndarray
    probes: int = 3


def ngrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each n-gram of letters; borders count as one letter, n-grams of borders only do not count."""
    b = LETTERS[buf].astype(U64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    border = b == 32
    hashes, rows = [], []
    for n in SIZES:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, U64)
        inner = np.zeros(m, np.int8)
        for j in range(n):
            h = h * U64(257) + b[j : j + m]
            if 0 < j < n - 1:
                inner += border[j : j + m]
        ok = (row[:m] == row[n - 1 :]) & (inner == 0) & ~(border[:m] & border[n - 1 :])
        hashes.append(mix(h[ok]))
        rows.append(row[:m][ok])
    return (np.concatenate(hashes), np.concatenate(rows)) if hashes else (np.zeros(0, U64), np.zeros(0, np.int64))


def positions(h: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    """Bloom positions by double hashing."""
    a, step = h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)
    return [((a + U64(i) * step) & U64(bits - 1)).astype(np.int64) for i in range(probes)]


def fit(labelled: DataFrame, max_rows: int = 12_000, most: int = 30_000, share: float = 0.35, bits: int = 1 << 20, probes: int = 3, lang: str = "lang") -> Filters:
    """Filters from rows (text, lang).  The n-gram counts are a Spark aggregation; ``most`` n-grams a language are kept, which bounds what the driver receives."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    rows = bounded_sample(rows, max_rows)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[str, np.ndarray, np.ndarray]] = []
        for name in set(batch.column(1).to_pylist()):
            texts = batch.column(0).filter(pa.compute.equal(batch.column(1), name))
            parts = [np.unique(ngrams(*utf8(texts.slice(a, b - a)))[0], return_counts=True) for a, b in slices(texts, SLICE)]
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            out.append((name, grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.string()), pa.array(np.concatenate([o[1] for o in out]).view(np.int64)), pa.array(np.concatenate([o[2] for o in out]), pa.int64())], names=["lang", "gram", "n"])

    langs = tuple(sorted(r[0] for r in rows.select("lang").distinct().collect()))
    counted = map_batches(rows.repartition(16, "h").select("text", "lang"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # What a large language has once or twice is chance; a small one is learned from all that it has.
    least = counted.groupBy("lang").agg(F.least(F.lit(LEAST), 1 + F.floor(F.sum("n") / THIN)).alias("least"))
    grams = counted.join(F.broadcast(least), "lang").where("n >= least").drop("least")
    total = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = grams.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    typical = rated.join(best, "gram").where(F.col("rate") >= share * F.col("best"))
    # The `most` most frequent of each language: counts by rate tell in which part of the rates the last of them lies, and that part alone is ranked.
    kept = typical.select("lang", "gram", "rate", F.floor(F.log2("rate") * 8).cast("int").alias("part")).persist()
    above, last = Counter(), []
    for lang_, part, n in sorted(map(tuple, kept.groupBy("lang", "part").count().collect()), key=lambda x: (x[0], -x[1])):
        if above[lang_] < most:
            last.append((lang_, part, most - above[lang_]))
        above[lang_] += n
    room = F.broadcast(labelled.sparkSession.createDataFrame(last, "lang string, part int, room long"))
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("rate"), "gram"))
    got = kept.join(room, ["lang", "part"]).withColumn("place", place).where("place <= room").select("lang", "gram").toArrow()
    kept.unpersist()
    names, found = np.array(got["lang"].to_pylist(), object), got["gram"].to_numpy().view(U64)
    parts = [found[names == name] for name in langs]
    table = np.zeros((-(-len(langs) // 64), bits), U64)
    for i, h in enumerate(parts):
        for p in positions(h, bits, probes):
            table[i // 64, p] |= U64(1 << i % 64)
    fill = np.array([((table[i // 64] >> U64(i % 64)) & U64(1)).mean() for i in range(len(langs))])
    return Filters(langs, table, fill, probes)


def shares(f: Filters, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Corrected share of the n-grams of each text (rows) that each language (columns) contains."""
    n_rows = len(offsets) - 1
    h, row = ngrams(buf, offsets)
    at = positions(h, f.table.shape[1], f.probes)
    n = np.maximum(np.bincount(row, minlength=n_rows), 1)
    out = np.zeros((n_rows, len(f.langs)))
    for i in range(len(f.langs)):
        if i % 64 == 0:
            mask = np.full(len(h), ~U64(0))
            for p in at:
                mask &= f.table[i // 64, p]
        hits = np.bincount(row[(mask >> U64(i % 64)) & U64(1) == 1], minlength=n_rows)
        chance = f.fill[i] ** f.probes
        out[:, i] = np.clip((hits / n - chance) / (1 - chance), 0, 1)
    return out


def predict(docs: DataFrame, filters: Filters, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns (doc_id) with lang_pred and score (under the given names), the winning language's corrected share of n-grams."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("__text"), has_letter.alias("__letter"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = shared.value
        texts, letter = batch.column(len(keep)), np.array(batch.column(len(keep) + 1).to_pylist(), bool)
        if f.langs:
            got = np.concatenate([shares(f, *utf8(texts.slice(a, b - a))) for a, b in slices(texts, SLICE)])
            best, top = got.argmax(axis=1), got.max(axis=1)
        else:
            best, top, letter = np.zeros(len(letter), int), np.zeros(len(letter)), letter & False
        langs = [f.langs[i] if ok else NONE for i, ok in zip(best, letter, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(np.where(letter, top, 0.0), pa.float64())], names=[*keep, *names])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{names[0]}` string, `{names[1]}` double"])
    return map_batches(rows, score, schema)
