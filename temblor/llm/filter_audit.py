"""Operator 12: how document filters overlap.

Each batch's Arrow buffer is scanned once: classes of bytes are looked up and summed up by prefix sums (code points,
capitals, symbols; words by their first bytes), so that a text's counts are differences at its borders.  A text's words are
sorted by hash; neighbours of equal hash are compared byte by byte, so that distinct words are exact.  What fails is a
mask of bits a document.  Whether a text stands under a smaller id is decided by SHA-256 of the whole text: the smallest id of each
digest, joined back on digest and id together, so that copies of one text, however many, are dealt out by their ids.
Texts themselves are not shuffled; what is written in between is a digest, an id and a mask a row.

Documents are then counted by part and mask (32 masks a part), and every order and step is
sums over a part's masks: a filter removes what fails it and none before it.  Which filters came before matters, not their order, so that 80
sums give all 600 rows of a part.

Defined results: a null text is empty: it has no words, fails A only, and is identical to other empty texts.  A null source is the part ''.  A row with a
null doc_id neither fails E nor makes others fail, and has no labels.  Repeated rows of one id count each, and don't fail E by each other.
Of several labels of one id, any that is 1 counts; null labels count as 0.  A very long text is scanned in blocks.  An empty table has no parts and so no rows.
Other columns are ignored."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, stored
from .textkernel import Words, slices, utf8

FILTERS = "ABCDE"
#: Least words, percent of distinct words, percent of capitals, and symbols of the filters A to D.
LEAST_WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
BLOCK = 1 << 20

#: A byte's class: 1 begins a code point, 2 is a capital, 4 is a symbol.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[*range(0x80), *range(0xC0, 0x100)]] |= 1
CLASSES[65:91] |= 2
CLASSES[list(SYMBOLS)] |= 4


def byte_counts(buf: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Code points, capitals and symbols (rows) of each text (columns), by prefix sums of blocks."""
    out = np.zeros((3, len(offsets) - 1), np.int64)
    for at in range(0, len(buf), block):
        kinds = CLASSES[buf[at : at + block]]
        a, b = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, at + len(kinds), "left")
        edges = np.clip(offsets[a : b + 1] - at, 0, len(kinds))
        for k in range(3):
            so_far = np.zeros(len(kinds) + 1, np.int32)
            np.cumsum((kinds >> k) & 1, out=so_far[1:])
            out[k, a:b] += np.diff(so_far[edges])
    return out


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes at a and at b are the same for ``length``, eight at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(buf) + 1, 8), (1, 1))
    load = lambda at: np.ascontiguousarray(eight[at]).view(np.uint64)[:, 0]
    same, open_ = np.ones(len(a), bool), np.arange(len(a))
    at = 0
    while len(open_):
        left = np.minimum(length[open_] - at, 8)
        cut = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64)
        same[open_] = ((load(a[open_] + at) ^ load(b[open_] + at)) & cut) == 0
        at += 8
        open_ = open_[same[open_] & (length[open_] > at)]
    return same


def distinct_words(words: Words, buf: np.ndarray) -> np.ndarray:
    """Number of distinct words of each text."""
    row = np.repeat(np.arange(len(words.count)), words.count)
    order = np.lexsort((words.hash, row))
    h, r, start = words.hash[order], row[order], words.start[order]
    length = words.end[order] - start
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    k = np.flatnonzero(again)
    sound = (length[k] == length[k - 1]) & same_bytes(buf, start[k], start[k - 1], np.minimum(length[k], length[k - 1]))
    out = np.bincount(r[~again], minlength=len(words.count))
    for i in np.unique(r[k[~sound]]):  # two words of one text share a hash: its words themselves are counted
        mine = slice(words.first[i], words.first[i + 1])
        out[i] = len({buf[s:e].tobytes() for s, e in zip(words.start[mine], words.end[mine], strict=True)})
    return out


def masks(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    out = []
    for a, b in slices(column):
        buf, offsets = utf8(column.slice(a, b - a))
        words = Words(buf, offsets)
        points, capitals, symbols = byte_counts(buf, offsets)
        fails = (words.count < LEAST_WORDS, 100 * distinct_words(words, buf) < DISTINCT * words.count, 100 * capitals > CAPITALS * points, symbols > 0)
        out.append(sum(f.astype(np.int32) << k for k, f in enumerate(fails)))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def scan(docs: DataFrame) -> DataFrame:
    """part, digest, doc_id and mask (A to D) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), "doc_id", text.alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(masks(batch.column(3)), pa.int32())], names=["part", "digest", "doc_id", "mask"])

    return map_batches(rows, run, f"part string, digest binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, mask int")


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """n, good and toxic documents of each part and mask (A to E)."""
    # Rows of one id and text are one row with a number: no id can be a hot key of the joins.
    rows = stored(scan(docs).groupBy("part", "digest", "doc_id", "mask").agg(F.count("*").alias("n")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(is_one("quality"), is_one("toxic")).where("id is not null")
    rows = rows.join(first, ["digest", "doc_id"], "left")
    # Null ids have no partner; by a second key they don't meet in one task.
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    rows = rows.withColumn("apart", apart).join(marks.withColumn("apart0", F.lit(0).cast("long")), (F.col("doc_id") == F.col("id")) & (F.col("apart") == F.col("apart0")), "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)
    of = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c)
    return rows.groupBy("part", mask.alias("mask")).agg(of("quality"), of("toxic"), F.sum("n").alias("n"))


def steps() -> dict[tuple[int, int], list[tuple[str, int]]]:
    """(mask of the filters before, filter) to the (order, step) that have them."""
    out: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.setdefault((before, f), []).append(("".join(FILTERS[x] for x in order), step))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    part = counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "quality", "toxic")).alias("cells"))
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame([(before, 1 << f, [{"filter_order": o, "step": s} for o, s in at]) for (before, f), at in steps().items()], "before int, own int, at array<struct<filter_order:string,step:int>>"))
    fails = lambda x, bits: x["mask"].bitwiseAND(bits) != 0
    before, own = F.col("before"), F.col("own")
    total = lambda c, on: F.aggregate("cells", F.lit(0).cast("long"), lambda s, x: s + F.when(on(x), c(x)).otherwise(0))
    n = lambda x: x["n"]
    removed = lambda x: ~fails(x, before) & fails(x, own)
    # Of the orders of a mask's filters, an equal share begins with each.
    share = lambda x: (x["n"] * F.lit(len(list(permutations(FILTERS)))) / F.bit_count(x["mask"])).cast("long")
    rows = part.join(table).select(
        "part", "at",
        total(n, lambda x: ~fails(x, before.bitwiseOR(own))).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda x: fails(x, before) & fails(x, own)).alias("redundant"),
        total(n, lambda x: x["mask"] == own).alias("unique_fails"),
        total(lambda x: x["quality"], removed).alias("good_lost"),
        total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        total(share, lambda x: fails(x, own)).alias("shapley"),
    )
    return rows.select("part", F.inline("at"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _oracle() -> str:
    letters = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(FILTERS))
    word = r"[^\x20\x09-\x0D]+"
    return f"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
f AS (SELECT part, doc_id, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END) + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS quality, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(quality, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x(f, bit) AS (VALUES {letters}),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, k AS step, bits[k] AS own, CAST(coalesce(list_sum(bits[:k - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, own, CAST(sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


ORACLE = _oracle()
