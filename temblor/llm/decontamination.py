"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

Texts are lower-cased and cut into words of letters and digits; shingles are
five words.  Items are partitioned by the number of their shingles (powers of
two).  Each partition has its sketch size and its least number of matches: the
sketch holds an item's smallest shingle hashes, a MinHash sample without
replacement, and the share of the sketch found among a document's shingle
hashes estimates the item's containment in it however long the document is.
The least number of matches is such that an item contained to the wanted degree
is missed with a chance of at most ``MISS``.  Candidates are then verified
by exact shingle containment on the words themselves.

All steps are DataFrame functions.  Arrays are exploded with explode_outer, since
the filter that Spark infers for explode would be pushed below the projections
and evaluate an array once for each of its elements; the nulls of empty arrays
meet no partner.  The sketches are broadcast only if they are
at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` of text; otherwise they are joined by a shuffle.
Documents are not sketched: all their shingles are probed, so that long ones hide nothing.

Defined results: null or empty texts match nothing; an item of fewer than five
words is one shingle, its whole word sequence, and an item without words matches nothing; repeated documents each
count as themselves; rows of one item_id are one item, which has the distinct
shingles of them all, and each text without an item_id is an item of its own (its item_id is null in the result); several items of equal text all match.  Very long texts are probed whole; an empty table on
either side gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import fresh, row_keys, stored

K = 5
SKETCH = 32
MISS = 1e-7
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
WORD = r"[\p{L}\p{N}]+"


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def runs(words: str, lengths: list[int], joined) -> Column:
    """Array of ``joined(i, k)`` for each run of k words, k in ``lengths``, that starts at word i."""
    each = lambda k: F.transform(F.slice(F.col(words), F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0))), lambda x, i: joined(i, k))
    return F.concat(*(each(k) for k in lengths))


def hashed_shingles(df: DataFrame, text: str, out: str, lengths: list[int]) -> DataFrame:
    """Adds an array with the hash of each run of words."""
    df = df.withColumn("__h", F.transform(words(text), lambda w: F.xxhash64(w)))
    return df.withColumn(out, runs("__h", lengths, lambda i, k: F.xxhash64(*(F.element_at(F.col("__h"), i + j + 1) for j in range(k))))).drop("__h")


def plain_shingles(df: DataFrame, text: str, out: str, lengths: list[int]) -> DataFrame:
    """Adds an array with the distinct runs of words as text."""
    df = df.withColumn("__w", words(text))
    return df.withColumn(out, F.array_distinct(runs("__w", lengths, lambda i, k: F.array_join(F.slice(F.col("__w"), i + 1, F.lit(k)), " ")))).drop("__w")


def of_items(items: DataFrame, shingles, lengths: list[int]) -> DataFrame:
    """item and its shingles ``s`` of all its rows: runs of K words, or the whole of a row with fewer."""
    n = F.size(words("text"))
    parts = [shingles(items.where(n >= K), "text", "s", [K]), *(shingles(items.where(n == k), "text", "s", [k]) for k in lengths if k < K)]
    return by_item(reduce(DataFrame.unionByName, parts))


def by_item(items: DataFrame) -> DataFrame:
    """item and ``s``, the distinct shingles of all rows of the item."""
    return items.select("item", F.explode_outer("s").alias("x")).groupBy("item").agg(F.collect_set("x").alias("s"))


def least_matches(sketch: int, containment: float) -> int:
    """The largest t with P(Binomial(sketch, containment) < t) <= MISS, 1 at least."""
    total = 0.0
    for t in range(sketch + 1):
        total += math.comb(sketch, t) * containment**t * (1 - containment) ** (sketch - t)
        if total > MISS:
            return max(1, t)
    return max(1, sketch)


def sketches(items: DataFrame, containment: float, lengths: list[int]) -> DataFrame:
    """item, shingle hash, and the least number of matches of the item's size partition."""
    sized = of_items(items, hashed_shingles, lengths)
    sized = sized.withColumn("part", F.floor(F.log2(F.greatest(F.size("s"), F.lit(1)))).cast("int"))
    # Sketch size of a partition: its smallest item's number of shingles, SKETCH at most.
    k = F.least(F.lit(SKETCH), F.pow(F.lit(2.0), F.col("part")).cast("int"))
    least = F.element_at(F.array(*(F.lit(least_matches(n, containment)) for n in range(1, SKETCH + 1))), k)
    return sized.select("item", least.alias("least"), F.explode_outer(F.slice(F.array_sort("s"), F.lit(1), k)).alias("h"))


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes of text."""
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0))
    rows, size = df.agg(F.count("*"), F.sum(text)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def find_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8) -> DataFrame:
    """k1, k2, doc_id, item_id, n_item (shingles of the item), n_shared and containment, for pairs at or above ``containment``."""
    text = F.col("text").cast("string")
    # A struct is never null, so that rows without an id meet in the joins too; each of their texts is an item of its own.
    own = F.when(F.col("item_id").isNull(), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    items = benchmark.select(F.struct("item_id", own.alias("own")).alias("item"), text.alias("text"))
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text"), *row_keys(F.col("doc_id"), F.col("text")))
    # Runs of fewer than K words are made of documents only for the lengths that short items have, K - 1 lengths at most.
    lengths = [K, *sorted(r[0] for r in items.select(F.size(words("text")).alias("n")).where((F.col("n") > 0) & (F.col("n") < K)).distinct().collect())]
    probes = stored(sketches(items, containment, lengths), "sketches")
    hashes = hashed_shingles(marked.drop("doc_id"), "text", "s", lengths).select("k1", "k2", F.explode_outer("s").alias("h"))
    found = hashes.join(small(probes), "h").groupBy("k1", "k2", "item", "least").agg(F.count_distinct("h").alias("n")).where("n >= least")
    pairs = stored(found.select("k1", "k2", "item"), "candidates")
    keys = small(pairs.select("k1", "k2").distinct())
    # Repeated rows are verified once and given as often as they are there; no row number can change when a task runs again.
    texts = marked.join(keys, ["k1", "k2"], "left_semi").groupBy("doc_id", "k1", "k2", "text").agg(F.count("*").alias("copies"))
    texts = plain_shingles(texts, "text", "s", lengths)
    whole = of_items(items, plain_shingles, lengths).select("item", F.size("s").alias("n_item"), F.explode_outer("s").alias("shingle"))
    exact = texts.select("doc_id", "k1", "k2", "copies", F.explode_outer("s").alias("shingle")).join(small(stored(whole, "items")), "shingle")
    exact = exact.join(small(pairs.distinct()), ["k1", "k2", "item"], "left_semi")
    exact = exact.groupBy("doc_id", "k1", "k2", "copies", "item", "n_item").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= F.lit(containment) * F.col("n_item"))
    exact = exact.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return exact.select("doc_id", "k1", "k2", F.col("item.item_id").alias("item_id"), "n_item", "n_shared", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    n1, n2 = fresh(docs, "k1"), fresh(docs, "k2")
    k1, k2 = row_keys(docs["doc_id"], docs["text"])
    leaked = stored(find_leaks(docs, benchmark, containment).select(F.col("k1").alias(n1), F.col("k2").alias(n2)).distinct(), "leaked")
    return docs.withColumns({n1: k1, n2: k2}).join(small(leaked), [n1, n2], "left_anti").select(docs.columns)


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents
), i AS (
  SELECT item_id, coalesce('i' || item_id, 't' || text) AS item, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark
), its AS (
  SELECT DISTINCT item_id, item, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT item_id, item, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM i WHERE len(w) > 0)
), ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM its) WHERE len(w) >= k)
), n AS (SELECT item, count(DISTINCT s) AS n_item FROM its GROUP BY 1)
SELECT doc_id, item_id, CAST(n_item AS INT) AS n_item, count(DISTINCT s) AS n_shared, round(count(DISTINCT s) / n_item, 6) AS containment
FROM ds JOIN its USING (k, s) JOIN n USING (item) GROUP BY doc_id, item, item_id, n_item HAVING count(DISTINCT s) >= 0.8 * n_item
"""
