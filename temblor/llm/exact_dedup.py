"""Operator 1: exact dedup by distributed MSD radix partitioning.

Texts without their white space are split by successive bytes.  A level takes
the next digit, a run of bytes that is eight times as wide on each level, and
splits every group by it; a group of one row, and a group whose texts have
ended, leaves the recursion.  Equality is decided by the bytes themselves, no
digest is compared.

A level is one aggregation over (group, digit), combined before the shuffle, so
that thousands of copies send one row a task, and one join that gives each row
its new group; a hot digit's rows can be split over tasks.  Only rows that
share all digits so far with another row carry their remaining bytes on.  The
state of a level is written to the shared folder.

Defined results: a null text counts as empty, and all empty texts are equal; of
equal texts the one with the most code points stays, then the smallest doc_id,
then any one of repeated rows, so that exactly one row of a group is kept; a
null doc_id comes last.  An empty table gives an empty result.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import BLANKS, fresh, row_keys, stored

FIRST_DIGIT = 64
WIDER = 8
#: Rows of a group that one task should meet, and the most parts of a group.
SALTED = 500
MOST_SALTS = 512
#: A first digit with more than one in HOT of all rows is hot.
HOT = 1000


def salted(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined with their groups; a group of more than SALTED rows, by the column ``size`` of both, is dealt to several tasks."""
    n = F.when(F.col(size) > SALTED, F.least(F.ceil(F.col(size) / SALTED).cast("int"), F.lit(MOST_SALTS))).otherwise(1)
    left = rows.withColumn("salt", F.pmod(F.hash("row"), n))
    right = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop(size)
    return left.join(right, [*keys, "salt"]).drop("salt")


def assign(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 and the row's keys k1, k2."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), F.length(text).alias("points"), F.regexp_replace(text, BLANKS, "").cast("binary").alias("rest"))
    digit = F.substring("rest", 1, FIRST_DIGIT)
    first = stored(rows.select(digit.alias("gid")).groupBy("gid").count().where("count > 1"), "digits")
    # Digits of more than a thousandth of all rows, of which there are fewer than a thousand, are dealt to several tasks.
    share = max(docs.count() // HOT, SALTED)
    salts = F.ceil(F.col("count") / share).cast("int")
    hot = F.broadcast(first.where(F.col("count") > share).select("gid", salts.alias("salts")))
    keyed = rows.withColumn("gid", digit).withColumn("text_sha256", F.sha2("rest", 256)).join(hot, "gid", "left")
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))))
    # The same join at every size: a table of digits that is small enough here to be broadcast is not on a larger corpus.
    state = keyed.join(first.hint("merge").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1))), ["gid", "salt"], "left")
    alone = F.col("count").isNull()
    state = stored(
        state.select("doc_id", "k1", "k2", "points", "text_sha256", F.when(~alone, F.col("gid")).alias("gid"), F.when(~alone, F.expr(f"substring(rest, {FIRST_DIGIT + 1})")).alias("rest"), F.coalesce("count", F.lit(1)).alias("many"), F.monotonically_increasing_id().alias("row")),
        "radix",
    )
    done = [state.where("gid is null").select("doc_id", "k1", "k2", "points", "text_sha256", "row", F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("gid"))]
    active, width = state.where("gid is not null"), FIRST_DIGIT * WIDER
    while not active.isEmpty():
        keyed = active.withColumn("digit", F.substring("rest", 1, width)).withColumn("ended", F.octet_length("rest") <= width)
        groups = keyed.groupBy("gid", "digit", "ended").agg(F.count("*").alias("size"), F.min("row").alias("next"), F.min("many").alias("many"))
        state = salted(keyed, groups, ["gid", "digit", "ended"], "many")
        goes_on = ~F.col("ended") & (F.col("size") > 1)
        state = stored(state.select("doc_id", "k1", "k2", "points", "text_sha256", "row", "size", F.col("next").alias("gid"), F.when(goes_on, F.expr(f"substring(rest, {width + 1})")).alias("rest"), F.col("size").alias("many")), "radix")
        done.append(state.where("rest is null").drop("rest", "many"))
        active, width = state.where("rest is not null").drop("size"), width * WIDER
    ended = reduce(DataFrame.unionByName, done)
    single, many = ended.where("size = 1"), ended.where("size > 1")
    best = many.groupBy("gid").agg(F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("best"), F.max("size").alias("size"))
    many = salted(many, best, ["gid"], "size").withColumn("keep_id", F.col("best.doc_id")).withColumn("kept", F.col("row") == F.col("best.row"))
    single = single.withColumn("keep_id", F.col("doc_id")).withColumn("kept", F.lit(True))
    columns = ["doc_id", "keep_id", F.col("size").alias("group_size"), "kept", "text_sha256", "k1", "k2"]
    return single.select(*columns).unionByName(many.select(*columns))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    n1, n2 = fresh(docs, "k1"), fresh(docs, "k2")
    k1, k2 = row_keys(docs["doc_id"], docs["text"])
    kept = assign(docs).where("kept").select(F.col("k1").alias(n1), F.col("k2").alias(n2))
    # The second step only meets repeated rows, and needs no shuffle of its own.
    return docs.withColumns({n1: k1, n2: k2}).join(kept, [n1, n2], "left_semi").dropDuplicates([n1, n2]).select(docs.columns)


ORACLE = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY body) AS group_size
  FROM n WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""
