"""Operator 5: MinHash near-dedup by a signature-coordinate inverted join.

A document's set holds its distinct 5-word shingles (64-bit hashes); sets that
are equal are one node.  Each node is posted under its (coordinate, value)
pairs.  A pair of nodes is retained if at least ``least`` of the ``COORDINATES``
agree: the most frequent least - 1 lists of a node are skipped, which leaves a
prefix that any retained pair must share, and collisions in skipped lists are
counted by probing the signatures.  ``MORE`` further coordinates, of one byte, are not posted and
only probed, so that texts that share a long passage but not most shingles are
not retained.  Retained pairs are confirmed on the full sets.  Both least numbers are such
that a pair at the wanted similarity is missed with a chance of at most ``MISS`` each.

Only connectedness matters, so no group is expanded into all its pairs:

1. in each list the node that shares most with others leads; every node is
   compared with the most central of its leaders.  Of the nodes that this leaves unlinked others lead in
   turn, as long as that links many;
2. the nodes of one leader are a family.  They are compared with each other by their differences from the
   leader, of which a linked pair must share rare ones (``families``);
3. pairs of one list that are in different components and families are compared; those of a long list only
   if they share one of their rarest shingles too, as every linked pair does (``cross_pairs``).

So a list's or family's square is never gone through: what one component holds already is not compared, and the rest meets
where it shares what is rare.

Components are found by joining smallest labels until nothing changes, on
tables in the shared folder; nothing is gathered on the driver.

Defined results: null and empty texts have no shingles and are linked with
nothing, each being its own component; rows that share a doc_id count as one
document; rows with a null doc_id are kept with a null component and linked
with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames
from .frames import fresh, map_batches
from .textkernel import Words, shingle_sets, slices, utf8

U64 = np.uint64
K = 5
COORDINATES = 32
MORE = 64
MISS = 1e-6
BLOCK = 128
#: Mixed lists of more nodes are split by rare shingles.
SHORT = 16
BROADCAST_ROWS = 1_000_000
#: Another round of leaders follows one that has linked, and left, at least one node in LESS.
LESS = 4
_random = np.random.default_rng(20240517)
FACTORS = _random.integers(0, 1 << 63, COORDINATES + MORE, dtype=np.int64).astype(U64) * U64(2) + U64(1)
SHIFTS = _random.integers(0, 1 << 63, COORDINATES + MORE, dtype=np.int64).astype(U64)


def stored(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder.  Its joins are sort-merge joins at every size: the driver builds no tables to broadcast."""
    return frames.stored(df, label).hint("merge")


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    for a, b in slices(texts, 1 << 20):
        yield from shingle_sets(Words(*utf8(texts.slice(a, b - a)), fold=True), K)


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest permuted hash of each coordinate, its upper 32 bits."""
    least = np.full(COORDINATES + MORE, ~U64(0))
    for at in range(0, len(s), 1024):
        np.minimum(least, (s[at : at + 1024, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return (least >> U64(32)).astype(np.uint32).view(np.int32)


def least_of(coordinates: int, percent: int) -> int:
    """The largest t such that two sets of this similarity agree in fewer than t coordinates with a chance of at most MISS."""
    p, total = percent / 100, 0.0
    for t in range(coordinates + 1):
        total += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if total > MISS:
            return max(1, t)
    return coordinates


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two keys of the set, and the signature in its two parts (null without shingles)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, first, second, signs, more = [], [], [], [], []
        for s in sets_of(batch.column(1)):
            n.append(len(s))
            first.append(int(s.sum(dtype=U64).view(np.int64)) if len(s) else None)
            second.append(int(np.bitwise_xor.reduce(s * U64(0x9E3779B97F4A7C15) ^ (s >> U64(31))).view(np.int64)) if len(s) else None)
            sign = signature(s) if len(s) else None
            signs.append(None if sign is None else sign[:COORDINATES])
            more.append(None if sign is None else sign[COORDINATES:].astype(np.int8))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(signs, pa.list_(pa.int32())), pa.array(more, pa.list_(pa.int8()))], names=["doc_id", "n_shingles", "s1", "s2", "sig", "more"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {id_type}, n_shingles long, s1 long, s2 long, sig array<int>, more array<tinyint>")


def matches(a: str, b: str):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))


def texts_of(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc_id, text) of the nodes that share a list with others; what the later steps read."""
    ids = lists.select(F.col("node").alias("doc_id")).distinct()
    few = ids.count() <= BROADCAST_ROWS
    return stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi"), "texts")


def compared(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (lead, node) with what their full sets say: ``linked``, the sizes n_lead and n_node, and the shingles that
    only the lead (``gone``) or only the node has (``added``).

    A lead's text goes once to each block of its nodes."""
    blocked = pairs.withColumn("salt", F.pmod(F.hash("node"), F.lit(64)))
    roles = blocked.select("lead", "salt", F.col("node").alias("of")).unionByName(blocked.select("lead", "salt", F.col("lead").alias("of")).distinct())
    # Rows that share a doc_id are one document: any of their texts may stand for it.
    texts = docs.select(F.col("doc_id").alias("of"), "text")
    rows = roles.join(texts.hint("merge"), "of").select("lead", "salt", "of", "text").repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.col("of") != F.col("lead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, []
        for batch in batches:
            out: list[tuple] = []
            for of, to, salt, s in zip(*(batch.column(i).to_pylist() for i in range(3)), sets_of(batch.column(3)), strict=True):
                if (to, salt) != block:
                    block, own = (to, salt), []
                if of == to:
                    own.append(s)
                    continue
                for x in own:
                    gone, added = np.setdiff1d(x, s, assume_unique=True), np.setdiff1d(s, x, assume_unique=True)
                    out.append((to, of, enough(len(x) - len(gone), len(x), len(s), percent), len(x), len(s), gone.view(np.int64), added.view(np.int64)))
            if out:
                cols = list(zip(*out, strict=True))
                types = (None, None, pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["lead", "node", "linked", "n_lead", "n_node", "gone", "added"])

    id_type = pairs.schema["lead"].dataType.simpleString()
    return rows.select("of", "lead", "salt", "text").mapInArrow(run, f"lead {id_type}, node {id_type}, linked boolean, n_lead long, n_node long, gone array<long>, added array<long>")


def families(tried: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (lead, node) among the nodes that were compared with one lead and are not in one component.

    A node x is its lead without the shingles G and with the shingles A.  For two of them |x - y| + |y - x| = |Ax| + |Ay| +
    |Gx| + |Gy| - 2 |Ax & Ay| - 2 |Gx & Gy|, which a link bounds by T = q * (|x| + |y|).  One of the two is not linked to the
    lead, so that this asks for more than sizes: either the two share one of A, which no other copy has by chance, or
    |Ax| + |Ay| + ||Gx| - |Gy|| <= T and they share most of G.  Both are found in lists of the shingles A and G: in any one
    order, two sets of sizes u <= v that share (u + v - T) / 2 meet in the first T / 2 + 1 of the smaller and T + 1 of the larger.
    Rare shingles come first, and before all others those whose nodes are in one component already."""
    q = (100 - percent) / (100 + percent)
    floor = lambda c: F.floor(c + 1e-9).cast("int")
    open_ = tried.groupBy("lead").agg(F.count_if(~F.col("linked")).alias("open"), F.count("*").alias("size"), F.max("n_node").alias("most")).where("open > 0 and size > 1").drop("open", "size")
    rows = tried.join(open_, "lead").join(labels, "node", "left").select("lead", "node", F.coalesce("label", "node").alias("label"), (~F.col("linked")).alias("open"), F.col("n_node").alias("n"), "n_lead", "most", "gone", "added")
    rows = rows.withColumns({"g": F.size("gone"), "a": F.size("added")})
    # T for the largest partner that the sizes allow, and what keeps another node from being linked to the lead, at least.
    rows = rows.withColumn("t", q * (F.col("n") + F.least(F.col("n") * 100 / percent, F.col("most")))).withColumn("far", q * (F.col("n") * percent / 100 + F.col("n_lead")))
    parts = F.array(F.struct(F.lit(True).alias("own"), F.col("added").alias("s")), F.struct(F.lit(False).alias("own"), F.col("gone").alias("s")))
    shingles = rows.where("open or a > 0 or g > 0").select("lead", "node", "label", "open", F.inline(parts)).select("lead", "node", "label", "open", "own", F.explode("s").alias("s"))
    useful = shingles.groupBy("lead", "own", "s").agg(F.count("*").alias("n"), F.max("open").alias("met"), F.min("label").alias("low"), F.max("label").alias("high")).where("met and low != high").select("lead", "own", "s", "n")
    held = shingles.join(useful, ["lead", "own", "s"]).groupBy("lead", "node", "own").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("order"))
    placed = stored(rows.drop("gone", "added").join(held, ["lead", "node"]), "placed")
    size = F.when(F.col("own"), F.col("a")).otherwise(F.col("g"))
    # Of G, less is enough: what is in A is not shared.
    less = F.when(F.col("own"), F.col("t") / 2).otherwise((F.col("g") - F.when(F.col("open"), F.col("g")).otherwise(F.greatest("g", "far")) - F.col("a") + F.col("t")) / 2)
    more = F.when(F.col("own"), F.col("t")).otherwise(F.col("t") - F.col("a"))
    posted = lambda name, length: placed.select("lead", "own", F.col("label").alias(f"{name}_label"), F.col("node").alias(name), F.col("open").alias(f"{name}_open"), F.col("g").alias(f"{name}_g"), F.col("a").alias(f"{name}_a"), F.col("n").alias(f"{name}_n"), (size - F.size("order")).alias(f"{name}_at"), F.posexplode(F.slice("order", F.lit(1), F.greatest(floor(length) + 1 - (size - F.size("order")), F.lit(0))))).withColumns({f"{name}_at": F.col(f"{name}_at") + F.col("pos"), "s": F.col("col.s")}).drop("pos", "col")
    x, y = posted("x", less), posted("y", more)
    t = q * (F.col("x_n") + F.col("y_n")) + 1e-9
    few = (F.col("x_a") + F.col("y_a") + F.abs(F.col("x_g") - F.col("y_g")) <= t) & (F.col("x_g") <= F.col("y_g"))
    own = (F.col("x_a") <= F.col("y_a")) & (F.col("y_a") - F.col("x_a") <= t)
    # Where a pair meets first, what is left of both must suffice for the overlap.
    own &= F.least(F.col("x_a") - F.col("x_at"), F.col("y_a") - F.col("y_at")) >= (F.col("x_a") + F.col("y_a") - t) / 2
    few &= F.least(F.col("x_g") - F.col("x_at"), F.col("y_g") - F.col("y_at")) >= (F.col("x_a") + F.col("y_a") + F.col("x_g") + F.col("y_g") - t) / 2
    ok = (F.col("x") != F.col("y")) & (F.col("x_open") | F.col("y_open")) & (F.least("x_n", "y_n") * 100 >= percent * F.greatest("x_n", "y_n")) & F.when(F.col("own"), own).otherwise(few)
    return apart(x, y, ["lead", "own", "s"], ok)


def apart(x: DataFrame, y: DataFrame, keys: list[str], ok) -> DataFrame:
    """Pairs (lead, node) of x and y that share the keys, with different labels.  A component that has most of a list is not
    joined with itself: its rows meet only those of other components."""
    labels = x.select(*keys, F.col("x_label").alias("label")).groupBy(*keys, "label").count()
    major = labels.groupBy(*keys).agg(F.max(F.struct("count", "label")).alias("top")).select(*keys, F.col("top.label").alias("major"))
    x, y = x.join(major, keys), y.join(major.withColumnRenamed("major", "y_major"), keys)
    other = (F.col("x_label") != F.col("y_label")) & ok
    first = x.where("x_label != major").join(y, keys).where(other)
    second = x.where("x_label = major").join(y.where("y_label != y_major"), keys).where(other)
    pair = (F.least("x", "y").alias("lead"), F.greatest("x", "y").alias("node"))
    return first.select(*pair).unionByName(second.select(*pair)).distinct()


def enough(shared, n_a, n_b, percent: int):
    """100 * intersection >= percent * union."""
    return 100 * shared >= percent * (n_a + n_b - shared)


def by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], fn) -> Iterator[pa.RecordBatch]:
    """The pairs that fn gives of each group of rows; rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    key = None

    def done() -> Iterator[pa.RecordBatch]:
        out = fn(pa.Table.from_batches(held)) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([y for _, y in out])], names=["a", "b"])

    for batch in batches:
        values = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
        at = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[at]:
                if values[at] != key:
                    yield from done()
                    held, key = [], values[at]
                held.append(batch.slice(at, i - at))
                at = i
    yield from done()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the edges (a, b), by alternating large and small stars."""
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # Large star: each node's greater neighbours go to its smallest neighbour, itself included.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = stored(small, "edges")
        # Done when each node has one edge at most and those that others point to have none: all are stars.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select("v").distinct().select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up > 0 and root > 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def prefixes(nodes: DataFrame, least: int) -> DataFrame:
    """(node, list, size, weight): the COORDINATES - least + 1 shortest lists of each node, without those of one node; nodes (node, sig).
    ``weight`` adds the sizes of all lists of the node."""
    posted = nodes.select("node", F.posexplode("sig").alias("j", "v")).select("node", (F.shiftleft(F.col("j").cast("long"), 32) + F.col("v").cast("long")).alias("list"))
    sizes = posted.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    held = posted.join(sizes, "list").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("size", "list"))).alias("lists"))
    # Lists of one node are the shortest: they fill the prefix first.
    room = F.greatest(F.lit(COORDINATES - least + 1) - (F.lit(COORDINATES) - F.size("lists")), F.lit(0))
    weight = F.aggregate("lists", F.lit(0).cast("long"), lambda x, y: x + y["size"])
    return held.select("node", weight.alias("weight"), F.inline_outer(F.slice("lists", F.lit(1), room))).where("list is not null")


def leaders(lists: DataFrame, nodes: DataFrame, percent: int, least: int, least_all: int) -> DataFrame:
    """(lead, node): each node with the most central of the leaders of its lists that its signature is close to.

    The node with the longest lists is most likely the one that its group was copied from; it leads them."""
    agree = matches("sig", "lead_sig")
    close = (agree >= least) & (agree + matches("more", "lead_more") >= least_all) & (F.least("n", "lead_n") * 100 >= percent * F.greatest("n", "lead_n"))
    leads = nodes.select(F.col("node").alias("lead"), F.col("sig").alias("lead_sig"), F.col("more").alias("lead_more"), F.col("n").alias("lead_n"))
    heads = lists.groupBy("list").agg(F.max(F.struct("weight", F.col("node"))).alias("top")).select("list", F.col("top.node").alias("lead"), "top.weight")
    first = lists.drop("weight").join(heads, "list").where("node != lead").groupBy("node", "lead").agg(F.max("weight").alias("weight"))
    first = first.join(nodes, "node").join(leads, "lead").where(close).withColumn("m", matches("sig", "lead_sig"))
    best = first.groupBy("node").agg(F.max(F.struct("weight", "m", F.col("lead"))).alias("top"))
    return best.select("node", F.col("top.lead").alias("lead"))


def recentred(tried: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The comparisons again, each family with an unlinked node led by the node that is nearest to what most of its nodes hold."""
    family = tried.groupBy("lead").agg(F.count("*").alias("size"), F.count_if(~F.col("linked")).alias("open")).where("open > 0 and size > 1").select("lead", "size")
    rows = tried.join(family, "lead").select("lead", "node", "size", F.size("gone").alias("g"), F.size("added").alias("a"), F.concat("gone", "added").alias("d"))
    # What most nodes have otherwise than the lead.
    turned = rows.select("lead", "size", F.explode("d").alias("s")).groupBy("lead", "s").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("2 * n > size")
    turned = turned.groupBy("lead").agg(F.collect_set("s").alias("turned"))
    far = rows.join(turned, "lead").select("lead", "node", (F.size("d") + F.size("turned") - 2 * F.size(F.array_intersect("d", "turned"))).alias("far"), F.size("turned").alias("own"))
    best = far.groupBy("lead").agg(F.min(F.struct("far", "node")).alias("top"), F.max("own").alias("own")).where("top.far < own").select("lead", F.col("top.node").alias("better"))
    moved = stored(best, "moved")
    members = tried.select("lead", "node").unionByName(moved.select("lead", F.col("lead").alias("node"))).join(moved, "lead").where("node != better")
    again = compared(members.select(F.col("better").alias("lead"), "node"), docs, percent)
    return tried.join(moved, "lead", "left_anti").unionByName(again)


def assign(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    known = stored(sketch(docs), "sketch")
    named = known.where("doc_id is not null and n_shingles > 0")
    same = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    # Nodes, and links between nodes of rows that share a doc_id or a set.
    members = stored(named.join(same, ["s1", "s2"]).select("doc_id", "node"), "members")
    nodes = stored(named.join(same, ["s1", "s2"]).where("doc_id = node").groupBy("s1", "s2").agg(F.first("node").alias("node"), F.first("sig").alias("sig"), F.first("more").alias("more"), F.first("n_shingles").alias("n")).drop("s1", "s2"), "nodes")
    least, least_all = least_of(COORDINATES, percent), least_of(COORDINATES + MORE, percent)
    lists = stored(prefixes(nodes, least), "lists")

    # Round 1.  Nodes that their lead does not link may have a lead among themselves: the next of several versions of a text.
    docs = texts_of(docs, lists)
    tried = stored(compared(leaders(lists, nodes, percent, least, least_all), docs, percent), "tried")
    links = tried.where("linked")
    last = tried = stored(recentred(tried, docs, percent), "tried")
    ups = last.where("linked")
    while True:
        n, linked = last.agg(F.count("*"), F.count_if("linked")).first()
        if linked * LESS <= n or (n - linked) * LESS <= n:
            break
        pool = lists.join(last.where("not linked").select("node"), "node", "left_semi")
        last = stored(compared(leaders(pool, nodes, percent, least, least_all), docs, percent), "tried")
        ups = ups.unionByName(last.where("linked"))
    links = links.unionByName(ups).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    links = stored(links.unionByName(members.where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))), "links")
    # Nodes of one label are in one component, though not all of a component have one label yet.
    ups = ups.groupBy("node").agg(F.min("lead").alias("label"))
    above = ups.select(F.col("node").alias("label"), F.col("label").alias("up"))
    labels = stored(ups.join(above, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
    # Round 2: what is still apart, inside families and across them.
    within = families(tried, labels, percent)
    family = tried.groupBy("node").agg(F.min("lead").alias("lead"))
    named = nodes.join(labels, "node", "left").join(family, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("lead", "node").alias("family"), "n", "sig", "more")
    across = cross_pairs(lists, stored(named, "named"), docs, percent, least, least_all)
    pairs = stored(within.unionByName(across).distinct(), "pairs")
    more = compared(pairs, docs, percent).where("linked").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    labels = components(links.unionByName(more))

    out = known.join(labels, known["doc_id"] == labels["node"], "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def mixed(posted: DataFrame) -> DataFrame:
    """The lists of posted (list, node, label, family) that hold nodes of different components and families: size, the family
    with most nodes (``major``) and its number of nodes (``n_major``)."""
    parts = posted.groupBy("list", "family").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    lists = parts.groupBy("list").agg(F.sum("n").alias("size"), F.max(F.struct("n", "family")).alias("top"), F.count("*").alias("families"), F.min("low").alias("low"), F.max("high").alias("high"))
    return lists.where("low != high and families > 1").select("list", "size", F.col("top.family").alias("major"), F.col("top.n").alias("n_major"))


def rare_shingles(named: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(list, node): each node under its rarest shingles, so many that two nodes of the wanted similarity share one of them.

    Two sets with J >= p share p * n shingles at least, so that they meet in the first n - p * n + 1 of both, in any one order; shingles of one node come first."""
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(named.select("node"), "node", "left_semi")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets_of(batch.column(1))], pa.list_(pa.int64()))], names=["node", "s"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sets = stored(map_batches(texts, cut, f"node {id_type}, s array<long>"), "sets")
    posted = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("list"))
    often = posted.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    held = posted.join(often, "list").groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("size", "list"))).alias("order"))
    length = F.floor(F.col("n") * (100 - percent) / 100 + 1e-9).cast("int") + 1 - (F.col("n") - F.size("order"))
    return held.select("node", F.inline(F.slice("order", F.lit(1), F.greatest(length, F.lit(0))))).select("node", F.col("list")).distinct()


def cross_pairs(lists: DataFrame, named: DataFrame, docs: DataFrame, percent: int, least: int, least_all: int) -> DataFrame:
    """Pairs (lead, node) that share a list, with different labels, of different families, with enough matches.

    Lists of up to SHORT nodes are compared within a task.  The nodes of longer ones, which a frequent
    passage makes, must share one of their rarest shingles too, and are compared under these."""
    posted = stored(lists.select("list", "node").join(named.select("node", "label", "family"), "node"), "posted")
    mix = stored(mixed(posted), "mixed")
    short = posted.join(mix.where(F.col("size") <= SHORT), "list").select(F.lit(0).alias("kind"), "list", "node", "family", "major", "size", "n_major")
    long_ = posted.join(mix.where(F.col("size") > SHORT).select("list"), "list", "left_semi").select("node").distinct()
    rare = stored(rare_shingles(long_, docs, percent).join(named.select("node", "label", "family"), "node"), "rare")
    rare = rare.join(mixed(rare), "list").select(F.lit(1).alias("kind"), "list", "node", "family", "major", "size", "n_major")
    return near_pairs(short.unionByName(rare), named, percent, least, least_all)


def near_pairs(posted: DataFrame, named: DataFrame, percent: int, least: int, least_all: int) -> DataFrame:
    """Pairs of one list with enough matches.  The nodes of a list's greatest family are not compared with each other; all else
    meets in groups of two blocks of about BLOCK nodes, which are compared within a task."""
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK).cast("int"), F.lit(1))
    dealt = posted.withColumns({"is_major": F.col("family") == F.col("major"), "w_major": blocks(F.col("n_major")), "w_minor": blocks(F.col("size") - F.col("n_major"))})
    dealt = dealt.withColumn("own", F.pmod(F.hash("node", "list"), F.when(F.col("is_major"), F.col("w_major")).otherwise(F.col("w_minor"))))
    # -1 and below stand for blocks of the greatest family, 0 and above for the others.
    across = F.sequence(F.lit(0), F.col("w_minor") - 1)
    partners = F.when(F.col("is_major"), across).otherwise(F.concat(across, F.transform(F.sequence(F.lit(1), F.col("w_major")), lambda x: -x)))
    met = dealt.withColumn("own", F.when(F.col("is_major"), -F.col("own") - 1).otherwise(F.col("own"))).withColumn("other", F.explode(partners))
    met = met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).select("kind", "list", "low", "high", "node", "own").join(named, "node")
    id_type = named.schema["node"].dataType.simpleString()

    def near(t: pa.Table) -> list[tuple]:
        node, label, family, own, n = (t.column(c).to_numpy() for c in ("node", "label", "family", "own", "n"))
        sig, more = (np.stack(t.column(c).to_numpy()) for c in ("sig", "more"))
        within = t.column("low")[0].as_py() == t.column("high")[0].as_py()
        out: list[tuple] = []
        for i in range(len(node) - 1):
            j = np.arange(i + 1, len(node))
            ok = (label[j] != label[i]) & (family[j] != family[i]) & (np.minimum(n[j], n[i]) * 100 >= percent * np.maximum(n[j], n[i]))
            # a node is compared with its lead already
            ok &= (family[j] != node[i]) & (family[i] != node[j])
            if not within:
                ok &= own[j] != own[i]
            j = j[ok]
            if len(j):
                agree = (sig[j] == sig[i]).sum(axis=1)
                j, agree = j[agree >= least], agree[agree >= least]
                j = j[agree + (more[j] == more[i]).sum(axis=1) >= least_all]
                out += [(min(node[i], x), max(node[i], x)) for x in node[j]]
        return out

    keys = ("kind", "list", "low", "high")
    rows = met.select(*keys, "node", "label", "family", "own", "n", "sig", "more").repartition(*keys).sortWithinPartitions(*keys)
    pairs = rows.mapInArrow(lambda batches: by_group(batches, keys, near), f"a {id_type}, b {id_type}").distinct()
    return pairs.select(F.col("a").alias("lead"), F.col("b").alias("node"))


def dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one document of each component, with all their columns.

    Rows of one doc_id are one document only if their texts are equal, and then one of them stays; of a component the smallest doc_id
    stays.  Rows with a null doc_id all stay."""
    name = fresh(docs, "key")
    keyed = docs.withColumn(name, text_key(docs["doc_id"], docs["text"]))
    kept = assign(keyed.select(F.col(name).alias("doc_id"), "text"), percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    named = keyed.where(F.col(name).isNotNull()).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))


def text_key(doc_id: Column, text: Column) -> Column:
    """A string for the rows of one id and text, which sorts whole numbers without a sign as such; null for a null id."""
    number = F.lpad(doc_id.try_cast("decimal(38,0)").cast("string"), 20, "0")
    plain = doc_id.cast("string")
    return F.concat(F.when(plain.rlike(r"^[0-9]{1,19}$"), number).otherwise(plain), F.lit(":"), F.hex(F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))))
