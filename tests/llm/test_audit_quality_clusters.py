"""Quality, the filter audit and centroids: against plain loops, exact integers and held-out labels, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from temblor.llm import centroids, filter_audit, quality
from temblor.llm.queries import QUERIES
from temblor.llm.textkernel import Words, utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \t\n", "one", "Éé 😀 漢字", "A" * 9, "x " * 400, "w" * 5000, "# " * 250, "a b c", " ".join(f"word{i}" for i in range(300)), "Same Same\nsame", "ends in blank \x0b", "y" * 8 + " " + "y" * 9 + " " + "y" * 8, "long " * 90_000]


def audit_of(rows, labels):
    """By definition, order by order."""

    def fails(i, text):
        words = WORD.findall(text)
        earlier = any(t == text and j is not None and i is not None and j < i for j, t, _ in rows)
        return (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), earlier)

    rows = [(i, t or "", s or "") for i, t, s in rows]
    judged = [(s, fails(i, t), *labels.get(i, (0, 0))) for i, t, s in rows]
    out = {}
    for part in {s for _, _, s in rows}:
        mine = [x for x in judged if x[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                k = "ABCDE".index(f)
                gone, kept = [x for x in left if x[1][k]], [x for x in left if not x[1][k]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = (len(kept), len(gone), sum(x[1][k] for x in mine) - len(gone), sum(x[1][k] and sum(x[1]) == 1 for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone))
                left = kept
        out |= {key: (*v, shapley[key[1][key[2] - 1]]) for key, v in out.items() if key[0] == part}
    return out


def test_filter_audit_by_definition(spark):
    rng = random.Random(2)
    pick = lambda: " ".join(rng.choice(["the", "of", "Cap", "big", "red", f"w{rng.randrange(900)}"]) for _ in range(rng.choice((20, 199, 200, 260))))
    rows = [(i, t, "s1") for i, t in enumerate(TEXTS)] + [(100 + i, pick(), rng.choice(("s1", "s2", None, ""))) for i in range(60)]
    rows += [(3, "one", "s2"), (3, "one", "s2"), (200, "one", "s1"), (None, "one", "s2"), (None, None, "s2"), *((300 + i, rows[20][1], "s2") for i in range(40))]
    labels = {i: (rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 340, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("mask", "n", "digest", "part", "first", "quality", "apart")}).repartition(5)
    marks = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()] + [(0, None, None), (None, 1, 1), (2, *labels[2])], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(docs, marks).collect()}
    assert got == audit_of(rows, labels) and len(got) == 3 * 600
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_distinct_words_are_verified():
    column = pa.array(TEXTS)
    words = Words(*utf8(column))
    want = [len(set(WORD.findall(t or ""))) for t in TEXTS]
    assert filter_audit.distinct_words(words, utf8(column)[0]).tolist() == want
    words.hash = words.hash & np.uint64(3)  # nearly all words share a hash with another
    assert filter_audit.distinct_words(words, utf8(column)[0]).tolist() == want
    small = filter_audit.byte_counts(*utf8(column), block=7)
    assert (small == filter_audit.byte_counts(*utf8(column))).all()
    assert small[0].tolist() == [len(t or "") for t in TEXTS] and small[1].tolist() == [len(re.findall("[A-Z]", t or "")) for t in TEXTS]


def lloyd(vectors, k, rounds, scale=64):
    """vec_id -> the row of the result; Python integers throughout."""
    kept = [(i, tuple(max(-(2**27), min(2**27, int(np.floor(scale * float(x))))) for x in v)) for i, v in vectors if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    cs = [c for _, c in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(near(v)[1], []).append(v)
        cs = [tuple(sum(x) // len(mine[n]) for x in zip(*mine[n], strict=True)) if n in mine else c for n, c in enumerate(cs)]
    found = [(i, *near(v)) for i, v in kept]
    own = Counter()
    for _, d, n in found:
        own[n] += d
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, n, d, fits(own[n]), fits(sum(own.values())), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, d, n in found), key=str)


@pytest.mark.parametrize("wide", [False, True])
def test_centroids_by_exact_integers(spark, wide):
    rng = random.Random(5)
    size = 1e6 if wide else 0.6
    rows = [(i, [rng.choice((0.0, 0.25, 0.5, -0.5, rng.uniform(-size, size))) for _ in range(4)]) for i in range(400)]
    rows += [(500 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(30)] + [(600, [0.1] * 3), (601, None), (602, [0.1, None, 0.2, 0.3]), (603, [float("nan"), 0.0, 0.0, 0.0]), (604, [float("inf")] * 4), (605, []), (7, [0.0] * 4), (7, [0.0] * 4), (None, [0.125] * 4), (606, [3e38 if wide else 0.3] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("c", "h", "x", "cluster", "n")}).repartition(4)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(map(tuple, centroids.cluster(df, k=6, dims=4).collect()), key=str)
    assert got == lloyd(rows, 6, 3)
    few = df.where("vec_id < 3")
    assert sorted(map(tuple, centroids.cluster(few, k=6, dims=4).collect()), key=str) == lloyd([x for x in rows if x[0] is not None and x[0] < 3], 6, 3)
    assert centroids.cluster(df.limit(0), dims=4).collect() == [] and centroids.cluster(df, dims=9).count() == 0


def test_intervals_hold_the_exact_ranks():
    rng = np.random.default_rng(3)
    for most in (40, 1 << 12, 1 << 27):
        v, c = rng.integers(-most, most + 1, (300, 64)), rng.integers(-most, most + 1, (16, 64))
        v[:16], c[1] = c, c[0]  # distances of nought, and a tie
        near = centroids.Nearest(c)
        low, high = near.bounds(v)
        exact = [[sum(int(x) ** 2 for x in b) - 2 * sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in c] for a in v]
        assert all(low[i, j] <= exact[i][j] <= high[i, j] for i in range(300) for j in range(16))
        assert near(v)[0].tolist() == [min(range(16), key=lambda j: (e[j], j)) for e in exact]


def features_of(text):
    """The shapes of a text's passages, word by word."""
    words = WORD.findall(text)
    out = []
    for at in range(0, max(len(words), 1), quality.WIDTH):
        w = words[at : at + quality.WIDTH]
        n = max(len(w), 1)
        size = [min(len(x.encode()), 40) for x in w]
        out.append((len(w) / quality.WIDTH, sum(size) / n / 10, sum(len(x.encode()) == 1 for x in w) / n, sum("A" <= x[0] <= "Z" for x in w) / n, sum(x[-1] in ".,;:!?#$%&*|@~^+=<>/\\_\"'()[]{}-" for x in w) / n, 1 - len(set(w)) / n if w else 0, sum(x in words[: at + i] for i, x in enumerate(w)) / n, sum(at + i > 0 and x == words[at + i - 1] for i, x in enumerate(w)) / n))
    return out


def test_passages_are_encoded_whole():
    texts = [t for t in TEXTS if t is None or len(t) < 10_000] + [" ".join(random.Random(1).choice(("Aa.", "b", "c!", "dd", "É")) for _ in range(500))]
    x, first = quality.passages(pa.array(texts))
    assert x.shape[1] == quality.SIZE and first[-1] == len(x)
    for i, t in enumerate(texts):
        want = features_of(t or "")
        assert np.allclose(x[first[i] : first[i + 1], quality.KINDS : quality.KINDS + 8], want, atol=1e-6)
    alone = np.concatenate([quality.passages(pa.array([t]))[0] for t in texts])
    assert np.array_equal(alone, x)


def test_quality_gradient():
    """Against differences of the loss."""
    m = {k: v.astype(np.float64) for k, v in quality.start(3).items()}
    x, first = quality.passages(pa.array([t for t in TEXTS if t is None or len(t) < 10_000]))
    x, y = x.astype(np.float64), np.arange(len(first) - 1) % 2

    def loss():
        p = quality.forward(m, x, first)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = quality.gradient(m, x, first, y)
    for k, g in found.items():
        for at in range(0, m[k].size, max(1, m[k].size // 5)):
            flat = m[k].reshape(-1)
            was = flat[at]
            flat[at] = was + 1e-5
            up = loss()
            flat[at] = was - 1e-5
            down = loss()
            flat[at] = was
            assert abs((up - down) / 2e-5 - g.reshape(-1)[at]) < 1e-6, k


def test_quality_of_unseen_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_quality"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    seen = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in seen)
    good, bad = [r.score for r in seen if r.quality], [r.score for r in seen if not r.quality]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) >= 0.85
    assert sum(r.predicted == r.quality for r in seen) / len(seen) >= 0.92


def test_quality_on_awkward_tables(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "x"), (3, "one")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "h", "y", "x", "shard", "n")})
    labelled = docs.withColumn("label", F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 2).cast("int")))
    model = quality.fit(labelled, rounds=1)
    rows = quality.predict(docs, model).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[0] == by[1]
    for m in (quality.fit(labelled.limit(0)), quality.fit(labelled.withColumn("label", F.lit(None).cast("int")))):
        assert {r.score for r in quality.predict(docs, m).collect()} == {0.5}
    assert quality.predict(docs.limit(0), model).count() == 0
    again = quality.fit(labelled.repartition(7), rounds=1)
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)
