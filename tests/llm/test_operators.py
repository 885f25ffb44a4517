"""The corpus operators against brute force, libraries and held-out labels, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from temblor.llm import bpe, decontamination, exact_dedup, language_id, near_dedup, secret_scan, substring_dedup, token_counts, toxicity, warc
from temblor.llm.queries import ORACLES, QUERIES, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward():
    """Nulls, empty texts, repeats, ties, a very long text, copies and near copies."""
    rng = random.Random(3)
    base, shared = sentence(rng, 300), sentence(rng, 60)
    near = base.split(" ")
    near[150] = "changed"
    rows = [
        (1, base), (2, base), (3, base.replace(" ", "\n ", 5)), (4, " ".join(near)), (5, None), (6, ""), (7, " \t\n"), (None, base), (None, None), (9, "one"), (10, "One"), (11, "a b c d"),
        (12, sentence(rng, 40) + " " + shared + " " + sentence(rng, 40)), (13, shared + " " + sentence(rng, 30)), (14, sentence(rng, 20) + " " + shared), (15, "x " * 100), (16, sentence(rng, 30_000)),
        (17, "é漢字😀 " * 20), (18, "password = 'abcdefghijkl1' token:short AKIA" + "B" * 16 + " " + "0123456789abcdef" * 2), (18, "password = 'abcdefghijkl1' token:short AKIA" + "B" * 16 + " " + "0123456789abcdef" * 2),
        (19, "<|endoftext|> a<|endoftext|>"), (20, "w" * 5000), (21, "ſecret= abcdefghijklmnop token=password: abcdefghijklmn"),
    ]
    return [(i, t, "en", "s", 0) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names the operators use inside
    return spark.createDataFrame(awkward(), SCHEMA).withColumns({c: F.lit(1) for c in ("k1", "k2", "row", "size", "count", "label", "node", "gid", "rest", "score", "kept", "h")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, same_as_sql):
    same_as_sql(QUERIES[name](spark, SF), ORACLES[name])


def test_exact_dedup(docs, none):
    got = exact_dedup.assign(docs).collect()
    assert len(got) == len(awkward())
    groups = defaultdict(list)
    for i, t, *_ in awkward():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    by_text = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        g = by_text[r.text_sha256]
        assert r.group_size == len(g)
        assert r.keep_id == min(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(by_text) and set(kept.values()) == {1}
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns and out.count() == len(by_text)
    assert exact_dedup.assign(none).count() == 0


def brute_substring(rows):
    cut = [WORD.findall(t or "") for _, t, *_ in rows]
    n = Counter(tuple(w[i : i + 35]) for w in cut for i in range(len(w) - 34))
    for (i, *_), w in zip(rows, cut, strict=True):
        gone = set()
        for k in range(len(w) - 34):
            if n[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("shard", [1000, 2])
def test_substring_dedup(docs, none, shard, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    got = substring_dedup.remove(docs)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_substring(awkward()), key=key)
    assert substring_dedup.remove(none).count() == 0


def test_automaton_counts():
    rng = random.Random(1)
    texts = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(3, 30))] for _ in range(20)]
    a = substring_dedup.Automaton()
    for t in texts:
        a.add(t, 2)
    a.close()
    n = Counter(tuple(t[i : i + 4]) for t in texts for i in range(len(t) - 3))
    for t in texts:
        assert a.occurrences(t, 4) == [2 * n[tuple(t[i : i + 4])] for i in range(len(t) - 3)]


def brute_near(rows, percent):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_dedup(docs, none):
    got = near_dedup.assign(docs, 85).collect()
    assert len(got) == len(awkward())
    want = brute_near(awkward(), 85)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept for r in got if r.doc_id is None)
    out = near_dedup.dedup(docs, 85)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(i for i, c in want.items() if i == c)
    assert near_dedup.assign(none).count() == 0


def test_near_dedup_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in QUERIES["op5_near_dedup"](spark, SF).collect()}
    assert got == brute_near(rows, 85)


def test_near_dedup_blocks(spark, monkeypatch):
    """A chain of near copies longer than a block: all pairs of one list, some linked only through others."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(9)
    words, rows = sentence(rng, 120).split(" "), []
    for i in range(60):
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((i, " ".join(words), "en", "s", 0))
    got = {r.doc_id: r.component_id for r in near_dedup.assign(spark.createDataFrame(rows, SCHEMA), 85).collect()}
    assert got == brute_near(rows, 85)


def edited(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = "".join(rng.choice("klmnopqrst") for _ in range(6))
    return out


def test_near_dedup_of_large_families(spark):
    """Two versions of a text with hundreds of edited and cut copies each, most of them too far from their source, and copies of copies."""
    rng = random.Random(12)
    first = sentence(rng, 110).split(" ")
    second = edited(rng, first, 4)
    texts = []
    for source in (first, second):
        for _ in range(220):
            one = edited(rng, source, rng.randint(1, 7))
            texts += [one, edited(rng, one, 1)] if rng.random() < 0.2 else [one]
        texts += [source[: rng.randint(60, 109)] for _ in range(40)] + [source[rng.randint(1, 30) :] for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in near_dedup.assign(spark.createDataFrame(rows, SCHEMA).repartition(4), 85).collect()}
    assert got == brute_near(rows, 85)


def test_near_dedup_keeps_texts_that_share_an_id(spark):
    rng = random.Random(13)
    a, b, c = (sentence(rng, 50) for _ in range(3))
    rows = [(7, a), (7, b), (7, a), (8, c), (9, c + " end"), (None, a), (10, None), (11, "")]
    out = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("__key", F.lit(1)))
    assert out.columns == ["doc_id", "text", "__key"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(7, a), (7, b), (8, c), (None, a), (10, None), (11, "")])


def test_ids_of_text_and_clashing_names(spark):
    rng = random.Random(14)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [("x1", a), ("x2", a), ("12", b), (None, b), (None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(c) for c in ("__k1", "__k2", "__key", "__score", "__lang", "score", "lang_pred", "lang")})
    items = spark.createDataFrame([(1, b)], "item_id long, text string")
    assert Counter(r.doc_id for r in exact_dedup.dedup(df).collect()) == Counter(["x1", "12", None])
    assert Counter(r.doc_id for r in near_dedup.dedup(df).collect()) == Counter(["x1", "12", None, None])
    assert Counter(r.doc_id for r in decontamination.clean(df, items).collect()) == Counter(["x1", "x2", None])
    assert {r.doc_id: r.component_id for r in near_dedup.assign(df).collect()} == {"x1": "x1", "x2": "x1", "12": "12", None: None}
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove(df).where("doc_id is not null").collect()} == {"x1": 60, "x2": 60, "12": 60}
    assert secret_scan.scan(df).count() == 5
    for out in (exact_dedup.dedup(df), near_dedup.dedup(df), decontamination.clean(df, items)):
        assert out.columns == df.columns and {r["__k1"] for r in out.collect()} == {"__k1"}


def plain_shares(texts, langs, share=0.35, sizes=(2, 3, 4)):
    """Rates of n-grams by exact sets: (typical n-grams of each language, n-grams of a text)."""

    def grams(text):
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
        out = []
        for n in sizes:
            for i in range(len(b) - n + 1):
                g = b[i : i + n]
                if 32 not in g[1:-1] and not (g[0] == 32 == g[-1]):
                    out.append((n, g))
        return out

    counts = defaultdict(Counter)
    for t, lang in zip(texts, langs, strict=True):
        counts[lang].update(grams(t))
    rate = {k: {g: n / total for g, n in c.items() if n >= 3} for k, c in counts.items() if (total := sum(n for n in c.values() if n >= 3))}
    best = Counter()
    for r in rate.values():
        for g, x in r.items():
            best[g] = max(best[g], x)
    return {k: {g for g, x in r.items() if x >= share * best[g]} for k, r in rate.items()}, grams


def test_language_id_by_exact_sets(spark):
    """The Bloom filters' decisions against exact sets of n-grams, on all documents."""
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    import zlib

    learned = [r for r in rows if r.text and r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    typical, grams = plain_shares([r.text for r in learned], [r.lang for r in learned])
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op2_language_id"](spark, SF).collect()}
    close = same = n = 0
    for r in rows:
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        g = grams(r.text)
        share = {k: sum(x in s for x in g) / max(1, len(g)) for k, s in typical.items()}
        n += 1
        same += max(sorted(share), key=share.get) == got[r.doc_id][0]
        close += abs(max(share.values()) - got[r.doc_id][1]) < 0.05
    assert same >= 0.99 * n and close >= 0.95 * n


def test_language_id(spark, docs, none):
    got = QUERIES["op2_language_id"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    f = language_id.fit(docs)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, f).collect()}
    assert pred[6] == pred[5] == ("und", 0.0) and pred[1][0] == "en" and all(0 <= s <= 1 for _, s in pred.values())
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(none)).collect()} == {"und"}
    assert language_id.predict(none, f).count() == 0


def test_language_id_of_many_languages(spark):
    """Each of 70 languages is learned, also if its words stand only behind a long head without letters."""
    rng = random.Random(8)
    vocabulary = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for k in range(70)}
    text = lambda k: "1 " * 2500 * (k == "l69") + " ".join(rng.choices(vocabulary[k], k=60))
    rows = [(i, text(k), k, "s", 0) for i, k in enumerate(sorted(vocabulary) * 4)]
    f = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    assert f.langs == tuple(sorted(vocabulary))
    new = spark.createDataFrame([(i, text(k), k, "s", 0) for i, k in enumerate(sorted(vocabulary))], SCHEMA)
    assert all(r.lang_pred == r.lang for r in language_id.predict(new, f, keep=["lang"]).collect())


def test_toxicity(spark, none):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 30) + (" vile" if i % 3 == 0 else "") + " " + sentence(rng, 30), int(i % 3 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    m = toxicity.fit(df.where("doc_id < 600"))
    got = toxicity.predict(df.where("doc_id >= 600"), m).join(df, "doc_id").collect()
    assert sum((r.score >= 0.5) == bool(r.label) for r in got) >= 0.97 * len(got)
    edge = {r.doc_id: r.score for r in toxicity.predict(spark.createDataFrame(awkward(), SCHEMA), m).collect()}
    assert edge[5] == edge[6] and all(0 <= s <= 1 for s in edge.values())
    empty = toxicity.fit(none.withColumn("label", F.lit(1)))
    assert {r.score for r in toxicity.predict(df.limit(3), empty).collect()} == {0.5}
    assert toxicity.predict(none, m).count() == 0


def test_toxicity_by_a_plain_loop(spark):
    """One task, one round: the weights are those of FTRL-proximal written row by row."""
    import math

    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(12)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=3)), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    m = toxicity.fit(df, rounds=1, shards=1, dims=1 << 21)
    order = [r.doc_id for r in df.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).collect()]
    import numpy as np

    x = {}
    for i, text, _ in rows:
        b = np.frombuffer(text.encode(), np.uint8)
        x[i] = sorted(set(toxicity.features(b, np.array([0, len(b)]), 1 << 21)[0].tolist()))
    often = Counter(k for xs in x.values() for k in xs)
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda k: 0.0 if k >= 0 and abs(z[k]) <= 2.0 else -(z[k] - (math.copysign(2.0, z[k]) if k >= 0 else 0)) / ((1 + math.sqrt(n[k])) / 0.5 + 0.1)
    for i in order:
        at = [k for k in x[i] if often[k] >= 4] + [-1]  # -1: the bias, without L1
        w = {k: weight(k) for k in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - rows[i][2]
        for k in at:
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.5 * w[k]
            n[k] += g * g
    got = dict(zip(m.index.tolist(), m.weights.tolist(), strict=True))
    want = {(1 << 21) if k < 0 else k: weight(k) for k in z}
    assert all(abs(got.get(k, 0.0) - v) < 1e-4 for k, v in want.items()) and set(got) <= set(want)


def test_toxicity_held_out(spark):
    """Quality of the query on labels it has not seen, rows with null labels and texts left out."""
    got = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic is not null"), "doc_id").select("score", "toxic").collect()
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc >= 0.9


def fuzz():
    rng = random.Random(5)
    alphabet = "abc  \n\t'’éèÅ①ﬁ漢字😀\x00\x1c\x85 　▁<|endoftext|>s0123 ½²,.;—AKIA_"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["<|endoftext|>a<|endoftext|>", "it's we'll 've", "a" * 5000, " " * 300 + "x", "=" * 500, "<s></s><unk><0x0A>"]


@pytest.fixture(scope="module")
def texts(spark):
    return fuzz() + [t for _, t, *_ in awkward() if t] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_bpe_is_the_library(spark, texts, docs, none):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    codec = bpe.codec(path)
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want))
        assert codec.decode(ids) == lib.decode(want, skip_special_tokens=False)
    rng = random.Random(9)  # any ids, which need not end at borders of characters
    for _ in range(300):
        some = [rng.randrange(lib.get_vocab_size()) for _ in range(rng.randint(0, 9))]
        assert codec.decode(",".join(map(str, some))) == lib.decode(some, skip_special_tokens=False)
    rows = bpe.encode(docs, path).collect()
    assert len(rows) == len(awkward()) and all(r.decoded == "" and r.ids == [] for r in rows if r.doc_id in (5, 6))
    assert bpe.encode_digests(none, path).count() == 0
    back = bpe.decode(bpe.encode(docs, path).select("doc_id", "ids"), path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t, *_ in awkward())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_queries_on_whole_documents(spark):
    """The columns of op3, op7, op8 and op9 on all documents, by brute force and the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in rows}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op7_bpe"](spark, SF).collect()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(lib.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op9_token_counts"](spark, SF).collect()}
    assert got == {i: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in rows}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op3_substring_dedup"](spark, SF).collect()}
    assert got == {i: (n, gone, sha(kept)) for i, n, gone, kept in brute_substring(rows)}
    want = {}
    for i, t in rows:
        found = secret_scan.brute_force(t)
        base = [x for x in found if secret_scan.RULES[x[1]].base]
        label = lambda xs: ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in xs)
        want[i] = (*(sum(k == j for _, k, _ in base) for j in range(3)), sha(label(base)), label(found))
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in QUERIES["op8_secret_scan"](spark, SF).collect()} == want


def test_bpe_forgets_without_harm(texts):
    path = tokenizer("byte_bpe_50k.json")
    whole = bpe.codec(path).encode(texts)
    small = bpe.codec.__wrapped__(path)
    old, bpe.CACHE_WORDS = bpe.CACHE_WORDS, 50
    try:
        assert [small.encode([t])[0] for t in texts] == whole
    finally:
        bpe.CACHE_WORDS = old


def test_token_counts_are_the_library(spark, texts, docs, none):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    m = token_counts.merger(path)
    assert [m.count(t) for t in texts] == [len(x) for x in sp.encode(texts, num_threads=1)]
    assert [token_counts.Merger(m.ranks, most=20).count(t) for t in texts[:200]] == [m.count(t) for t in texts[:200]]
    rows = token_counts.count_tokens(docs, path, limit=100).collect()
    assert all(r.n_tokens == r.n_bytes == 0 for r in rows if r.doc_id in (5, 6)) and {r.over_limit for r in rows} == {True, False}
    assert token_counts.count_tokens(none, path).count() == 0


def spans(text):
    return ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in secret_scan.brute_force(text))


def test_secret_scan(spark, docs, none, monkeypatch):
    extra = ["ghp_" + "a1" * 20, "xoxb-1234567890ab", "-----BEGIN RSA PRIVATE KEY-----", "API_KEY\" : 'QWERTYUIOPAS'", "secret==" + "x" * 12, "token=password: abcdefghijklmn", "Apikey:abcdefghijklmnop Apikey:abcdefghijklmnop", "ééé token=abcdefghijkl😀", "passwd=" * 30]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    for few in (500_000, 0):  # candidates by broadcast and by shuffle
        monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", few)
        got = Counter((r.doc_id, r.spans) for r in secret_scan.scan(df).collect())
        assert got == Counter((r.doc_id, spans(r.text)) for r in df.collect())
    assert secret_scan.scan(none).count() == 0


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("[0-9a-f]+") is None and q("ab|cde") is None
    assert q("abcd") == [frozenset({"abc", "bcd"})]
    assert set(q("(?i:TOKEN|key_)x*")) == {frozenset({"tok", "oke", "ken"}), frozenset({"key", "ey_"})}
    for rule in secret_scan.RULES:  # what matches satisfies the rule's query
        clauses = q(rule.pattern)
        for text in ("my Password: abcdefghijkl", "api_key=abc", "AKIA" + "A" * 20, "-----BEGIN EC PRIVATE KEY-----", "xoxp-aaaaaaaaaaaa", "rk_live_" + "a" * 20):
            if clauses is not None and re.search(rule.pattern, text):
                assert any(all(t in text.lower() for t in c) for c in clauses)


def test_decontamination(spark, docs, none):
    rng = random.Random(4)
    item, other = sentence(rng, 40), sentence(rng, 40)
    changed = item.split(" ")
    changed[0] = "zzz"
    half = item.split(" ")[:20]
    items = spark.createDataFrame([(1, item), (2, other), (3, "Quite short"), (4, None), (5, item), (6, " .")], "item_id long, text string")
    rows = [(200, sentence(rng, 5000) + " " + item.upper().replace(" ", ", ", 3) + " " + sentence(rng, 5000)), (201, " ".join(changed)), (202, " ".join(half)), (203, sentence(rng, 100)), (204, "that is quite, short indeed"), (205, "quite a short one")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, items).collect()}
    assert got == {(200, 1), (200, 5), (201, 1), (201, 5), (204, 3)}
    kept = decontamination.clean(df, items)
    assert kept.count() == df.count() - 3 and kept.columns == df.columns
    assert decontamination.find_leaks(none, items).count() == 0 and decontamination.find_leaks(df, items.limit(0)).count() == 0


def test_decontamination_of_repeated_items(spark):
    """Rows of one item_id are one item: equal rows count once, different ones together."""
    rng = random.Random(6)
    item, a, b = sentence(rng, 40), sentence(rng, 40), sentence(rng, 40)
    items = spark.createDataFrame([(1, item), (1, item), (2, a), (2, b)], "item_id long, text string")
    half = " ".join(item.split(" ")[:22])
    df = spark.createDataFrame([(1, half), (2, item), (3, a), (4, a + " | " + b)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.find_leaks(df, items).collect()}
    assert got == {(2, 1, 36, 36), (4, 2, 72, 72)}
    assert sorted(r.doc_id for r in decontamination.clean(df, items).collect()) == [1, 3]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<html lang='en'><title>T &amp; U</title><p>One<br>two<script>x</script></p><a href='/b'>b</a>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("record_id", F.lit("x"))
    r = warc.derive(warc.responses(pages), keep=("page_id",))
    got = [x for x in r.collect() if x.page_id == 1]
    text = next(x for x in got if x.warc_type == "conversion")
    about = next(x for x in got if x.warc_type == "metadata")
    assert text.block == "One\ntwo\nb" and "title: T & U\r\nlang: en\r\nlinks: 1\r\n" in about.block and "http-header-Content-Type: text/html" in about.block
    assert about.refers_to == text.refers_to and about.concurrent_to == text.record_id and r.count() == 6
    warc.write(r, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w") + "/part-*").collect()
    assert sorted((x.headers["warc-record-id"], x.block) for x in back) == sorted((x.record_id, x.block) for x in r.collect())
    assert {x.headers["warc-refers-to"] for x in back} == {x.refers_to for x in r.collect()}
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_language_id_of_thin_languages(spark):
    """A language of one row is learned, and every text with a letter gets a learned language."""
    one = "Der schnelle braune Fuchs springt über den faulen Hund und läuft weg"
    rows = [(i, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 0) for i in range(20)] + [(30, one, "de", "s", 0), (31, "быстрая лиса прыгает", "ru", "s", 0), (32, "12 34", "zz", "s", 0)]
    f = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    assert f.langs == ("de", "en", "ru", "zz")
    new = spark.createDataFrame([(1, "der faule Hund"), (2, "лиса"), (3, "the lazy dog"), (4, "漢字"), (5, "12"), (6, None)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(new, f).collect()}
    assert (got[1], got[2], got[3], got[5], got[6]) == ("de", "ru", "en", "und", "und") and got[4] in f.langs
    two = language_id.fit(spark.createDataFrame(rows[19:21], SCHEMA))
    assert {r.doc_id: r.lang_pred for r in language_id.predict(new, two).collect()}[1] == "de"


def test_decontamination_of_items_without_an_id(spark):
    rng = random.Random(8)
    a, b = sentence(rng, 40), sentence(rng, 40)
    items = spark.createDataFrame([(None, a), (None, b), (None, b), (3, sentence(rng, 20)), (None, None)], "item_id long, text string")
    df = spark.createDataFrame([(1, a), (2, "x " + b), (2, "x " + b), (4, sentence(rng, 90)), (None, a + " " + b)], "doc_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_item) for r in decontamination.find_leaks(df, items).collect())
    assert got == {(1, None, 36): 1, (2, None, 36): 2, (None, None, 36): 2}
    assert [r.doc_id for r in decontamination.clean(df, items).collect()] == [4]


def test_exact_dedup_of_a_hot_first_digit(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALTED", 3)
    monkeypatch.setattr(exact_dedup, "HOT", 10)
    head = "head " * 30
    rows = [(i, head + str(i % 7)) for i in range(60)] + [(100 + i, "") for i in range(30)] + [(200 + i, f"own {i}") for i in range(20)] + [(5, head + "5")] * 4
    got = exact_dedup.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    key = lambda t: re.sub(r"\s", "", t)
    by = {sha(key(t)): v for t, v in groups.items()}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all((r.keep_id, r.group_size) == (min(by[r.text_sha256]), len(by[r.text_sha256])) for r in got) and sum(r.kept for r in got) == len(groups)
